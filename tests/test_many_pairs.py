"""Many questions against many points: blocks and shares, odd vectors, and what an answer computes."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import strip
from lodestone.operators import generate, search


@pytest.mark.parametrize("metric", ["Cosine", "Dot", "Euclid", "Manhattan"])
def test_blocks_and_shares_give_what_a_broadcast_gives(spark, monkeypatch, metric):
    """Ties, zero vectors and vectors of other lengths included."""
    rng = np.random.default_rng(7)
    values = rng.integers(-1, 2, (900, 3)).astype(float)
    rows = [(f"p{i:04d}", v.tolist() if i % 50 else [1.0, 2.0]) for i, v in enumerate(values)]
    points = spark.createDataFrame(rows, "vec_id string, embedding array<double>").repartition(5)
    queries = points.where("vec_id < 'p0060'").selectExpr("vec_id AS query_id", "embedding")
    want = sorted(map(tuple, search.search_many(points, queries, 4, metric).collect()))
    for name, value in (("QUERY_BLOCK", 7), ("POINT_FILE", 40)):
        monkeypatch.setattr(search, name, value, raising=False)
    found = search.search_many(points, queries, 4, metric)
    assert sorted(map(tuple, found.collect())) == want


def test_single_precision_never_decides():
    """Scores closer than single precision can tell, and components that it can't hold."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=16)
    near = base + rng.normal(size=(500, 16)) * 1e-5
    for metric, scale in (("COSINE", 1.0), ("DOT", 1.0), ("DOT", 1e30), ("COSINE", 1e-30), ("COSINE", 1e120)):
        v = near * scale
        v[::90] = 0
        q = np.concatenate([near[:20] * scale, np.zeros((2, 16))])
        held = search._Held(pa.array(range(22)), q, metric, -1.0, 5)
        for start in range(0, 500, 60):
            held.meet(pa.array(range(start, min(start + 60, 500))), v[start : start + 60])
        got = {x for b in held.best() for x in zip(*(c.to_pylist() for c in b.columns), strict=True)}
        score = np.round(search._scores(metric, q, v), 6)
        row, best = search._first(-score, np.arange(500), 5)
        if scale == 1e30:  # rounding of sums as large as these depends on their order
            assert {(i, j) for i, j, _ in got} == set(zip(row.tolist(), best.tolist(), strict=True))
        else:
            assert got == set(zip(row.tolist(), best.tolist(), score[row, best].tolist(), strict=True))


def test_points_that_are_not_finite_hide_no_others():
    v = np.eye(8)
    v[3, 3] = np.nan
    v[5, 5] = np.inf
    held = search._Held(pa.array([0, 1]), np.array([[1.0] * 8, [0.0, 1.0] + [0.0] * 6]), "COSINE", -1.0, 2)
    held.meet(pa.array(range(8)), v)
    got = [x for b in held.best() for x in zip(*(c.to_pylist() for c in b.columns), strict=True) if x[2] == x[2]]
    assert (1, 1, 1.0) in got and {(0, 0), (0, 1)} <= {x[:2] for x in got}


def test_an_answer_looks_for_words_once_a_sentence_and_once_a_question(spark):
    hits = F.array(F.struct(F.col("text"), F.lit("s").alias("source")))
    plan = spark.createDataFrame([("a b", "c. b a!")], "question string, text string").select(generate.Extractive().answer(F.col("question"), hits).alias("said"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract_all") == 2
    assert plan.first().said == "b a! (Source: s)"


def test_sentences_lose_what_strip_takes_off(spark):
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and c)
    white = spark.createDataFrame([(c,) for c in every if c.isspace() or c in "\u180e\u200b\ufeff"], "c string")
    assert white.where(strip("c") != F.btrim("c", F.lit(generate.WHITE))).count() == 0
