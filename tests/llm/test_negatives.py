from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import negatives


def brute(rows, positives=5, k=10):
    ok = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if None not in (i, label) and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in {i for i, *_ in ok if i % 100 == 0}:
        v, label = min((w, l) for i, l, w in ok if i == a)
        others = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, l == label) for i, l, w in ok if i != a and len(w) == len(v))
        for s, p, _ in [t for t in others if t[2]][:positives]:
            fit = [(n, i) for n, i, same in others if not same and 30 * -s <= 100 * -n <= 90 * -s][:k]
            out += [(a, p, r, i, -s, -n) for r, (n, i) in enumerate(fit, 1)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, label, v, 1, 2.0) for i, label, v in rows], "vec_id long, label int, embedding array<double>, block int, norm double")
    return sorted(tuple(r) for r in negatives.mine(negatives.labelled(df, F.col("label")), F.col("vec_id") % 100 == 0).collect())


def test_query_and_sql(spark, sf):
    got = negatives.op11_hard_negatives(spark, sf)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and dict(got.dtypes)["rank"] == "int"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({negatives.SQL})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(want) and len(rows) > 100


def test_norms_ties_copies_and_small_blocks(spark, monkeypatch):
    for name, value in (("ANCHOR_BLOCK", 3), ("CANDIDATE_BLOCK", 60), ("MIN_BLOCKS", 3), ("BUCKET", 16), ("STEP", 2)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(5)
    rows = [(int(i * 10), int(rng.integers(3)), (rng.normal(size=6) * 10.0 ** rng.integers(-2, 2)).tolist()) for i in range(200)]
    rows += [(int(5 + i * 10), int(i % 2), rows[0][2]) for i in range(100)]  # a third are copies of one vector
    rows += [(20_000 + i, 1, [float(i % 4), 0.0, 0.0, 0.0, 0.0, 1.0]) for i in range(0, 40, 3)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(0, 1, None), (100, None, [1.0]), (None, 1, [1.0]), (200, 1, [1.0, None]), (300, 2, [math.nan]), (400, 1, [math.inf]), (500, 1, [])],
        [(0, 1, [1.0, 2.0]), (0, 1, [1.0, 1.0]), (1, 1, [2.0, 2.0]), (1, 1, [2.0, 2.0]), (2, 0, [1.0, 0.5]), (2, 0, [1.0, 0.5]), (3, 0, [1.0])],
        [(0, 1, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 0, [-0.5, 0.0]), (3, 1, [0.0, 5.0]), (4, 0, [0.0, 3.0])],  # negative and zero scores
        [(0, 1, [1e5, 3.0]), (1, 1, [9e4, -1.0]), (2, 0, [5e4, 7.0]), (3, 0, [5e4, 6.5])],  # beyond doubles
    ],
)
def test_cases(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_a_score_beyond_a_long_is_an_error(spark):
    with pytest.raises(Exception, match="too large|overflow"):
        run(spark, [(0, 1, [1e7]), (1, 1, [1e7]), (2, 0, [1e7])])


def test_short_buckets_are_pruned():
    """By the lower limit at once, by the running k-th score where there is no limit."""
    rng = np.random.default_rng(6)
    v = rng.integers(-9, 10, size=(20_000, 8)) * np.repeat([1000, 100, 10, 1], 5000)[:, None]
    rows = negatives.Rows(np.arange(len(v)), np.arange(len(v)) % 2, np.sqrt((v.astype(float) ** 2).sum(1)), v)
    anchor = rows.part(slice(0, 1))
    scores = v @ v[0]
    for low in (10_000_000, negatives.LEAST):
        count: list[int] = []
        best = negatives.search(anchor, np.array([low]), np.array([negatives.MOST]), np.array([0]), rows, 5, False, count)
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i % 2 == 1 and s >= low)[:5]
        assert list(zip((-best.score).tolist(), best.id.tolist(), strict=True)) == want
        assert sum(count) <= 3 * negatives.BUCKET  # 5000 long ones and what shares their last bucket
