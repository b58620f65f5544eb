from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import search
from lodestone.operators.store import Collection


def rows(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, "hot" if i % 3 else f"l{i % 7}", [float(x) for x in rng.integers(-3, 4, 5)]) for i in range(n)], "vec_id long, location string, embedding array<double>")


def brute(points, queries, k):
    out = set()
    for q in queries:
        near = sorted((-round(float(np.dot(p.embedding, q.embedding)), 6), p.vec_id) for p in points if not q.location or p.location == q.location)
        out |= {(q.query_id, i, -s, r) for r, (s, i) in enumerate(near[:k], 1)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_each_query_searches_its_location(spark, tmp_path, monkeypatch, small):
    if small:
        for name, value in (("QUERY_BLOCK", 3), ("POINT_BLOCK", 20), ("POINT_BATCH", 8)):
            monkeypatch.setattr(search, name, value)
    points = rows(spark)
    places = F.element_at(F.array(*map(F.lit, ["hot", "l0", "", "nowhere", "l3", "hot"])), (F.col("vec_id") % 6 + 1).cast("int"))
    queries = points.where("vec_id % 11 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.when(F.col("vec_id") % 5 != 0, places).alias("location"))
    got = [tuple(r) for r in search.search_by_location(points, queries, 4, "Dot").select("query_id", "id", "score", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(points.collect(), queries.collect(), 4)


def test_only_named_partitions_are_read(spark, tmp_path, capsys):
    kept = Collection(spark, f"file://{tmp_path}", "c", 5, "Dot")
    kept.rebuild(rows(spark))
    queries = spark.createDataFrame([(1, [1.0] * 5, "l0"), (2, [1.0, 0.0, 0.0, 0.0, 2.0], "l3")], "query_id long, embedding array<double>, location string")
    found = search.search_by_location(kept.points(), queries, 3, "Dot")
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("PartitionFilters: [location") >= 2 and "hot" not in plan
    assert found.count() == 6


def test_nothing_asked_and_nothing_there(spark):
    none = spark.createDataFrame([], "query_id long, embedding array<double>, location string")
    assert search.search_by_location(rows(spark, 20), none).collect() == []
    one = spark.createDataFrame([(1, [1.0] * 5, "l0"), (2, None, "l0")], "query_id long, embedding array<double>, location string")
    assert search.search_by_location(rows(spark, 20).limit(0), one).collect() == []


def test_the_least_with_ties():
    rng = np.random.default_rng(2)
    for _ in range(100):
        cost = rng.integers(0, 4, (3, rng.integers(1, 12))).astype(float)
        ids = rng.permutation(cost.shape[1])
        row, column = search._first(cost, ids, 4)
        want = [(i, c) for i in range(3) for c in sorted(range(cost.shape[1]), key=lambda c: (cost[i, c], ids[c]))[:4]]
        assert list(zip(row.tolist(), column.tolist(), strict=True)) == want
