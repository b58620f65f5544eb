"""Many queries: neither points nor queries are shuffled, and workers get short batches."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from lodestone.operators import batches, search


def test_points_and_queries_stay_where_they_lie(spark, monkeypatch, capsys):
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(k, rng.normal(size=6).tolist()) for k in range(500)] + [(500, [1.0]), (501, None)], "vec_id long, embedding array<double>")
    queries = points.where("vec_id % 7 = 0").selectExpr("vec_id AS query_id", "embedding")
    want = sorted(map(tuple, search.search_many(points, queries, 4).collect()))
    monkeypatch.setattr(search, "QUERY_BLOCK", 5)
    monkeypatch.setattr(search, "MET_QUERIES", 7, raising=False)
    monkeypatch.setattr(search, "POINT_BYTES", 4000, raising=False)
    found = search.search_many(points, queries, 4)
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "CoGroup" not in plan  # the ranking's own
    assert sorted(map(tuple, found.collect())) == want


def test_workers_get_short_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        points = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
        search.search_many(points, points.selectExpr("vec_id AS query_id", "embedding"))
        assert int(spark.conf.get(key)) <= 1000
        spark.conf.set(key, "10")
        batches.small_batches(spark)
        assert spark.conf.get(key) == "10"
    finally:
        spark.conf.set(key, before)


def test_memory_of_scoring_does_not_follow_the_number_of_queries():
    rng = np.random.default_rng(6)
    v = rng.normal(size=(1000, 4))
    points = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["id", "v"])

    def peak(n):
        q = rng.normal(size=(n, 4))
        tracemalloc.start()
        try:
            found = [x.to_pydict() for x in search._best({4: (pa.array(range(n)), q)}, points, "DOT", -1.0, 1)]
            most = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        best = {i: (j, s) for x in found for i, j, s in zip(*x.values(), strict=True)}
        score = np.round(q @ v.T, 6)
        assert len(best) == n and all(score[i, j] == score[i].max() == s for i, (j, s) in best.items())
        return most

    assert peak(4000) < 2 * peak(500)
