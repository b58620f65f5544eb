"""The batch search in DataFrame functions on many points: few pairs are ranked, and the results stay those of matrix products."""

from __future__ import annotations

import numpy as np
import pytest

from lodestone.operators import search


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(3000)] + [(k, [1.0] * 8) for k in range(3000, 3400)] + [(k, [1.0, 2.0]) for k in range(3400, 3403)]
    return spark.createDataFrame(rows + [(4000, None), (4001, [None] * 8)], "vec_id long, embedding array<float>").coalesce(2).cache()


@pytest.mark.parametrize("block", [4096, 17])
@pytest.mark.parametrize("metric", ["Cosine", "euclid"])
def test_few_pairs_are_ranked(spark, cloud, monkeypatch, metric, block):
    queries = cloud.where("vec_id % 100 = 0 OR vec_id IN (3401, 3333)").selectExpr("vec_id AS query_id", "embedding")
    want = sorted(map(tuple, search.search_many(cloud, queries, 5, metric).collect()))
    ranked, counts = search._ranked, []

    def seen(found, k, larger):
        counts.append(found.count())
        return ranked(found, k, larger)

    monkeypatch.setattr(search, "_ranked", seen)
    monkeypatch.setattr(search, "PAIRS", 20_000, raising=False)
    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    assert sorted(map(tuple, search.search_many_native(cloud, queries, 5, metric).collect())) == want
    assert max(counts) < 3403 * 36 / 4  # of all pairs


def test_long_vectors_are_scored_as_arrays(spark, cloud, monkeypatch):
    queries = cloud.where("vec_id < 4").selectExpr("vec_id AS query_id", "embedding")
    want = sorted(map(tuple, search.search_many(cloud, queries, 5, "manhattan").collect()))
    for columns in (4, 8):
        monkeypatch.setattr(search, "UNROLLED", columns, raising=False)
        assert sorted(map(tuple, search.search_many_native(cloud, queries, 5, "manhattan").collect())) == want
