from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from lodestone.llm import topk


def brute(rows, k, queries):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in {i: min(w for j, w in ok if j == i) for i, _ in ok if queries(i)}.items():
        best = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v)))[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


def run(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, v int")
    q = topk.quantised(df)
    got = [tuple(r) for r in topk.top_k(q.where("vec_id % 50 = 0"), q, k).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_query_and_sql(spark, sf):
    got = {tuple(r) for r in topk.op8_topk(spark, sf).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert got == set(db.execute(topk.SQL).fetchall())


def test_clusters_ties_and_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * 4
    rows = [(int(i), (centres[i % 6] + rng.normal(size=8) * 0.05).tolist()) for i in range(400)]
    rows += [(int(i), centres[0].tolist()) for i in range(400, 560)]
    for name, value in (("QUERY_BLOCK", 3), ("CANDIDATE_BLOCK", 100), ("MIN_BLOCKS", 2), ("STEP", 2)):
        monkeypatch.setattr(topk, name, value)
    assert run(spark, rows) == brute(rows, 5, lambda i: i % 50 == 0)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(0, None), (50, [1.0, None]), (100, [float("nan"), 1.0]), (150, [float("inf"), 1.0]), (None, [1.0, 2.0]), (200, [])],
        [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (50, [3.0]), (51, [2.0]), (0, [1.0, 2.0])],
        [(0, [1e6, -1e6]), (1, [1e6 + 3, 1.0]), (2, [-3.5, 2.0])],
        [(0, [2.0, 1.0]), (0, [1.0, 3.0]), (50, [1.0, 1.0]), (3, [1.0, 0.0])],
    ],
)
def test_cases(spark, rows):
    assert run(spark, rows) == brute(rows, 5, lambda i: i % 50 == 0)


def test_a_component_beyond_a_long_is_an_error(spark):
    with pytest.raises(Exception, match="too large for a long"):
        run(spark, [(0, [1e18]), (1, [1.0])])


def test_elimination_skips_candidates():
    rng = np.random.default_rng(4)
    v = np.concatenate([np.floor(rng.normal(size=(500, 4)) * 3 + c) for c in (0, 4000, 9000)]).astype(np.int64)
    pivots = topk.farthest_first(v.astype(float), 8)
    scores = v @ v[1400]
    want = sorted((-int(s), i) for i, s in enumerate(scores) if i != 1400)[:5]
    block = topk.Block(np.arange(len(v)), v, pivots)
    assert topk.search(block, 1400, block, 5) == [(-s, i) for s, i in want]
    assert 0 < block.evaluated < 1000
    # a floor from a sample eliminates a block of others as a whole, and never a result
    some = topk.Block(np.arange(1000, 1500, 5), v[1000:1500:5], pivots)
    floor = topk.floors(block, some, 5)[1400]
    assert floor <= -want[-1][0] and topk.floors(block, topk.Block(np.arange(3), v[:3], pivots), 5)[1400] == -np.inf
    whole = topk.Block(np.arange(len(v)), v, pivots)
    assert topk.search(whole, 1400, whole, 5, floor) == [(-s, i) for s, i in want] and whole.evaluated <= block.evaluated
    far = topk.Block(np.arange(500), v[:500], pivots)
    assert topk.search(block, 1400, far, 5, floor) == [] and far.evaluated == 0


def test_projections_from_the_table_leave_little_to_evaluate():
    """Vectors without clusters, and no floor from a sample: under a tenth of the candidates is evaluated, and the results are exact."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 64))
    v = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    pivots = topk.farthest_first(v[:500].astype(float), topk.PIVOTS)
    block = topk.Block(np.arange(len(v)), v, pivots)
    assert block.within.shape[1] == topk.PIVOTS - 1
    assert np.allclose((block.within**2).sum(1) + block.rest**2, block.norm)
    for i in range(0, 2000, 50):
        want = sorted((-int(s), j) for j, s in enumerate(v @ v[i]) if j != i)[:5]
        assert topk.search(block, i, block, 5) == [(-s, j) for s, j in want]
    assert block.evaluated < 0.1 * 40 * len(v)


@pytest.mark.parametrize("pivots", [np.zeros((0, 3)), np.zeros((1, 3)), np.array([[1.0, 2, 3], [1.0, 2, 3]]), np.array([[0.0, 0, 0], [1, 0, 0], [2, 0, 0], [0, 1, 1e-9]])])
def test_pivots_that_span_little(pivots):
    v = np.array([[1, 2, 3], [-1, 0, 5], [4, 4, 4], [0, 0, 0]])
    block = topk.Block(np.arange(4), v, pivots)
    for i in range(4):
        assert topk.search(block, i, block, 2) == [(-s, j) for s, j in sorted((-int(s), j) for j, s in enumerate(v @ v[i]) if j != i)[:2]]
