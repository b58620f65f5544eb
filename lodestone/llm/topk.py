"""Exact top-k inner products by pivot-table elimination.

Vectors become integers, floor(256 * x).  For whole numbers
``q.v = (|q|^2 + |v|^2 - d(q, v)^2) / 2``, and for any pivot p the triangle
inequality gives ``d(q, v) >= |d(q, p) - d(v, p)|``.  A table with the distance
of every vector to every pivot hence gives each candidate a maximum lower
bound of its distance and so an upper bound of its score.  A query evaluates
its candidates in the order of that bound and stops, exactly, when no later
candidate can enter its k best.

The same table bounds more tightly through several pivots at once: the
differences of a vector's squared distances to two pivots are its inner product
with what lies between them, so that its projection onto the span of the pivots
follows, and what is left of it has a known length.  Hence
``q.v <= q_P.v_P + |q - q_P| |v - v_P|``; the smaller of both bounds counts.

Pivots: chosen farthest-first among ``SAMPLE`` candidates, those with the
smallest hash of their id.  The same candidates give every query a floor before
it meets any block, the k-th best score among them: what is bounded below the
floor is eliminated at once, whole blocks if need be.  The sample only steers
how much is eliminated; every row is in the table.

Queries and candidates are hashed into blocks by id, so that equal vectors
spread; a pair of blocks is one task's work of bounded size.  Candidates are
shuffled once per block of queries, queries once per block of candidates.

Defined cases: vectors that are null, empty, or hold null or non-finite
components, and rows without an id, take no part; nor do vectors of another
length than a query's.  ``vec_id`` names a row: a query never meets a row of
its own id; of queries that share an id, the smallest vector is answered; and a
repeated candidate counts once for each row.  A component beyond a long is an
error.  Equal scores go to the smaller id.  Scores beyond 2**52
are evaluated in Python integers, and one that no long holds is an error.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, table, written

PIVOTS = 64
SAMPLE = 2048
#: Rows of a block at most on average; a table has at least MIN_BLOCKS of candidates.
QUERY_BLOCK = 16_384
CANDIDATE_BLOCK = 65_536
MIN_BLOCKS = 64
#: Queries that meet the sample together.
QUERY_STEP = 1024
#: Candidates evaluated at first; the next steps double.
STEP = 16
LIMIT = 2**31  # components up to here stay exact as doubles


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, extra: Sequence[str] = ()) -> DataFrame:
    """``vec_id long, v array<long>`` of the rows that take part, with their columns ``extra``."""
    frame = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"), *extra)
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = lambda e: F.when(F.abs(e * scale) < 2.0**63, F.floor(e * scale)).otherwise(F.raise_error(F.lit("a component is too large for a long")))
    return frame.where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & finite).select("vec_id", F.transform("x", whole).alias("v"), *extra)


def farthest_first(sample: np.ndarray, k: int) -> np.ndarray:
    """``k`` distinct rows, each the farthest from those before."""
    if not len(sample):
        return sample
    chosen, least = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < k and (far := int(least.argmax())) is not None and least[far] > 0:
        chosen.append(far)
        least = np.minimum(least, ((sample - sample[far]) ** 2).sum(axis=1))
    return sample[chosen]


def sampled(rows: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the commonest length in a bounded sample."""
    found = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).collect()
    if not found:
        return np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
    sizes = [len(r.v) for r in found]
    size = max(set(sizes), key=lambda n: (sizes.count(n), n))
    found = [r for r in found if len(r.v) == size]
    return np.array([r.vec_id for r in found], dtype=np.int64), np.array([r.v for r in found], dtype=np.int64)


def directions(pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of pivots whose differences from the first span the most, and what makes inner products with those differences coordinates.

    A difference that adds next to nothing to the span is left out, so that
    coordinates are computed without much loss.
    """
    kept: list[int] = []
    basis = np.zeros((0, pivots.shape[1] if pivots.ndim == 2 else 0))
    for k in range(1, len(pivots)):
        own = pivots[k] - pivots[0]
        left = own - basis.T @ (basis @ own)
        left -= basis.T @ (basis @ left)
        if (size := np.linalg.norm(left)) > 1e-3 * np.linalg.norm(own):
            kept.append(k)
            basis = np.vstack((basis, left / size))
    return np.array(kept, dtype=np.int64), np.linalg.inv(basis @ (pivots[kept] - pivots[0]).T) if kept else np.zeros((0, 0))


class Block:
    """Vectors of one length with their pivot table."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[order], vectors[order].astype(np.float64)
        self.exact = bool(len(vectors) == 0 or (np.abs(vectors).max() < LIMIT and float(np.abs(self.v).max()) ** 2 * vectors.shape[1] < 2**52))
        self.whole = vectors[order]
        self.norm = (self.v * self.v).sum(axis=1)
        near = pivots if len(pivots) and pivots.shape[1:] == self.v.shape[1:] else np.zeros((1, self.v.shape[1]))
        squared = self.norm[:, None] + (near * near).sum(axis=1)[None, :] - 2 * self.v @ near.T
        squared = np.maximum(squared, 0)
        self.table = np.sqrt(squared)
        kept, change = directions(near)
        length = (near * near).sum(axis=1)
        #: the projection onto the pivots' span, from the table alone, and the length of the rest
        self.within = (squared[:, :1] - squared[:, kept] + length[kept] - length[0]) / 2 @ change
        self.rest = np.sqrt(np.maximum(self.norm - (self.within * self.within).sum(axis=1), 0))
        #: candidates whose scores were computed
        self.evaluated = 0


def floors(q: Block, sample: Block, k: int) -> np.ndarray:
    """For every query the k-th best score among sampled candidates, or minus infinity."""
    if not (q.exact and sample.exact) or q.v.shape[1:] != sample.v.shape[1:]:
        return np.full(len(q.ids), -np.inf)
    scores = np.where(q.ids[:, None] == sample.ids[None, :], -np.inf, q.v @ sample.v.T)
    return np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(q.ids), -np.inf)


def search(q: Block, i: int, c: Block, k: int, floor: float = -np.inf) -> list[tuple[int, int]]:
    """The k best (score, id) of one query among the candidates of a block; those below ``floor`` may be missing."""
    if not (q.exact and c.exact):
        scored = sorted(((sum(int(a) * int(b) for a, b in zip(q.whole[i], row, strict=True)), int(x)) for x, row in zip(c.ids, c.whole, strict=True) if x != q.ids[i]), key=lambda t: (-t[0], t[1]))
        return scored[:k]
    gap = np.zeros(len(c.ids))
    for p in range(c.table.shape[1]):
        np.maximum(gap, np.abs(c.table[:, p] - q.table[i, p]), out=gap)
    # rounding of the distances moves a bound by far less than what is added
    slack = 1 + 1e-9 * (q.norm[i] + c.norm)
    bound = (q.norm[i] + c.norm - gap * gap) / 2 + slack
    np.minimum(bound, c.within @ q.within[i] + q.rest[i] * c.rest + 1 + 1e-6 * np.sqrt(q.norm[i] * c.norm), out=bound)
    open_ = np.nonzero(bound >= floor)[0]
    order = open_[np.argsort(-bound[open_], kind="stable")]  # equal bounds: the smaller id
    best_s, best_i = np.zeros(0), np.zeros(0, np.int64)
    at, step = 0, STEP
    while at < len(order):
        if len(best_s) == k and bound[order[at]] < best_s[-1]:
            break
        part = order[at : at + step]
        part_ids = c.ids[part]
        c.evaluated += len(part)
        keep = part_ids != q.ids[i]
        s = np.concatenate((best_s, c.v[part[keep]] @ q.v[i]))
        x = np.concatenate((best_i, part_ids[keep]))
        top = np.lexsort((x, -s))[:k]
        best_s, best_i = s[top], x[top]
        at += step
        step *= 2
    return [(int(s), int(x)) for s, x in zip(best_s, best_i, strict=True)]


def _by_length(rows: pd.DataFrame, pivots: np.ndarray) -> dict[int, Block]:
    sizes = rows["v"].map(len).to_numpy()
    return {int(n): Block(rows["vec_id"].to_numpy()[sizes == n], np.stack(rows["v"].to_numpy()[sizes == n]), pivots) for n in np.unique(sizes)}


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of every query; both inputs as :func:`quantised` gives them."""
    candidates = written(candidates, "topk-candidates")
    spark = candidates.sparkSession
    ids, vectors = sampled(candidates)
    pivots = farthest_first(vectors.astype(np.float64), PIVOTS) if len(ids) else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast((ids, vectors, pivots))

    def with_floor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors, _ = shared.value
        sample = Block(ids, vectors, np.zeros((0, 0))) if len(ids) else None
        for whole in batches:
            for at in range(0, len(whole), QUERY_STEP):
                rows = whole.iloc[at : at + QUERY_STEP].copy()
                rows["floor"] = -np.inf
                if sample is not None:
                    sizes = rows["v"].map(len).to_numpy()
                    for n in np.unique(sizes):
                        block = Block(rows["vec_id"].to_numpy()[sizes == n], np.stack(rows["v"].to_numpy()[sizes == n]), np.zeros((0, 0)))
                        found = dict(zip(block.ids.tolist(), floors(block, sample, k).tolist(), strict=True))
                        rows.loc[sizes == n, "floor"] = [found[x] for x in rows["vec_id"].to_numpy()[sizes == n].tolist()]
                yield rows

    one = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = written(one.mapInPandas(with_floor, "vec_id long, v array<long>, floor double"), "topk-queries")
    n_q = max(1, -(-queries.count() // QUERY_BLOCK))
    n_c = max(MIN_BLOCKS, -(-candidates.count() // CANDIDATE_BLOCK))
    blocks = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    q = queries.select("vec_id", "v", "floor", F.pmod(F.xxhash64("vec_id"), F.lit(n_q)).cast("int").alias("qb"), F.explode(blocks(n_c)).alias("cb"))
    c = candidates.select("vec_id", "v", F.explode(blocks(n_q)).alias("qb"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_c)).cast("int").alias("cb"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        pivots = shared.value[2]
        mine, theirs = _by_length(left, pivots), _by_length(right, pivots)
        floor = dict(zip(left["vec_id"].tolist(), left["floor"].tolist(), strict=True))
        for n, block in mine.items():
            if n in theirs:
                for i, x in enumerate(block.ids.tolist()):
                    out += [(x, v, s) for s, v in search(block, i, theirs[n], k, floor[x])]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(run, "query_id long, vec_id long, score long")
    ordered = F.row_number().over(_window())
    return found.withColumn("rank", ordered).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows of ``embeddings`` for each row whose id is divisible by 50."""
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(rows.where("vec_id % 50 = 0"), rows, 5)


SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
