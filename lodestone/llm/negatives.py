"""Hard negatives by norm-bucketed search.

Candidates are sorted by norm, longest first, and dealt into blocks of bounded
size; equal norms spread by a hash.  By Cauchy-Schwarz no candidate scores more
than the product of both norms, so that an anchor meets only blocks whose
longest vector reaches the lower limit of one of its windows, and inside a
block, bucket by bucket, leaves off as soon as a bucket's longest vector
reaches neither the lower limit nor the running k-th best score.

One search serves twice: an anchor's positives are its best rows of the same
label, without limits, and its negatives, for each positive, the best rows of
another label within the window of that positive's score.  Neither meets all
pairs as rows: a block of anchors and a block of candidates are one task's
matrix product, and only k rows a window leave it.

Defined cases: rows with a null label, id or vector, or with a null or
non-finite component, and empty vectors take no part; vectors of another length
than the anchor's aren't met.  ``vec_id`` names a row: an anchor never meets a
row of its id, of anchors that share an id the smallest (vector, then label) is
answered, and a repeated candidate counts once for each row.  A positive with a
negative score has an empty window.  Equal scores go to the smaller id.
Products beyond 2**52 are made in Python integers; a score whose hundredfold no
long holds is an error.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .topk import quantised

#: Rows of a block at most on average; there are at least MIN_BLOCKS of candidates.
ANCHOR_BLOCK = 8_192
CANDIDATE_BLOCK = 32_768
MIN_BLOCKS = 24
#: Candidates that are pruned or scored together, and anchors that meet them at a time.
BUCKET = 2_048
STEP = 256
LEAST = -(2**63)
MOST = 2**63 - 1


def labelled(vectors: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id long, v array<long>, label long`` of the rows that take part."""
    marked = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), label.cast("long").alias("label"))
    return quantised(marked, scale=scale, extra=["label"]).where("label IS NOT NULL")


def bucketed(candidates: DataFrame) -> DataFrame:
    """The candidates with ``norm`` and ``block``, written; blocks follow the norm downwards."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = written(candidates.withColumn("norm", F.sqrt(square)), "negatives-rows")
    n = max(MIN_BLOCKS, -(-rows.count() // CANDIDATE_BLOCK))
    dealt = rows.repartitionByRange(n, F.desc("norm"), F.xxhash64("vec_id", "v"))
    return written(dealt.withColumn("block", F.spark_partition_id()), "negatives-blocks")


@dataclass
class Rows:
    """Vectors of one length."""

    ids: np.ndarray
    labels: np.ndarray
    norm: np.ndarray
    v: np.ndarray

    @staticmethod
    def of(data: pa.Table) -> dict[int, tuple[Rows, np.ndarray]]:
        """By length: the rows, and their places in the table."""
        lists = data.column("v").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        out = {}
        for n in np.unique(sizes).tolist():
            at = np.nonzero(sizes == n)[0]
            take = lambda c: data.column(c).to_numpy()[at]  # noqa: E731, B023
            flat = (lists.take(pa.array(at)) if len(at) < len(sizes) else lists).flatten().to_numpy()
            out[n] = Rows(take("vec_id"), take("label"), take("norm"), flat.reshape(-1, n)), at
        return out

    def part(self, at: np.ndarray | slice) -> Rows:
        return Rows(self.ids[at], self.labels[at], self.norm[at], self.v[at])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products."""
    top = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if top < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    found = a.astype(object) @ b.astype(object).T
    if any(abs(x) * 100 >= 2**63 for x in found.ravel()):
        raise OverflowError("a score is too large for a long")
    return found.astype(np.int64)


class Best:
    """The k best (score, id) of every window so far, by descending score, then id."""

    def __init__(self, windows: int, k: int) -> None:
        self.k = k
        self.window, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        #: the k-th best score, or the least long while there are fewer
        self.floor = np.full(windows, LEAST, np.int64)

    def add(self, window: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        window, score, id_ = (np.concatenate(x) for x in ((self.window, window), (self.score, score), (self.id, id_)))
        order = np.lexsort((id_, -score, window))
        window, score, id_ = window[order], score[order], id_[order]
        rank = np.arange(len(window)) - np.searchsorted(window, window)
        keep = rank < self.k
        self.window, self.score, self.id = window[keep], score[keep], id_[keep]
        last = rank == self.k - 1
        self.floor[window[last]] = score[last]


def search(anchors: Rows, low: np.ndarray, high: np.ndarray, owner: np.ndarray, candidates: Rows, k: int, alike: bool, count: list[int] | None = None) -> Best:
    """The k best of every window among the candidates of the anchor's label (``alike``) or of others.

    A window is ``low <= score <= high`` for the anchor at ``owner``; windows
    are in the order of their owners.  ``count`` gets the number of products.
    """
    best = Best(len(owner), k)
    order = np.argsort(-candidates.norm, kind="stable")
    starts = np.searchsorted(owner, np.arange(len(anchors.ids) + 1))
    for at in range(0, len(order), BUCKET):
        bucket = candidates.part(order[at : at + BUCKET])
        # what rounding moves in the product of two norms is far less than what is added
        reach = anchors.norm * bucket.norm[0] * (1 + 1e-9) + 1
        wanted = reach[owner] >= np.maximum(low, best.floor).astype(np.float64)
        open_ = np.unique(owner[wanted])
        if not len(open_):
            break  # all later buckets are shorter still
        for s in range(0, len(open_), STEP):
            mine = open_[s : s + STEP]
            some = anchors.part(mine)
            scores = products(some.v, bucket.v)
            if count is not None:
                count.append(scores.size)
            met = (some.labels[:, None] == bucket.labels[None, :]) == alike
            met &= some.ids[:, None] != bucket.ids[None, :]
            span = starts[mine + 1] - starts[mine]
            for nth in range(int(span.max(initial=0))):
                row = np.nonzero(span > nth)[0]
                window = starts[mine[row]] + nth
                row, window = row[wanted[window]], window[wanted[window]]
                if not len(row):
                    continue
                own = scores[row]
                fits = met[row] & (own >= np.maximum(low[window], best.floor[window])[:, None]) & (own <= high[window][:, None])
                if own.shape[1] > k:  # the k-th best of this bucket bounds what can enter
                    kth = np.partition(np.where(fits, own, LEAST), -k, axis=1)[:, -k]
                    fits &= own >= kth[:, None]
                i, j = np.nonzero(fits)
                best.add(window[i], own[i, j], bucket.ids[j])
    return best


def best_rows(anchors: DataFrame, candidates: DataFrame, k: int, alike: bool) -> DataFrame:
    """``anchor_id, window, vec_id, score, rank`` for ``anchors(vec_id, v, label, norm, windows array<struct<low, high>>)``.

    ``candidates`` are :func:`bucketed`, and ``windows`` numbered from 0; every
    window gets its k best, all if there are fewer.
    """
    n_a = max(1, -(-anchors.count() // ANCHOR_BLOCK))
    longest = candidates.groupBy("block").agg(F.max("norm").alias("longest"))
    blocks = longest.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0] + 1
    least = F.array_min(F.transform("windows", lambda w: w["low"]))
    group = F.pmod(F.xxhash64("vec_id"), F.lit(n_a)).cast("int").alias("ab")
    sent = anchors.withColumn("least", least).select("*", group, F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))).alias("block"))
    reached = F.col("norm") * F.col("longest") * (1 + 1e-9) + 1 >= F.col("least")
    sent = sent.join(longest, "block").where(reached).select("ab", "block", "vec_id", "v", "label", "norm", "windows")
    # under new names, as the anchors come from the same table
    met = candidates.select(F.explode(F.sequence(F.lit(0), F.lit(n_a - 1))).alias("ab"), *(F.col(c).alias(c) for c in ("block", "vec_id", "v", "label", "norm")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        theirs = Rows.of(right)
        windows = left.column("windows").combine_chunks()
        n = windows.value_lengths().to_numpy(zero_copy_only=False)
        low, high = (windows.flatten().field(i).to_numpy() for i in (0, 1))
        first = np.cumsum(n) - n
        out = []
        for size, (mine, at) in Rows.of(left).items():
            if size in theirs:
                owner = np.repeat(np.arange(len(at)), n[at])
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(n[at]) - n[at], n[at])
                place = first[at][owner] + nth
                best = search(mine, low[place], high[place], owner, theirs[size][0], k, alike)
                out.append((mine.ids[owner[best.window]], nth[best.window], best.id, best.score))
        columns = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*out, strict=True) if out else [()] * 4)]
        return pa.table([pa.array(c) for c in columns], names=["anchor_id", "window", "vec_id", "score"])

    found = sent.groupBy("ab", "block").cogroup(met.groupBy("ab", "block")).applyInArrow(run, "anchor_id long, window long, vec_id long, score long")
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, percent: tuple[int, int] = (30, 90)) -> DataFrame:
    """Hard negatives of the anchors among :func:`labelled` rows.

    ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``: for each anchor and each of its best rows of the same
    label, the best rows of other labels whose score is within ``percent`` of
    the positive's.
    """
    candidates = bucketed(rows)
    smallest = F.min(F.struct("v", "label", "norm")).alias("one")
    anchors = candidates.where(is_anchor).groupBy("vec_id").agg(smallest).select("vec_id", "one.*")
    everything = F.array(F.struct(F.lit(LEAST).alias("low"), F.lit(MOST).alias("high")))
    alike = best_rows(anchors.withColumn("windows", everything), candidates, positives, alike=True)
    alike = written(alike.where("score >= 0").select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").cast("long").alias("nth")), "negatives-positives")
    least, most = percent
    # whole numbers: the least and the greatest score in the window
    low, high = F.expr(f"(positive_score * {least} + 99) div 100"), F.expr(f"positive_score * {most} div 100")
    windows = alike.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("nth", low.alias("low"), high.alias("high")))).alias("w"))
    windows = windows.select(F.col("anchor_id").alias("vec_id"), F.transform("w", lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high"))).alias("windows"))
    found = best_rows(anchors.join(windows, "vec_id"), candidates, negatives, alike=False)
    found = found.select("anchor_id", (F.col("window") + 1).alias("nth"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(alike, ["anchor_id", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row of ``embeddings`` whose id is divisible by 100; every seventh id has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(labelled(table(spark, sf_dir, "embeddings"), label), F.col("vec_id") % 100 == 0)


SQL = """
WITH rows_ AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, p.positive_score, n.vec_id AS negative_id, n.score AS negative_score,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.alike
  AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) <= 10
"""
