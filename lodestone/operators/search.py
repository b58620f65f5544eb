"""Exact similarity search.

``search`` answers one query as a plan of scan, filter, projection and top-k.
``search_many`` answers any number in one plan.  A block of at most
``QUERY_BLOCK`` queries is sent to the points, which are scored where they lie
(Arrow, one matrix product a batch).  More queries are kept in a table in the
shared folder, and so are the points: a task reads a block of queries and a share
of the points where they lie, so that neither are shuffled or pass the driver.
By cosine and dot product it scores all its pairs in single precision, and those
in reach of a query's k best so far in double precision.  The best of every task
go on to a top-k per query.  Equal scores, to six digits, go to the smaller id.  A vector that is null or empty, holds nulls or has another length
than its counterpart takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from lodestone.functions.vectors import distance, norm, unrolled
from lodestone.operators.batches import releasing, small_batches
from lodestone.operators.store import settled

#: Queries that are sent to the points together.
QUERY_BLOCK = 4096
#: Blocks of queries of a kept table that a task has, and queries of them that meet a batch of points at a time.
QUERY_BLOCKS = 4
MET_QUERIES = 512
#: Tasks for each core at least, if there are points enough, and points of a file that they read.
TASKS = 6
POINT_FILE = 16_384
#: Points of a batch in reach of a query, as multiples of the k wanted, above which it is scored against all of the batch.
CROWD = 8
#: Points of a block on average that meets a block of queries.
POINT_BLOCK = 65_536
#: Points that are scored together.
POINT_BATCH = 2048
#: Pairs of a query and a point that are scored together: a worker's memory doesn't follow the number of queries.
SCORED = 1 << 18
#: Blocks of points for each partition that they are read in.
POINT_PARTS = 4
#: Pairs of a point and a query that are ranked without a bound, and a task's at least.
PAIRS = 1_000_000
#: Components that can be columns of their own; longer vectors are scored as arrays.
UNROLLED = 512
#: Locations that are named to the scan; more meet it in a join.
NAMED = 1000


def location_filter(points: DataFrame, location: str | None, column: str = "location") -> DataFrame:
    """The points of a location; all of them for none or an empty one."""
    return points.where(F.col(column) == location) if location else points


def all_of(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def search(points: DataFrame, query: list[float], k: int = 10, metric: str = "Cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``points`` with ``score``, the ``k`` best first."""
    score, larger = distance(metric)
    scored = points.withColumn("score", F.round(score(F.col(vector_col), F.array(*(F.lit(float(x)) for x in query))), 6)).drop(vector_col)
    return scored.orderBy(F.desc("score") if larger else F.asc("score"), id_col).limit(k)


def _scores(metric: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    if metric == "MANHATTAN":
        return np.stack([np.abs(v - row).sum(axis=1) for row in q])
    product = q @ v.T
    if metric == "COSINE":
        size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
        return np.divide(product, size, out=np.zeros_like(product), where=size > 0)
    if metric == "EUCLID":
        return np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2 * product, 0))
    return product


def _whole(rows: DataFrame) -> DataFrame:
    return rows.where((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull()))


def _by_length(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        at = np.nonzero(sizes == n)[0]
        yield at, vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(n))


Block = dict[int, tuple[pa.Array, np.ndarray]]  # by length: ids and vectors of queries


def _block(ids: pa.Array, vectors: pa.ListArray) -> Block:
    return {v.shape[1]: (ids.take(pa.array(at)), v) for at, v in _by_length(vectors)}


def _first(cost: np.ndarray, by_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` least of each row, equal ones in the order of ``by_id``; only what ties with the k-th is sorted."""
    if cost.shape[1] > k:
        row, column = np.nonzero(cost <= np.partition(cost, k - 1, axis=1)[:, k - 1 : k])
    else:
        row, column = (x.ravel() for x in np.indices(cost.shape))
    order = np.lexsort((by_id[column], cost[row, column], row))
    row, column = row[order], column[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], column[keep]


def _best(asked: Block, points: pa.RecordBatch, name: str, sign: float, k: int) -> Iterator[pa.RecordBatch]:
    """Columns (id, v) of points: the ``k`` best of them for each query."""
    for start in range(0, points.num_rows, POINT_BATCH):
        batch = points.slice(start, POINT_BATCH)
        for at, v in _by_length(batch.column(1)):
            if v.shape[1] not in asked:
                continue
            ids, q = asked[v.shape[1]]
            own = batch.column(0).take(pa.array(at))
            by_id = np.argsort(np.argsort(np.array(own.to_pylist()), kind="stable"))
            some = max(1, SCORED // len(at))
            for first in range(0, len(q), some):
                score = np.round(_scores(name, q[first : first + some], v), 6)
                row, best = _first(sign * score, by_id, k)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(first + row)), own.take(pa.array(best)), pa.array(score[row, best])], names=["query_id", "id", "score"])


def _ranked(found: DataFrame, k: int, larger: bool) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score") if larger else F.asc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _meeting(name: str, sign: float, k: int, larger: bool):
    """What a block of queries ``i, v`` and one of points ``id, v`` give: the ``k`` best points of each query."""

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        block = _block(mine.column("i").combine_chunks(), mine.column("v").combine_chunks()) if mine.num_rows else {}
        kind = pa.schema([("query_id", mine.schema.field("i").type), ("id", theirs.schema.field("id").type), ("score", pa.float64())])
        parts = [x for batch in theirs.select(["id", "v"]).combine_chunks().to_batches() for x in _best(block, batch, name, sign, k)]
        found = pa.Table.from_batches([pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(x.columns, kind, strict=True)], schema=kind) for x in parts], schema=kind)
        order = found.sort_by([("query_id", "ascending"), ("score", "descending" if larger else "ascending"), ("id", "ascending")])
        own = order.column("query_id").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        return order.filter(pa.array(rank < k))

    return meet


def _files(kept: DataFrame) -> list[tuple[str, int]]:
    """The files of a table that :func:`settled` has written and their numbers of rows; none that is empty."""
    from pyarrow import fs, parquet

    out = []
    for uri in kept.inputFiles():
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as file:
            out.append((uri, parquet.read_metadata(file).num_rows))
    return [f for f in out if f[1]]


def _shares(files: list[tuple[str, int]], n: int) -> list[list[str]]:
    """The files in at most ``n`` groups of about as many rows."""
    out: list[tuple[int, list[str]]] = [(0, []) for _ in range(min(n, len(files)))]
    for uri, rows in sorted(files, key=lambda f: (-f[1], f[0])):
        at = min(range(len(out)), key=lambda i: out[i][0])
        out[at] = out[at][0] + rows, [*out[at][1], uri]
    return [own for _, own in out]


def _batches(files: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """The two columns of the files of a kept table, in batches of at most ``rows`` rows."""
    from pyarrow import fs, parquet

    for uri in files:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as file:
            yield from parquet.ParquetFile(file).iter_batches(rows, use_threads=False)


class _Held:
    """The ``k`` best points so far of each of a block of queries of one length."""

    def __init__(self, ids: pa.Array, q: np.ndarray, name: str, sign: float, k: int) -> None:
        self.ids, self.q, self.name, self.sign, self.k = ids, q, name, sign, k
        self.size = np.linalg.norm(q, axis=1)
        self.unit = np.divide(q, self.size[:, None], out=np.zeros_like(q), where=self.size[:, None] > 0).astype(np.float32)
        self.least = np.full(len(q), -np.inf)  # the worst score of k points; without k, none
        self.parts: list[pa.Table] = []
        self.new = self.seen = self.due = 0

    def meet(self, own: pa.Array, v: np.ndarray) -> None:
        order = pc.sort_indices(own).to_numpy(zero_copy_only=False)
        by_id = np.empty(len(order), np.int64)
        by_id[order] = np.arange(len(order))
        every = np.arange(len(self.q))
        if self.name in ("COSINE", "DOT"):
            size = np.linalg.norm(v, axis=1)
            plain = np.isfinite(size)  # what isn't goes by double precision alone
            if not plain.all():
                odd = np.flatnonzero(~plain)
                self._all(every, own.take(pa.array(odd)), v[odd], by_id[odd])
            at = np.flatnonzero(plain)
            if len(at):
                own, v, by_id, size = (own, v, by_id, size) if len(at) == len(v) else (own.take(pa.array(at)), v[at], by_id[at], size[at])
                self._all(np.flatnonzero(~np.isfinite(self.size)), own, v, by_id)
                self._near(own, v, size, by_id)
        else:
            self._all(every, own, v, by_id)
        self.seen += len(v)
        if self.seen >= self.due:
            self.settle()
            self.due = 2 * self.seen

    def _all(self, at: np.ndarray, own: pa.Array, v: np.ndarray, by_id: np.ndarray) -> None:
        some = max(1, SCORED // len(v))
        for part in (at[first : first + some] for first in range(0, len(at), some)):
            score = np.round(_scores(self.name, self.q[part], v), 6)
            row, best = _first(self.sign * score, by_id, self.k)
            self._keep(part[row], own.take(pa.array(best)), score[row, best])

    def _near(self, own: pa.Array, v: np.ndarray, size: np.ndarray, by_id: np.ndarray) -> None:
        """Scores in single precision are off by ``reach`` at most, for vectors no longer than 1; what they leave open is scored again."""
        k, cosine = self.k, self.name == "COSINE"
        longest = size.max()
        by = size[:, None] if cosine else longest
        unit = np.ascontiguousarray(np.divide(v, by, out=np.zeros_like(v), where=by > 0).T, dtype=np.float32)
        reach = (v.shape[1] + 8) * 2.0**-24
        for first in range(0, len(self.q), MET_QUERIES):
            at = slice(first, first + MET_QUERIES)
            scale = (self.size[at] > 0).astype(float) if cosine else self.size[at] * longest
            level = scale == 0  # all points are equally good
            near = self.unit[at] @ unit
            with np.errstate(divide="ignore", invalid="ignore"):
                slack = 1e-6 / scale + 2 * reach
                bound = self.least[at] / scale - slack
                new = ~level & np.isneginf(self.least[at])
                if new.any() and near.shape[1] > k:
                    bound[new] = np.partition(near[new], -k, axis=1)[:, -k] - slack[new]
            bound[level | ~np.isfinite(self.size[at])] = np.inf
            some = np.flatnonzero(near.max(axis=1) >= bound)
            inside = near[some] >= bound[some, None]
            crowd = np.count_nonzero(inside, axis=1) > CROWD * k
            self._all(first + some[crowd], own, v, by_id)
            row, column = divmod(np.flatnonzero(inside[~crowd]), near.shape[1])
            row = first + some[~crowd][row]
            for start in range(0, len(row), SCORED // 16):
                r, c = row[start : start + SCORED // 16], column[start : start + SCORED // 16]
                score = np.einsum("ij,ij->i", self.q[r], v[c])
                if cosine:
                    both = self.size[r] * size[c]
                    score = np.divide(score, both, out=np.zeros_like(score), where=both > 0)
                self._checked(r, c, np.round(score, 6), own)
            if level.any():
                r, c = (x.ravel() for x in np.meshgrid(first + np.flatnonzero(level), np.argsort(by_id)[:k], indexing="ij"))
                self._checked(r, c, np.zeros(len(r)), own)

    def _checked(self, row: np.ndarray, column: np.ndarray, score: np.ndarray, own: pa.Array) -> None:
        good = score >= self.least[row]
        self._keep(row[good], own.take(pa.array(column[good])), score[good])

    def _keep(self, row: np.ndarray, own: pa.Array, score: np.ndarray) -> None:
        if not len(row):
            return
        self.parts.append(pa.table({"row": pa.array(row), "id": own, "score": pa.array(score)}))
        self.new += len(row)
        if self.new > max(SCORED, 4 * self.k * len(self.q)):
            self.settle()

    def settle(self) -> None:
        """What was found goes down to the ``k`` best."""
        if not self.new:
            return
        found = pa.concat_tables(self.parts)
        found = found.sort_by([("row", "ascending"), ("score", "descending" if self.sign < 0 else "ascending"), ("id", "ascending")])
        row = found.column("row").to_numpy()
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        last = rank == self.k - 1
        self.least[row[last]] = np.nan_to_num(found.column("score").to_numpy()[last], nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        self.parts, self.new = [found.filter(pa.array(rank < self.k)).combine_chunks()], 0

    def best(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        for part in self.parts:
            for batch in part.to_batches(10_000):
                yield pa.RecordBatch.from_arrays([self.ids.take(batch.column(0)), batch.column(1), batch.column(2)], names=["query_id", "id", "score"])


def _passed(queries: list[str], points: list[str], name: str, sign: float, k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best points of each query, both ``id, vector`` in files of kept tables."""
    asked = pa.Table.from_batches(list(_batches(queries, QUERY_BLOCK)))
    held = {n: _Held(*own, name, sign, k) for n, own in _block(*(c.combine_chunks() for c in asked.columns)).items()}
    for batch in _batches(points, POINT_BATCH):
        for at, v in _by_length(batch.column(1)):
            if v.shape[1] in held:
                held[v.shape[1]].meet(batch.column(0).take(pa.array(at)), v)
    for own in held.values():
        yield from own.best()


def _dealt(c: str, n: Column | int) -> Column:
    return F.pmod(F.xxhash64(c), n if isinstance(n, Column) else F.lit(n)).cast("int")


def _each(n: Column | int) -> Column:
    return F.explode(F.sequence(F.lit(0), (n if isinstance(n, Column) else F.lit(n)) - 1))


def search_many(points: DataFrame, queries: DataFrame, k: int = 10, metric: str = "Cosine", id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` best points of every query; ``queries(query_id, embedding)``.

    More queries than a block are encoded into a table of their own, and the
    points into another, which tasks read by blocks and shares.
    """
    asked = _whole(queries.select(F.col(query_id).alias("i"), F.col(vector_col).cast("array<double>").alias("v")))
    few = asked.limit(QUERY_BLOCK + 1).toArrow()
    return _search(points, few if few.num_rows <= QUERY_BLOCK else settled(asked, QUERY_BLOCK), k, metric, id_col, vector_col)


def _search(points: DataFrame, asked: DataFrame | pa.Table, k: int, metric: str, id_col: str, vector_col: str) -> DataFrame:
    """:func:`search_many` for queries ``i, v``: a block that is at hand, or a table of any size."""
    _, larger = distance(metric)
    name, sign = metric.upper(), -1.0 if larger else 1.0
    spark = points.sparkSession
    small_batches(spark)
    frame = _whole(points.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")))
    asked_id = from_arrow_type(asked.schema.field("i").type) if isinstance(asked, pa.Table) else asked.schema["i"].dataType
    schema = f"query_id {asked_id.simpleString()}, id {frame.schema['id'].dataType.simpleString()}, score double"
    if isinstance(asked, pa.Table):
        shared = spark.sparkContext.broadcast(_block(asked.column(0).combine_chunks(), asked.column(1).combine_chunks()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _best(shared.value, batch, name, sign, k)

        return _ranked(frame.mapInArrow(releasing(run), schema), k, larger)

    mine, theirs = _files(asked), _files(settled(frame, POINT_FILE))
    queries = _shares(mine, -(-sum(n for _, n in mine) // (QUERY_BLOCKS * QUERY_BLOCK)))
    shares = _shares(theirs, -(-TASKS * spark.sparkContext.defaultParallelism // len(queries)))

    def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                yield from _passed(queries[task // len(shares)], shares[task % len(shares)], name, sign, k)

    tasks = len(queries) * len(shares)
    return _ranked(spark.range(0, tasks, 1, max(1, tasks)).mapInArrow(releasing(pass_by), schema), k, larger)


def search_by_location(points: DataFrame, queries: DataFrame, k: int = 10, metric: str = "Cosine", id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", by: str = "location") -> DataFrame:
    """As :func:`search_many`, each query among the points of its own location; one with none (null or empty) among all.

    The locations that are asked for reach the scan: of a table partitioned by
    location the others aren't read.  A location and a block of queries and one
    of points is a task, so that neither a location with many points nor one
    with many questions is one group.
    """
    _, larger = distance(metric)
    asked = settled(_whole(queries.select(F.col(query_id).alias("i"), F.col(vector_col).cast("array<double>").alias("v"), F.nullif(F.col(by), F.lit("")).alias("place"))))
    everywhere = asked.where("place IS NULL").select("i", "v")
    few = everywhere.limit(QUERY_BLOCK + 1).toArrow()
    found = _search(points, few if few.num_rows <= QUERY_BLOCK else settled(everywhere, QUERY_BLOCK), k, metric, id_col, vector_col)
    bound = asked.where("place IS NOT NULL")
    questions = bound.groupBy("place").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("n_q"))
    names = [r.place for r in questions.select("place").limit(NAMED + 1).collect()]
    if not names:
        return found
    own = points.where(F.col(by).isin(names)) if len(names) <= NAMED else points.join(questions.select(F.col("place").alias(by)), by, "left_semi")
    frame = _whole(own.select(F.col(by).alias("place"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")))
    sizes = own.groupBy(F.col(by).alias("place")).agg(F.ceil(F.count("*") / POINT_BLOCK).cast("int").alias("n_p"))
    left = bound.join(questions, "place").join(sizes, "place").select("place", "i", "v", _dealt("i", F.col("n_q")).alias("qb"), _each(F.col("n_p")).alias("pb"))
    right = frame.join(questions, "place").join(sizes, "place").select("place", "id", "v", _dealt("id", F.col("n_p")).alias("pb"), _each(F.col("n_q")).alias("qb"))
    schema = f"query_id {asked.schema['i'].dataType.simpleString()}, id {frame.schema['id'].dataType.simpleString()}, score double"
    keys = ["place", "qb", "pb"]
    right = right.select(*(F.col(c).alias(c) for c in right.columns))
    mine = _ranked(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meeting(metric.upper(), -1.0 if larger else 1.0, k, larger), schema), k, larger)
    return found.unionByName(mine) if few.num_rows else mine


def _components(rows: DataFrame, vector: str, size: int) -> DataFrame:
    """``rows`` with the length and the norm of a vector, and its first ``size`` components as columns; those it lacks are 0."""
    each = (F.coalesce(F.get(vector, F.lit(i)), F.lit(0.0)).alias(f"{vector}{i}") for i in range(size))
    return rows.select("*", F.size(vector).alias("n"), norm(F.col(vector)).alias(f"{vector}_norm"), *each)


def _scored(points: DataFrame, asked: DataFrame, metric: str, size: int, blocks: int, parts: int, bound: bool = False) -> DataFrame:
    """``query_id, id, score`` of the pairs of points ``id, v`` and queries ``query_id, q`` of one length.

    With a bound, queries have ``least`` and ``last`` too: only pairs that come
    no later than a score of ``least`` and an id of ``last`` go on.
    """
    kernel, larger = distance(metric)
    columns = size if size <= UNROLLED else 0
    if blocks == 1:
        left, right, keys = F.broadcast(_components(asked, "q", columns)), _components(points.repartition(parts), "v", columns), ["n"]
    else:
        left = asked.withColumn("pb", _each(parts)).withColumn("part", _dealt("query_id", blocks) * parts + F.col("pb")).drop("pb")
        right = points.withColumn("qb", _each(blocks)).withColumn("part", F.col("qb") * parts + _dealt("id", parts)).drop("qb")
        keys = ["part", "n"]
        left = _components(left.repartition(blocks * parts, "part"), "q", columns).hint("shuffle_hash")
        right = _components(right.repartition(blocks * parts, "part"), "v", columns)
    met = right.join(left, keys)
    if columns:
        raw = unrolled(metric, *([F.col(f"{c}{i}") for i in range(columns)] for c in "vq"), F.col("v_norm"), F.col("q_norm"))
    else:
        raw = kernel(F.col("v"), F.col("q"))
    score = F.round(raw, 6)
    if bound:
        least = F.col("least")
        # rounding is dear: what is out of its reach goes first
        near, before = (raw >= least - 2e-6, score > least) if larger else (raw <= least + 2e-6, score < least)
        met = met.where(least.isNull() | (near & (before | ((score == least) & (F.col("id") <= F.col("last"))))))
    return met.select("query_id", "id", score.alias("score"))


def search_many_native(points: DataFrame, queries: DataFrame, k: int = 10, metric: str = "Cosine", id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """As :func:`search_many` in DataFrame functions.

    All pairs are scored, by compiled expressions over single components.  Of
    many points some go first: the k-th best of about ``4 sqrt(k n)`` bounds
    what a query still needs of all, so that few pairs are kept and ranked.
    """
    larger = distance(metric)[1]
    asked = settled(_whole(queries.select(F.col(query_id).alias("query_id"), F.col(vector_col).cast("array<double>").alias("v")))).withColumnRenamed("v", "q")
    n_q, size = asked.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    frame = _whole(points.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))).where(F.size("v") <= size)
    n = frame.count()
    blocks = max(1, -(-n_q // QUERY_BLOCK))
    most = max(POINT_PARTS * points.sparkSession.sparkContext.defaultParallelism, frame.rdd.getNumPartitions())
    parts = lambda pairs: min(most, 1 + pairs // PAIRS)
    one_of = isqrt(n // (16 * k))
    bound = n * n_q > PAIRS and one_of > 1
    if bound:
        some = frame.where(F.pmod(F.hash("id"), F.lit(one_of)) == 0)
        kth = _ranked(_scored(some, asked, metric, size, blocks, parts(n * n_q // one_of)), k, larger).where(F.col("rank") == k)
        asked = settled(asked.join(kth.select("query_id", F.col("score").alias("least"), F.col("id").alias("last")), "query_id", "left"))
    return _ranked(_scored(frame, asked, metric, size, blocks, parts(n * n_q), bound), k, larger)


def distinct_sources(hits: DataFrame, key: str) -> DataFrame:
    """``key, location, source, first_rank``: first places of the sources among a query's ranked hits."""
    return hits.groupBy(key, "location", "source").agg(F.min("rank").alias("first_rank"))


def sources_line(sources: DataFrame, key: str) -> DataFrame:
    """``key, line``: locations in order, without the empty ones."""
    ordered = F.array_sort(F.collect_list(F.struct("first_rank", "source", "location")))
    line = F.array_join(F.filter(F.transform(ordered, lambda s: s.location), lambda x: x != ""), ", ")
    return sources.groupBy(key).agg(line.alias("line"))
