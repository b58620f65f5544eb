"""Groups of texts whose sets of five-word shingles are similar, by SimHash and an exact check.

Two texts are linked if the Jaccard similarity of their shingle sets (words and
hashes as in :mod:`simhash`) is at least 4/5; the groups are the connected
components.  Every link is checked on the whole sets.

1. Equal sets are one node, named by a 64-bit hash, with a 256-bit SimHash
   fingerprint of the set and ``BANDS`` keys, each made of the minima of the set
   under ``ROWS`` hash functions.  Two sets of similarity 4/5 share none of the
   32 keys with a chance of (1 - 0.8**5)**32 = 3e-6, more similar ones with less.
2. Nodes of an equal key are compared bit-sliced (:mod:`simhash`).  At a
   similarity of 4/5 about 39 of 256 bits differ, 48 for sets of five; ``RADIUS``
   lies five standard deviations beyond, and abandons what shares a line only.
   The spanning forests of what is left give candidate groups.
3. The sets of each candidate group meet in one task, every set once, which
   counts shared shingles by an inverted list and emits a spanning forest of the
   links.  A group beyond ``CHUNK`` sets is dealt out by its keys instead, and a
   key beyond that by pairs of chunks, so that a task's work is bounded.

Defined cases: texts without words (null counts as empty) have the empty set
and are equal to each other; a text of fewer than five words is one shingle;
repeated shingles count once; rows without an id or with a repeated one take
part like any other, and a group of rows without ids has a null id; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import releasing, shuffle_partitions, within, without, written
from .components import components
from .simhash import SEED, Scheme, links_by_key, print_of, shingle_hashes

SCHEME = Scheme(5, 4, 80, ())
#: Keys of a set, and hash functions of a key.
BANDS, ROWS = 32, 5
#: Sets, and shingles in them, of a candidate group or of one chunk of a key.
CHUNK, CHUNK_SHINGLES = 1024, 500_000
#: Shingles hashed at once for the keys, and texts of a batch.
HASH_ROWS, BATCH = 2048, 512

_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(text or "", SCHEME.width))


def node_of(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def keys_of(own: np.ndarray) -> np.ndarray:
    """The keys of a set; the empty set has none."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.min([((own[k : k + HASH_ROWS, None] ^ _FLIP) * _TIMES).min(axis=0) for k in range(0, len(own), HASH_ROWS)], axis=0)
    key = np.arange(BANDS, dtype=np.uint64)
    for x in least.reshape(BANDS, ROWS).T:
        key = (key ^ x) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _place(id_col: str, text_col: str) -> Column:
    """Names a row by id and text; rows that repeat both are one place."""
    return F.xxhash64(F.col(id_col).cast("string"), F.lit("\n"), F.coalesce(F.col(text_col), F.lit("")))


def _texts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for whole in batches:
        for k in range(0, whole.num_rows, BATCH):
            batch = whole.slice(k, BATCH)
            yield batch, [shingle_set(t.as_py()) for t in batch.column(at)]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, place, text): rows (doc_id, place, node, n, keys, f0, ..)."""
    for batch, sets in _texts(batches, 2):
        keys = [keys_of(s) for s in sets]
        ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
        fps = np.array([print_of(s, SCHEME.words) for s in sets], dtype=np.uint64).reshape(-1, SCHEME.words)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), lists, *(pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in range(SCHEME.words))],
            names=["doc_id", "place", "node", "n", "keys", *SCHEME.columns()],
        )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node) sorted by key: those whose key has several."""
    kept = np.zeros((2, 0), np.int64)  # the last row, which the next batch may join
    joined = False  # whether the kept row has a neighbour before it
    for batch in batches:
        rows = np.concatenate((kept, np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)])), axis=1)
        if not rows.shape[1]:
            continue
        same = rows[0, 1:] == rows[0, :-1]
        before = np.concatenate(([joined], same))
        many = before[:-1] | same
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows[:, :-1][:, many]], names=["key", "node"])
        kept, joined = rows[:, -1:], bool(before[-1])
    if joined:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept], names=["key", "node"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text): rows (node, own)."""
    for _, sets in _texts(batches, 0):
        yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "own"])


def similar_to(i: int, sizes: np.ndarray, ends: np.ndarray, group: np.ndarray, starts: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Which sets are similar to set ``i``, by the lists of the sets that hold each shingle."""
    own = group[ends[i] : ends[i + 1]]
    begin, many = starts[own], starts[own + 1] - starts[own]
    where = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    both = np.bincount(owners[where], minlength=len(sizes))
    return 9 * both >= 4 * (sizes[i] + sizes)


def spanning_links(sets: list[np.ndarray]) -> np.ndarray:
    """For every set the index of one in its component, the same for all of them.

    Sets outside the largest component are compared with all others, so that
    no link between components is left out; those within need no comparison.
    """
    root = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(root, sizes)
    order = np.argsort(values, kind="stable")
    new = np.concatenate(([True], values[order][1:] != values[order][:-1]))
    group = np.empty(len(values), np.int64)
    group[order] = np.cumsum(new) - 1
    starts, ends, owners = np.concatenate((np.nonzero(new)[0], [len(values)])), np.concatenate(([0], np.cumsum(sizes))), owner[order]
    open_ = np.ones(len(sets), bool)
    while True:
        left = np.nonzero(open_ & (root != np.bincount(root).argmax()))[0] if not open_.all() else np.array([0])
        if not len(left):
            return root
        i = int(left[0])
        open_[i] = False
        joined = np.unique(root[similar_to(i, sizes, ends, group, starts, owners)])
        root[np.isin(root, joined)] = joined.min()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, lo, hi, node, own) sorted so: links that span all links within each (key, lo, hi)."""

    def done(nodes: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(nodes) < 2:
            return
        root = spanning_links(sets)
        moved = np.nonzero(root != np.arange(len(root)))[0]
        if len(moved):
            names = np.array(nodes, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[root[moved]])], names=["a", "b"])

    at: tuple | None = None
    nodes: list[int] = []
    sets: list[np.ndarray] = []
    for batch in batches:
        for *group, node, own in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if group != at:
                yield from done(nodes, sets)
                at, nodes, sets = group, [], []
            nodes.append(node)
            sets.append(np.frombuffer(own, np.uint64))
    yield from done(nodes, sets)


def places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, place, root`` for every row: the place names id and text, equal roots are a group."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    names = SCHEME.columns()
    frame = docs.select(F.col(id_col).alias("doc_id"), _place(id_col, text_col).alias("place"), F.col(text_col).alias("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()
    every = written(frame.mapInArrow(releasing(_prints), f"doc_id {kind}, place long, node long, n long, keys array<long>, {', '.join(f'{c} long' for c in names)}"), "similar-prints")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "place")).getField("place")
    nodes = written(every.groupBy("node").agg(one.alias("place"), *(F.first(c).alias(c) for c in ("n", "keys", *names))), "similar-nodes")

    keyed = nodes.select(F.explode("keys").alias("key"), "node").repartition(parts, "key").sortWithinPartitions("key", "node")
    shared = written(keyed.mapInArrow(releasing(_shared), "key long, node long"), "similar-shared")
    own = nodes.select("node", *names)
    near = components(links_by_key(shared.join(own, "node").select("key", "node", *names), own, SCHEME), "similar-near")
    near = written(near.join(nodes.select("node", "n", "place"), "node"), "similar-candidates")

    total = near.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    large = (F.col("sets") > CHUNK) | (F.col("shingles") > CHUNK_SHINGLES)
    zero = F.lit(0).cast("long")
    small = near.join(total.where(~large), "root").select(F.col("root").alias("key"), zero.alias("lo"), zero.alias("hi"), "node")
    dealt = shared.join(near.join(total.where(large), "root").select("node", "n"), "node")
    chunks = dealt.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_SHINGLES)).alias("chunks"), F.count("*").alias("sets")).where("sets > 1")
    split = dealt.join(chunks, "key").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")))
    split = split.withColumn("other", F.explode(F.sequence(zero, F.col("chunks") - 1)))
    hot = split.select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "node")
    texts = within(frame.select("place", "text"), near.select("place"), "place").dropDuplicates(["place"]).select("text")
    sets = texts.mapInArrow(releasing(_sets), "node long, own binary")
    jobs = small.unionByName(hot).join(sets, "node").select("key", "lo", "hi", "node", "own")
    checked = jobs.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node").mapInArrow(releasing(_verify), "a long, b long")
    roots = components(written(checked, "similar-links"), "similar-roots")
    return written(every.select("doc_id", "place", "node").join(roots, "node", "left").select("doc_id", "place", F.coalesce("root", "node").alias("root")), "similar-places")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` for every row: the smallest id of its group."""
    own = places(docs, id_col, text_col)
    least = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return own.join(least, "root").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every group of ``docs``, with its columns.

    The row with the smallest id stays, or one without an id if no row of the
    group has one; of rows that share the id, the one with the smallest hash of
    id and text; of rows that repeat both, the smallest in the other columns.
    """
    own = places(docs, id_col, text_col)
    chosen = own.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "place")).getField("place").alias("place"), F.count("*").alias("rows"))
    rows = own.groupBy("place").agg(F.count("*").alias("rows"))
    single = rows.join(chosen.select("place", F.lit(True).alias("chosen")).distinct(), "place", "left")
    single = written(single.select("place", F.coalesce("chosen", F.lit(False)).alias("chosen"), (F.col("rows") > 1).alias("again")), "similar-chosen")
    at = docs.withColumn("__place", _place(id_col, text_col))
    plain = without(at, single.where("NOT chosen OR again").select(F.col("place").alias("__place")), "__place").drop("__place")
    again = within(at, single.where("chosen AND again").select(F.col("place").alias("__place")), "__place")
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    first = again.groupBy("__place").agg(F.first(id_col).alias(id_col), F.first(text_col).alias(text_col), F.min(F.struct(*others) if others else F.lit(0)).alias("__rest"))
    return plain.select(*docs.columns).unionByName(first.select(id_col, text_col, *(F.col("__rest").getField(c).alias(c) for c in others)).select(*docs.columns))
