"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: A-Z lower-cased, words cut at ASCII white space, shingles of
some words (repeats count) hashed with XXH64, seed 42; a bit of the fingerprint
is set if it is set in more than half the hashes.  A wide fingerprint has
further words of 64 bits, from the same hashes mixed with a constant.

Links: fingerprints within ``radius`` differing bits.  Distinct fingerprints
meet by keys, a fixed number of short rows per fingerprint, never a pair.  In
scheme ``EXACT`` the keys are bits of the fingerprint: within three bits, two
fingerprints agree on at least two of five bit ranges, so ten tables find every
link.

Rows of equal keys lie together; tiles of them are compared bit-sliced: the bit
planes of blocks of 64 lanes are stored vertically, a query's differences are
added plane by plane into carry-save counters, and a block is abandoned for a
query as soon as all of its lanes are beyond the radius; lanes that the query
need not meet count as beyond it from the start.  Hits are folded into a
spanning forest as they come, and a tile emits the forest, not its pairs.  A
key with more fingerprints than a tile holds is cut into chunks, and the chunks
are compared two by two in tasks of their own, so that any key is handled
exactly in bounded memory.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero and is linked like any other; equal rows share a component;
a null id takes part in links but never names a component; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import releasing, shuffle_partitions, table, written
from .components import components

SEED = 42
#: Fingerprints that are compared with each other at once.
TILE = 256
#: Fingerprints of one key beyond which the key is cut into chunks.
CHUNK = 2048
#: Rows per hashing step, which bounds the unpacked bits of a long text.
HASH_ROWS = 32_768
_EVERY = np.uint64(0xFFFFFFFFFFFFFFFF)


class Scheme(NamedTuple):
    """What a fingerprint is, and which bits key a table."""

    width: int
    words: int
    radius: int
    tables: tuple[tuple[int, ...], ...]

    def columns(self) -> list[str]:
        return [f"f{k}" for k in range(self.words)]


def _ranges() -> tuple[tuple[int, ...], ...]:
    cuts = (0, 13, 26, 39, 52, 64)
    blocks = [tuple(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return tuple(x + y for x, y in combinations(blocks, 2))


EXACT = Scheme(3, 1, 3, _ranges())


def shingle_hashes(text: str, width: int) -> np.ndarray:
    words = text.encode().lower().split()
    h = xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([h(b" ".join(words), SEED)], dtype=np.uint64)
    return np.array([h(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(width)))], dtype=np.uint64)


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    if not word:
        return hashes
    x = (hashes ^ np.uint64(word * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def fingerprint(text: str, width: int = EXACT.width, words: int = 1) -> np.ndarray:
    """The fingerprint as unsigned words."""
    return print_of(shingle_hashes(text, width), words)


def print_of(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """The fingerprint of some hashes."""
    ones = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(hashes), HASH_ROWS):
        part = np.stack([_mixed(hashes[at : at + HASH_ROWS], k) for k in range(words)], axis=1)
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, scheme: Scheme = EXACT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, f0, ..`` for every row; the columns hold 64 bits each as a signed long."""
    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = scheme.columns()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or "", scheme.width, scheme.words) for t in batch.column(1)], dtype=np.uint64).reshape(-1, scheme.words)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in range(scheme.words))], names=["doc_id", *names])

    return frame.mapInArrow(releasing(run), f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names))


# -- bit-sliced comparison ----------------------------------------------------


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of the lanes, 64 lanes a word; lanes beyond the end repeat the last."""
    n = -(-len(fps) // 64) * 64
    padded = np.concatenate((fps, np.repeat(fps[-1:], n - len(fps), axis=0)))
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


class Counters:
    """Carry-save counters of many lanes at once, one bit of all counts an array."""

    def __init__(self, radius: int, over: np.ndarray) -> None:
        """``over``: the lanes that are beyond the radius from the start."""
        self.radius, self.over = radius, over
        self.sums = [np.zeros(len(over), np.uint64) for _ in range(radius.bit_length())]
        self.waiting: list[np.ndarray | None] = [None] * len(self.sums)

    def add(self, bits: np.ndarray, level: int = 0) -> None:
        """Two arrays of a level meet its sum in one full adder and give one carry."""
        while level < len(self.sums):
            other = self.waiting[level]
            if other is None:
                self.waiting[level] = bits
                return
            self.waiting[level] = None
            own = self.sums[level]
            half = own ^ bits
            self.sums[level], bits = half ^ other, (own & bits) | (half & other)
            level += 1
        self.over |= bits

    def beyond(self) -> np.ndarray:
        """Lanes whose count exceeds the radius."""
        for level in range(len(self.waiting)):
            if self.waiting[level] is not None:
                self.add(np.zeros_like(self.over), level)
        more, same = self.over.copy(), ~self.over
        for level in range(len(self.sums) - 1, -1, -1):
            if self.radius >> level & 1:
                same &= self.sums[level]
            else:
                more |= same & self.sums[level]
                same &= ~self.sums[level]
        return more

    def keep(self, some: np.ndarray) -> None:
        """Only some of the blocks from here on; nothing may be waiting."""
        self.over = self.over[some]
        self.sums = [x[some] for x in self.sums]


class Near:
    """Pairs of fingerprints within a radius; both sides are (fingerprint, word)."""

    def __init__(self, queries: np.ndarray, lanes: np.ndarray | None, radius: int) -> None:
        """Without ``lanes``, every query meets the queries behind it."""
        self.queries, self.own, self.radius = queries, lanes is None, radius
        lanes = queries if lanes is None else lanes
        self.lanes, self.sliced = len(lanes), planes(lanes)
        #: blocks compared, and those abandoned before the last bit
        self.blocks = self.abandoned = 0

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indices (query, lane), for some queries at a time."""
        for at in range(0, len(self.queries), TILE):
            yield self._some(at, self.queries[at : at + TILE])

    def _some(self, at: int, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits, words = self.sliced.shape
        query, block = np.divmod(np.arange(len(part) * words), words)
        over = np.zeros(len(query), np.uint64)
        if self.own:  # lanes up to the query itself are masked
            behind = np.clip(query + at + 1 - 64 * block, 0, 64)
            over = np.where(behind == 64, _EVERY, (np.uint64(1) << (behind % 64).astype(np.uint64)) - np.uint64(1))
            some = over != _EVERY
            query, block, over = query[some], block[some], over[some]
        self.blocks += len(query)
        counters = Counters(self.radius, over)
        flips = np.uint64(0) - np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").T.astype(np.uint64)
        for bit in range(bits):
            counters.add(self.sliced[bit][block] ^ flips[bit][query])
            if bit % 16 == 15 and bit > 2 * self.radius and bit + 1 < bits:
                some = counters.beyond() != _EVERY
                if not some.all():
                    self.abandoned += len(some) - int(some.sum())
                    counters.keep(some)
                    query, block = query[some], block[some]
                    if not len(query):
                        break
        row, lane = np.nonzero(np.unpackbits((~counters.beyond()).view(np.uint8).reshape(len(query), 8), axis=1, bitorder="little"))
        lane = lane + 64 * block[row]
        real = lane < self.lanes
        return query[row[real]] + at, lane[real]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


Rows = tuple[np.ndarray, np.ndarray]  # nodes, fingerprints


def linked(rows: Rows, radius: int, other: Rows | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of nodes that span all links within ``rows``, or between them and ``other``."""
    nodes, fps = rows
    shift = 0
    if other is not None:
        shift, nodes = len(fps), np.concatenate((nodes, other[0]))
    root = np.arange(len(nodes))
    for q, lane in Near(fps, None if other is None else other[1], radius):
        lane = lane + shift
        new = root[q] != root[lane]
        if new.any():
            root = forest(len(nodes), np.concatenate((np.arange(len(nodes)), q[new])), np.concatenate((root, lane[new])))
    moved = np.nonzero(root != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[root[moved]]


def _columns(batch: pa.RecordBatch, first: int, scheme: Scheme) -> np.ndarray:
    return np.stack([batch.column(first + k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(scheme.words)], axis=1)


def _keys(scheme: Scheme):
    """Rows (node, f0, ..): a row (key, node, f0, ..) for every table."""
    tables = len(scheme.tables)
    names = ["key", "node", *scheme.columns()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                fps = np.ascontiguousarray(_columns(batch, 1, scheme))
                bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little").astype(np.int64)
                keys = np.stack([(bits[:, t] << np.arange(len(t))).sum(axis=1) | k << 32 for k, t in enumerate(map(list, scheme.tables))], axis=1)
                again = pa.array(np.repeat(np.arange(len(fps)), tables))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(c.take(again) for c in batch.columns)], names=names)

    return run


_LINKS = "kind int, key long, chunk long, a long, b long"


def _out(kind: int, key: np.ndarray, chunk: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(key), pa.array(chunk), pa.array(a), pa.array(b)], names=["kind", "key", "chunk", "a", "b"])


def _starts(k: np.ndarray) -> np.ndarray:
    return np.concatenate((np.nonzero(np.concatenate(([True], k[1:] != k[:-1])))[0], [len(k)])) if len(k) else np.zeros(1, int)


def _compare_sorted(scheme: Scheme):
    """Rows (key, node, f0, ..) sorted by key: links (kind 0), and rows of keys beyond a chunk (kind 1)."""

    def tiles(k: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole keys, none beyond a chunk."""
        if len(k) < 2:
            return
        same = k[1:] == k[:-1]
        many = np.concatenate((same, [False])) | np.concatenate(([False], same))
        k, nodes, fps = k[many], nodes[many], fps[many]
        starts = _starts(k)
        at = 0
        while at < len(starts) - 1:
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + TILE, side="right")) - 1)
            part = slice(starts[at], starts[to])
            own, one = np.unique(nodes[part], return_index=True)  # neighbouring keys may share fingerprints
            a, b = linked((own, fps[part][one]), scheme.radius)
            if len(a):
                yield _out(0, np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), a, b)
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, scheme.words), np.uint64))
        hot: int | None = None  # the key that is handed on, with the rows handed on so far
        handed = 0
        for batch in batches:
            new = (batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), _columns(batch, 2, scheme))
            k, nodes, fps = (np.concatenate(x) for x in zip(kept, new, strict=True))
            if not len(k):
                continue
            starts = _starts(k)
            small = np.ones(len(k), bool)
            large = np.diff(starts) > CHUNK
            if hot is not None:
                large |= k[starts[:-1]] == hot
            for g in np.nonzero(large)[0]:
                s, e = int(starts[g]), int(starts[g + 1])
                if int(k[s]) != hot:
                    hot, handed = int(k[s]), 0
                small[s:e] = False
                yield _out(1, k[s:e], (handed + np.arange(e - s)) // CHUNK, nodes[s:e], nodes[s:e])
                handed += e - s
            last = int(starts[-2])  # the last key may go on in the next batch
            ready = small.copy()
            ready[last:] = False
            yield from tiles(k[ready], nodes[ready], fps[ready])
            rest = small[last:]
            kept = (k[last:][rest], nodes[last:][rest], fps[last:][rest])
        yield from tiles(*kept)

    return run


def _compare_chunks(scheme: Scheme):
    """Rows (key, lo, hi, side, node, f0, ..) sorted so: links within a chunk or between two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        sides: tuple[list[Rows], list[Rows]] = ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            if sides[0] and (at[1] == at[2] or sides[1]):
                whole = [tuple(np.concatenate(x) for x in zip(*side, strict=True)) if side else None for side in sides]
                a, b = linked(whole[0], scheme.radius, whole[1])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            fps = _columns(batch, 5, scheme)
            change = np.nonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0))[0] + 1
            for s, e in zip([0, *change], [*change, batch.num_rows], strict=True):
                group = tuple(int(c[s]) for c in cols[:3])
                if group != at:
                    yield from done()
                    at, sides = group, ([], [])
                sides[int(cols[3][s])].append((cols[4][s:e], fps[s:e]))
        yield from done()

    return run


def links(distinct: DataFrame, scheme: Scheme = EXACT) -> DataFrame:
    """``a, b``: links between the nodes of ``distinct(node, f0, ..)`` that span all links found."""
    names = scheme.columns()
    own = distinct.select("node", *names)
    return links_by_key(own.mapInArrow(releasing(_keys(scheme)), f"key long, node long, {', '.join(f'{c} long' for c in names)}"), own, scheme)


def links_by_key(keyed: DataFrame, own: DataFrame, scheme: Scheme) -> DataFrame:
    """``a, b``: links that span all links between nodes of an equal key, for ``keyed(key, node, f0, ..)`` and ``own(node, f0, ..)``."""
    parts = shuffle_partitions(keyed.sparkSession)
    names = scheme.columns()
    found = written(keyed.repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(releasing(_compare_sorted(scheme)), _LINKS), "simhash-links")
    direct = found.where("kind = 0").select("a", "b")
    hot = found.where("kind = 1").select("key", "chunk", F.col("a").alias("node"))
    if hot.isEmpty():
        return direct
    chunks = hot.groupBy("key").agg((F.max("chunk") + 1).alias("chunks"))
    paired = hot.join(chunks, "key").select("key", "chunk", "node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    sided = paired.select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), (F.col("chunk") > F.col("other")).cast("int").alias("side"), "node")
    full = sided.join(own.select("node", *names), "node").select("key", "lo", "hi", "side", "node", *names)
    far = full.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "side", "node").mapInArrow(releasing(_compare_chunks(scheme)), "a long, b long")
    return direct.unionByName(far)


def near_duplicates(docs: DataFrame, scheme: Scheme = EXACT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``."""
    names = scheme.columns()
    prints = written(fingerprints(docs, scheme, id_col, text_col), "simhash-prints")
    distinct = prints.groupBy(*names).agg(F.min("doc_id").alias("least"))
    # nodes hold from here on, as the table is written
    node = F.col("f0") if scheme.words == 1 else F.monotonically_increasing_id()
    distinct = written(distinct.select(node.alias("node"), *names, "least"), "simhash-distinct")
    roots = components(links(distinct, scheme), "simhash-roots").withColumnRenamed("node", "member")
    grouped = distinct.join(roots, distinct.node == roots.member, "left").select(*names, "least", F.coalesce("root", "node").alias("root"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    member = written(grouped.join(named, "root").select(*names, "component_id"), "simhash-members")
    text = F.concat(*(F.lower(F.lpad(F.hex(c), 16, "0")) for c in reversed(names)))
    return prints.join(member, names).select("doc_id", text.alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"))
