"""Removal of byte strings that also occur elsewhere, by suffix arrays.

A byte goes if a string of ``SIZE`` bytes that covers it also starts anywhere
else, in the same document or another one; strings are judged on the input and
never cross documents.

1. Equal texts are one row with a count (partial counts before the shuffle),
   kept as a table bucketed by its key, so that later joins do not move texts.
2. Anchors: in every ``SIZE`` bytes the smallest hash of a ``GRAM``-byte string
   marks a place (winnowing; of near ties only as many as cover all windows).
   Equal strings hold an anchor of equal hash at the same offset, so the
   *context* of an anchor, the bytes of all strings that hold it, is all that
   must be compared, and only with contexts of equal anchors.  Anchors are kept
   as (hash of the anchor, hash of the context, text key, position); counts are
   combined before the shuffle, and joined back where a hot one can be split.
3. Contexts that occur more than once are repeated as a whole, whatever their
   number.  One context of each kind is fetched if its anchor has several
   kinds; equal anchors go to the same task, which sorts the suffixes of its
   contexts by the difference-cover algorithm (triples, names, recursion,
   merge) and compares adjacent prefixes.  This deals the corpus out by
   content instead of by rank: sorting all suffixes of the corpus in one order
   would shuffle every byte as a row of ranks at each level of the recursion.
4. An anchor with more kinds of contexts than a task sorts is dealt out by the
   strings themselves, so that no group is bounded or dropped.

Contexts of one anchor count as equal if their XXH3 hashes of 64 bits, lengths
and offsets agree, the strings of step 4 if their XXH3 hashes of 128 bits do;
the anchors' own hashes only bring together what is then compared.  Text keys
are 64-bit hashes, too; should two different texts share one, another
seed is taken.

Defined cases: a null text counts as empty; texts shorter than ``SIZE`` bytes
stay as they are; repeated rows count as different places, ids play no part
and may be null or repeat; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _groups
from .common import releasing, shared_dir, shuffle_partitions, table, written
from .difference_cover import long_prefixes, suffix_array

SIZE = 200
GRAM = 64
#: Anchors that one string may hold.
WINDOW = SIZE - GRAM + 1
#: Bytes of a context before its anchor; behind the anchor's start come SIZE.
BEFORE = WINDOW - 1
#: Bytes hashed at once, and the strings of a long text that are treated together.
GROUP_BYTES = 1 << 20
SEGMENT = 1 << 18
#: Bytes of texts whose results are held together.
APPLY_BYTES = 2_000_000
#: Ways to key the texts whose keys clash.
MAX_SEED = 64
#: Contexts of one anchor that a task sorts, and symbols that are sorted together.
KINDS = 2048
SYMBOLS = 700_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of substrings from prefix sums, modulo 2**64."""

    def __init__(self, size: int) -> None:
        self.of_byte = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        self.up = np.ones(size + 1, np.uint64)
        self.down = np.ones(size + 1, np.uint64)
        self.up[1:], self.down[1:] = _BASE, inverse
        np.multiply.accumulate(self.up, out=self.up)
        np.multiply.accumulate(self.down, out=self.down)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.of_byte[data] * self.up[: len(data)], out=out[1:])
        return out


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over each ``width`` neighbours, from every position with that many behind it."""
    size = 1
    while 2 * size <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def thinned(at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which anchors to keep so that no window loses all of its equal smallest ones."""
    keep = np.ones(len(at), dtype=bool)
    tied = np.nonzero((value[1:] == value[:-1]) & (np.diff(at) <= WINDOW))[0]
    if not len(tied):
        return keep
    for run in np.split(tied, np.nonzero(np.diff(tied) > 1)[0] + 1):
        i, last = int(run[0]), int(run[-1]) + 1
        keep[i + 1 : last] = False
        places = at[i : last + 1]
        k = 0
        while k < len(places) - 1:
            k = max(k + 1, int(np.searchsorted(places, places[k] + WINDOW, side="right")) - 1)
            keep[i + k] = True
    return keep


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: Hashes, first: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Anchors of the texts ``data[starts:ends]``: (text, position in data, anchor hash, context hash).

    ``first`` and ``last`` bound, where given, the strings by their starts.
    """
    first = starts if first is None else first
    last = np.maximum(ends - SIZE + 1, starts) if last is None else last
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    n = len(data)
    if n < SIZE:
        return none
    sums = hashes.sums(data)
    places = np.arange(n - GRAM + 1)
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * hashes.down[places])
    least = sliding(grams, WINDOW, np.minimum)  # of the string that starts there
    step = np.zeros(n + 2, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, np.maximum(last, first), -1)
    valid = np.cumsum(step)[: len(least)] > 0
    of_windows = np.zeros(len(grams) + WINDOW - 1, np.uint64)
    of_windows[WINDOW - 1 : WINDOW - 1 + len(least)] = np.where(valid, least, np.uint64(0))
    at = np.nonzero((sliding(of_windows, WINDOW, np.maximum) == grams) & (grams != 0))[0]
    if not len(at):
        return none
    text = np.searchsorted(starts, at, side="right") - 1
    keep = thinned(at, grams[at])
    at, text = at[keep], text[keep]
    lo, hi = np.maximum(at - BEFORE, starts[text]), np.minimum(at + SIZE, ends[text])
    view = memoryview(data)
    own = np.fromiter((xxhash.xxh3_64_intdigest(view[x:y]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)), np.uint64, len(at))
    context = mix(own ^ mix(((hi - lo) << 16 | (at - lo)).astype(np.uint64)))
    return text, at, grams[at], context


def anchors_of_column(column: pa.Array, hashes: Hashes) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, position, anchor hash, context hash) of the texts of a binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + GROUP_BYTES, side="right")) - 1)
        base = offsets[row]
        if offsets[to] - base <= GROUP_BYTES:
            text, at, a, c = anchors(data[base : offsets[to]], offsets[row:to] - base, offsets[row + 1 : to + 1] - base, hashes)
            yield text + row, at - (offsets[row:to] - base)[text], a, c
        else:  # one long text, some of its strings at a time
            size, found = int(offsets[to] - base), []
            for s in range(0, size - SIZE + 1, SEGMENT):
                lo, hi = max(0, s - BEFORE), min(size, s + SEGMENT + 2 * SIZE)
                part = data[base + lo : base + hi]
                _, at, a, c = anchors(part, np.array([0]), np.array([len(part)]), hashes, np.array([s - lo]), np.array([min(s + SEGMENT, size - SIZE + 1) - lo]))
                found.append((at + lo, a, c))
            at, one = np.unique(np.concatenate([x[0] for x in found]), return_index=True)
            yield np.full(len(at), row), at, np.concatenate([x[1] for x in found])[one], np.concatenate([x[2] for x in found])[one]
        row = to


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text): rows (a, c, key, pos)."""
    hashes = Hashes(GROUP_BYTES)
    for batch in batches:
        keys = batch.column(0).to_numpy()
        for row, at, a, c in anchors_of_column(batch.column(1), hashes):
            yield pa.RecordBatch.from_arrays([_long(a), _long(c), _long(keys[row]), pa.array(at.astype(np.int32))], names=["a", "c", "key", "pos"])


def judge_anchors(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From the anchors ``a, c, key, pos``: places of contexts that repeat, and kinds to compare.

    The first has ``key, pos`` of every place of a context that occurs more than
    once; the second ``a, key, pos, twin, kinds``, one place of each kind of
    context whose anchor has several kinds (``twin``: it occurs more than once).
    """
    # a table of its own, so that adaptive execution can split the join with a hot anchor
    again = written(marked.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"), "substrings-again")
    cand = written(marked.join(again, "a"), "substrings-anchors")
    kinds = written(cand.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("key", "pos")).alias("at")), "substrings-kinds")
    places = cand.join(kinds.where("n > 1").select("a", "c"), ["a", "c"]).select("key", "pos")
    several = kinds.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1")
    return places, kinds.join(several, "a").select("a", "at.key", "at.pos", (F.col("n") > 1).alias("twin"), "kinds")


def _fetch_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text, places): rows (a, key, lo, twin, context)."""
    for batch in batches:
        for r in range(batch.num_rows):
            key, text = batch.column(0)[r].as_py(), memoryview(batch.column(1)[r].as_buffer())
            places = batch.column(2)[r].values
            pos = places.field("pos").to_numpy()
            lo = np.maximum(pos - BEFORE, 0)
            contexts = [bytes(text[x : p + SIZE]) for x, p in zip(lo, pos, strict=True)]
            yield pa.RecordBatch.from_arrays([places.field("a"), pa.array(np.full(len(pos), key)), pa.array(lo.astype(np.int32)), places.field("twin"), pa.array(contexts, pa.binary())], names=["a", "key", "lo", "twin", "context"])


Context = tuple[int, int, bool, bytes]  # key, lo, twin, bytes


def repeated_strings(contexts: list[Context]) -> tuple[np.ndarray, np.ndarray]:
    """Places (index of the context, offset) of the strings that start in two places of the corpus."""
    sizes = np.array([len(c[3]) for c in contexts])
    total = int(sizes.sum())
    data = np.frombuffer(b"".join(c[3] for c in contexts), np.uint8)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    begin = np.cumsum(sizes) - sizes
    # a symbol of its own ends every context
    symbols = np.empty(total + len(contexts), dtype=np.int64)
    spread = np.arange(total) + owner
    symbols[spread] = data.astype(np.int64) + 1
    symbols[begin + np.arange(len(contexts)) + sizes] = 257 + np.arange(len(contexts))
    order = suffix_array(symbols)
    back = np.full(len(symbols), -1, dtype=np.int64)
    back[spread] = np.arange(total)
    order = back[order]
    order = order[order >= 0]
    offset = order - begin[owner[order]]
    order = order[offset + SIZE <= sizes[owner[order]]]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    group = np.concatenate(([0], np.cumsum(~long_prefixes(data, order, SIZE))))
    own = owner[order]
    offset = order - begin[own]
    key = np.unique(np.array([c[0] for c in contexts]), return_inverse=True)[1]
    place = key[own].astype(np.int64) << 40 | (np.array([c[1] for c in contexts])[own] + offset)
    firsts = np.concatenate(([0], np.nonzero(np.diff(group))[0] + 1))
    more = np.minimum.reduceat(place, firsts) != np.maximum.reduceat(place, firsts)  # contexts of one text may overlap
    more |= np.maximum.reduceat(np.array([c[2] for c in contexts], dtype=np.int8)[own], firsts) > 0
    hit = more[group]
    return own[hit], offset[hit]


def runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals; touching ones are one run."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    cut = np.concatenate(([True], lo[1:] > reach[:-1])) if len(lo) else np.zeros(0, bool)
    return lo[cut], reach[np.concatenate((np.nonzero(cut)[0][1:] - 1, [len(lo) - 1]))] if len(lo) else reach


def _sort_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, key, lo, twin, context) sorted by a: spans (key, lo, hi) of the strings that start in two places."""

    def spans(contexts: list[Context]) -> Iterator[pa.RecordBatch]:
        own, offset = repeated_strings(contexts)
        keep = ~np.array([c[2] for c in contexts], dtype=bool)[own]  # contexts that repeat go as a whole
        own, offset = own[keep], offset[keep]
        if not len(own):
            return
        key, lo = np.array([c[0] for c in contexts])[own], np.array([c[1] for c in contexts])[own] + offset
        order = np.lexsort((lo, key))
        key, lo = key[order], lo[order]
        cut = np.concatenate(([True], (key[1:] != key[:-1]) | (lo[1:] > lo[:-1] + SIZE)))
        ends = np.concatenate((np.nonzero(cut)[0][1:] - 1, [len(lo) - 1]))
        yield pa.RecordBatch.from_arrays([pa.array(key[cut]), pa.array(lo[cut].astype(np.int32)), pa.array((lo[ends] + SIZE).astype(np.int32))], names=["key", "lo", "hi"])

    ready: list[Context] = []
    group: list[Context] = []
    ready_size = group_size = 0
    at = None
    for batch in batches:
        for a, *context in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if a != at:
                if ready and ready_size + group_size > SYMBOLS:
                    yield from spans(ready)
                    ready, ready_size = [], 0
                ready += group
                ready_size += group_size
                group, group_size, at = [], 0, a
            group.append(tuple(context))
            group_size += len(context[3]) + 1
    if ready and ready_size + group_size > SYMBOLS:
        yield from spans(ready)
        ready = []
    if ready or group:
        yield from spans(ready + group)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, lo, twin, context): every string of a context by the two halves of its hash."""
    for batch in batches:
        for key, lo, twin, context in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            n = len(context) - SIZE + 1
            if n <= 0:
                continue
            view, at = memoryview(context), np.arange(n)
            halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[k : k + SIZE]) for k in range(n)), np.int64).reshape(n, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])), pa.array(np.full(n, key)), pa.array((lo + at).astype(np.int32)), pa.array(np.full(n, twin))],
                names=["s", "r", "key", "lo", "twin"],
            )


def _strings_elsewhere(hot: DataFrame) -> DataFrame:
    """``key, lo, hi`` of the strings in ``hot`` contexts that start in two places."""
    strings = written(hot.select("key", "lo", "twin", "context").mapInArrow(releasing(_strings), "s long, r long, key long, lo int, twin boolean"), "substrings-strings")
    place = F.struct("key", "lo")
    found = strings.groupBy("s", "r").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.max("twin").alias("t")).where("x <> y OR t").select("s", "r")
    return strings.where("NOT twin").join(found, ["s", "r"]).select("key", "lo", (F.col("lo") + SIZE).alias("hi")).distinct()


def _text(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _keyed(texts: DataFrame, seed: int) -> str:
    """A bucketed table ``key, text, n, sha, clash``, a row for each 64-bit key; ``clash``: several texts have it."""
    spark = texts.sparkSession
    name = f"lodestone_texts_{uuid.uuid4().hex}"
    kept = texts.select(F.xxhash64(F.lit(seed), "text").alias("key"), F.col("text").cast("binary").alias("text"), F.sha2("text", 256).alias("sha"))
    kept = kept.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("n"), F.min("sha").alias("sha"), (F.min("sha") != F.max("sha")).alias("clash"))
    kept.write.format("parquet").option("compression", "zstd").bucketBy(shuffle_partitions(spark), "key").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return name


def distinct_texts(texts: DataFrame, size: int = SIZE) -> list[str]:
    """Names of tables that hold, by keys of their own, the distinct texts of at least ``size`` bytes; see :func:`texts_of`.

    Texts whose keys clash, a few in 10**10, are keyed anew in a further table;
    no other text is written again.
    """
    spark = texts.sparkSession
    left = texts.where(F.octet_length("text") >= size)
    names = [_keyed(left, 0)]
    seed = 0
    while not (clash := spark.table(names[-1]).where("clash").select("key")).isEmpty():
        left = left.withColumn("key", F.xxhash64(F.lit(seed), "text")).join(clash, "key", "left_semi").drop("key")
        seed += 1
        while True:  # until no new key is one of another table
            extra = _keyed(left, seed)
            if all(spark.table(extra).join(spark.table(n), "key", "left_semi").isEmpty() for n in names):
                break
            seed += 1
            if seed > MAX_SEED:
                raise RuntimeError("no seed tells the texts apart")
        names.append(extra)
        if seed > MAX_SEED:
            raise RuntimeError("no seed tells the texts apart")
    return names


def texts_of(spark: SparkSession, names: list[str]) -> DataFrame:
    """``key, text, n, sha`` of all distinct texts."""
    first, *rest = (spark.table(n).where("NOT clash").drop("clash") for n in names)
    for more in rest:
        first = first.unionByName(more)
    return first


def find_spans(texts: DataFrame) -> DataFrame:
    """``key, spans array<struct<lo, hi>>`` of the distinct texts that share strings with other places."""
    spark = texts.sparkSession
    parts = shuffle_partitions(spark)
    marked = written(texts.select("key", "text").mapInArrow(releasing(_find_anchors), "a long, c long, key long, pos int"), "substrings-marked")
    repeating, kinds = judge_anchors(marked)
    kinds = written(kinds, "substrings-compared")

    def contexts(some: DataFrame) -> DataFrame:
        places = some.groupBy("key").agg(F.collect_list(F.struct("pos", "a", "twin")).alias("places"))
        return texts.select("key", "text").join(places, "key").select("key", "text", "places").mapInArrow(releasing(_fetch_contexts), "a long, key long, lo int, twin boolean, context binary")

    sorted_ones = contexts(kinds.where(F.col("kinds") <= KINDS)).repartition(parts, "a").sortWithinPartitions("a").mapInArrow(releasing(_sort_contexts), "key long, lo int, hi int")
    # spans beyond a text's end are cut when they are applied
    spans = repeating.select("key", F.greatest(F.col("pos") - BEFORE, F.lit(0)).alias("lo"), (F.col("pos") + SIZE).alias("hi")).unionByName(sorted_ones)
    hot = kinds.where(F.col("kinds") > KINDS)
    if not hot.isEmpty():
        spans = spans.unionByName(_strings_elsewhere(contexts(hot)))
    return spans.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _apply(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in _groups(whole.column(1), APPLY_BYTES)):
            out: list[list] = [[], [], [], []]
            for r in range(batch.num_rows):
                text, spans = batch.column(1)[r].as_buffer(), batch.column(3)[r].values
                size = text.size
                if batch.column(2)[r].as_py() > 1:
                    lo, hi = np.array([0]), np.array([size])
                elif spans is None:
                    lo = hi = np.zeros(0, np.int64)
                else:
                    lo, hi = spans.field("lo").to_numpy().astype(np.int64), np.minimum(spans.field("hi").to_numpy(), size).astype(np.int64)
                    some = hi - lo >= SIZE
                    lo, hi = runs(lo[some], hi[some])
                view = memoryview(text)
                kept = b"".join(view[a:b] for a, b in zip([0, *hi], [*lo, size], strict=True))
                for column, x in zip(out, (int((hi - lo).sum()), len(lo), hashlib.sha256(kept).hexdigest(), _whole_chars(view, lo, hi) if with_text else None), strict=True):
                    column.append(x)
            arrays = [batch.column(4), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["sha", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _whole_chars(text: memoryview, lo: np.ndarray, hi: np.ndarray) -> str:
    """What is left if a character goes only when all of its bytes go."""
    parts, at = [], 0
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        while a < b and text[a] & 0xC0 == 0x80:  # its first byte stays
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:  # its last byte stays
            b -= 1
        parts.append(bytes(text[at:a]))
        at = b
    return b"".join([*parts, bytes(text[at:])]).decode()


def repeated(docs: DataFrame, text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``sha, n_removed, n_spans, kept_sha256, kept`` for every distinct text that loses bytes.

    ``sha`` is the SHA-256 of the text; ``kept`` is null unless ``with_text``,
    and then holds the text without the characters that go as a whole.
    """
    texts = texts_of(docs.sparkSession, distinct_texts(docs.select(_text(text_col).alias("text"))))
    joined = texts.join(find_spans(texts), "key", "left").where("n > 1 OR spans IS NOT NULL").select("key", "text", "n", "spans", "sha")
    return written(joined.mapInArrow(releasing(_apply(with_text)), "sha string, n_removed long, n_spans long, kept_sha256 string, kept string").where("n_removed > 0"), "substrings-kept")


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``."""
    lost = repeated(docs, text_col).drop("kept")
    own = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(_text(text_col)).cast("long").alias("n_bytes"), F.sha2(_text(text_col), 256).alias("sha"))
    zero = F.lit(0).cast("long")
    return own.join(lost, "sha", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without the strings of 200 bytes that occur elsewhere."""
    return remove_repeated(table(spark, sf_dir, "documents"))
