"""Benchmark decontamination: BM25 with block-max WAND, then an overlap check.

Index: each test item is a document of lower-cased words (runs of word
characters).  A posting holds the item's BM25 impact for a word, divided by the
item's own score, so that one threshold serves items of any length: a passage
scores ``THRESHOLD`` or more if the words it shares with an item carry that
share of the item's weight.  Postings are cut into blocks of items with the
largest impact of each block.

Every passage of every text is a query: windows of ``PASSAGE`` words that
overlap by ``PART`` words, so that any copy of an indexed part lies whole in one
window; items of more words are indexed in parts.  For all passages of a group of texts the
block maxima of their words are summed; a block whose sum is below the
threshold is skipped for good.  In a block that is left, WAND moves the cursors
of the passage's posting lists to the next item for which the lists' maxima in
the block can still reach the threshold, and scores only those items.  All
items at or above the threshold are retrieved; none is dropped.

An item is a question and an answer: up to the last ``?`` that has words behind
it, or else its two halves.  A retrieved item counts as found if the passage
holds, in order, at least ``QUESTION`` of the question's and ``ANSWER`` of the
answer's word ``GRAM``-grams (of all words, if there are fewer); an item of
several parts is held against the whole text.  What is found for an item hence
never depends on the other items of its shard.

The index is broadcast in shards of at most ``SHARD_WORDS`` words, so its size
is bounded for any number of items; each shard is one more pass over the texts.

Defined cases: null or empty texts hold nothing; items without words match
nothing; repeated items and rows count as they are; a null id of an item is
kept; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _clean, _groups, _types
from .common import releasing, table

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
THRESHOLD = 0.5
QUESTION = ANSWER = 0.5
GRAM = 3
#: Words of an indexed part of an item, and of a passage beyond such a part.
PART = 128
PASSAGE = 64
#: Parts of a block at least; there are at most BLOCKS blocks in a shard.
BLOCK, BLOCKS = 4, 64
#: Words of a shard; a word's number has 21 bits, three of them are a gram's number.
SHARD_WORDS = 2_000_000
#: Windows whose block maxima are summed together.
TOGETHER = 256
GROUP_CHARS = 250_000


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of the two sides of a test item."""
    cut = text.rfind("?")
    while cut >= 0 and not WORD.search(text, cut):
        cut = text.rfind("?", 0, cut)
    words = WORD.findall(text.lower())
    if cut >= 0 and (first := WORD.findall(text[: cut + 1].lower())):
        return first, words[len(first) :]
    half = (len(words) + 1) // 2
    return words[:half], words[half:]


def grams(words: list[str]) -> list[tuple[str, ...]]:
    n = min(GRAM, len(words))
    return [tuple(words[k : k + n]) for k in range(len(words) - n + 1)] if n else []


def overlap(side: list[str], passage: list[str]) -> float:
    """Share of a side's grams that the passage holds; 1 for an empty side."""
    wanted = Counter(grams(side))
    if not wanted:
        return 1.0
    n = len(next(iter(wanted)))
    have = Counter(tuple(passage[k : k + n]) for k in range(len(passage) - n + 1))
    return sum(min(c, have[g]) for g, c in wanted.items()) / sum(wanted.values())


class Index:
    """Impacts of a shard's items by word, with the largest of each block."""

    def __init__(self, items: list[tuple[int | None, str]], parts: list[tuple[int, list[str]]], df: dict[str, int], n: int, mean: float) -> None:
        self.items = [(i, *question_and_answer(t)) for i, t in items]
        self.item_of = [item for item, _ in parts]
        self.number: dict[str, int] = {}
        postings: list[list[tuple[int, float]]] = []
        for p, (_, words) in enumerate(parts):
            norm = K1 * (1 - B + B * len(words) / mean)
            impact = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in Counter(words).items()}
            whole = sum(impact.values())
            for w, x in impact.items():
                k = self.number.setdefault(w, len(postings))
                if k == len(postings):
                    postings.append([])
                postings[k].append((p, x / whole))
        self.block = max(BLOCK, -(-len(parts) // BLOCKS))
        self.blocks = np.zeros((len(postings), max(1, -(-len(parts) // self.block))), dtype=np.float32)
        #: (word, block) -> parts in ascending order, impacts, largest impact
        self.postings: dict[tuple[int, int], tuple[list[int], list[float], float]] = {}
        for k, x in enumerate(postings):
            for p, v in x:
                found = self.postings.setdefault((k, b := p // self.block), ([], [], 0.0))
                found[0].append(p)
                found[1].append(v)
                self.postings[k, b] = (found[0], found[1], max(found[2], v))
        for at, x in self.postings.items():
            self.blocks[at] = np.nextafter(np.float32(x[2]), np.float32(2))

    def wand(self, words: list[int], block: int) -> list[tuple[int, float]]:
        """All parts of a block that score at least the threshold for a passage's distinct words."""
        lists = [self.postings[w, block] for w in words if (w, block) in self.postings]
        cursors = [[x[0][0], 0, k] for k, x in enumerate(lists)]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for item, _, k in cursors:
                bound += lists[k][2]
                if bound >= THRESHOLD - 1e-9:
                    pivot = item
                    break
            if pivot < 0:
                break
            target = pivot
            if cursors[0][0] == pivot:
                score, target = 0.0, pivot + 1
                for item, at, k in cursors:
                    if item != pivot:
                        break
                    score += lists[k][1][at]
                if score >= THRESHOLD:
                    found.append((pivot, score))
            left = []
            for c in cursors:
                if c[0] < target:
                    places, at = lists[c[2]][0], c[1]
                    n = len(places)
                    while at < n and places[at] < target:
                        at += 1
                    if at == n:
                        continue
                    c[0], c[1] = places[at], at
                left.append(c)
            cursors = left
        return found

    def in_text(self, side: list[str], known: np.ndarray, sorted_codes: dict[int, np.ndarray]) -> float:
        """As :func:`overlap`, for a whole text of ``known`` words; its grams are numbered and sorted once, in ``sorted_codes``."""
        wanted = Counter(grams(side))
        if not wanted:
            return 1.0
        n = len(next(iter(wanted)))
        code = lambda words: sum(x.astype(np.int64) << 21 * k for k, x in enumerate(words))
        if n not in sorted_codes:
            words = [known[k : len(known) - n + 1 + k] + 1 for k in range(n)] if len(known) >= n else []
            sorted_codes[n] = np.sort(code([x[np.all([y > 0 for y in words], axis=0)] for x in words])) if words else np.zeros(0, np.int64)
        own = code(np.array([[self.number.get(w, -1) + 1 for w in g] for g in wanted]).T)  # a number of 0 is in no gram of the text
        have = np.searchsorted(sorted_codes[n], own, side="right") - np.searchsorted(sorted_codes[n], own)
        return int(np.minimum(have, list(wanted.values())).sum()) / sum(wanted.values())

    def matches(self, texts: list[str]) -> list[list[tuple[int | None, float]]]:
        """For every text the items found in it with their best score."""
        out = [self._in_one(text) for text in texts]
        return [[(self.items[i][0], s) for i, s in sorted(found.items())] for found in out]

    def _in_one(self, text: str) -> dict[int, float]:
        """Item numbers with their best scores; the time is linear in the text, the memory beyond its words bounded."""
        number, size = self.number, PASSAGE + PART
        words = WORD.findall(text.lower())
        known = np.fromiter((number.get(w, -1) for w in words), np.int64, len(words))
        out: dict[int, float] = {}
        codes: dict[int, np.ndarray] = {}
        long_items: dict[int, bool] = {}  # those of several parts, decided once for the text
        starts = range(0, max(1, len(known) - size + PASSAGE), PASSAGE)
        for first in range(0, len(starts), TOGETHER):
            ids: list[np.ndarray] = []
            where: list[int] = []
            for at in starts[first : first + TOGETHER]:
                part = np.unique(known[at : at + size])
                part = part[1:] if len(part) and part[0] < 0 else part
                if len(part):
                    ids.append(part)
                    where.append(at)
            if not ids:
                continue
            firsts = np.concatenate(([0], np.cumsum([len(x) for x in ids])[:-1]))
            bounds = np.add.reduceat(self.blocks[np.concatenate(ids)], firsts, axis=0)
            reach = bounds >= THRESHOLD * (1 - 1e-4)
            for p, block in zip(*(x.tolist() for x in np.nonzero(reach)), strict=True):
                passage = words[where[p] : where[p] + size]
                for part, score in self.wand(ids[p].tolist(), block):
                    item = self.item_of[part]
                    if score <= out.get(item, 0.0):
                        continue
                    _, question, answer = self.items[item]
                    if len(question) + len(answer) <= PART:
                        held = overlap(question, passage) >= QUESTION and overlap(answer, passage) >= ANSWER
                    elif item in long_items:
                        held = long_items[item]
                    else:
                        held = long_items[item] = self.in_text(question, known, codes) >= QUESTION and self.in_text(answer, known, codes) >= ANSWER
                    if held:
                        out[item] = score
        return out


def shards(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """The index in shards of at most SHARD_WORDS words (one item at least); items are read one by one."""
    df: Counter[str] = Counter()
    n = total = 0

    def rows() -> Iterator[tuple[int | None, str, list[list[str]]]]:
        for r in benchmark.select(id_col, text_col).orderBy(id_col, text_col).toLocalIterator():
            words = WORD.findall((r[1] or "").lower())
            yield r[0], r[1] or "", [words[k : k + PART] for k in range(0, len(words), PART)]

    for _, _, parts in rows():
        for p in parts:
            df.update(set(p))
            n, total = n + 1, total + len(p)
    items: list[tuple[int | None, str]] = []
    kept: list[tuple[int, list[str]]] = []
    size = 0
    for i, text, parts in rows():
        if items and size + sum(map(len, parts)) > SHARD_WORDS:
            yield Index(items, kept, df, n, total / n)
            items, kept, size = [], [], 0
        if parts:
            kept += [(len(items), p) for p in parts]
            items.append((i, text))
            size += sum(map(len, parts))
    if items:
        yield Index(items, kept, df, n, total / n)


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, item_id, score`` for every item found in a text of ``docs``."""
    spark = docs.sparkSession
    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    schema = f"{_types(frame.select('doc_id'))}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, score double"
    out = None
    for shard in shards(benchmark):
        shared = spark.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            kind = pa.int64() if not index.items or all(i is None or isinstance(i, int) for i, _, _ in index.items) else pa.string()
            for batch in batches:
                for a, b in _groups(batch.column(1), GROUP_CHARS):
                    found = index.matches(_clean(batch.column(1).slice(a, b - a)))
                    rows = np.repeat(np.arange(a, b), [len(f) for f in found])
                    flat = [x for f in found for x in f]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([i for i, _ in flat], kind), pa.array([s for _, s in flat], pa.float64())], names=["doc_id", "item_id", "score"])

        found = frame.mapInArrow(releasing(run), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def flag(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "n_items") -> DataFrame:
    """``docs`` with the number of items found in each text."""
    names = [c for c in docs.columns if c != out]
    at = names.index(text_col)
    frame = docs.select(*names, F.lit(0).cast("long").alias(out))
    for shard in shards(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in _groups(batch.column(at), GROUP_CHARS):
                    part = batch.slice(a, b - a)
                    found = [len(f) for f in shared.value.matches(_clean(part.column(at)))]
                    before = part.column(len(names)).to_numpy()
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(before + np.array(found, dtype=np.int64))], names=[*names, out])

        frame = frame.mapInArrow(releasing(run), _types(frame))
    return frame


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of ``benchmark`` that is found in a text of ``documents``."""
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
