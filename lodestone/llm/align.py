"""Alignment of two tokenizers' ids over a corpus, through a dictionary of groups.

Both encodings of a text spell the same bytes.  The places where a token of A
and one of B end cut them into groups, and within a group two tokens are linked
if their byte ranges overlap.  A group is named by its ids, ``a1,a2|b1``: equal
names have equal bytes and equal links.

A task reads its documents in chunks of about ``CHUNK_BYTES`` and interns the
groups of a chunk: documents keep numbers of groups and how often each occurs,
the chunk keeps one dictionary of names.  Of each distinct group the links are
expanded once, there for counting the documents that hold a pair of ids, and
once more over all chunks' dictionaries for the sums of a group's links.  These
sums come back by the group's name to the dictionaries, not to the far more
numerous groups of documents, and a chunk's documents meet its dictionary in
one bounded group.

Defined cases: texts that are null, empty or not spelt alike by both tokenizers
(a U+2581 in the text, say) have no tokens, which gives zeros and an empty
``groups``; special tokens' strings inside texts are plain text; repeated rows
count as documents of their own; null ids stay null; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import byte_level
from .bpe import _clean, _groups, public_path
from .common import releasing, table, written

#: Bytes of text of a chunk, but for a single longer document.
CHUNK_BYTES = 1_500_000


class Pieces:
    """Ids of a ``sentencepiece`` file and the bytes that each spells."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        named = ((self.model.id_to_piece(i), self.model.is_byte(i)) for i in range(self.model.vocab_size()))
        self.names = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in named]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int32)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values in the place of others."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x


class Side:
    """One tokenizer's ids in a row, cut into groups."""

    def __init__(self, ids: np.ndarray, last: np.ndarray) -> None:
        self.ids = ids
        self.stop = np.nonzero(last)[0].astype(np.int32) + np.int32(1)
        self.start = np.concatenate(([0], self.stop))[:-1].astype(np.int32)
        self.n = self.stop - self.start

    def _place(self) -> np.ndarray:
        """Of every id, its place in its group."""
        at = np.arange(len(self.ids), dtype=np.int32)
        at -= np.repeat(self.start, self.n)
        return at

    def hashed(self, seed: int) -> np.ndarray:
        if not len(self.ids):
            return np.zeros(0, np.uint64)
        code = self.ids.astype(np.uint64)
        code <<= np.uint64(32)
        code += self._place().astype(np.uint64) * np.uint64(2) + np.uint64(seed)
        code *= np.uint64(0x9E3779B97F4A7C15)
        return np.add.reduceat(_mixed(code), self.start)

    def like(self, model: np.ndarray) -> bool:
        """Whether every group has the ids of the group that ``model`` names for it."""
        if not np.array_equal(self.n, self.n[model]):
            return False
        at = self._place()
        at += np.repeat(self.start[model], self.n)
        return np.array_equal(self.ids, self.ids[at])

    def of(self, group: int) -> list[int]:
        return self.ids[self.start[group] : self.stop[group]].tolist()


def interned(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """A first occurrence of each distinct group, and for every group the number of its like."""
    _, first, like = np.unique(a.hashed(0) + b.hashed(1), return_index=True, return_inverse=True)
    like = like.reshape(-1)
    if a.like(first[like]) and b.like(first[like]):
        return first, like
    seen: dict[tuple, int] = {}  # two groups with one hash: tell them apart by their ids
    like = np.array([seen.setdefault((*a.of(g), -1, *b.of(g)), len(seen)) for g in range(len(a.n))], np.int64)
    return np.unique(like, return_index=True)[1], like


def links(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> list[tuple[int, int]]:
    """The pairs of a group's tokens whose bytes overlap, in order."""
    if len(a) == 1 or len(b) == 1:
        return [(x, y) for x in a for y in b]
    out, i, j = [(a[0], b[0])], 0, 0
    end_a, end_b = size_a[a[0]], size_b[b[0]]
    while i < len(a) - 1 or j < len(b) - 1:
        if end_a < end_b:
            i += 1
            end_a += size_a[a[i]]
        else:
            j += 1
            end_b += size_b[b[j]]
        out.append((a[i], b[j]))
    return out


class Chunk:
    """The groups of some texts."""

    def __init__(self, texts: list[str], path_a: str, path_b: str) -> None:
        self.a_model, self.b_model = byte_level.loaded(path_a), pieces(path_b)
        self.size_a, self.size_b = ([len(x) for x in m.names] for m in (self.a_model, self.b_model))
        ids_a, ids_b = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        self.n_a, self.n_b = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text and (found := self._both(text)):
                self.n_a[i], self.n_b[i] = map(len, found)
                ids_a.append(found[0])
                ids_b.append(found[1])
        ids_a, ids_b = np.concatenate(ids_a), np.concatenate(ids_b)
        ends_a, ends_b = np.cumsum(np.array(self.size_a)[ids_a]), np.cumsum(np.array(self.size_b)[ids_b])
        ends = np.zeros((2, int(ends_a[-1]) + 1 if len(ends_a) else 1), bool)
        ends[0][ends_a], ends[1][ends_b] = True, True
        self.a, self.b = Side(ids_a, ends[1][ends_a]), Side(ids_b, ends[0][ends_b])
        self.first, self.like = interned(self.a, self.b)
        #: number of the first group of every text, and of all
        self.rows = np.concatenate(([0], np.searchsorted(self.a.stop, np.cumsum(self.n_a), side="right")))
        self.names = [",".join(map(str, self.a.of(g))) + "|" + ",".join(map(str, self.b.of(g))) for g in self.first.tolist()]

    def _both(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        meant = (" " + text).encode()
        spelt = lambda ids, names: b"".join(map(names.__getitem__, ids.tolist())) == meant
        a, b = self.a_model.encode(" " + text, special=False), self.b_model.encode(text)
        return (a, b) if spelt(b, self.b_model.names) and spelt(a, self.a_model.names) else None

    def groups(self) -> list[str]:
        """The names of each text's groups in their order."""
        return [";".join(map(self.names.__getitem__, self.like[s:e].tolist())) for s, e in zip(self.rows[:-1], self.rows[1:], strict=True)]

    def occurrences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's distinct groups begin, their numbers, and how often each occurs in the text."""
        doc = np.repeat(np.arange(len(self.n_a)), np.diff(self.rows))
        code, times = np.unique(doc * max(1, len(self.first)) + self.like, return_counts=True)
        doc, group = np.divmod(code, max(1, len(self.first)))
        return np.searchsorted(doc, np.arange(len(self.n_a) + 1)), group, times

    def documents_by_pair(self, rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of ids and the number of texts in which each is linked."""
        number: dict[tuple[int, int], int] = {}
        held, stop = [], [0]
        for g in self.first.tolist():
            held += dict.fromkeys(number.setdefault(p, len(number)) for p in links(self.a.of(g), self.b.of(g), self.size_a, self.size_b))
            stop.append(len(held))
        held, stop = np.array(held, np.int64), np.array(stop)
        n = np.diff(stop)[group]
        pair = held[np.repeat(stop[group] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        doc = np.repeat(np.repeat(np.arange(len(rows) - 1), np.diff(rows)), n)
        once = np.unique(doc * max(1, len(number)) + pair) % max(1, len(number))
        a, b = np.array(list(number), np.int32).reshape(-1, 2).T
        return a, b, np.bincount(once, minlength=len(number))


def _lists(values: np.ndarray, stop: np.ndarray, kind: pa.DataType = pa.int32()) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(stop.astype(np.int32)), pa.array(values).cast(kind))


SCHEMA = "chunk long, {id}, n_a long, n_b long, n_groups long, groups string, held array<int>, times array<int>, names array<string>, pairs array<struct<a: int, b: int, docs: long>>"


def grouped(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every document and, with ``names`` and ``pairs``, one for every chunk.

    ``groups`` spells a document's groups in their order; ``held`` has the
    places of its distinct groups among the chunk's ``names``, ``times`` their
    occurrences.
    """
    frame = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = SCHEMA.format(id=f"`{id_col}` {frame.schema[0].dataType.simpleString()}")
    order = ["chunk", id_col, "n_a", "n_b", "n_groups", "groups", "held", "times", "names", "pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for s, e in _groups(batch.column(1), CHUNK_BYTES):
                own = batch.column(0).slice(s, e - s)
                chunk = Chunk(_clean(batch.column(1).slice(s, e - s)), path_a, path_b)
                rows, held, times = chunk.occurrences()
                a, b, n = chunk.documents_by_pair(rows, held)
                null = lambda kind, size=e - s: pa.nulls(size, kind)
                pair = pa.StructArray.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "docs"])
                names = pa.ListArray.from_arrays(pa.array([0, len(chunk.names)], pa.int32()), pa.array(chunk.names, pa.string()))
                pairs = pa.ListArray.from_arrays(pa.array([0, len(pair)], pa.int32()), pair)
                at = lambda size: pa.array(np.full(size, number, np.int64))
                texts = pa.array(chunk.groups(), pa.string())
                counts = [pa.array(x) for x in (chunk.n_a, chunk.n_b, np.diff(chunk.rows).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([at(e - s), own, *counts, texts, _lists(held, rows), _lists(times, rows), null(names.type), null(pairs.type)], names=order)
                whole = pa.int32()
                yield pa.RecordBatch.from_arrays([at(1), null(own.type, 1), *(null(pa.int64(), 1) for _ in range(3)), null(pa.string(), 1), null(pa.list_(whole), 1), null(pa.list_(whole), 1), names, pairs], names=order)
                number += 1

    return frame.mapInArrow(releasing(run), schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``a, b, docs, best``: the documents in which a pair is linked, and the most that any pair of the same ``a`` has."""
    one = rows.where("pairs IS NOT NULL").select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    return one.withColumn("best", F.max("docs").over(Window.partitionBy("a")))  # at most B's vocabulary in a group


def expanded(names: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``name, a, b`` for every link of every distinct ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_a, size_b = ([len(x) for x in m.names] for m in (byte_level.loaded(path_a), pieces(path_b)))
        for batch in batches:
            for s, e in _groups(batch.column(0), 250_000):
                sides = [[list(map(int, side.split(","))) for side in name.split("|")] for name in batch.column(0).slice(s, e - s).to_pylist()]
                found = [links(a, b, size_a, size_b) for a, b in sides]
                name = batch.column(0).slice(s, e - s).take(pa.array(np.repeat(np.arange(e - s), [len(x) for x in found])))
                a, b = np.array([p for x in found for p in x], np.int32).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([name, pa.array(a), pa.array(b)], names=["name", "a", "b"])

    return names.select("name").mapInArrow(releasing(run), "name string, a int, b int")


def scored(rows: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id") -> DataFrame:
    """The documents of written :func:`grouped` rows with ``n_best`` and ``count_sum`` of their links; ``groups`` may be anything."""
    names = rows.where("names IS NOT NULL").select("chunk", F.posexplode("names").alias("place", "name"))
    held = expanded(names.select("name").distinct(), path_a, path_b).join(pair_counts(rows), ["a", "b"])
    sums = held.groupBy("name").agg(F.sum((F.col("docs") == F.col("best")).cast("long")).alias("n_best"), F.sum("docs").alias("count_sum"))
    back = names.join(sums, "name").select(F.col("chunk").alias("chunk"), "place", "n_best", "count_sum")  # a new name: both sides come from the same rows
    documents = rows.where("held IS NOT NULL").drop("names", "pairs")
    kept = [c for c in documents.columns if c not in ("chunk", "held", "times")]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*kept).schema.fields]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, place = left.combine_chunks(), right.column("place").to_numpy()
        held, times = (left.column(c).combine_chunks() for c in ("held", "times"))
        n = held.value_lengths().to_numpy(zero_copy_only=False)
        group, times = held.flatten().to_numpy(), times.flatten().to_numpy()
        stop = np.cumsum(n)
        out = left.select(kept)
        for c in ("n_best", "count_sum"):
            value = np.zeros(int(place.max()) + 1 if len(place) else 1, np.int64)
            value[place] = right.column(c).to_numpy()
            upto = np.concatenate(([0], np.cumsum(value[group] * times)))
            out = out.append_column(c, pa.array(upto[stop] - upto[stop - n]))
        return out

    return documents.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(run, ", ".join([*kinds, "n_best long", "count_sum long"]))


def op12_alignment(spark: SparkSession, sf_dir: str, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Aligns the two tokenizers over every document; digests of the groups, counts of the links."""
    path_a, path_b = path_a or public_path("byte_bpe_50k.json"), path_b or public_path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = grouped(docs, path_a, path_b)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    rows = written(found.withColumn("groups", digest).withColumnRenamed("groups", "groups_sha256"), "alignment")
    links_ = (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links")
    return scored(rows, path_a, path_b).select("doc_id", "n_a", "n_b", "n_groups", links_, "n_best", "count_sum", "groups_sha256")
