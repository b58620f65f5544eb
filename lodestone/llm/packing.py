"""Packing of documents into sequences by best-fit decreasing.

A document is its tokens and one end id.  Overlong documents are first cut into
full windows; what is left of each goes, longest first, into the tightest open
window that holds it, which a segment tree indexed by remaining capacity finds
in as many steps as the window has bits.  Two steps then take the rest of the
padding: windows with a gap of more than ``SLACK`` ids are filled up with what
the emptiest windows hold, and what no window takes becomes sequences whose
lengths are powers of two, which need no padding.

Every task packs the documents it reads, about ``GROUP_TOKENS`` ids at a time:
nothing is shuffled, and a task that is run again numbers its sequences as
before.  A group is bounded by its ids, whatever the number of documents; a
longer document is a group of its own.

Defined cases: a null text counts as empty, and an empty one is its end id
alone; repeated rows are packed once each, under the id they share; null ids
stay null; an empty table gives no pieces; other columns are ignored.  Equal
lengths are placed in the order of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _clean, _groups, public_path
from .byte_level import loaded
from .common import releasing, table

WINDOW = 1024
#: Ids that a window may go without and still count as filled.
SLACK = 8
#: Ids and bytes of text that are packed together at most, but for a single document.
GROUP_TOKENS = 4_000_000
GROUP_BYTES = 8_000_000
END = 0


class Capacities:
    """Open windows by remaining capacity: a segment tree of which nodes have any below."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        at = capacity + self.leaves
        while at and not self.some[at]:
            self.some[at] = 1
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that an open window has."""
        some, at = self.some, least + self.leaves
        while not some[at]:
            while at & 1:  # a right child: what comes next lies right of its parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if some[2 * at] else 2 * at + 1
        return at - self.leaves

    def take(self, capacity: int) -> int:
        window = self.open[capacity].pop()
        if not self.open[capacity]:
            at = capacity + self.leaves
            self.some[at] = 0
            while at > 1 and not self.some[at ^ 1]:
                at >>= 1
                self.some[at] = 0
        return window


Piece = tuple[int, int, int]  # document, start, length


def best_fit(pieces: list[Piece], window: int) -> list[list[Piece]]:
    """Pieces no longer than a window, longest first, each in the tightest window that is open."""
    out: list[list[Piece]] = []
    tree = Capacities(window)
    for piece in sorted(pieces, key=lambda p: -p[2]):
        room = tree.tightest(piece[2])
        if room is None:
            at, room = len(out), window
            out.append([])
        else:
            at = tree.take(room)
        out[at].append(piece)
        if room > piece[2]:
            tree.put(room - piece[2], at)
    return out


def _held(pieces: list[Piece]) -> int:
    return sum(n for _, _, n in pieces)


def filled_up(windows: list[list[Piece]], window: int, slack: int) -> list[list[Piece]]:
    """The windows with gaps of up to ``slack`` only, and sequences of powers of two from what the emptiest held."""
    done = [w for w in windows if window - _held(w) <= slack]
    gaps = sorted((w for w in windows if window - _held(w) > slack), key=_held)
    spare: list[Piece] = []
    while gaps:
        if not spare:
            spare = sorted(gaps.pop(0), key=lambda p: -p[2])
            continue
        target = gaps[-1]
        doc, start, n = spare.pop()  # the shortest first, so that long pieces stay whole
        room = window - _held(target)
        target.append((doc, start, min(n, room)))
        if n > room:
            spare.append((doc, start + room, n - room))
        if window - _held(target) <= slack:
            done.append(gaps.pop())
    return done + powers_of_two(spare)


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces in a row, cut into sequences by the binary digits of their length."""
    total, out = _held(pieces), []
    rest = sorted(pieces, key=lambda p: p[2])
    for bit in reversed(range(total.bit_length())):
        room = total & (1 << bit)
        if not room:
            continue
        now: list[Piece] = []
        while room:
            doc, start, n = rest.pop()
            now.append((doc, start, min(n, room)))
            if n > room:
                rest.append((doc, start + room, n - room))
            room -= now[-1][2]
        out.append(now)
    return out


def packed(lengths: list[int], window: int = WINDOW, slack: int = SLACK) -> list[list[Piece]]:
    """Sequences of ``(document, start, length)`` for documents of these lengths."""
    full: list[list[Piece]] = []
    rest: list[Piece] = []
    for doc, n in enumerate(lengths):
        whole = n - n % window
        full += [[(doc, at, window)] for at in range(0, whole, window)]
        if n > whole:
            rest.append((doc, whole, n - whole))
    return full + filled_up(best_fit(rest, window), window, slack)


def pack(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id_col, start, length, doc_tokens, sequence_id, offset`` and ``ids``.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit integers.
    ``sequence_id`` holds the number of the task in its upper bits.
    """
    frame = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = frame.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sequence = loaded(path), TaskContext.get().partitionId() << 36
        names, ids, tokens = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, tokens
            owners = pa.concat_arrays(names)
            rows = [(doc, start, n, sequence + at, offset) for at, pieces in enumerate(packed([len(x) for x in ids], window)) for (doc, start, n), offset in zip(pieces, np.cumsum([0, *(p[2] for p in pieces)]).tolist(), strict=False)]
            sequence = rows[-1][3] + 1
            for a in range(0, len(rows), 1000):
                part = rows[a : a + 1000]
                doc, start, n, seq, offset = (np.array(x, np.int64) for x in zip(*part, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [owners.take(pa.array(doc)), *map(pa.array, (start, n, np.array([len(ids[d]) for d in doc]), seq, offset)), pa.array([ids[d][s : s + k].astype("<u4").tobytes() for d, s, k, *_ in part], pa.binary())],
                    names=["__id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )
            names.clear(), ids.clear()
            tokens = 0

        for batch in batches:
            for a, b in _groups(batch.column(1), GROUP_BYTES):
                names.append(batch.column(0).slice(a, b - a))
                ids += [np.append(encoder.encode(text), np.int32(END)) for text in _clean(batch.column(1).slice(a, b - a))]
                tokens += sum(map(len, ids[a - b :]))
                if tokens >= GROUP_TOKENS:
                    yield from flush()
        if ids:
            yield from flush()

    out = frame.mapInArrow(releasing(run), f"__id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out.withColumnRenamed("__id", id_col)


def op13_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Packs every document into sequences of at most 1024 ids; a digest for the ids of each piece."""
    pieces = pack(table(spark, sf_dir, "documents"), path or public_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
