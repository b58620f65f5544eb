"""Recursive text splitting without overlap.

A text is cut at the first of the separators blank line, line, sentence, word
that occurs in it; the separator stays at the head of the piece behind it.  A
piece of ``size`` characters or more is cut again at the later separators, at
last after every ``size`` characters.  Runs of short pieces from one cut are
packed greedily into chunks of at most ``size`` characters.  Chunks are
stripped, and empty ones dropped.  Each level alone is a native expression.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

#: (separator, its regular expression), in order.
SEPARATORS = [("\n\n", "\n\n"), ("\n", "\n"), (". ", "\\. "), (" ", " ")]


def cut(text: Column, separator: str, pattern: str) -> Column:
    """The pieces of a text; each but the first begins with the separator."""
    parts = F.split(text, pattern, -1)
    return F.filter(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(separator), p))), lambda p: p != "")


def hard_cut(text: Column, size: int) -> Column:
    """Every ``size`` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size))
    return F.filter(F.transform(starts, lambda s: F.substring(text, s, F.lit(size))), lambda p: p != "")


def pack(pieces: Column, size: int) -> Column:
    """Greedy chunks of ``pieces array<struct<t, b>>``; ``b`` begins a new chunk."""
    kind = "struct<done:array<string>,cur:string>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur")).cast(kind)

    def step(state: Column, p: Column) -> Column:
        close = p.b | (F.length(state.cur) + F.length(p.t) > size)
        return F.when(close, F.struct(closed(state).alias("done"), p.t.alias("cur"))).otherwise(F.struct(state.done.alias("done"), F.concat(state.cur, p.t).alias("cur"))).cast(kind)

    def closed(state: Column) -> Column:
        return F.when(state.cur == "", state.done).otherwise(F.concat(state.done, F.array(state.cur)))

    return F.aggregate(pieces, start, step, closed)


def _parts(text: str, level: int, size: int) -> tuple[list[str], int]:
    """The pieces of a text at the first separator from ``level`` on that occurs in it, and the next level."""
    while level < len(SEPARATORS) and SEPARATORS[level][0] not in text:
        level += 1
    if level == len(SEPARATORS):
        return [text[k : k + size] for k in range(0, len(text), size)], level + 1
    separator = SEPARATORS[level][0]
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p], level + 1


def _runs(text: str, level: int, size: int) -> Iterator[str]:
    """Packed chunks; the depth of the recursion is that of the separators."""
    run: list[str] = []
    total = 0
    pieces, after = _parts(text, level, size)
    for piece in pieces:
        if len(piece) >= size and after <= len(SEPARATORS):
            yield "".join(run)
            run, total = [], 0
            yield from _runs(piece, after, size)
            continue
        if total + len(piece) > size:
            yield "".join(run)
            run, total = [], 0
        run.append(piece)
        total += len(piece)
    yield "".join(run)


def split_text(text: str, size: int = 800) -> list[str]:
    """The chunks of one text."""
    return [c for c in map(str.strip, _runs(text, 0, size)) if c]


def with_chunks(df: DataFrame, text_col: str = "text", out: str = "chunks", size: int = 800) -> DataFrame:
    """``df`` with ``array<string>`` of the chunks of each text; a null text has none.

    The five levels nest to expressions that the optimizer multiplies out, so
    this one step runs in Python, a batch at a time and in linear time.
    """
    names = [c for c in df.columns if c != out]
    frame = df.select(*names)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                found = [split_text(t or "", size) for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=[*names, out])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInArrow(run, f"{types}, `{out}` array<string>")
