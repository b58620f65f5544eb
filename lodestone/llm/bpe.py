"""BPE encoding and decoding with a pair occurrence index.

A batch of texts is cut into words; every distinct pre-token of the batch that
is not known yet becomes a row of symbols in one shared array.  An index maps
each adjacent pair to all its positions.  The active ranks are applied in
ascending order, each to its whole position list, and only the lists of the
neighbouring pairs are touched.  A text is then the concatenation of its
words' ids, so the work of merging is paid once per distinct pre-token.

Defined cases: a null text counts as empty and gives no ids; equal rows give
equal results; other columns of the input are ignored, so that they may carry
any name; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import releasing, table

#: Pre-tokens whose ids a worker keeps between groups of texts.
CACHED_PIECES = 300_000
#: Characters of text that are encoded together.
GROUP_CHARS = 2_000_000

#: Texts of these characters alone are cut by ``SIMPLE_CUT``: they are stable
#: under NFC, and Python lower-cases them as the library does.
BEYOND_SIMPLE = re.compile("[^\x00-\u012f\u0131-\u017f]")
SIMPLE_CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ſ0-9²³¹¼½¾]+")
#: The pattern that SIMPLE_CUT stands for.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_chars() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def public_path(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PairIndexBpe:
    """Encoder and decoder for a ``tokenizers`` file with a BPE model and no decoder."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        #: pair of ids -> (rank, id of the merged symbol)
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        size = max([*self.vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.names: list[str] = [""] * size
        for token, i in self.vocab.items():
            self.names[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.names[i] = token
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        cuts = [x["pattern"].get("Regex") for x in spec["pre_tokenizer"].get("pretokenizers", []) if x["type"] == "Split"]
        normal = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        self.simple = cuts == [CUT] and normal == ["NFC", "Replace", "Lowercase"]
        if spec["decoder"] is not None or spec["model"]["type"] != "BPE":
            raise ValueError("a BPE file without a decoder is needed")
        self.path = path
        self.spoken: pa.StringArray | None = None
        self.library: Tokenizer | None = None
        self.bytes = str.maketrans({chr(b): c for b, c in enumerate(byte_chars())})
        self._forget()

    def _forget(self) -> None:
        self.number = {"\n" + token: k for k, token in enumerate(self.special)}  # no pre-token starts with a line feed
        self.ids = array("i", self.special.values())
        self.first = array("q", range(len(self.special) + 1))

    # -- the pair occurrence index ------------------------------------------

    def merge_all(self, tokens: list[str]) -> list[tuple[int, ...]]:
        """Ids of every pre-token, merged together through one pair index."""
        ids: list[int] = []
        owner: list[int] = []
        left: list[int] = []
        right: list[int] = []
        starts: list[int] = []
        for w, token in enumerate(tokens):
            first = len(ids)
            starts.append(first)
            symbols = [self.vocab[c] for c in token[:-1] if c in self.vocab]
            last = token[-1] + self.suffix
            if last in self.vocab:
                symbols.append(self.vocab[last])
            n = len(symbols)
            ids += symbols
            owner += [w] * n
            left += range(first - 1, first + n - 1)
            right += range(first + 1, first + n + 1)
            if n:
                left[first], right[first + n - 1] = -1, -1
        starts.append(len(ids))

        merges = self.merges
        where: dict[int, list[int]] = {}
        pair_of: dict[int, tuple[int, int]] = {}
        new_id: dict[int, int] = {}
        for i, j in enumerate(right):
            if j >= 0 and (found := merges.get((ids[i], ids[j]))):
                rank = found[0]
                if rank in where:
                    where[rank].append(i)
                else:
                    where[rank], pair_of[rank], new_id[rank] = [i], (ids[i], ids[j]), found[1]
        active = list(where)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            positions = where.pop(rank, None)
            if positions is None:
                continue
            a, b = pair_of[rank]
            made = new_id[rank]
            positions.sort()
            held: set[int] = set()  # words in which a merge has woken a lower rank
            later: list[int] = []
            for i in positions:
                if ids[i] != a or (j := right[i]) < 0 or ids[j] != b:
                    continue
                if held and owner[i] in held:
                    later.append(i)
                    continue
                ids[i], ids[j] = made, -1
                k = right[i] = right[j]
                if k >= 0:
                    left[k] = i
                h = left[i]
                for p, pair in ((h, (ids[h], made) if h >= 0 else None), (i, (made, ids[k]) if k >= 0 else None)):
                    if pair and (found := merges.get(pair)):
                        r = found[0]
                        if r == rank:
                            later.append(p)
                            continue
                        if r in where:
                            where[r].append(p)
                        else:
                            where[r], pair_of[r], new_id[r] = [p], pair, found[1]
                            heapq.heappush(active, r)
                        if r < rank:
                            held.add(owner[i])
            if later:
                where[rank] = later
                heapq.heappush(active, rank)
        return [tuple(x for x in ids[starts[w] : starts[w + 1]] if x >= 0) for w in range(len(tokens))]

    # -- texts --------------------------------------------------------------

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if self.simple and not BEYOND_SIMPLE.search(text):
            return SIMPLE_CUT.findall(text.lower())
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
        cut, normal = self.library.pre_tokenizer.pre_tokenize_str, self.library.normalizer
        # as the library writes them, with one character a byte; the line feeds set them apart from plain ones
        return ["\n\n" + p for p, _ in cut(normal.normalize_str(text) if normal else text)]

    def _learn(self, new: list[str]) -> None:
        written = [p[2:] if p.startswith("\n\n") else p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.bytes) for p in new]
        for p, ids in zip(new, self.merge_all(written), strict=True):
            self.number[p] = len(self.first) - 1
            self.ids.extend(ids)
            self.first.append(len(self.ids))

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts."""
        flat: list[str] = []
        rows = [0]
        for text in texts:
            at = 0
            if self.special_re is not None:
                for m in self.special_re.finditer(text):
                    flat += self.cut(text[at : m.start()])
                    flat.append("\n" + m.group())
                    at = m.end()
            flat += self.cut(text[at:] if at else text)
            rows.append(len(flat))
        if len(self.number) > CACHED_PIECES:
            self._forget()
        number = self.number
        if new := list({p for p in flat if p not in number}):
            self._learn(new)
        piece = np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))
        first = np.array(self.first, dtype=np.int64)
        n = np.diff(first)[piece]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = np.array(self.ids, dtype=np.int32)[np.repeat(first[piece] - ends[:-1], n) + np.arange(ends[-1])]
        return ends[np.array(rows)], ids

    def decode_batch(self, lists: pa.ListArray) -> pa.StringArray:
        """Tokens joined by one space; without a decoder in the file, the library does the same."""
        if self.spoken is None:
            self.spoken = pa.array(self.names, pa.string())
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(ends, self.spoken.take(lists.flatten())), " ")


@lru_cache(maxsize=2)
def loaded(path: str) -> PairIndexBpe:
    return PairIndexBpe(path)


def _groups(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def _types(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)


def _clean(texts: pa.Array) -> list[str]:
    return [t or "" for t in texts.to_pylist()]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """``id_col`` and ``ids array<int>`` for every row of ``docs``.

    With ``decoded``, a column of that name holds what :func:`decode` makes of
    the ids, made by the same worker.
    """
    frame = docs.select(id_col, F.col(text_col).alias("__text"))
    names = [id_col, "ids", *([decoded] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for a, b in _groups(batch.column(1), GROUP_CHARS):
                ends, ids = bpe.encode_batch(_clean(batch.column(1).slice(a, b - a)))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, *([bpe.decode_batch(lists)] if decoded else [])], names=names)

    return frame.mapInArrow(releasing(run), f"{_types(frame.select(id_col))}, ids array<int>" + (f", `{decoded}` string" if decoded else ""))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids, special tokens included; null ids count as none."""
    names = [c for c in encoded.columns if c != out]
    frame = encoded.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, bpe.decode_batch(batch.column(names.index(ids_col)))], names=[*names, out])

    return frame.mapInArrow(releasing(run), f"{_types(frame)}, `{out}` string")


def digests(decoded: DataFrame) -> DataFrame:
    """Per document the number of ids and digests of the ids and of the decoded text."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Encodes and decodes every whole text of ``documents``."""
    path = path or public_path("word_bpe_49k.json")
    return digests(encode(table(spark, sf_dir, "documents"), path, decoded="decoded"))
