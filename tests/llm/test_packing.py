from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from lodestone.llm import packing
from lodestone.llm.bpe import public_path

FILE = "byte_bpe_50k.json"


def check(rows, pieces, window=1024):
    """Every id lies in one piece, sequences are gapless; the padding of all sequences."""
    library = Tokenizer.from_file(public_path(FILE))
    ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows]
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    want = defaultdict(list)
    for i, x in ids:
        want[i].append(x)
    assert set(want) == set(by_doc)
    for i, own in want.items():
        if len(own) == 1:
            at = 0
            for p in sorted(by_doc[i], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(own[0]) and p.ids_crc32 == crc(own[0][at : at + p.length])
                at += p.length
            assert at == len(own[0])
        else:
            assert sum(p.length for p in by_doc[i]) == sum(map(len, own))
    padding = 0
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def run(spark, tmp_path, rows, parts=3):
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, start int, ids string").repartition(parts)
    df.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return packing.op13_packing(spark, str(tmp_path)).collect()


def test_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    pieces = packing.op13_packing(spark, sf)
    assert dict(pieces.dtypes) == {c: "bigint" for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
    pieces = pieces.collect()
    total = sum(p.length for p in pieces)
    assert check(rows, pieces) <= 0.01 * total
    # documents are cut where they must be, and few beyond
    assert len(pieces) <= sum(-(-n // 1024) for n in {p.doc_id: p.doc_tokens for p in pieces}.values()) + 0.15 * len(rows)


def test_cases(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "a"), (None, "null id"), (4, "same"), (4, "same"), (5, "<|endoftext|> inside <|endoftext|>"), (6, " " * 10_000), (7, "word " * 30_000), (8, "z" * 100_000), (9, "日本 🙂 é")]
    assert check(rows, run(spark, tmp_path, rows)) == 0
    assert run(spark, tmp_path, []) == []


def test_many_groups_in_a_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_TOKENS", 3000)
    monkeypatch.setattr(packing, "GROUP_BYTES", 2000)
    rng = random.Random(2)
    rows = [(i, "some words here " * rng.randint(0, 400)) for i in range(150)]
    assert check(rows, run(spark, tmp_path, rows, 2)) <= 8 * 40


def test_sequences_are_numbered_alike_each_time(spark, sf):
    one, two = (sorted(map(tuple, packing.op13_packing(spark, sf).collect())) for _ in range(2))
    assert one == two


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(3)
    for _ in range(300):
        pieces = [(i, 0, rng.randint(1, 64)) for i in range(rng.randint(0, 60))]
        open_, held = [], []
        for p in sorted(pieces, key=lambda p: -p[2]):
            fits = [r for r in open_ if r >= p[2]]
            if fits:
                at = max(i for i, r in enumerate(open_) if r == min(fits))
            else:
                at = len(open_)
                open_.append(64)
            open_[at] -= p[2]
        held = sorted(64 - r for r in open_)
        assert sorted(sum(n for *_, n in w) for w in packing.best_fit(pieces, 64)) == held


def test_any_lengths_leave_little_padding():
    rng = random.Random(4)
    for _ in range(300):
        lengths = [rng.choice([1, rng.randint(1, 30), rng.randint(1, 64), 64, 128, rng.randint(1, 500)]) for _ in range(rng.randint(0, 40))]
        out = packing.packed(lengths, 64, 2)
        held = defaultdict(list)
        for w in out:
            n = sum(p[2] for p in w)
            assert 62 <= n <= 64 or n & (n - 1) == 0
            for d, s, k in w:
                assert k > 0
                held[d] += range(s, s + k)
        assert all(sorted(held[d]) == list(range(n)) for d, n in enumerate(lengths))
