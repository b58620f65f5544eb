from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestone.llm import align
from lodestone.llm.bpe import public_path
from lodestone.llm.common import written

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def spellings():
    """The libraries, and the bytes of each id as their files have them."""
    a, b = Tokenizer.from_file(public_path(A)), sentencepiece.SentencePieceProcessor(model_file=public_path(B))
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(c): c for c in printable} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in printable)}
    name_a = lambda i: bytes(chars[c] for c in a.id_to_token(i))
    name_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, name_a, name_b


def brute(rows):
    a, b, name_a, name_b = spellings()
    docs, held = [], Counter()
    for doc_id, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        spans = []
        for ids, name in ((ids_a, name_a), (ids_b, name_b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(name(i)), i))
                at = own[-1][1]
            spans.append(own)
        meant = (" " + (text or "")).encode()
        if not text or any(b"".join(name(i) for i in ids) != meant for ids, name in ((ids_a, name_a), (ids_b, name_b))):
            spans = [[], []]
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, last = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for _, x, i in side if last < x <= e) for side in spans))
            last = e
        links = [(x, y) for s, e, x in spans[0] for t, f, y in spans[1] if s < f and t < e]
        held.update(set(links))
        docs.append((doc_id, len(spans[0]), len(spans[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return sorted(((d, n, m, g, len(ls), sum(held[p] == best[p[0]] for p in ls), sum(held[p] for p in ls), sha) for d, n, m, g, ls, sha in docs), key=str)


def run(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id long, text string, chunk string, n_a int").repartition(3)
    df.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return sorted((tuple(r) for r in align.op12_alignment(spark, str(tmp_path)).collect()), key=str)


TEXTS = [
    "", None, " ", "  ", "\n", "a", "the cat sat on the mat", "the cat sat on the mat", "The  CAT\n\n sat\ton\r\nthe mat ", "naïve café — “déjà vu” ﬁ Ａ", "日本語のテキスト 漢字かな交じり文", "🙂🙃 👩‍👩‍👧‍👧 ok",
    "a▁b", "x\x00y", "<|endoftext|> is text <s> </s> <unk> <0x41>", "don't we'll 12345 3.14159 ---- ====", "é  nbsp em", "trailing   ", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "﻿bom", "\r", "}\r\n", "Привет мир, как дела", "عربي نص",
]


def test_cases(spark, tmp_path):
    rows = [*enumerate(TEXTS), (None, "the mat"), (3, "the"), (3, "the")]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_rows_of_the_table_in_many_chunks(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(align, "CHUNK_BYTES", 20_000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000").collect()]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_empty_table_and_table_without_tokens(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
    assert run(spark, tmp_path, [(1, None), (2, ""), (3, "▁")]) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_very_long_text(spark, tmp_path):
    text = "ab " * 200_000 + "z" * 300_000 + " " * 50_000 + "end"
    (got,) = run(spark, tmp_path, [(7, text)])
    a, b, *_ = spellings()
    assert got[1:3] == (len(a.encode(" " + text, add_special_tokens=False).ids), len(b.encode(text))) and got[4] == got[1] + got[2] - got[3] == got[6]


def test_links_are_the_overlaps():
    size = [0, 1, 2, 3]
    assert align.links([1, 3, 2], [2, 3, 1], size, size) == [(1, 2), (3, 2), (3, 3), (2, 3), (2, 1)]
    assert align.links([3], [1, 2], size, size) == [(3, 1), (3, 2)]
    assert align.links([1, 3, 1], [2, 1, 2], size, size) == [(1, 2), (3, 2), (3, 1), (3, 2), (1, 2)]  # a pair may be linked twice


def test_groups_with_one_hash_are_told_apart(monkeypatch):
    plain = align.Chunk(["the cat sat", "the mat naïve"], public_path(A), public_path(B))
    monkeypatch.setattr(align, "_mixed", lambda x: x * 0)
    clash = align.Chunk(["the cat sat", "the mat naïve"], public_path(A), public_path(B))
    assert clash.groups() == plain.groups() and len(clash.first) == len(plain.first)


def test_the_pair_table(spark):
    docs = spark.createDataFrame([(1, "the the"), (2, "the"), (3, "cat")], "doc_id long, text string")
    rows = written(align.grouped(docs, public_path(A), public_path(B)), "pairs")
    a, b, *_ = spellings()
    the = (a.encode(" the").ids[0], b.encode("the")[0])
    found = {(r.a, r.b): (r.docs, r.best) for r in align.pair_counts(rows).collect()}
    assert found[the] == (2, 2) and len(found) == 2
    names = [r.name for r in rows.where("names IS NOT NULL").selectExpr("explode(names) name").collect()]
    assert f"{the[0]}|{the[1]}" in names


@pytest.mark.parametrize("path", ["word_bpe_49k.json"])
def test_only_byte_level_files(path):
    from lodestone.llm import byte_level

    with pytest.raises(ValueError, match="byte-level"):
        byte_level.ByteLevel(public_path(path))
