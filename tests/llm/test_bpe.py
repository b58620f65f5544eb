from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import bpe

PATH = bpe.public_path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
LIB.no_padding()
LIB.no_truncation()


def ids_of(texts):
    ends, ids = bpe.loaded(PATH).encode_batch(texts)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


HARD = ["", " ", "\n\t", "Hello, World's  end!", "<|endoftext|>a<|startoftext|>", "a" * 5000, "ΣΑΣ ΟΔΟΣ", "İstanbul ǅ", "é ạ̀  x y\u0085z\x1cw", "don't we'LL 12345 x‍y 😀😀", "aaaaaaa banana ananas", "x\x00y", "Ünïcödé ﬁ １２", "<|endoftext", "﻿bom"]


def test_simple_cut_is_the_librarys():
    every = [chr(c) for c in range(0x180)]
    texts = [f"{a}{b}" for a in every for b in "a1' \x85"] + ["x".join(every), "".join(every).upper()]
    assert not any(bpe.BEYOND_SIMPLE.search(t) for t in texts if "İ" not in t and not set(t) - set(every))
    assert ids_of(texts) == [LIB.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgetting(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    test_hard_texts()
    test_hard_texts()


def test_hard_texts():
    assert ids_of(HARD) == [LIB.encode(t, add_special_tokens=False).ids for t in HARD]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n'<|>etaoinsh")), max_size=60), max_size=5))
def test_any_text(texts):
    assert ids_of(texts) == [LIB.encode(t, add_special_tokens=False).ids for t in texts]


def test_query(spark, sf):
    rows = {r.doc_id: r for r in bpe.op1_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = LIB.encode(d.text or "", add_special_tokens=False).ids
        r = rows[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("rows", [[], [(1, None, 2), (1, None, 2), (None, "a b", 3), (4, "<|endoftext|>", 1)]])
def test_cases(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = bpe.digests(bpe.decode(bpe.encode(docs, PATH), PATH)).collect()
    assert len(got) == len(rows)
    assert sorted(r.n_tokens for r in got) == sorted(len(LIB.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows)
