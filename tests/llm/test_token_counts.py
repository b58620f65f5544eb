from __future__ import annotations

import math
import re

import pytest

from lodestone.llm import token_counts as tc
from lodestone.llm.bpe import public_path
from lodestone.llm.pieces import normal_pieces

PATH = public_path("piece_bpe_32k.model")
SCORE = {p: -math.log(r + tc.ZIPF_SHIFT) for r, (p, _) in enumerate(normal_pieces(PATH))}


def cut(text):
    return re.findall(r"\w+|[^\w\s]+", text or "")


def brute(word):
    """Best segmentation by forward dynamic programming over the word alone."""
    token = tc.MARK + word if re.match(r"\w", word) else word
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(token)
    for end in range(1, len(token) + 1):
        for start in range(end):
            piece = token[start:end]
            if piece in SCORE:
                best[end] = max(best[end], (best[start][0] + SCORE[piece], best[start][1] - 1))
            elif end - start == 1:
                n = len(piece.encode())
                best[end] = max(best[end], (best[start][0] - n * math.log(len(SCORE) + tc.ZIPF_SHIFT), best[start][1] - n))
    return -best[-1][1]


def test_query(spark, sf):
    got = {r.doc_id: (r.n_pre_tokens, r.n_tokens) for r in tc.op3_token_counts(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500").collect():
        words = cut(d.text)
        assert got[d.doc_id] == (len(words), sum(map(brute, words)))


def test_prefixes_are_scored_once():
    trie = tc.Trie(PATH)
    tc.count_batch(trie, ["international internationally internationals inter", "inter"])
    assert trie.visited == len({(tc.MARK + w)[:n] for w in ("internationally", "internationals") for n in range(1, 17)})
    assert trie.terminal["inter"] == brute("inter")


@pytest.mark.parametrize("rows", [[], [(1, None, 3), (1, None, 3), (None, "a  b_!?\n...", 1), (5, "", 1), (6, "日本語😀 x" + "z" * 3000, 2)]])
def test_cases(spark, rows, monkeypatch):
    monkeypatch.setattr(tc, "NODES", 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, tc.token_counts(docs, PATH).collect()), key=str)
    assert got == sorted(((i, len(cut(t)), sum(map(brute, cut(t)))) for i, t, _ in rows), key=str)
