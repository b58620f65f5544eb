from __future__ import annotations

import math
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lodestone.llm import langid
from lodestone.llm.bpe import public_path

PATH = public_path("piece_bpe_32k.model")


def brute(pieces, probs, token):
    """Sum over all segmentations, by recursion."""
    if not token:
        return 1.0
    total = 0.0
    for n in range(1, len(token) + 1):
        k = pieces.number.get(token[:n])
        if k is None and n == 1:
            k = pieces.size - 1
        if k is not None:
            total += probs[k] * brute(pieces, probs, token[n:])
    return total


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(PATH)
    rng = np.random.default_rng(5)
    probs = rng.random((pieces.size, 2)) / pieces.size
    words = ["the", "é", "international", "日ж", "aaaa"]
    got = langid.Lattices(pieces, words)
    for w, row in zip(words, got.totals(got.forward(probs)), strict=True):
        for k in range(2):
            assert math.isclose(row[k], brute(pieces, probs[:, k], langid.MARK + w), rel_tol=1e-9)


def by_position(pieces, probs, token):
    """Exact sum over all segmentations, position by position in whole numbers over a power of two."""
    sums = [Fraction(1)]
    for j in range(1, len(token) + 1):
        total = Fraction(0)
        for i in range(max(0, j - pieces.longest), j):
            k = pieces.number.get(token[i:j], pieces.size - 1 if j == i + 1 else None)
            if k is not None:
                total += sums[i] * Fraction(probs[k])
        sums.append(total)
    return sums[-1]


def log_of(x):
    return math.log(x.numerator) - math.log(x.denominator)


def test_long_words_are_summed_whole():
    pieces = langid.Pieces(PATH)
    rng = np.random.default_rng(6)
    probs = rng.random((pieces.size, 2)) / pieces.size
    words = ["donaudampfschifffahrtsgesellschaftskapitaenswitwenrentenkasse", "the", "日" * 90, "internationalisation", "x" * 17]
    got = langid.word_scores(pieces, words, probs)
    for w, row in zip(words, got, strict=True):
        for k in range(2):
            assert math.isclose(row[k], log_of(by_position(pieces, probs[:, k], langid.MARK + w)), rel_tol=1e-9)
    n = rng.random((3, 2))
    whole = langid.Lattices(pieces, words[3:] + ["the"]).expected(probs, n)
    assert np.allclose(langid.expected_uses(pieces, words[3:] + ["the"], n, probs), whole, rtol=1e-8)


def test_every_language_is_learned(spark):
    letters = "abcdefghijklmnopqrst"
    rows = [(f"l{k:03}", f"{letters[k // 20] * 3}{letters[k % 20] * 4} " * 30) for k in range(300)]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"), PATH, rounds=1)
    assert len(model.languages) == 300
    said, _, _ = model.scorer().predict([t for _, t in rows])
    assert sum(a == b for a, (b, _) in zip(said, rows, strict=True)) > 280


def test_expected_uses_are_the_gradient():
    pieces = langid.Pieces(PATH)
    probs = np.full((pieces.size, 1), 1.0 / pieces.size)
    lattices = langid.Lattices(pieces, ["then", "he"])
    n = np.array([[3.0], [2.0]])
    uses = lattices.expected(probs, n)
    value = lambda p: float((n * np.log(lattices.totals(lattices.forward(p)))).sum())
    for k in (pieces.number["he"], pieces.number["t"], pieces.number["▁then"]):
        more = probs.copy()
        more[k] *= 1 + 1e-6
        assert math.isclose(uses[k, 0], (value(more) - value(probs)) / 1e-6, rel_tol=1e-3, abs_tol=1e-4)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.op5_langid(spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    judged = [r for r in got if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in judged) > 0.97 * len(judged)
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None, "en", 1), (2, "12 ²½ !?", "en", 2), (None, "the house", "en", 3), (4, "la casa", "es", 4), (4, "la casa", "es", 4), (5, "x" * 90000 + " 日本", None, 5)]])
def test_cases(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.train(docs.select("lang", "text"), PATH)
    got = langid.predict(docs, model).collect()
    assert sorted(r.lang_pred for r in got if r.doc_id in (1, 2)) == ["und"] * 2 * bool(rows)
    assert {r.lang_pred for r in got if r.doc_id == 4} <= {"es"}
    assert len(got) == len(rows)
    untaught = langid.predict(docs, langid.train(docs.where("false").select("lang", "text"), PATH)).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in untaught)
