from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import difference_cover, substrings


def brute(texts, size=200):
    """(n_bytes, n_removed, n_spans, digest) of every text, by a table of all strings."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + size] for r in raw for i in range(len(r) - size + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, np.int64)
        for i in range(len(r) - size + 1):
            if seen[r[i : i + size]] > 1:
                gone[i] += 1
                gone[i + size - len(r) - 1 if i + size <= len(r) else -1] -= 1
        mask = np.cumsum(gone)[: len(r)] > 0
        spans = int(np.sum(np.diff(np.concatenate(([0], mask.astype(int)))) == 1))
        out.append((len(r), int(mask.sum()), spans, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~mask])).hexdigest()))
    return out


def check(spark, rows, extra="long"):
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], f"doc_id long, text string, key {extra}")
    got = sorted(map(tuple, substrings.remove_repeated(docs).collect()), key=str)
    assert got == sorted(((i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows]), strict=True)), key=str)
    return got


@pytest.mark.parametrize("n,alphabet", [(0, 1), (1, 3), (3, 1), (7, 1), (10, 2), (50, 1), (333, 2), (1000, 4), (1001, 3), (5000, 200)])
def test_suffix_array(n, alphabet):
    s = np.random.default_rng(n).integers(1, alphabet + 1, n)
    assert difference_cover.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_every_string_holds_an_anchor():
    rng = np.random.default_rng(7)
    hashes = substrings.Hashes(substrings.GROUP_BYTES)
    for data in (rng.integers(97, 123, 5000), np.full(5000, 97), np.tile(rng.integers(97, 123, 7), 800), np.tile(rng.integers(97, 123, 150), 30)):
        column = pa.array([data.astype(np.uint8).tobytes()[:1900], b"", data.astype(np.uint8).tobytes()[1900:]], pa.binary())
        for row, at, _, _ in substrings.anchors_of_column(column, hashes):
            for r in (0, 2):
                own = np.sort(at[row == r])
                assert len(own) < 0.05 * 5000
                size = len(column[r].as_py())
                for s in range(size - 199):
                    assert np.any((own >= s) & (own + substrings.GRAM <= s + 200))


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d.doc_id, *w) for d, w in zip(docs, brute([d.text for d in docs]), strict=True))
    got = sorted(map(tuple, substrings.op9_substrings(spark, sf).collect()))
    assert got == want
    assert any(0 < r[2] < r[1] for r in got)


def words(rng, n):
    return "".join(rng.choice(list("abcdefghij éñ"), n))


def family(rng):
    shared = [words(rng, 260) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [words(rng, int(rng.integers(1, 300)))]
        for k in rng.choice(5, 2):
            cut = int(rng.integers(0, 40))
            parts += [shared[k][cut:], words(rng, int(rng.integers(0, 200)))]
        rows.append((i, "".join(parts)))
    base = words(rng, 1500)
    for i in range(60, 90):
        at = int(rng.integers(0, 1400))
        rows.append((i, base[:at] + words(rng, 5) + base[at:]))
    return rows


def test_shared_passages_and_near_copies(spark):
    check(spark, family(np.random.default_rng(8)))


@pytest.mark.parametrize("kinds,symbols", [(6, 700_000), (2048, 3000)])
def test_anchors_with_many_contexts(spark, monkeypatch, kinds, symbols):
    monkeypatch.setattr(substrings, "KINDS", kinds)
    monkeypatch.setattr(substrings, "SYMBOLS", symbols)
    used = []
    elsewhere = substrings._strings_elsewhere
    monkeypatch.setattr(substrings, "_strings_elsewhere", lambda hot: used.append(1) or elsewhere(hot))
    check(spark, family(np.random.default_rng(9)))
    assert bool(used) == (kinds == 6)


def test_judged_anchors(spark):
    rows = [(1, 1, 10, 0), (1, 1, 11, 5), (1, 2, 12, 7), (2, 3, 10, 3), (3, 4, 10, 4), (3, 4, 10, 90), (4, 5, 1, 1), (4, 6, 2, 2)]
    places, kinds = substrings.judge_anchors(spark.createDataFrame(rows, "a long, c long, key long, pos int"))
    assert sorted(map(tuple, places.collect())) == [(10, 0), (10, 4), (10, 90), (11, 5)]
    assert sorted(map(tuple, kinds.collect())) == [(1, 10, 0, True, 2), (1, 12, 7, False, 2), (4, 1, 1, False, 2), (4, 2, 2, False, 2)]


def test_long_text_in_segments(spark, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP_BYTES", 4000)
    monkeypatch.setattr(substrings, "SEGMENT", 700)
    rng = np.random.default_rng(10)
    long = words(rng, 9000)
    hashes = substrings.Hashes(20_000)
    raw = long.encode()
    rows = [r for r in substrings.anchors_of_column(pa.array([raw], pa.binary()), hashes)]
    at = rows[0][1]
    assert len(set(at.tolist())) == len(at)
    one = substrings.anchors(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), hashes)
    assert at.tolist() == one[1].tolist() and rows[0][2].tolist() == one[2].tolist() and rows[0][3].tolist() == one[3].tolist()


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None), (1, None), (None, "x" * 199), (2, "x" * 199), (3, "")],
        [(1, "y" * 200), (2, "y" * 201), (5, "z" * 200)],
        [(1, "ab" * 400), (None, "é" * 150), (None, "é" * 150), (7, "q" + "é" * 150 + "r")],
    ],
)
def test_cases(spark, rows):
    check(spark, rows, "string")


def test_characters_stay_whole():
    text = "aé" * 3
    raw = memoryview(text.encode())
    assert substrings._whole_chars(raw, np.array([2, 6]), np.array([4, 8])) == "aééé"
    assert substrings._whole_chars(raw, np.array([0]), np.array([2])) == "éaéaé"


def test_texts_whose_keys_clash_are_keyed_anew(spark, monkeypatch):
    """The first seed has few keys, so that most texts clash; the tables hold every text once and no key twice."""
    rows = [(f"text number {k} " * 20,) for k in (*range(40), *range(5))] + [("short",)]
    docs = spark.createDataFrame(rows, "text string")
    real = substrings.F.xxhash64

    def few(*columns):
        full = real(*columns)
        seed = columns[0]
        return substrings.F.when(seed == 0, substrings.F.pmod(full, substrings.F.lit(30))).when(seed == 1, substrings.F.pmod(full, substrings.F.lit(1000))).otherwise(full)

    monkeypatch.setattr(substrings.F, "xxhash64", few)
    names = substrings.distinct_texts(docs)
    found = [(r.key, bytes(r.text).decode(), r.n) for r in substrings.texts_of(spark, names).collect()]
    assert len(names) >= 2 and len({k for k, _, _ in found}) == 40
    assert {t: n for _, t, n in found} == {t: (2 if k < 5 else 1) for k, (t,) in enumerate(rows[:40])}
