from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import hmm


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


def base_of(rows):
    c = Counter(w for held, t in rows if not held for w in split(t))
    n, v = sum(c.values()), len(c)
    return c, n, lambda w: math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1)))


def brute_forward(chain, classes):
    """Natural logarithm of a text's probability, token by token."""
    state, total = chain.start * chain.emit[classes[0]], 0.0
    for c in classes[1:]:
        total += math.log(state.sum())
        state = (state / state.sum()) @ chain.moves * chain.emit[c]
    return total + math.log(state.sum())


def some_chain(rng, classes, k):
    part = lambda *s: (x := rng.random(s) + 0.01) / x.sum(axis=-1, keepdims=True)
    return hmm.Chain(part(k), part(k, k), part(k, classes).T)


def test_forward_is_exact():
    rng = np.random.default_rng(12)
    chain = some_chain(rng, 9, 4)
    sizes = [1, 63, 64, 65, 128, 1, 1000, 130]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    classes = rng.integers(0, 9, ends[-1])
    got = chain.log_likelihoods(classes, ends)
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        assert math.isclose(got[k], brute_forward(chain, classes[a:b]), rel_tol=1e-9)


def brute_expect(chain, texts):
    """Expected starts, moves and emissions, token by token over whole texts."""
    k = len(chain.start)
    start, pair, emit = np.zeros(k), np.zeros((k, k)), np.zeros(chain.emit.shape)
    for own in texts:
        alpha = [chain.start * chain.emit[own[0]]]
        alpha[0] = alpha[0] / alpha[0].sum()
        for c in own[1:]:
            now = alpha[-1] @ chain.moves * chain.emit[c]
            alpha.append(now / now.sum())
        beta = np.ones(k)
        for t in range(len(own) - 1, -1, -1):
            gamma = alpha[t] * beta
            emit[own[t]] += gamma / gamma.sum()
            if t:
                both = alpha[t - 1][:, None] * chain.moves * (chain.emit[own[t]] * beta)[None, :]
                pair += both / both.sum()
                beta = chain.moves @ (chain.emit[own[t]] * beta)
                beta = beta / beta.sum()
            else:
                start += gamma / gamma.sum()
    return start, pair, emit


@pytest.mark.parametrize("piece", [1, 2, 3, 512])
def test_expectations(monkeypatch, piece):
    monkeypatch.setattr(hmm, "PIECE", piece)
    monkeypatch.setattr(hmm, "TOGETHER", 4)
    rng = np.random.default_rng(13)
    chain = some_chain(rng, 3, 2)
    sizes = [4, 1, 3, 2, 50, 6]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    classes = rng.integers(0, 3, ends[-1])
    sums = hmm.Sums(3, 2)
    chain.expect(classes, ends, sums)
    start, pair, emit = brute_expect(chain, [classes[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
    assert np.allclose(sums.start, start, atol=1e-4) and np.allclose(sums.pair, pair, atol=1e-4) and np.allclose(sums.emit, emit, atol=1e-4)


def test_brute_expectations_sum_over_all_paths():
    rng = np.random.default_rng(15)
    chain, own = some_chain(rng, 3, 2), rng.integers(0, 3, 5)
    start, pair, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))
    for code in range(2**5):
        path = [code >> t & 1 for t in range(5)]
        p = chain.start[path[0]] * np.prod([chain.emit[c, s] for c, s in zip(own, path, strict=True)]) * np.prod([chain.moves[x, y] for x, y in zip(path, path[1:], strict=False)])
        start[path[0]] += p
        for c, s in zip(own, path, strict=True):
            emit[c, s] += p
        for x, y in zip(path, path[1:], strict=False):
            pair[x, y] += p
    got = brute_expect(chain, [own])
    assert all(np.allclose(x, y / start.sum()) for x, y in zip(got, (start, pair, emit), strict=True))


def test_scores_against_brute_force(spark, sf, monkeypatch):
    """The whole query's scores from learning and scoring token by token."""
    monkeypatch.setattr(hmm, "WORDS", 300)
    monkeypatch.setattr(hmm, "HASHED", 64)
    monkeypatch.setattr(hmm, "PIECE", 50)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", hmm.held_out().alias("held_out"), "text").where("doc_id < 60")
    rows = [(r.held_out, split(r.text), r.doc_id) for r in docs.collect()]
    c = Counter(w for held, t, _ in rows if not held for w in t)
    base = hmm.learn_base(spark.createDataFrame(list(c.items()), "token string, n long"))
    number = {w: k for k, w in enumerate(base.words)}
    assert len(number) == 300 and len(c) > 600
    place = lambda w: base.end if w == "\n" else number.get(w, 300 + zlib.crc32(w.encode()) % 64)
    mass = Counter()
    for w, n in c.items():
        if w != "\n" and w not in number:
            mass[place(w)] += n + 0.1
    others = sum(n for w, n in c.items() if w != "\n" and w not in number)
    unknown = min(0.9, sum(n == 1 for w, n in c.items() if w != "\n") / others)
    chain = hmm.Chain.first(base, hmm.STATES)
    for _ in range(hmm.ROUNDS):
        sums = hmm.Sums(len(base.probs), hmm.STATES)
        sums.start, sums.pair, sums.emit = brute_expect(chain, [[place(w) for w in t] for held, t, _ in rows if not held])
        chain = hmm.Chain.from_sums(sums, base)
    got = {r.doc_id: r.score for r in hmm.score_documents(docs).collect()}
    for _, t, i in rows:
        want = brute_forward(chain, [place(w) for w in t]) / math.log(10)
        for w in t:
            if w != "\n" and w not in number:
                k = place(w)
                share = unknown / 64 / ((1 - unknown) * mass[k] / sum(mass.values()) + unknown / 64)
                want += math.log10((1 - share) * (c[w] + 0.1) / mass[k]) if c[w] else math.log10(share)
        assert math.isclose(got[i], want, rel_tol=1e-3), i


def test_rounds_raise_the_likelihood(spark):
    rng = np.random.default_rng(14)
    texts = [" ".join(rng.choice(["a", "b", "c"] if i % 2 else ["x", "y", "z"], 20)) for i in range(200)]
    docs = spark.createDataFrame([(i, i % 5 == 0, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string")
    rows = hmm.score_documents(docs).collect()
    assert sum(r.score for r in rows if r.held_out) > 0.85 * sum(r.base_score for r in rows if r.held_out)
    assert all(r.score > r.base_score for r in rows)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(1, False, "a b a"), (2, False, "b"), (3, False, "c c d e f g")], "doc_id long, held_out boolean, text string")
    counts = hmm.count_tokens(docs.select("text")).collect()
    base = hmm.learn_base(spark.createDataFrame(counts), words=2, hashed=3)
    assert math.isclose(base.probs.sum(), 1.0)
    chain = hmm.Chain.first(base, 3)
    assert np.allclose(chain.emit.sum(axis=0), 1) and np.allclose(chain.moves.sum(axis=1), 1)
    chain = hmm.Chain.from_sums(hmm.Sums(len(base.probs), 3), base)
    assert np.allclose(chain.emit.sum(axis=0), 1) and (chain.emit[base.hashed].sum(axis=0) >= base.least - 1e-12).all()
    events = Counter()  # given a hashed class, its known words and its unknown event
    for k, (_, known, unknown) in enumerate(base.class_terms()):
        events[k] += 10**unknown
        for r in counts:
            if r.token != "\n" and r.token not in base.words and zlib.crc32(r.token.encode()) % 3 == k:
                events[k] += 10 ** (known + math.log10((r.n + 0.1) / base.total))
    assert all(math.isclose(x, 1.0) for x in events.values()) and len(events) == 3


def check_base(got, rows):
    c, n, log = base_of([(held, t) for _, held, t in rows])
    want = sorted(((i, held, len(split(t)), sum(c[w] > 0 for w in split(t)), n, round(sum(map(log, split(t))), 6)) for i, held, t in rows), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


@pytest.mark.parametrize("words", [300, 100_000])
def test_query(spark, sf, monkeypatch, words):
    monkeypatch.setattr(hmm, "WORDS", words)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = hmm.op4_hmm(spark, sf).collect()
    check_base(got, [(d.doc_id, zlib.crc32(str(d.doc_id).encode()) % 10 == 0, d.text) for d in docs])
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


@pytest.mark.parametrize("rows", [[], [(1, True, "a b"), (2, True, None)], [(1, False, None), (1, False, None), (None, True, "X y"), (3, False, "x y é" * 3000), (4, False, ""), (5, True, "w" * 100 + "\x0b q\x1cr")]])
def test_cases(spark, rows):
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, held_out boolean, text string, n long")
    got = hmm.score_documents(docs.select("doc_id", "held_out", "text")).collect()
    check_base(got, rows)


def test_a_word_of_many_texts_is_hashed_once(spark, monkeypatch):
    """Numbering works on the distinct words of a group of texts, not on every text's own."""
    calls = spark.sparkContext.accumulator(0)

    def counted(word):
        calls.add(1)
        return zlib.crc32(word)

    monkeypatch.setattr(hmm, "crc32", counted)
    docs = spark.createDataFrame([(i, False, " a A b\tC\n") for i in range(100)] + [(100, False, None), (101, False, "\x0b")], "doc_id long, held_out boolean, text string").coalesce(1)
    base = hmm.learn_base(hmm.count_tokens(docs.select("text")), words=1, hashed=8)
    rows = hmm.number_texts(docs, base).orderBy("doc_id").collect()
    place = {w: 1 + zlib.crc32(w.encode()) % 8 for w in "bc"}
    assert all(r.classes == [0, 0, place["b"], place["c"], base.end] and sorted(map(tuple, r.others)) == [("b", 1), ("c", 1)] for r in rows[:100])
    assert all(r.classes == [base.end] and r.others == [] for r in rows[100:])
    assert calls.value <= 3  # b, c and the empty piece that white space leaves at the ends; once a text would be 200
