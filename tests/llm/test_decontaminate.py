from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import decontaminate as dc


def brute(docs, items):
    """All pairs, every passage scored against every item part in full."""
    parts = []
    for i, (_, text) in enumerate(items):
        words = dc.WORD.findall((text or "").lower())
        parts += [(i, words[k : k + dc.PART]) for k in range(0, len(words), dc.PART)]
    df = Counter(w for _, p in parts for w in set(p))
    mean = sum(len(p) for _, p in parts) / max(1, len(parts))
    out = set()
    for d, text in docs:
        words = dc.WORD.findall((text or "").lower())
        size = dc.PASSAGE + dc.PART
        for at in range(0, max(1, len(words) - size + dc.PASSAGE), dc.PASSAGE):
            passage = words[at : at + size]
            have = set(passage)
            for i, part in parts:
                weight = {}
                for w, c in Counter(part).items():
                    idf = math.log(1 + (len(parts) - df[w] + 0.5) / (df[w] + 0.5))
                    weight[w] = idf * c * (dc.K1 + 1) / (c + dc.K1 * (1 - dc.B + dc.B * len(part) / mean))
                if sum(x for w, x in weight.items() if w in have) >= dc.THRESHOLD * sum(weight.values()):
                    q, a = dc.question_and_answer(items[i][1])
                    whole = passage if len(q) + len(a) <= dc.PART else words
                    if dc.overlap(q, whole) >= dc.QUESTION and dc.overlap(a, whole) >= dc.ANSWER:
                        out.add((d, items[i][0]))
    return out


def pairs(df):
    got = [(r.doc_id, r.item_id) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = pairs(dc.op10_decontaminate(spark, sf))
    assert got == brute(docs, items)
    exact = {(d, i) for d, t in docs for i, x in items if x in (t or "")}
    assert exact and exact <= got


def test_wand_retrieves_all(monkeypatch):
    monkeypatch.setattr(dc, "BLOCKS", 9)
    rng = np.random.default_rng(11)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary, 12))) for k in range(70)]
    parts = [(k, t.split()) for k, (_, t) in enumerate(items)]
    df = Counter(w for _, p in parts for w in set(p))
    index = dc.Index(items, parts, df, len(parts), 12.0)
    whole = {}
    for (w, _), (places, impacts, _) in index.postings.items():
        for p, x in zip(places, impacts, strict=True):
            whole.setdefault(p, {})[w] = x
    some = 0
    for _ in range(60):
        words = sorted({index.number[w] for w in rng.choice(vocabulary, 25) if w in index.number})
        want = {p for p, x in whole.items() if sum(x.get(w, 0.0) for w in words) >= dc.THRESHOLD}
        reach = index.blocks[words].sum(axis=0) >= dc.THRESHOLD * (1 - 1e-4)
        assert {p for b in np.nonzero(reach)[0] for p, _ in index.wand(words, int(b))} == want
        some += len(want)
    assert some and index.blocks.shape[1] > 2


def test_question_and_answer():
    assert dc.question_and_answer("Who is it? It is me. ok?") == (["who", "is", "it"], ["it", "is", "me", "ok"])
    assert dc.question_and_answer("a b c") == (["a", "b"], ["c"])
    assert dc.question_and_answer("??") == ([], [])


LONG = " ".join(f"long{k}" for k in range(400))


@pytest.mark.parametrize(
    "docs,items",
    [
        ([], [(1, "what is it? it is that")]),
        ([(1, "some text here")], []),
        (
            [(1, None, 1), (2, "", 1), (None, "so What is IT, it is that thing!", 1), (3, "what is it", 1), (3, "x " * 40000 + "what is it? it is that", 1), (4, "q " + LONG, 1), (5, LONG[:600], 1)],
            [(1, "what is it? it is that"), (1, "what is it? it is that"), (2, None), (3, "!!"), (None, "some thing else entirely here"), (7, LONG)],
        ),
    ],
)
@pytest.mark.parametrize("shard", [4_000_000, 5])
def test_cases(spark, docs, items, shard, monkeypatch):
    monkeypatch.setattr(dc, "SHARD_WORDS", shard)
    frame = spark.createDataFrame([(d[0], d[1], 0) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.find_items(frame, bench).collect()}
    want = brute([d[:2] for d in docs], items)
    assert got == want
    flagged = {r.doc_id for r in dc.flag(frame, bench).where("n_items > 0").collect()}
    assert flagged == {d for d, _ in want}


def test_a_million_words_take_seconds_and_bounded_memory():
    rng = np.random.default_rng(12)
    item = [f"w{k}" for k in rng.integers(0, 150, 200)]  # two parts, so that it is held against whole texts
    short = "where does it lie? it lies over there"
    parts = [(0, item[:128]), (0, item[128:]), (1, dc.WORD.findall(short))]
    index = dc.Index([(5, " ".join(item)), (6, short)], parts, Counter(w for _, p in parts for w in set(p)), 3, 70.0)
    filler = rng.permutation([f"w{k % 300}" for k in range(1_000_000)]).tolist()  # most windows reach the threshold, none holds the item
    plain = " ".join(filler)
    leaked = " ".join([*filler[:500_000], *item, *dc.WORD.findall(short), *filler[500_000:]])
    import time
    import tracemalloc

    tracemalloc.start()
    began = time.perf_counter()
    assert [[i for i, _ in found] for found in index.matches([plain, leaked])] == [[], [5, 6]]
    assert time.perf_counter() - began < 60 and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_whole_text_overlap_equals_the_plain_one():
    rng = np.random.default_rng(13)
    for _ in range(200):
        item = [f"w{k}" for k in rng.integers(0, 6, rng.integers(1, 9))]
        text = [f"w{k}" for k in rng.integers(0, 8, rng.integers(0, 12))]
        index = dc.Index([(0, " ".join(item))], [(0, item)], Counter(set(item)), 1, float(len(item)))
        known = np.array([index.number.get(w, -1) for w in text], np.int64)
        codes: dict = {}
        for side in (item, item[:1], item[:2], []):
            assert index.in_text(side, known, codes) == dc.overlap(side, text)
