from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as cp
from lodestone.llm import common, simhash, similar


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s or {()}:
            where.setdefault(x, []).append(i)
    for i, j in {(a, b) for at in where.values() for k, a in enumerate(at) for b in at[k + 1 :]}:
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def groups(df):
    return sorted((tuple(r) for r in similar.similar_groups(df).collect()), key=str)


def edited(rng, words, edits):
    own = list(words)
    for at in rng.choice(len(words), edits, replace=False):
        own[at] = f"e{rng.integers(10**9)}"
    return own


def near_texts():
    """Families around the bound: 3 to 8 edits in 150 words leave similarities of about 0.6 to 0.85."""
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(4000)]
    texts = []
    for g in range(120):
        base = rng.choice(words, 150).tolist()
        texts += [" ".join(base), *(" ".join(edited(rng, base, 3 + g % 6)) for _ in range(3))]
    return [(i, t) for i, t in enumerate(texts)]


def test_pipeline_links_at_the_bound(spark):
    rows = near_texts()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in cp.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {c for _, c in brute_groups(rows)}


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert groups(docs) == brute_groups([(r.doc_id, r.text) for r in docs.collect()])


def odd_rows():
    rng = np.random.default_rng(3)
    base = [f"b{k}" for k in range(100)]
    line = [f"c{k}" for k in range(60)]
    rows = [(i, " ".join(edited(rng, base, 2))) for i in range(150)]
    rows += [(i, " ".join(line + [f"x{i}_{k}" for k in range(25)])) for i in range(200, 300)]
    rows += [(None, " ".join(base)), (None, "alone here"), (500, None), (501, ""), (502, "A  b"), (503, "a b"), (503, "a b"), (504, "q " * 900), (505, "q " * 9)]
    return rows + [(600, " ".join(base + line)), (600, "two texts of one id"), (None, "unnamed twins here"), (None, "unnamed twins here")]


@pytest.mark.parametrize("chunk,shingles,keys", [(4, 500_000, 1), (1024, 300, 1_000_000), (1024, 500_000, 1_000_000)])
def test_large_group_common_line_and_odd_rows(spark, monkeypatch, chunk, shingles, keys):
    monkeypatch.setattr(similar, "CHUNK", chunk)
    monkeypatch.setattr(similar, "CHUNK_SHINGLES", shingles)
    monkeypatch.setattr(common, "BROADCAST_KEYS", keys)
    rows = odd_rows()
    assert groups(spark.createDataFrame(rows, "doc_id long, text string")) == brute_groups(rows)
    assert groups(spark.createDataFrame([], "doc_id long, text string")) == []


def test_one_row_of_each_group_stays(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, k, "s") for k, (i, t) in enumerate(rows)], "doc_id long, text string, place int, root string")
    got = [(r.doc_id, r.text) for r in similar.one_of_each(docs).collect()]
    root = {}
    for (i, t), (_, c) in zip(sorted(rows, key=str), brute_groups(rows), strict=False):
        root.setdefault(i, c)
    kept = [i for i, _ in got]
    named = {c for _, c in brute_groups(rows) if c is not None}
    assert sorted(i for i in kept if i is not None) == sorted([*named, 600])  # 600 names two groups
    assert sorted(t for i, t in got if i is None) == ["alone here", "unnamed twins here"]
    assert similar.one_of_each(docs.limit(0)).collect() == []


def test_keys_share_as_promised():
    rng = np.random.default_rng(9)
    shared = 0
    for _ in range(400):
        both, one, other = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (80, 10, 10))
        a, b = (similar.keys_of(np.unique(np.concatenate((both, x)))) for x in (one, other))
        shared += int((a == b).sum())
    assert abs(shared / 400 / similar.BANDS - 0.8**5) < 0.02


def test_spanning_links_of_any_sets():
    rng = np.random.default_rng(10)
    for n in (2, 3, 40):
        base = rng.integers(0, 2**64, 30, dtype=np.uint64)
        sets = [np.unique(np.concatenate((rng.choice(base, 30 - int(k)), rng.integers(0, 2**64, int(k), dtype=np.uint64)))) for k in rng.integers(0, 6, n)]
        sets[0] = base[:0]
        root = similar.spanning_links(sets)
        links = [(i, j) for i in range(n) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])) > 0]
        want = simhash.forest(n, *(np.array([x[k] for x in links], dtype=np.int64) for k in (0, 1)))
        assert len(set(zip(root.tolist(), want.tolist(), strict=True))) == len(set(root.tolist())) == len(set(want.tolist()))


def test_shared_over_any_batches():
    rng = np.random.default_rng(5)
    rows = sorted({(int(k), int(n)) for k, n in zip(rng.integers(0, 60, 150), rng.integers(0, 90, 150), strict=True)})
    want = [r for r in rows if sum(k == r[0] for k, _ in rows) > 1]
    for size in (1, 2, 7, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows[at : at + size]], pa.int64()) for i in range(2)], names=["key", "node"]) for at in range(0, len(rows), size)]
        assert [(r["key"], r["node"]) for b in similar._shared(iter(batches)) for r in b.to_pylist()] == want
