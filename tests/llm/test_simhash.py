from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lodestone.llm import components, simhash


def brute_print(text, width=3):
    words = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    for c in b"\t\n\x0b\x0c\r":
        words = words.replace(bytes([c]), b" ")
    words = [w for w in words.split(b" ") if w]
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: list of (doc_id, fp)."""
    fps = sorted({f for _, f in prints})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    arr = np.array(fps, dtype=np.uint64)
    for i, f in enumerate(fps):
        close = np.bitwise_count(arr ^ np.uint64(f)) <= 3
        for j in np.nonzero(close)[0]:
            a, b = find(f), find(fps[j])
            root[max(a, b)] = min(a, b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [(d, f"{f:016x}", least.get(find(f))) for d, f in prints]


def order(rows):
    return sorted(rows, key=str)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = brute_components([(d.doc_id, brute_print(d.text)) for d in docs])
    got = [tuple(r) for r in simhash.op2_simhash(spark, sf).collect()]
    assert order(got) == order(want)
    assert len({r[2] for r in got}) < len(got)


@pytest.mark.parametrize("rows", [[], [(1, None, 5), (2, "", 6), (2, "", 6), (None, "a b c d", 0), (7, "A\tb C  d", 1), (9, "x", 1), (4, "q " * 30000, 2)]])
def test_cases(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert order(got) == order(brute_components([(d, brute_print(t)) for d, t, _ in rows]))


def flipped(rng, base, n, bits):
    return [base ^ sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in range(n)]


def test_links_chains_and_hot_keys(spark, monkeypatch):
    rng = np.random.default_rng(1)
    fps = {int(x) for x in rng.integers(0, 2**63, 500)}
    for base in list(fps)[:40]:
        fps |= set(flipped(rng, base, 3, 3)) | set(flipped(rng, base, 2, 4))
    hot = int(rng.integers(0, 2**63)) >> 38 << 38
    fps |= {hot | int(x) for x in rng.integers(0, 2**14, 900)}
    chain = 0x0F0F0F0F0F0F0F0F
    for b in range(40):
        chain ^= 7 << b
        fps.add(chain)
    fps = {f & (1 << 64) - 1 for f in fps}
    prints = list(enumerate(sorted(fps)))
    want = order(brute_components(prints))
    monkeypatch.setattr(simhash, "CHUNK", 128)
    signed = lambda f: int(np.uint64(f).view(np.int64))
    scheme = simhash.EXACT._replace(tables=(tuple(range(38, 64)), *simhash.EXACT.tables))
    for tile in (64, 256):
        monkeypatch.setattr(simhash, "TILE", tile)
        rows = []
        key = sorted((int(f) >> 38, signed(f)) for _, f in prints)
        batches = [pa.RecordBatch.from_arrays([pa.array([x[n] for x in key[i : i + 50]], pa.int64()) for n in (0, 1, 1)], names=["key", "node", "f0"]) for i in range(0, len(key), 50)]
        for out in simhash._compare_sorted(scheme)(iter(batches)):
            rows += out.to_pylist()
        assert {r["key"] for r in rows if r["kind"] == 1} == {hot >> 38}
        assert sum(r["kind"] for r in rows) == sum(k == hot >> 38 for k, _ in key)
        df = spark.createDataFrame([(signed(f), signed(f)) for _, f in prints], "node long, f0 long")
        roots = {r.node: r.root for r in components.components(simhash.links(df, scheme)).collect()}
        groups = {}
        for d, f in prints:
            groups.setdefault(roots.get(signed(f), signed(f)), []).append((d, f))
        got = [(d, f"{f:016x}", min(x for x, _ in g)) for g in groups.values() for d, f in g]
        assert order(got) == want


def test_near_and_forest():
    rng = np.random.default_rng(2)
    for words, radius, flips in ((1, 3, 3), (4, 44, 60), (4, 7, 12), (2, 1, 2)):
        fps = rng.integers(0, 2**64, (300, words), dtype=np.uint64)
        for i in range(50, 90):
            bits = np.unpackbits(fps[3].view(np.uint8), bitorder="little")
            bits[rng.choice(64 * words, int(rng.integers(0, flips + 1)), replace=False)] ^= 1
            fps[i] = np.packbits(bits, bitorder="little").view(np.uint64)
        far = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2, dtype=int) > radius
        for lanes in (None, fps):
            found = [p for q, lane in simhash.Near(fps, lanes, radius) for p in zip(q.tolist(), lane.tolist(), strict=True)]
            assert sorted(found) == [(i, j) for i in range(300) for j in range(300) if not far[i, j] and (lanes is not None or i < j)]
    path = np.arange(99)
    assert (simhash.forest(100, path, path + 1) == 0).all()


def test_blocks_beyond_the_radius_are_abandoned():
    fps = np.random.default_rng(4).integers(0, 2**64, (512, 4), dtype=np.uint64)
    for words, radius, lanes in ((1, 3, None), (1, 3, fps[:, :1]), (4, 60, None)):
        near = simhash.Near(np.ascontiguousarray(fps[:, :words]), lanes, radius)
        assert sum(len(q) for q, _ in near) == (512 if lanes is not None else 0)
        assert near.abandoned > 0.95 * (near.blocks - 512 * (lanes is not None))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(30)] + [(1000, x) for x in range(900, 1000)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(900, 1001), 900)}
