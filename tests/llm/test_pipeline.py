from __future__ import annotations

import random

import pytest

import corpus_pipeline as cp
from lodestone.llm import bpe, decontaminate, langid, similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA)


@pytest.fixture
def own_sf(spark, tmp_path):
    """A folder of small tables with planted cases."""
    rng = random.Random(15)
    words = lambda n: " ".join("".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 8))) for _ in range(n))
    docs = [(i, words(rng.randint(30, 200))) for i in range(60)]
    near = docs[0][1].split()
    near[3] = "changed"
    passage = words(70)
    item = words(30)
    docs += [(100, docs[1][1]), (101, " ".join(near)), (102, words(40) + " " + passage + " " + words(50)), (103, words(20) + " " + passage), (104, words(50) + " " + item + " " + words(20)), (105, None), (106, "123 !! 456"), (107, "")]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), dict(docs), passage


def test_planted_cases(spark, own_sf):
    sf, docs, passage = own_sf
    at = spark.read.parquet(f"{sf}/documents.parquet")
    left = {}
    for name, stage in cp.STAGES:
        at = cp.written(stage(spark, at, sf), name)
        if name != "bpe":
            assert at.columns == cp.COLUMNS
            rows = at.collect()
            assert all(r.n_chars == len(r.text) for r in rows)
            left[name] = {r.doc_id: r.text for r in rows}
    clean = set(range(60))
    assert set(left["language_id"]) == set(docs) - {105, 106, 107}
    assert set(left["simhash_near_dedup"]) == clean | {102, 103, 104}
    assert all(passage[20:-20] not in t for t in left["suffix_array_dedup"].values())
    assert all(left["suffix_array_dedup"][i] == docs[i] for i in clean | {104})
    assert set(left["suffix_array_dedup"]) == clean | {102, 103, 104}
    assert set(left["benchmark_decontamination"]) == clean | {102, 103}
    final = {r.doc_id: r for r in at.collect()}
    assert set(final) == clean | {102, 103} and all(r.n_tokens == len(r.ids) > 0 for r in final.values())


def test_run_over_documents(spark, sf):
    final = cp.run(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert 0 < len(final) < len(docs)
    assert len({similar.node_of(similar.shingle_set(docs[r.doc_id].text)) for r in final}) == len(final)


def test_copies_without_ids_are_not_lost(spark, own_sf):
    """A named row stands for its unnamed copies, and one of several unnamed ones stays."""
    text, other = ("".join(f" word{k}{c}" for k in range(60)) for c in "ab")
    at = spark.createDataFrame([(1, text, "en", "s", 0), (None, text, "en", "s", 0), (None, other, None, None, 0), (None, other, "de", "s", 0), (5, "some more words", "en", "s", 0)], SCHEMA)
    for name, stage in cp.STAGES:
        at = cp.written(stage(spark, at, own_sf[0]), name)
        assert sorted(str(r.doc_id) for r in at.collect()) == (["1", "5", "None", "None", "None"] if name == "language_id" else ["1", "5", "None"]), name


def test_texts_of_no_one_language_go(spark, own_sf):
    """Three languages share one text, two of them have one of their own: only what is likelier than not stays."""
    both = "alpha beta gamma delta " * 20
    own = {"x": "kilo lima mike november " * 20, "y": "tango uniform victor whiskey " * 20}
    rows = [(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate([(both, "x"), (both, "y"), (both, "z"), (own["x"], "x"), (own["y"], "y")] * 8)]
    df = spark.createDataFrame([*rows, (900, "november lima kilo", None, "s", 0), (901, "whiskey victor", None, "s", 0)], SCHEMA)
    model = langid.train(df.where(~langid.held_out()).select("lang", "text"), bpe.public_path("piece_bpe_32k.model"))
    want = {r.doc_id: r.lang or r.lang_pred for r in langid.predict(df, model).collect() if r.score >= 0.5}
    got = {r.doc_id: r.lang for r in cp.identify_language(spark, df, own_sf[0]).collect()}
    assert got == want and got[900] == "x" and got[901] == "y"


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_empty_and_odd_rows(spark, own_sf, name, stage):
    sf = own_sf[0]
    assert stage(spark, frame(spark, []), sf).collect() == []
    odd = spark.createDataFrame([(None, "some words here", None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, " ".join(f"word{k}" for k in range(5000)), "en", "s", 3)], SCHEMA)
    got = stage(spark, odd.withColumn("item_id", odd.doc_id).withColumn("ids", odd.text), sf)
    assert {r.doc_id for r in got.collect()} >= {2, None}


def test_shards_add_up(spark, own_sf, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 1)
    sf = own_sf[0]
    kept = cp.drop_benchmark_leaks(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert 104 not in {r.doc_id for r in kept.collect()}
