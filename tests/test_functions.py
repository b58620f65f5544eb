from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import chunking, text, vectors
from lodestone.sources import articles, config


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n\t", max_size=200), st.integers(1, 30))
def test_splitter_properties(value, size):
    chunks = chunking.split_text(value, size)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    assert "".join("".join(c.split()) for c in chunks) == "".join(value.split())


@pytest.mark.parametrize("n,want", [(0, []), (800, [800]), (801, [800, 1])])
def test_splitter_hard_cuts(n, want):
    assert [len(c) for c in chunking.split_text("x" * n)] == want


def test_splitter_levels():
    a, b, c = "a" * 500, "b" * 400, "c" * 100
    assert chunking.split_text(f"{a}\n\n{b}\n\n{c}") == [a, f"{b}\n\n{c}"]
    assert max(map(len, chunking.split_text(("word " * 400 + ". ") * 5))) <= 800


def test_splitter_count(spark):
    docs = articles.articles(spark, "/root/testdata/sf0.01")
    assert chunking.with_chunks(docs).select(F.sum(F.size("chunks"))).first()[0] == 4496


def test_native_levels_agree_with_the_splitter(spark):
    value = "one\n" + "two. three " * 90 + "\nfour"
    row = spark.createDataFrame([(value,)], "t string")
    for separator, pattern in chunking.SEPARATORS:
        first, *rest = value.split(separator)
        assert row.select(chunking.cut(F.col("t"), separator, pattern)).first()[0] == [p for p in (first, *(separator + r for r in rest)) if p]


TEXTS = [
    (lambda c: text.collapse(c), "\n".join(["x" * 10] * 5), "\n".join(["x" * 10] * 4) + "\n..."),
    (lambda c: text.collapse(c), "y" * 501, "y" * 500 + "..."),
    (lambda c: text.collapse(c), "a\nb", "a\nb"),
    (lambda c: text.preview(c), "z" * 200, "z" * 200),
    (lambda c: text.preview(c), "z" * 201, "z" * 200 + "…"),
    (lambda c: text.truncate_string(c), "https://a.b/" + "c" * 120, "https://a.b/" + "c" * 120),
    (lambda c: text.truncate_string(c), "d" * 101, "d" * 100 + "..."),
    (lambda c: text.prettify(c), "snake_case-and camelCase", "Snake Case And Camel Case"),
    (lambda c: text.pretty_date(c), "2024-01-02 15:04:05", "01/02/2024 03:04 PM"),
    (lambda c: text.pretty_date(c), "no date", None),
    (lambda c: text.id_abbrev(c), "abcdefgh", "abc...fgh"),
    (lambda c: text.data_url_payload(c), "data:image/png;base64,QUJD", "QUJD"),
    (lambda c: text.strip(c), "  a b \n", "a b"),
    (lambda c: text.studio_url("https://s/t", c, F.lit("id1")), "http://h//", "https://s/t/id1?baseUrl=http%3A%2F%2Fh%2F"),
]


@pytest.mark.parametrize("f,value,want", TEXTS)
def test_text_helpers(spark, f, value, want):
    assert spark.createDataFrame([(value,)], "c string").select(f(F.col("c"))).first()[0] == want


def test_bold_runs(spark):
    assert spark.range(1).select(text.bold_runs(F.lit("a **b** c **d e**"))).first()[0] == ["b", "d e"]


def test_vectors(spark):
    row = spark.range(1).select(F.array(F.lit(3.0), F.lit(4.0)).alias("a"), F.array(F.lit(0.0), F.lit(0.0)).alias("z"))
    got = row.select(vectors.norm(F.col("a")), vectors.normalize(F.col("a")), vectors.normalize(F.col("z")), vectors.cosine(F.col("a"), F.col("z")), vectors.euclid(F.col("a"), F.col("z")), vectors.manhattan(F.col("a"), F.col("z"))).first()
    assert list(got) == [5.0, [0.6, 0.8], [0.0, 0.0], 0.0, 5.0, 7.0]
    with pytest.raises(ValueError):
        vectors.distance("hamming")


def test_settings(tmp_path, monkeypatch):
    path = tmp_path / "c.yaml"
    path.write_text("locations: [Köln, Bonn]\ningest: {lang: de, chunk_size: 400}\nretrieval: {top_k: 12}\ngenerator: {backend: api, api: {model: m}}\n", encoding="utf-8")
    got = config.load_settings(path)
    assert (got.locations, got.lang, got.chunk_size, got.top_k, got.query_prefix, got.models) == (("Köln", "Bonn"), "de", 400, 12, "", {"api": "m"})
    for bad in ("retrieval: {top_k: 16}", "store: {distance: nope}", "ingest: {chunk_overlap: 5}"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            config.load_settings(path)
    (tmp_path / ".env").write_text("# c\nLODESTONE_T = 'x y'\n")
    monkeypatch.setenv("LODESTONE_T", "")
    monkeypatch.delenv("LODESTONE_T")
    config.load_dotenv(tmp_path / ".env")
    assert config.required_env("LODESTONE_T") == "x y" and config.env("LODESTONE_NONE", "d") == "d"
    monkeypatch.delenv("LODESTONE_T")
    with pytest.raises(RuntimeError):
        config.required_env("LODESTONE_T")


def test_retries():
    calls, slept = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("down")
        return [{"text": "t"}]

    assert articles.with_retries(call, sleep=slept.append) == [{"text": "t"}] and slept == [3.0, 6.0]
    with pytest.raises(ZeroDivisionError):
        articles.with_retries(lambda: 1 / 0, sleep=slept.append)
    assert slept[2:] == [3.0, 6.0, 9.0]


def test_article_source(spark):
    def fetch(place, lang, n):
        if place == "bad":
            raise OSError("no such place")
        return [{"text": f"{place} in {lang}", "source": None}] * 3

    waited = []
    rows = articles.read_articles(spark, articles.article_source(fetch, ["x", "bad", "y", "x"], "de", 2, backoff=0.0, polite=0.0))
    got = sorted((r.location, r.article_no, r.text, r.source, r.attempt, r.error) for r in rows.collect() if r.error is None)
    assert got == [(p, k, f"{p} in de", p, 1, None) for p in "xy" for k in range(2)] and not waited
    failed = sorted((r.location, r.attempt, r.wait_s, r.error) for r in rows.where("error IS NOT NULL").collect())
    assert failed == [("bad", k, None if k == 4 else 0.0, "no such place") for k in range(1, 5)]
    places = spark.createDataFrame([("x",), ("bad",), ("y",)], "location string")
    assert [r.location for r in articles.skipped(places, rows).collect()] == ["bad"]
    # filters reach the source: other locations aren't asked, and the language is that of the filter
    some = rows.where("location = 'y' AND lang = 'fr' AND error IS NULL")
    assert some.rdd.getNumPartitions() == 1 and {r.text for r in some.collect()} == {"y in fr"}
    assert rows.where("location IN ('x', 'y')").rdd.getNumPartitions() == 2
    assert rows.where("location = 'nowhere'").collect() == [] and rows.where("article_no = 1").count() == 2
    assert articles.ensure_rows(rows) is rows
    with pytest.raises(RuntimeError):
        articles.ensure_rows(rows.limit(0))


def test_files(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"no")
    got = articles.content_blocks(articles.read_files(spark, str(tmp_path))).collect()
    assert [tuple(r) for r in got] == [("a.PNG", "image", "image/png", "YWJj", "name")]


def test_thread_search(spark):
    uuid = "0a0a0a0a-1111-2222-3333-444444444444"
    rows = spark.createDataFrame([("t2", "g", None), ("t1", "g", None), ("t3", None, uuid)], "thread_id string, graph_id string, assistant_id string")
    assert [r.thread_id for r in articles.search_threads(rows, "g").collect()] == ["t1", "t2"]
    assert [r.thread_id for r in articles.search_threads(rows, uuid).collect()] == ["t3"]
    assert articles.search_threads(rows, None).count() == 0
