from __future__ import annotations

import json
import os
import sys
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lodestone.functions.chunking import split_text
from lodestone.operators import generate, prompts, review, search, threads, uploads
from lodestone.operators.embed import HashedEmbedder, ModelEmbedder
from lodestone.operators.store import Collection
from lodestone.plans import catalog, search_queries
from lodestone.plans.pipeline import Engine, chunked, report, sources_of
from lodestone.sources.config import Settings
from lodestone.streaming import live

PASSAGES = [
    ("c1", "Munich", "u1", "Munich is the capital of Bavaria. It has many museums."),
    ("c2", "Cologne", "u2", "Cologne has a famous cathedral. It lies on the Rhine."),
    ("c3", "Munich", "u1", "The Isar flows through Munich."),
    ("c4", "", "u4", "Unrelated words entirely."),
]
KIND = "chunk_id string, location string, source string, text string"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine.over(spark.createDataFrame(PASSAGES, KIND), top_k=3)


def ask(spark, engine, *questions):
    rows = spark.createDataFrame(list(enumerate(questions)), "question_id long, question string")
    return {r.question: r for r in engine.ask_batch(rows).collect()}


def test_answers_are_grounded(spark, engine):
    got = ask(spark, engine, "hello, which city has a  cathedral?", "xyzzy", "")
    first = got["hello, which city has a  cathedral?"]
    assert first.rewritten_query == "which city has a cathedral?"
    assert first.answer == "Cologne has a famous cathedral. (Source: u2)"
    assert len(first.retrieved_docs) == 3 and [d.rank for d in first.retrieved_docs] == [1, 2, 3]
    assert got["xyzzy"].answer == prompts.REFUSAL == got[""].answer


def test_location_filter_and_empty_hits(spark, engine):
    rows = spark.createDataFrame([(0, "capital of Bavaria")], "question_id long, question string")
    assert {d.location for d in engine.ask_batch(rows, "Munich").first().retrieved_docs} == {"Munich"}
    assert len(engine.ask_batch(rows, "").first().retrieved_docs) == 3
    none = engine.ask_batch(rows, "Nowhere").first()
    assert none.retrieved_docs == [] and none.answer == prompts.REFUSAL and none.sources == []


def test_trace_and_report(spark, engine):
    rows = spark.createDataFrame([(0, "Isar")], "question_id long, question string")
    assert [(r.step, r.node) for r in engine.trace(rows).orderBy("step").collect()] == [(1, "rewrite"), (2, "retrieve"), (3, "answer")]
    done = engine.ask(spark, "Isar")
    said = report(done).first().report
    assert said.startswith("Q (original) : Isar\nQ (rewritten): Isar\n\nA: The Isar flows through Munich. (Source: u1)\n\nSources: Munich") and said.endswith("(retrieved 3 passages)")
    assert sources_of(done).first().line.split(", ")[0] == "Munich"


def test_context_format(spark):
    hits = F.array(F.struct(F.lit("T").alias("text"), F.lit("L").alias("location"), F.lit("S").alias("source")))
    row = spark.range(1).select(prompts.format_context(hits), prompts.answer_text(F.lit("q"), prompts.format_context(F.slice(hits, 1, 0)))).first()
    assert row[0] == "[1] (Location: L) T\n    Source: S"
    assert "(no context retrieved)" in row[1]


def test_kernels_agree_and_blocks_add_up(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    a = sorted(map(tuple, search_queries.topk_batch(spark, sf).collect()))
    assert a == sorted(map(tuple, search_queries.topk_batch_native(spark, sf).collect()))
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(search, "POINT_BATCH", 37)
    assert a == sorted(map(tuple, search_queries.topk_batch(spark, sf).collect()))
    points = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries = points.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), "embedding")
    for metric in ("dot", "euclid", "manhattan"):
        monkeypatch.setattr(search, "QUERY_BLOCK", 4096)
        many = {(r.query_id, r.rank): (r.id, r.score) for r in search.search_many(points, queries, 4, metric).collect()}
        alone = search.search(points, [float(x) for x in points.where("vec_id = 7").first().embedding], 4, metric).collect()
        assert [many[7, k + 1][0] for k in range(4)] == [r.vec_id for r in alone]


def test_odd_vectors_and_dealt_blocks(spark, monkeypatch):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, []), (6, [0.0, 1.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(k, [1.0, k / 10]) for k in range(12)] + [(20, None), (21, [2.0]), (22, [None, 1.0]), (23, [1.0, 2.0, 3.0])], "query_id long, embedding array<double>")
    few = sorted(map(tuple, search.search_many(points, queries, 2).collect()))
    assert {r[0] for r in few} == {*range(12), 21} and [r for r in few if r[0] == 21] == [(21, 3, 1.0, 1)]
    assert few == sorted(map(tuple, search.search_many_native(points, queries, 2).collect()))
    monkeypatch.setattr(search, "QUERY_BLOCK", 5)
    monkeypatch.setattr(search, "POINT_BLOCK", 2)
    assert few == sorted(map(tuple, search.search_many(points, queries, 2).collect()))
    assert few == sorted(map(tuple, search.search_many_native(points, queries, 2).collect()))
    assert search.search_many(points, queries.limit(0), 2).collect() == search.search_many_native(points, queries.limit(0), 2).collect() == []


def plain_chunks(text, size=800):
    """The splitter over a stack of texts: cut at the first separator that occurs, pack what is short."""
    out, current = [], ""
    todo = [(text, ("\n\n", "\n", ". ", " "))]
    while todo:
        own, separators = todo.pop()
        if own is None:  # a border between cuts
            out, current = [*out, current], ""
            continue
        if separators is None:
            if len(current) + len(own) > size:
                out, current = [*out, current], ""
            current += own
            continue
        while separators and separators[0] not in own:
            separators = separators[1:]
        if separators:
            mark = separators[0]
            pieces = [p if k == 0 else mark + p for k, p in enumerate(own.split(mark))]
        else:
            pieces = [own[k : k + size] for k in range(0, len(own), size)]
        row = [(None, ())]
        for p in filter(None, pieces):
            row += [(None, ()), (p, separators[1:]), (None, ())] if len(p) >= size and separators else [(p, None)]
        todo += reversed([*row, (None, ())])
    return [c.strip() for c in [*out, current] if c.strip()]


def test_chunk_queries_against_a_plain_splitter(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {(d.source, f"doc:{d.doc_id}", k, c) for d in docs for k, c in enumerate(plain_chunks(d.text or ""))}
    run = lambda name: catalog.queries()[name](spark, sf).collect()
    assert {(r.location, r.source, r.chunk_no, r.text) for r in run("chunks_recursive")} == want
    assert {(r.location, r.source, r.chunk_no) for r in run("chunks_tagged")} == {x[:3] for x in want}
    assert len({r.chunk_id for r in run("chunks_tagged")}) == run("chunks_total")[0].n == len(want)
    counts = Counter(x[0] for x in want)
    assert {r.location: r.n for r in run("chunks_per_location")} == counts
    for text in ("x" * 2000, ("word " * 400 + ". ") * 3, "a\n\n" + "b" * 801 + "\n\nc", "", " \n "):
        assert split_text(text) == plain_chunks(text)


def test_chat_appends_an_answer(spark, engine):
    rows = [(1, 0, "a", "human", "which city has a cathedral?"), (1, 1, "b", "ai", "which one?"), (2, 0, "c", "human", "xyzzy"), (2, 1, "d", "human", "please, which city is the capital of Bavaria?"), (3, 0, "e", "ai", "hello")]
    got = engine.chat(spark.createDataFrame(rows, "conv_id long, turn long, id string, type string, content string")).collect()
    new = {r.conv_id: r for r in got if r.id.startswith("answer-")}
    assert len(got) == len(rows) + 3 and {c: (r.turn, r.type) for c, r in new.items()} == {1: (2, "ai"), 2: (2, "ai"), 3: (1, "ai")}
    assert new[1].content.startswith("Cologne has a famous cathedral.") and new[2].content.startswith("Munich is the capital of Bavaria.")


def test_topk_plan(spark, capsys):
    search_queries.topk_filtered(spark, "/root/testdata/sf0.001").explain("formatted")
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "EqualTo(label,3)" in plan


def test_more_hits_than_points(spark, engine):
    assert Engine.over(spark.createDataFrame(PASSAGES, KIND), top_k=15).ask(spark, "x").select(F.size("retrieved_docs")).first()[0] == 4


def test_collection(spark, tmp_path):
    kept = Collection(spark, f"file://{tmp_path}", "c", 256)
    points = HashedEmbedder().transform(chunked(spark.createDataFrame([("A", "s", 1, "one. two"), ("B", "s", 2, "three")], "location string, source string, article_no long, text string")), "text")
    kept.rebuild(points)
    ids = {r.chunk_id for r in kept.points().collect()}
    kept.rebuild(points)
    assert kept.count() == 2 and kept.version() == 2 and {r.chunk_id for r in kept.points().collect()} == ids
    kept.backfill(points.where("location = 'A'").withColumn("text", F.lit("new")))
    assert {r.location: r.text for r in kept.points().collect()} == {"A": "new", "B": "three"}
    with pytest.raises(Exception, match="256 components"):
        kept.rebuild(points.withColumn("embedding", F.slice("embedding", 1, 3)))
    assert kept.version() == 2
    with pytest.raises(ValueError):
        Collection(spark, str(tmp_path), "d", 4, "nope")
    numbered = Collection(spark, f"file://{tmp_path}", "n", 256)
    assert numbered.version() == 0
    numbered.rebuild(points.withColumn("location", F.lit("007")))
    assert {r.location for r in numbered.points().collect()} == {"007"}
    (tmp_path / "n" / "_versions").rename(tmp_path / "n" / "away")
    (tmp_path / "n" / "_versions").mkdir()
    (tmp_path / "n" / "_versions" / "part.json.gz").write_bytes(b"no archive")
    with pytest.raises(Exception):  # noqa: B017  an unreadable version is no version 0
        numbered.version()


def test_generators(monkeypatch):
    assert isinstance(generate.make_generator(Settings()), generate.Extractive)
    monkeypatch.delenv("API_API_KEY", raising=False)
    with pytest.raises(RuntimeError):
        generate.make_generator(Settings(backend="API"))
    with pytest.raises(ValueError):
        generate.make_generator(Settings(backend="other"))
    assert generate.sampling(0.0) == (1e-5, False) and generate.sampling(0.3) == (0.3, True)


def test_remote_models(spark, monkeypatch):
    """Requests and answers of both forms, and a whole chain that asks a model from the workers."""
    for name, value in (("GROQ_API_KEY", "k"), ("GROQ_API_URL", "http://x/"), ("API_API_KEY", "k2"), ("API_API_URL", "http://y/")):
        monkeypatch.setenv(name, value)
        monkeypatch.setitem(spark.sparkContext.environment, name, value)
    talk = [("system", "a"), ("user", "q"), ("system", "b"), ("tool", "t")]
    rows = spark.createDataFrame([(1, talk), (2, talk[1:2])], "k int, m array<struct<role:string,content:string>>")
    made = generate.make_generator(Settings(backend="Groq", models={"groq": "m"}))

    def heard(generator):
        return {r.k: json.loads(r.s) for r in rows.select("k", generator.said(F.col("m")).alias("s")).collect()}

    plain = replace(made, send=lambda *r: {"choices": [{"message": {"content": f" {json.dumps(r)}\n"}}]})
    told = {"model": "m", "messages": [{"role": r, "content": c} for r, c in talk], "temperature": 0.1, "max_tokens": 512}
    assert heard(plain)[1] == ["http://x/", {"Authorization": "Bearer k"}, told]
    cut = lambda *r: {"content": [{"type": "text", "text": " " + json.dumps(r)[:5]}, {"type": "x"}, {"type": "text", "text": json.dumps(r)[5:] + " "}]}
    blocks = heard(replace(generate.make_generator(Settings(backend="api", models={"api": "n"})), send=cut))
    assert [blocks[k][2].get("system") for k in (1, 2)] == ["a\n\nb", None] and blocks[1][1] == {"X-Api-Key": "k2"}
    assert blocks[1][2]["messages"] == blocks[2][2]["messages"] == [{"role": "user", "content": "q"}]

    def echo(url, headers, body):
        first, last = body["messages"]
        said = last["content"] if first["content"] == prompts.SYSTEM_REWRITE else f"{url} {headers['Authorization']} {last['content'].count('(Location: ')}"
        return {"choices": [{"message": {"content": f'"{said}"'}}]}

    points = spark.createDataFrame(PASSAGES, KIND)
    got = ask(spark, Engine.over(points, generator=replace(made, send=echo), top_k=3), "a cathedral", "")
    assert got["a cathedral"].rewritten_query == "a cathedral" and got["a cathedral"].answer == '"http://x/ Bearer k 3"'
    assert len(got) == 2


def test_model_adapter_needs_its_package(spark, monkeypatch):
    monkeypatch.setitem(sys.modules, "sentence_transformers", None)
    with pytest.raises(RuntimeError):
        ModelEmbedder("m", 4).transform(spark.range(1).select(F.lit("x").alias("t")), "t")


def test_conversation_corner_cases(spark):
    rows = spark.createDataFrame([(1, 0, "m0", "ai", "b"), (2, 0, "m0", "human", "a"), (2, 1, "m1", "ai", "b"), (2, 2, None, "human", "c")], "conv_id long, turn long, id string, type string, content string")
    assert {r.conv_id: r.text for r in threads.last_user_text(rows).collect()} == {1: "b", 2: "c"}
    assert threads.visible(rows).count() == 4
    assert spark.range(1).select(uploads.removed_at(F.array(F.lit(1), F.lit(2), F.lit(3)), 1)).first()[0] == [1, 3]
    assert spark.range(1).select(review.interrupt_title(F.lit(""), F.lit(3))).first()[0] == "Interrupt 3"


def test_stream_equals_batch(spark, engine, tmp_path):
    kind = "question_id long, question string"
    rows = [(0, "cathedral"), (1, "capital of Bavaria"), (2, "zzz")]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    live.ask_stream(engine, stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {r.question_id: r.answer for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r.question_id: r.answer for r in engine.ask_batch(spark.createDataFrame(rows, kind)).collect()}
    assert len([x for x in os.listdir(f"{tmp_path}/out") if x.startswith("batch=")]) == 2


def test_last_turn_stream(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = live.last_turns(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("last_turns").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("last_turns").collect())) == sorted(map(tuple, live.last_turns(rows).collect()))


def test_flagship(spark):
    assert catalog.flagship(spark, "/root/testdata/sf0.001").columns == ["vec_id", "label", "score"]
