"""Queries of encoding, retrieval and question answering, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text, vectors
from lodestone.operators import prompts, search
from lodestone.operators.embed import HashedEmbedder, embed_queries
from lodestone.operators.store import work_dir
from lodestone.plans import pipeline
from lodestone.sources.articles import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector of the single-query operators: that of id 0."""
    found = _points(spark, sf_dir).where("vec_id = 0").select(F.col("embedding").cast("array<double>")).first()
    return list(found[0]) if found else []


# points as doubles, and the query vector
_VECTORS = "WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS qv FROM p WHERE vec_id = 0)"
_COSINE = "list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv)))"


def _top(score: str, order: str = "DESC", where: str = "true", k: int = 10) -> str:
    return f"{_VECTORS} SELECT vec_id, label, round({score}, 6) AS score FROM p, q WHERE {where} ORDER BY score {order}, vec_id LIMIT {k}"


@query(_top(_COSINE))
def topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_points(spark, sf_dir), _probe(spark, sf_dir))


@query(_top("list_dot_product(v, qv)"))
def topk_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_points(spark, sf_dir), _probe(spark, sf_dir), metric="dot")


@query(_top("list_distance(v, qv)", "ASC"))
def topk_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_points(spark, sf_dir), _probe(spark, sf_dir), metric="euclid")


@query(_top("list_sum(list_transform(list_zip(v, qv), lambda z: abs(z[1] - z[2])))", "ASC"))
def topk_manhattan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_points(spark, sf_dir), _probe(spark, sf_dir), metric="manhattan")


@query(_top(_COSINE, where="label = 3"))
def topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The equality filter comes before scoring and reaches the scan."""
    return search.search(_points(spark, sf_dir).where(search.all_of(F.col("label") == 3)), _probe(spark, sf_dir))


_BATCH = f"""
WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS qv FROM p WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, label, round({_COSINE}, 6) AS score FROM p, q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s),
hits AS (SELECT * FROM r WHERE rank <= 10)
"""


def _batch(spark: SparkSession, sf_dir: str, run=search.search_many) -> DataFrame:
    """The ten best points for every point whose id is divisible by 50."""
    points = _points(spark, sf_dir)
    queries = points.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return run(points, queries)


@query(_BATCH + "SELECT query_id, vec_id AS id, score, rank FROM hits")
def topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir)


@query(_BATCH + "SELECT query_id, vec_id AS id, score, rank FROM hits")
def topk_batch_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir, search.search_many_native)


@query(_BATCH.replace("FROM p, q)", "FROM p JOIN q ON query_id % 3 = 0 OR CAST(label AS VARCHAR) = CAST(query_id // 50 % 10 AS VARCHAR))") + "SELECT query_id, vec_id AS id, score, rank FROM hits")
def topk_by_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A location of its own for two of three queries, none for the third, over a collection."""
    from lodestone.plans.ingest_queries import _collection

    points = _collection(spark, sf_dir).points()
    place = F.when(F.col("vec_id") % 3 != 0, (F.floor(F.col("vec_id") / 50) % 10).cast("string")).when(F.col("vec_id") % 2 == 0, "")
    queries = _points(spark, sf_dir).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", place.alias("location"))
    return search.search_by_location(points, queries)


@query(_BATCH + "SELECT query_id, rank, '[' || rank || '] ' || label || ' score=' || printf('%.3f', score) AS shown FROM hits")
def hits_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _batch(spark, sf_dir).join(_points(spark, sf_dir).select(F.col("vec_id").alias("id"), "label"), "id")
    shown = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("label").cast("string"), F.lit(" score="), text.three_decimals(F.col("score")))
    return named.select("query_id", "rank", shown.alias("shown"))


@query(_BATCH + "SELECT query_id, CAST(count(*) AS INTEGER) AS n FROM hits GROUP BY query_id")
def retrieved_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir).groupBy("query_id").agg(F.size(F.collect_list("id")).alias("n"))


_SOURCES = _BATCH + ", src AS (SELECT query_id, CAST(label AS VARCHAR) AS location, 's' || (vec_id % 3) AS source, min(rank) AS first_rank FROM hits GROUP BY 1, 2, 3)"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("location"), F.concat(F.lit("s"), (F.col("vec_id") % 3).cast("string")).alias("source"))
    return search.distinct_sources(_batch(spark, sf_dir).join(points, "id"), "query_id")


@query(_SOURCES + " SELECT * FROM src")
def sources_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir)


@query(_SOURCES + " SELECT query_id, string_agg(location, ', ' ORDER BY first_rank) AS line FROM src WHERE location <> '' GROUP BY query_id")
def sources_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.sources_line(_sources(spark, sf_dir), "query_id")


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").alias("dim"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first, round(embedding[-1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS last FROM embeddings")
def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = _points(spark, sf_dir).select("vec_id", vectors.normalize(F.col("embedding")).alias("u"))
    return unit.select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.element_at("u", -1), 6).alias("last"))


@query(f"{_VECTORS} SELECT vec_id, round({_COSINE}, 5) AS cosine, round(list_dot_product(v, qv), 5) AS dot FROM p, q")
def cosine_vs_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = F.array(*map(F.lit, _probe(spark, sf_dir)))
    return _points(spark, sf_dir).select("vec_id", F.round(vectors.cosine(F.col("embedding"), probe), 5).alias("cosine"), F.round(vectors.dot(F.col("embedding"), probe), 5).alias("dot"))


def _bags(rows: str, key: str, dim: int = 256) -> str:
    """Normalised bags of words of ``rows(key, text)`` in long form: bag(key, bucket, x)."""
    return f"""
tok AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM {rows}),
cnt AS (SELECT {key}, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {dim} AS bucket, count(*) AS n FROM tok GROUP BY 1, 2),
bag AS (SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS x FROM cnt)"""


@query(f"WITH {_bags('documents', 'doc_id')} SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, round(x, 6) AS x FROM bag")
def passage_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = HashedEmbedder().transform(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return own.select("doc_id", F.posexplode("embedding").alias("bucket", "x")).where("x > 0").select("doc_id", "bucket", F.round("x", 6).alias("x"))


@query(f"WITH asked AS (SELECT item_id, 'find: ' || text AS text FROM benchmark), {_bags('asked', 'item_id')} SELECT item_id, CAST(bucket AS INTEGER) AS bucket, round(x, 6) AS x FROM bag")
def query_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = embed_queries(HashedEmbedder(), table(spark, sf_dir, "benchmark").select("item_id", "text"), "text", "find: ")
    return own.select("item_id", F.posexplode("embedding").alias("bucket", "x")).where("x > 0").select("item_id", "bucket", F.round("x", 6).alias("x"))


# question answering: the articles are the passages, the benchmark items the questions
_ASK = r"""
WITH asked AS (
  SELECT item_id, text AS question, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(text, '^\s*(hello|hi|hey|please|could you|can you|tell me|i would like to know)[,!.:]*\s+', '', 'i'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), ''), text) AS plain FROM benchmark
), rew AS (SELECT item_id, question, regexp_replace(plain, '^"+|"+$', '', 'g') AS rewritten_query FROM asked),
rtext AS (SELECT item_id, rewritten_query AS text FROM rew),
""" + _bags("rtext", "item_id").replace("tok AS", "qtok AS").replace("FROM tok", "FROM qtok").replace("cnt AS", "qcnt AS").replace("FROM cnt", "FROM qcnt").replace("bag AS", "qbag AS") + "," + _bags("documents", "doc_id") + """,
dots AS (SELECT item_id, doc_id, sum(bag.x * qbag.x) AS s FROM bag JOIN qbag USING (bucket) GROUP BY 1, 2),
every AS (SELECT q.item_id, d.doc_id, round(coalesce(s, 0), 6) AS score, md5(d.source || '|doc:' || d.doc_id || '|' || d.doc_id || '|0') AS chunk_id
  FROM benchmark q CROSS JOIN documents d LEFT JOIN dots ON dots.item_id = q.item_id AND dots.doc_id = d.doc_id),
hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM every) WHERE rank <= 10),
full_hits AS (SELECT h.*, d.text, d.source AS location, 'doc:' || d.doc_id AS source FROM hits h JOIN documents d USING (doc_id))
"""


def _engine(spark: SparkSession, sf_dir: str) -> tuple[pipeline.Engine, DataFrame]:
    from lodestone.operators.store import chunk_id
    from lodestone.sources.articles import articles

    passages = articles(spark, sf_dir).withColumn("chunk_no", F.lit(0)).select(chunk_id().alias("chunk_id"), "location", "source", "text")
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return pipeline.Engine.kept(passages, work_dir(spark)), questions


@query(_ASK + "SELECT item_id AS question_id, rank, score, chunk_id, location, source, md5(text) AS text_md5 FROM full_hits")
def retrieve_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, questions = _engine(spark, sf_dir)
    hits = engine.hits(questions.transform(engine.rewrite))
    return hits.select("question_id", "rank", "score", "chunk_id", "location", "source", F.md5("text").alias("text_md5"))


@query(_ASK + """, listed AS (SELECT item_id, string_agg('[' || rank || '] (Location: ' || location || ') ' || text || chr(10) || '    Source: ' || source, chr(10) || chr(10) ORDER BY rank) AS context,
  string_agg(location, ', ' ORDER BY rank) AS line, CAST(count(*) AS INTEGER) AS n FROM full_hits GROUP BY item_id)
SELECT item_id AS question_id, question, rewritten_query, md5(context) AS context_md5, line AS sources, n AS n_hits FROM rew LEFT JOIN listed USING (item_id)""")
def ask_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question to context and sources in one plan."""
    engine, questions = _engine(spark, sf_dir)
    done = engine.ask_batch(questions)
    context = prompts.format_context(F.col("retrieved_docs"))
    names = F.array_join(F.filter(F.transform("sources", lambda s: s.location), lambda x: x != ""), ", ")
    return done.select("question_id", "question", "rewritten_query", F.md5(context).alias("context_md5"), names.alias("sources"), F.size("retrieved_docs").alias("n_hits"))


@query()
def ask_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extracted answers; SQL has no form of them, tests look at planted questions."""
    engine, questions = _engine(spark, sf_dir)
    return engine.ask_batch(questions).select("question_id", "answer")


TOLD = _ASK + """, listed AS (SELECT item_id, string_agg('[' || rank || '] (Location: ' || location || ') ' || text || chr(10) || '    Source: ' || source, chr(10) || chr(10) ORDER BY rank) AS context,
  string_agg(location, ', ' ORDER BY rank) AS line FROM full_hits GROUP BY item_id)
SELECT item_id AS question_id, step, node, CASE step WHEN 1 THEN rewritten_query WHEN 2 THEN md5(context) ELSE line END AS said
FROM rew LEFT JOIN listed USING (item_id), (VALUES (1, 'rewrite'), (2, 'retrieve'), (3, 'answer')) t(step, node)"""


def told(trace: DataFrame) -> DataFrame:
    """``question_id, step, node, said``: what a delta holds, read back from its JSON."""
    d = F.from_json("delta", f"rewritten_query string, retrieved_docs {pipeline.HIT}, sources array<struct<location:string,source:string>>")
    context = F.md5(prompts.format_context(d.retrieved_docs))
    line = F.array_join(F.transform(d.sources, lambda s: s.location), ", ")
    return trace.select("question_id", "step", "node", F.when(F.col("step") == 1, d.rewritten_query).when(F.col("step") == 2, context).otherwise(line).alias("said"))


@query(TOLD)
def ask_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, questions = _engine(spark, sf_dir)
    return told(engine.trace(questions))


@query("""
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE role END AS type, md5(text) AS kept FROM conversations
UNION ALL SELECT conv_id, max(turn) + 1, 'ai', NULL FROM conversations GROUP BY conv_id
""")
def chat_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with an answer to its last question at its end; tests look at the answers."""
    engine, _ = _engine(spark, sf_dir)
    kind = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai").otherwise(F.col("role"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), kind.alias("type"), F.col("text").alias("content"))
    return engine.chat(rows).select("conv_id", "turn", "type", F.when(~F.col("id").startswith("answer-"), F.md5("content")).alias("kept"))


@query()
def result_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, questions = _engine(spark, sf_dir)
    return pipeline.report(engine.ask_batch(questions))


_LISTED = """, listed AS (SELECT item_id, string_agg('[' || rank || '] (Location: ' || location || ') ' || text || chr(10) || '    Source: ' || source, chr(10) || chr(10) ORDER BY rank) AS context FROM full_hits GROUP BY item_id)
SELECT item_id AS question_id, question, rewritten_query, md5(context) AS context_md5 FROM rew LEFT JOIN listed USING (item_id)"""


@query(_ASK + _LISTED)
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in the files of the JSON sink, read back."""
    engine, questions = _engine(spark, sf_dir)
    done = engine.ask_batch(questions)
    path = work_dir(spark)
    pipeline.write_json(done, path)
    back = pipeline.read_json(done.schema, spark, path)
    return back.select("question_id", "question", "rewritten_query", F.md5(prompts.format_context(F.col("retrieved_docs"))).alias("context_md5"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS preview FROM documents")
def passage_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query(_BATCH + "SELECT query_id, md5(string_agg('[' || rank || '] (Location: ' || label || ') point ' || vec_id || chr(10) || '    Source: vec:' || vec_id, chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM hits GROUP BY query_id")
def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of every query as one numbered context."""
    name = F.col("vec_id").cast("string")
    payload = _points(spark, sf_dir).select(F.col("vec_id").alias("id"), F.concat(F.lit("point "), name).alias("text"), F.col("label").cast("string").alias("location"), F.concat(F.lit("vec:"), name).alias("source"))
    hits = _batch(spark, sf_dir).join(payload, "id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "location", "source"))).alias("hits"))
    return hits.select("query_id", F.md5(prompts.format_context(F.col("hits"))).alias("context_md5"))


@query("""
SELECT item_id, 'Context passages:' || chr(10) || CASE WHEN item_id % 2 = 0 THEN '(no context retrieved)' ELSE '[1] (Location: ?) ' || text || chr(10) || '    Source: ' END || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Answer using only the context above.' AS prompt FROM benchmark
""")
def answer_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the items have no passage, the others one without location and source."""
    none = F.lit(None).cast("string")
    hit = F.array(F.struct(F.col("text").alias("text"), none.alias("location"), none.alias("source")))
    hits = F.when(F.col("item_id") % 2 == 0, F.slice(hit, 1, 0)).otherwise(hit)
    rows = table(spark, sf_dir, "benchmark").select("item_id", prompts.messages(prompts.SYSTEM_ANSWER, prompts.answer_text(F.col("text"), prompts.format_context(hits))).alias("m"))
    return rows.select("item_id", F.col("m")[1]["content"].alias("prompt"))


@query("""
SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text ELSE 'Conversation so far:' || chr(10) || 'earlier' || chr(10) || chr(10) || 'Latest question: ' || text END AS prompt FROM benchmark
""")
def rewrite_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = F.when(F.col("item_id") % 2 == 0, "").otherwise("earlier")
    rows = table(spark, sf_dir, "benchmark").select("item_id", prompts.messages(prompts.SYSTEM_REWRITE, prompts.rewrite_text(F.col("text"), history)).alias("m"))
    return rows.select("item_id", F.col("m")[1]["content"].alias("prompt"))


@query(r"""WITH said AS (SELECT item_id, CASE item_id % 5 WHEN 0 THEN '  "' || text || '"' || chr(10) WHEN 1 THEN '""' WHEN 2 THEN '" ' || text || ' "' WHEN 3 THEN NULL ELSE chr(9) || '"' || substr(text, 1, 20) || '"b""' END AS s, text FROM benchmark)
SELECT item_id, coalesce(nullif(regexp_replace(regexp_replace(s, '^\s+|\s+$', '', 'g'), '^"+|"+$', '', 'g'), ''), text) AS rewritten FROM said""")
def rewrite_postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrites as a model may give them: with white space or quotes around, with spaces inside the quotes, empty, missing."""
    own, k = F.col("text"), F.col("item_id") % 5
    said = F.when(k == 0, F.concat(F.lit('  "'), own, F.lit('"\n'))).when(k == 1, '""').when(k == 2, F.concat(F.lit('" '), own, F.lit(' "'))).when(k == 4, F.concat(F.lit('\t"'), F.substring(own, 1, 20), F.lit('"b""')))
    return table(spark, sf_dir, "benchmark").select("item_id", text.clean_rewrite(said, own).alias("rewritten"))
