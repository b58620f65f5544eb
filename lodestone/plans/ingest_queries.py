"""Queries of sources, splitting, counts and the collection, with their DuckDB SQL."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import chunking, text
from lodestone.operators import store
from lodestone.plans.pipeline import chunked
from lodestone.sources import articles as src
from lodestone.sources.articles import articles, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ARTICLES = "SELECT source AS location, doc_id AS article_no, text, 'doc:' || doc_id AS source FROM documents"


@query(ARTICLES)
def scan_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir)


@query(ARTICLES + " WHERE lang = 'en'")
def scan_articles_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir, "en")


@query("SELECT location, article_no, source FROM (SELECT source AS location, doc_id AS article_no, 'doc:' || doc_id AS source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3")
def articles_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.capped(articles(spark, sf_dir).drop("text"), 3)


@query("SELECT doc_id AS article_no, substr(text, 1, 1000000) AS text FROM documents")
def articles_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.truncated(articles(spark, sf_dir)).select("article_no", "text")


def _failures(place: str) -> int:
    """How often the stand-in service fails for a location: 0 to 5 times, by its name."""
    return int(md5(place.encode()).hexdigest()[0], 16) % 6


def _fetched(spark: SparkSession, sf_dir: str, max_docs: int = 3) -> tuple[DataFrame, DataFrame]:
    """The configured locations, and what a fetch of English articles got and met for each."""
    docs = table(spark, sf_dir, "documents")
    root = store.work_dir(spark)
    src.serve(articles(spark, sf_dir).join(docs.select(F.col("doc_id").alias("article_no"), "lang"), "article_no"), root)
    places = docs.select(F.col("source").alias("location")).distinct()
    names = [r.location for r in places.orderBy("location").collect()]  # the list that settings have
    service = src.article_source(src.ServedArticles(root, _failures), names, "en", max_docs, sleep=src.no_wait)
    return places, src.read_articles(spark, service)


_FAILS = """places AS (SELECT DISTINCT source AS location FROM documents), fails AS (SELECT location, CAST('0x' || substr(md5(location), 1, 1) AS INTEGER) % 6 AS n FROM places)"""
_GOT = f"""{_FAILS}, got AS (
  SELECT source AS location, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS article_no, 'doc:' || doc_id AS source, text, CAST(n + 1 AS INTEGER) AS attempt
  FROM documents d JOIN fails f ON f.location = d.source WHERE lang = 'en' AND n < 4 QUALIFY article_no < 3)"""


@query(f"WITH {_GOT} SELECT location, article_no, source, substr(text, 1, 1000000) AS text, attempt FROM got")
def fetched_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three articles of a location, from a service that fails for some."""
    _, rows = _fetched(spark, sf_dir)
    return rows.where("lang = 'en' AND error IS NULL").select("location", "article_no", "source", "text", "attempt")


@query(f"WITH {_FAILS} SELECT location, CAST(i AS INTEGER) AS attempt, CASE WHEN i < 4 THEN i * 3.0::DOUBLE END AS wait_s, 'no answer for ' || location AS error FROM fails, range(1, 5) r(i) WHERE i <= n")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every failed attempt of that fetch with the wait behind it."""
    _, rows = _fetched(spark, sf_dir)
    return rows.where("error IS NOT NULL").select("location", "attempt", "wait_s", "error")


@query(f"WITH {_GOT} SELECT location FROM places WHERE location NOT IN (SELECT location FROM got)")
def skipped_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The locations that gave no article."""
    places, rows = _fetched(spark, sf_dir)
    return src.skipped(places, rows)


_STRIP = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"


def _level(separator: str, name: str) -> None:
    sql = f"""
    SELECT doc_id AS article_no, CAST(len(p) AS INTEGER) AS n_pieces, md5(array_to_string(p, '|')) AS digest
    FROM (SELECT doc_id, list_filter(list_transform(string_split(text, {separator!r}), lambda x, i: CASE WHEN i = 1 THEN x ELSE {separator!r} || x END), lambda x: x <> '') AS p FROM documents)
    """.replace("'\\n\\n'", "chr(10) || chr(10)").replace("'\\n'", "chr(10)")
    pattern = dict(chunking.SEPARATORS)[separator]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pieces = articles(spark, sf_dir).select("article_no", chunking.cut(F.col("text"), separator, pattern).alias("p"))
        return pieces.select("article_no", F.size("p").alias("n_pieces"), F.md5(F.array_join("p", "|")).alias("digest"))

    run.__name__ = name
    query(sql)(run)


for _name, _separator in (("split_paragraph", "\n\n"), ("split_line", "\n"), ("split_sentence", ". "), ("split_word", " ")):
    _level(_separator, _name)


@query("""
SELECT doc_id AS article_no, CAST(i AS INTEGER) AS piece_no, substr(text, CAST(i * 800 + 1 AS BIGINT), 800) AS piece
FROM documents, range(0, 1000000) r(i) WHERE i * 800 < length(text)
""")
def split_hardcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("article_no", F.posexplode(chunking.hard_cut(F.col("text"), 800)).alias("piece_no", "piece"))


_PACKED = """
WITH RECURSIVE pieces AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i = 1 THEN x ELSE chr(10) || x END), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL
), packed AS (
  SELECT doc_id, p, 1 AS i, 0 AS chunk_no, coalesce(p[1], '') AS cur FROM pieces
  UNION ALL
  SELECT doc_id, p, i + 1, CASE WHEN length(cur) + length(p[i + 1]) > 800 THEN chunk_no + 1 ELSE chunk_no END,
    CASE WHEN length(cur) + length(p[i + 1]) > 800 THEN p[i + 1] ELSE cur || p[i + 1] END
  FROM packed WHERE i < len(p)
), last AS (SELECT doc_id, chunk_no, arg_max(cur, i) AS chunk FROM packed GROUP BY doc_id, chunk_no)
SELECT doc_id AS article_no, CAST(chunk_no AS INTEGER) AS chunk_no, chunk FROM last WHERE chunk <> ''
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = F.transform(chunking.cut(F.col("text"), "\n", "\n"), lambda t: F.struct(t.alias("t"), F.lit(False).alias("b")))
    return articles(spark, sf_dir).where("text IS NOT NULL").select("location", "article_no", "source", F.posexplode(chunking.pack(pieces, 800)).alias("chunk_no", "chunk")).where("chunk <> ''")


@query(_PACKED)
def chunks_packed_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("article_no", "chunk_no", "chunk")


@query(f"SELECT doc_id AS article_no, {_STRIP.replace('x,', 'text,', 1)} AS text FROM documents WHERE {_STRIP.replace('x,', 'text,', 1)} <> ''")
def chunks_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("article_no", text.strip(F.col("text")).alias("text")).where("text <> ''")


@query("SELECT doc_id AS article_no, CAST(i - 1 AS INTEGER) AS chunk_no, string_split(text, chr(10))[i] AS line FROM documents, range(1, 100000) r(i) WHERE i <= len(string_split(text, chr(10)))")
def chunks_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("article_no", F.posexplode(F.split("text", "\n", -1)).alias("chunk_no", "line"))


@query()
def chunks_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(articles(spark, sf_dir)).select("chunk_id", "location", "source", "chunk_no")


@query()
def chunks_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five levels; SQL has no form of it, tests hold it and the counts against a plain splitter."""
    return chunked(articles(spark, sf_dir))


@query("SELECT doc_id AS article_no, true AS in_order, true AS bounded, CAST(0 AS BIGINT) AS repeated_chars FROM documents WHERE trim(regexp_replace(text, '\\s', '', 'g')) <> ''")
def chunk_overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible characters of the chunks are those of the text, once and in order."""
    rows = chunking.with_chunks(articles(spark, sf_dir), out="c").where(F.size("c") > 0)
    bare = lambda x: F.regexp_replace(x, r"(?U)\s", "")
    whole = F.array_join(F.transform("c", bare), "")
    return rows.select("article_no", (whole == bare(F.col("text"))).alias("in_order"), F.forall("c", lambda x: F.length(x) <= 800).alias("bounded"), (F.length(whole) - F.length(bare(F.col("text")))).cast("long").alias("repeated_chars"))


@query()
def chunks_per_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(articles(spark, sf_dir)).groupBy("location").agg(F.count("*").alias("n"))


@query()
def chunks_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(articles(spark, sf_dir)).agg(F.count("*").alias("n"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings")
    return own.select(F.md5(F.concat_ws("|", F.col("label").cast("string"), F.col("vec_id").cast("string"))).alias("id"), F.col("label").cast("string").alias("location"), "vec_id", "embedding")


def _collection(spark: SparkSession, sf_dir: str, times: int = 1) -> store.Collection:
    """All points in a collection of their dimension, rebuilt so many times."""
    points = _points(spark, sf_dir)
    dim = points.agg(F.max(F.size("embedding"))).first()[0] or 1
    kept = store.Collection(spark, store.work_dir(spark), "points", dim)
    for _ in range(times):
        kept.rebuild(points)
    return kept


@query("SELECT md5(label || '|' || vec_id) AS id, CAST(label AS VARCHAR) AS location, vec_id, CAST(len(embedding) AS INTEGER) AS dim, list_sum(embedding[1:2])::FLOAT::DOUBLE AS two FROM embeddings")
def collection_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a collection after two batched inserts: vector and payload are columns of one row."""
    points = _points(spark, sf_dir)
    dim = points.agg(F.max(F.size("embedding"))).first()[0] or 1
    kept = store.Collection(spark, store.work_dir(spark), "points", dim)
    for half in (0, 1):
        kept.insert(points.where(F.col("vec_id") % 2 == half))
    two = (F.get("embedding", F.lit(0)) + F.get("embedding", F.lit(1))).cast("float").cast("double")
    return kept.points().select("id", "location", "vec_id", F.size("embedding").alias("dim"), two.alias("two"))


@query("SELECT count(*) AS n FROM embeddings")
def collection_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(_collection(spark, sf_dir).count(),)], "n long")


@query("SELECT CAST(label AS VARCHAR) AS location, count(*) AS n, count(DISTINCT vec_id) AS n_ids, 2 AS version FROM embeddings GROUP BY 1")
def index_rebuild_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection rebuilt twice from equal points holds each of them once."""
    kept = _collection(spark, sf_dir, 2)
    return kept.points().groupBy("location").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"), F.lit(kept.version()).alias("version"))


_THREADS = """
SELECT CAST(conv_id AS VARCHAR) AS thread_id, CASE conv_id % 3 WHEN 0 THEN 'rag' WHEN 1 THEN 'rag_chat' ELSE NULL END AS graph_id FROM conversations GROUP BY conv_id
"""


@query(f"SELECT thread_id, graph_id FROM ({_THREADS}) WHERE graph_id = 'rag' ORDER BY thread_id LIMIT 100")
def thread_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.lit(None).cast("string").alias("assistant_id"))
    graph = F.when(F.col("conv_id") % 3 == 0, "rag").when(F.col("conv_id") % 3 == 1, "rag_chat")
    threads = threads.select(F.col("conv_id").cast("string").alias("thread_id"), graph.alias("graph_id"), "assistant_id")
    return src.search_threads(threads, "rag").select("thread_id", "graph_id")
