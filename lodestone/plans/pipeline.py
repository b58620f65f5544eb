"""Grounded question answering as one chain of DataFrame steps: rewrite, retrieve, answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions.chunking import with_chunks
from lodestone.functions.text import clean_rewrite
from lodestone.operators.embed import Embedder, HashedEmbedder, VectorTable, embed_queries
from lodestone.operators.generate import Extractive, Generator
from lodestone.operators.prompts import answer_text, format_context
from lodestone.operators.search import location_filter, search_by_location, search_many
from lodestone.operators.store import chunk_id
from lodestone.operators.threads import append, last_user_text

HIT = "array<struct<rank:int,score:double,text:string,location:string,source:string>>"


def chunked(articles: DataFrame, size: int = 800) -> DataFrame:
    """``chunk_id, location, source, article_no, chunk_no, text`` of the articles' chunks; no shuffle."""
    rows = with_chunks(articles, size=size).select("location", "source", "article_no", F.posexplode("chunks").alias("chunk_no", "text"))
    return rows.select(chunk_id().alias("chunk_id"), "location", "source", "article_no", "chunk_no", "text")


@dataclass(frozen=True)
class Engine:
    """Passages ``chunk_id, location, source, text`` and their index, which has an embedding too, with an encoder and a generator."""

    passages: DataFrame
    index: DataFrame
    embedder: Embedder
    generator: Generator
    top_k: int = 10
    prefix: str = ""
    metric: str = "Cosine"

    @classmethod
    def over(cls, passages: DataFrame, embedder: Embedder | None = None, generator: Generator | None = None, **settings) -> Engine:
        embedder = embedder or HashedEmbedder()
        return cls(passages, embedder.transform(passages, "text"), embedder, generator or Extractive(), **settings)

    @classmethod
    def kept(cls, passages: DataFrame, root: str, embedder: Embedder | None = None, generator: Generator | None = None, **settings) -> Engine:
        """As :meth:`over`, with the vectors kept below ``root``: each distinct text is encoded once, and never again by a later plan or engine."""
        embedder = embedder or HashedEmbedder()
        vectors = VectorTable(passages.sparkSession, root, embedder)
        vectors.add(passages, "text")
        return cls(passages, vectors.join(passages.select("chunk_id", "location", "text"), "text").drop("text"), embedder, generator or Extractive(), **settings)

    def rewrite(self, state: DataFrame) -> DataFrame:
        return state.withColumn("rewritten_query", clean_rewrite(self.generator.rewrite(F.col("question")), F.col("question")))

    def hits(self, state: DataFrame, location: str | None = None) -> DataFrame:
        """``question_id, rank, score, chunk_id, text, location, source``, one row a hit."""
        own = [c for c in ("location",) if c in state.columns]  # a question may have a location of its own
        queries = embed_queries(self.embedder, state.select("question_id", "rewritten_query", *own), "rewritten_query", self.prefix).select(F.col("question_id").alias("query_id"), "embedding", *own)
        points = location_filter(self.index, location)
        found = (search_by_location if own else search_many)(points, queries, self.top_k, self.metric, id_col="chunk_id")
        # texts are fetched for the hits alone, from the passages, which need no encoding
        payload = location_filter(self.passages, location).select("chunk_id", "text", "location", "source")
        named = found.select(F.col("query_id").alias("question_id"), F.col("id").alias("chunk_id"), "score", "rank").join(payload, "chunk_id")
        return named.select("question_id", "rank", "score", "chunk_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "location", "source")))

    def retrieve(self, state: DataFrame, location: str | None = None) -> DataFrame:
        listed = self.hits(state, location).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "text", "location", "source"))).alias("retrieved_docs"))
        joined = state.drop("retrieved_docs").join(listed, "question_id", "left")
        return joined.withColumn("retrieved_docs", F.coalesce("retrieved_docs", F.array().cast(HIT)))

    def answer(self, state: DataFrame) -> DataFrame:
        sources = F.array_distinct(F.transform("retrieved_docs", lambda d: F.struct(d.location.alias("location"), d.source.alias("source"))))
        prompt = answer_text(F.col("question"), format_context(F.col("retrieved_docs")))
        said = self.generator.answer(F.col("question"), F.col("retrieved_docs"))
        return state.withColumns({"prompt": prompt, "answer": said, "sources": sources})

    def ask_batch(self, questions: DataFrame, location: str | None = None) -> DataFrame:
        """``questions(question_id, question)`` with the five fields of a result; a column ``location`` filters each question's passages."""
        done = questions.transform(self.rewrite).transform(lambda s: self.retrieve(s, location)).transform(self.answer)
        return done.select("question_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("question", "rewritten_query")), "retrieved_docs", F.coalesce("answer", F.lit("")).alias("answer"), "sources")

    def ask(self, spark: SparkSession, question: str) -> DataFrame:
        return self.ask_batch(spark.createDataFrame([(0, question)], "question_id long, question string"))

    def chat(self, rows: DataFrame) -> DataFrame:
        """Messages ``conv_id, turn, id, type, content`` with an answer of type ``ai`` at the end of every conversation.

        The question of a conversation is its last human text; the id of the
        answer follows from conversation and length, so a repetition gives the same.
        """
        asked = last_user_text(rows).select(F.col("conv_id").alias("question_id"), F.col("text").alias("question"))
        length = rows.groupBy("conv_id").agg(F.max("turn").alias("last"))
        said = self.ask_batch(asked).select(F.col("question_id").alias("conv_id"), "answer").join(length, "conv_id")
        own = F.concat_ws("-", F.lit("answer"), F.col("conv_id").cast("string"), F.col("last").cast("string"))
        return append(rows, said.select("conv_id", own.alias("id"), F.lit("ai").alias("type"), F.col("answer").alias("content")))

    def trace(self, questions: DataFrame) -> DataFrame:
        """``question_id, step, node, delta``: what each node adds, as JSON."""
        done = questions.transform(self.rewrite).transform(self.retrieve).transform(self.answer)
        deltas = [("rewrite", ["rewritten_query"]), ("retrieve", ["retrieved_docs"]), ("answer", ["answer", "sources"])]
        steps = F.array(*(F.struct(F.lit(k).alias("step"), F.lit(node).alias("node"), F.to_json(F.struct(*cols)).alias("delta")) for k, (node, cols) in enumerate(deltas, 1)))
        return done.select("question_id", F.explode(steps).alias("s")).select("question_id", "s.step", "s.node", "s.delta")


def sources_of(result: DataFrame) -> DataFrame:
    """``question_id, line``: locations of the sources in order, without the empty ones."""
    names = F.filter(F.transform("sources", lambda s: s.location), lambda x: x != "")
    return result.select("question_id", F.array_join(names, ", ").alias("line"))


def report(result: DataFrame) -> DataFrame:
    """``question_id, report``: a result as text."""
    line = F.array_join(F.filter(F.transform("sources", lambda s: s.location), lambda x: x != ""), ", ")
    text = F.concat(
        F.lit("Q (original) : "), "question", F.lit("\nQ (rewritten): "), "rewritten_query", F.lit("\n\nA: "), "answer", F.lit("\n\n"),
        F.when(line != "", F.concat(F.lit("Sources: "), line, F.lit("\n"))).otherwise(""), F.lit("(retrieved "), F.size("retrieved_docs").cast("string"), F.lit(" passages)"),
    )
    return result.select("question_id", text.alias("report"))


def write_json(result: DataFrame, path: str) -> None:
    """Writes results as JSON, one a line: all characters as they are, missing values as null; what was there is replaced as a whole."""
    result.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_json(result_schema: StructType, spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(result_schema).json(path)
