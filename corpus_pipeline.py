"""A corpus pipeline of five stages over ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each result as Parquet in the shared folder and rereads it as the next
stage's input.  All stages but the last return the columns of ``documents``.
Texts go to Python in small batches (``small_batches``), a setting of the session
that every stage makes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, langid, similar, substrings
from lodestone.llm.common import small_batches, table, written

#: Posterior that a document's language needs: likelier than all others together.
LEAST_SCORE = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language can't be told.

    These have no text (null or empty), no letter in it, or no language whose
    posterior under the model is ``LEAST_SCORE`` or more.  ``lang`` stays as it came; a prediction fills it where it is null.  The
    model learns from the labelled documents of this input that aren't held out;
    if there are none, every text with a letter stays and ``lang`` with it.
    Ids play no part but for the split and may be null or repeat; repeated rows
    all stay.
    """
    small_batches(spark)
    model = langid.train(docs.where(~langid.held_out()).select("lang", "text"), bpe.public_path("piece_bpe_32k.model"))
    if not model.languages:
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    said = langid.predict(docs.select(*COLUMNS), model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return said.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group.

    Links are pairs whose sets of five-word shingles have a similarity of 0.8 or
    more, found by bit-sliced SimHash comparison and checked on the whole sets.
    The smallest id stays; a row without an id stays only if no row of its
    group has one, and then one of them; of rows that share the smallest id or
    repeat each other, one stays (:func:`similar.one_of_each`).
    """
    small_batches(spark)
    return similar.one_of_each(docs.select(*COLUMNS))


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the 200-byte strings that occur elsewhere, in whole characters.

    ``n_chars`` follows the text; a document of which nothing but white space
    is left goes.  Null and empty texts and those under 200 bytes stay as they
    are; repeated rows, had the stage before left any, would lose all copies.
    """
    small_batches(spark)
    lost = substrings.repeated(docs, with_text=True).select("sha", "kept")
    own = docs.select(*COLUMNS, F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    left = own.join(lost, "sha", "left").withColumn("text", F.coalesce("kept", "text"))
    changed = F.col("kept").isNotNull()
    left = left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.where(~changed | F.col("text").rlike(r"\S")).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of ``benchmark``; null and empty texts hold none, ids play no part."""
    small_batches(spark)
    found = decontaminate.flag(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where("n_items = 0").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids`` and the digests of ids and decoded text of every row; a null text encodes as the empty one."""
    small_batches(spark)
    path = bpe.public_path("word_bpe_49k.json")
    encoded = bpe.encode(docs, path, decoded="decoded")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_strings),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]

#: No stage can be written in SQL; tests hold their operators against brute-force versions and the stages against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
