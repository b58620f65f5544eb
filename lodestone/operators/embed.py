"""Encoders: a protocol and an offline stand-in.

The stand-in hashes words into buckets (first 8 hex digits of md5, modulo the
dimension), counts them and normalises.  It is lexical, deterministic and the
same in any engine; a sentence model plugs in behind the same protocol.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.batches import releasing, small_batches

TOKEN = re.compile("[a-z0-9]+")
#: Words whose buckets a worker remembers.
REMEMBERED = 200_000
BATCH = 1024


class Embedder(Protocol):
    dim: int
    #: Tells apart encoders that give different vectors.
    name: str

    def transform(self, df: DataFrame, text_col: str, out: str = "embedding") -> DataFrame: ...


class Buckets(dict):
    """The buckets of words; one that isn't known yet is found and remembered."""

    def __init__(self, dim: int) -> None:
        self.dim = dim

    def __missing__(self, word: str) -> int:
        self[word] = found = int(md5(word.encode()).hexdigest()[:8], 16) % self.dim
        return found


class HashedEmbedder:
    def __init__(self, dim: int = 256, normalize: bool = True) -> None:
        self.dim, self.normalize = dim, normalize
        self.name = f"hashed-{dim}-{int(normalize)}"

    def vectors(self, texts: list[str], known: Buckets) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for k, text in enumerate(texts):
            words = TOKEN.findall(text.lower())
            if words:
                out[k] = np.bincount(np.fromiter(map(known.__getitem__, words), np.intp, len(words)), minlength=self.dim)
        if self.normalize:
            size = np.sqrt((out * out).sum(axis=1, keepdims=True))
            out = np.divide(out, size, out=out, where=size > 0)
        return out

    def transform(self, df: DataFrame, text_col: str, out: str = "embedding") -> DataFrame:
        """``df`` with a vector per row; a null text counts as empty and has the zero vector."""
        small_batches(df.sparkSession)
        names = [c for c in df.columns if c != out]
        frame = df.select(*names)
        at = names.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Buckets(self.dim)
            for whole in batches:
                for k in range(0, whole.num_rows, BATCH):
                    batch = whole.slice(k, BATCH)
                    if len(known) > REMEMBERED:
                        known.clear()
                    v = self.vectors([t or "" for t in batch.column(at).to_pylist()], known)
                    ends = np.arange(len(v) + 1, dtype=np.int32) * self.dim
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(v.ravel()))], names=[*names, out])

        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
        return frame.mapInArrow(releasing(run), f"{types}, `{out}` array<double>")


@lru_cache(maxsize=2)
def model(name: str):
    """A sentence model, loaded once in the life of a worker process, whatever tasks it runs."""
    from sentence_transformers import SentenceTransformer

    return SentenceTransformer(name)


class ModelEmbedder:
    """Adapter of a sentence model; package and model are loaded once per worker process."""

    def __init__(self, model: str, dim: int, normalize: bool = True, batch: int = 32) -> None:
        self.model, self.dim, self.normalize, self.batch = model, dim, normalize, batch
        self.name = f"model-{re.sub('[^A-Za-z0-9]+', '-', model)}-{dim}-{int(normalize)}"

    def transform(self, df: DataFrame, text_col: str, out: str = "embedding") -> DataFrame:
        try:
            import sentence_transformers  # noqa: F401
        except ImportError as e:
            raise RuntimeError("a sentence model needs the package sentence_transformers") from e
        name, normalize, size = self.model, self.normalize, self.batch

        @F.pandas_udf("array<double>")
        def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from lodestone.operators.embed import model

            for texts in parts:
                yield pd.Series(list(model(name).encode(texts.fillna("").tolist(), batch_size=size, normalize_embeddings=normalize).astype(float)))

        return df.withColumn(out, encode(F.col(text_col)))


class VectorTable:
    """Vectors of texts, kept in a folder by the SHA-256 of the text, so that no text is encoded twice.

    What is new is encoded and appended once for each distinct text; rows get
    their vectors by a join on the hash, in this plan and in all later ones.  A
    text that two writers add at the same time has two equal rows, of which one
    counts.
    """

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder) -> None:
        self.spark, self.embedder, self.path = spark, embedder, f"{root}/vectors-{embedder.name}"

    def rows(self) -> DataFrame:
        """``text_sha, embedding`` of all texts so far."""
        try:
            return self.spark.read.schema("text_sha string, embedding array<double>").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "text_sha string, embedding array<double>")

    def add(self, df: DataFrame, text_col: str = "text") -> None:
        """Encodes the texts that have no vector yet; a null text counts as empty."""
        text = F.coalesce(text_col, F.lit(""))
        texts = df.select(F.sha2(text, 256).alias("text_sha"), text.alias("text")).dropDuplicates(["text_sha"])
        new = texts.join(self.rows().select("text_sha"), "text_sha", "left_anti")
        self.embedder.transform(new, "text").select("text_sha", "embedding").write.mode("append").parquet(self.path)

    def join(self, df: DataFrame, text_col: str = "text", out: str = "embedding") -> DataFrame:
        """``df`` with the vectors of its texts, all of which must have been added."""
        own = df.drop(out).withColumn("text_sha", F.sha2(F.coalesce(text_col, F.lit("")), 256))
        once = self.rows().groupBy("text_sha").agg(F.first("embedding").alias(out))
        return own.join(once, "text_sha").drop("text_sha")


def embed_queries(embedder: Embedder, df: DataFrame, text_col: str, prefix: str = "", out: str = "embedding") -> DataFrame:
    """Queries are encoded behind a prefix, passages are not."""
    held = "__prefixed"
    return embedder.transform(df.withColumn(held, F.concat(F.lit(prefix), F.coalesce(text_col, F.lit("")))), held, out).drop(held)
