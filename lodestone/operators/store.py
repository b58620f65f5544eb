"""The collection: one Parquet table of points, partitioned by location."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.vectors import distance
from lodestone.operators.insert import BATCH, inserted_files, point_writer

#: Rows of a written file at most.
ROWS_PER_FILE = 1_000_000


def chunk_id() -> F.Column:
    """An id that follows from the place of a chunk, so that a rebuild gives the same ids."""
    return F.md5(F.concat_ws("|", "location", "source", F.col("article_no").cast("string"), F.col("chunk_no").cast("string")))


def work_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one under a local master alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="lodestone-work-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        root = "file://" + root
    return os.path.join(root, uuid.uuid4().hex)


def settled(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """``df`` as a table in the shared folder, where its lineage ends; its files have at most ``rows_per_file`` rows, or any number."""
    path = work_dir(df.sparkSession)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Collection:
    """A named set of points of one dimension and distance.

    A rebuild writes a new version beside the old one and then names it in the
    metadata, so that a failure leaves the old version in place.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, dim: int, metric: str = "Cosine") -> None:
        distance(metric)
        self.spark, self.path, self.dim, self.metric = spark, os.path.join(root, name), dim, metric

    def _meta(self) -> DataFrame:
        return self.spark.read.schema("version int, dim int, metric string").json(os.path.join(self.path, "_versions"))

    def version(self) -> int:
        """The version in use; 0 if the collection was never built."""
        try:
            found = self._meta().agg(F.max("version")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0
        return found or 0

    def rebuild(self, points: DataFrame) -> None:
        """Replaces all points; checks every vector's dimension."""
        after = self.version() + 1
        good = points.withColumn("embedding", F.when(F.size("embedding") == self.dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector has not {self.dim} components"))))
        good.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("location").parquet(os.path.join(self.path, f"v{after}"))
        row = json.dumps({"version": after, "dim": self.dim, "metric": self.metric})
        self.spark.range(1).select(F.lit(row).alias("value")).write.mode("append").text(os.path.join(self.path, "_versions"))

    def backfill(self, points: DataFrame) -> None:
        """Replaces the points of the locations that occur in ``points``."""
        path = os.path.join(self.path, f"v{max(self.version(), 1)}")
        points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("location").parquet(path)

    def insert(self, points: DataFrame, batch_size: int = BATCH) -> None:
        """Adds points in batches of ``batch_size``: all of them become visible at once, or none does.

        Every point needs a location, and a vector of the collection's dimension
        without null components; ids aren't compared with those that are there.
        """
        version = max(self.version(), 1)
        root = os.path.join(self.path, f"inserts-v{version}")
        at = points.columns.index("location"), points.columns.index("embedding")
        source = point_writer(root, points.schema, at, self.dim, batch_size)
        self.spark.dataSource.register(source)
        points.write.format(source.name()).mode("append").save()

    def points(self) -> DataFrame:
        """The points in use; a location is text, even where all locations look like numbers."""
        version = self.version()
        files = inserted_files(os.path.join(self.path, f"inserts-v{max(version, 1)}"))
        found = None
        if version:
            path = os.path.join(self.path, f"v{version}")
            schema = self.spark.read.parquet(path).schema
            kinds = T.StructType([T.StructField("location", T.StringType()) if f.name == "location" else f for f in schema])
            found = self.spark.read.schema(kinds).parquet(path)
        if files:
            added = self.spark.read.parquet(*files)
            found = added if found is None else found.unionByName(added)
        if found is None:
            raise ValueError("the collection was never built")
        return found

    def count(self) -> int:
        return self.points().count()
