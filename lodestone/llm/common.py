"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Only a local master, as in
    tests, may go without: then a temporary folder is set for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", "file://" + made)
    return "file://" + made


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Long keys that a join may broadcast, 16 MB of them.
BROADCAST_KEYS = 1_000_000


def _small(keys: DataFrame) -> bool:
    return keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS


def within(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose long ``on`` is among ``keys``; few keys are sent to the rows, many meet them in a shuffle."""
    return rows.join(F.broadcast(keys) if _small(keys) else keys, on, "left_semi")


def without(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose long ``on`` isn't among ``keys``, likewise."""
    return rows.join(F.broadcast(keys) if _small(keys) else keys, on, "left_anti")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on this session sends Python at most ``rows`` rows at a time.

    Batches of whole texts are bounded by this number alone, and each is held
    several times over: by the executor's Arrow buffers, the pipe and the worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= rows:
        spark.conf.set(key, str(rows))


Batches = Iterator[pa.RecordBatch]


def release() -> None:
    """Gives this process's free memory back to the system: Arrow's pool and, where the C library can, the heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``work`` over the batches of a task, whose worker releases memory at the end.

    Spark keeps workers for the tasks of later stages; without this each keeps
    the most that any of its tasks has taken.
    """

    def run(batches: Batches) -> Batches:
        try:
            yield from work(batches)
        finally:
            release()

    return run
