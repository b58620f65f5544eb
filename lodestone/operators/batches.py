"""What keeps Python workers small: short batches, and memory that is given back after every task."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

Batches = Iterator[pa.RecordBatch]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on this session sends Python at most ``rows`` rows at a time: texts and vectors of a batch are held several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def releasing(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``work`` over the batches of a task, whose worker, kept for later tasks, gives its free memory back at the end."""

    def run(batches: Batches) -> Batches:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run
