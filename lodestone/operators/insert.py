"""Batched insertion of points with a two-phase commit.

Every task writes the batches of its rows to files of their own and reports
them; only when all tasks have reported does the driver write one manifest that
names the files.  Readers go by manifests, so that a failed insert, a lost
executor or an attempt that ran twice leaves nothing that can be seen; an abort
also takes the files away.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

BATCH = 128
MANIFESTS = "_manifests"
#: Batches of one file.
TOGETHER = 1024


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int
    batches: int


def _system(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root else fs.FileSystem.from_uri("file://" + root)


def checked(batch: pa.RecordBatch, location: int, vector: int, dim: int) -> pa.RecordBatch:
    """The batch, or an error if a point has no location, or no vector of ``dim`` numbers."""
    if batch.column(location).null_count:
        raise ValueError("a point has no location")
    lengths = pc.fill_null(pc.list_value_length(batch.column(vector)), -1)
    if not pc.all(pc.equal(lengths, dim), min_count=0).as_py() or batch.column(vector).flatten().null_count:
        raise ValueError(f"a vector has not {dim} components")
    return batch


def batches_of(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows in batches of ``size``, the last one smaller."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in rows:
        while batch.num_rows:
            part = batch.slice(0, size - n)
            held.append(part)
            n, batch = n + part.num_rows, batch.slice(part.num_rows)
            if n == size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def point_writer(root: str, schema: StructType, at: tuple[int, int], dim: int, size: int) -> type[DataSource]:
    """A data source class that inserts rows of ``schema`` below ``root``; ``at`` has the places of location and vector."""
    job = uuid.uuid4().hex

    class Writer(DataSourceArrowWriter):
        def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
            system, path = _system(root)
            system.create_dir(f"{path}/{job}", recursive=True)
            files, rows, batches, out = [], 0, 0, None
            task = TaskContext.get()
            for k, batch in enumerate(batches_of((checked(b, *at, dim) for b in iterator), size)):
                if k % TOGETHER == 0:
                    if out is not None:
                        out.close()
                    files.append(f"{path}/{job}/part-{task.partitionId()}-{task.taskAttemptId()}-{len(files)}.parquet")
                    out = pq.ParquetWriter(files[-1], batch.schema, filesystem=system, compression="zstd")
                out.write_table(batch, row_group_size=size)
                rows, batches = rows + batch.num_rows, batches + 1
            if out is not None:
                out.close()
            return Written(files, rows, batches)

        def commit(self, messages: list[WriterCommitMessage | None]) -> None:
            system, path = _system(root)
            done = [m for m in messages if m is not None]
            text = json.dumps({"files": [f for m in done for f in m.files], "rows": sum(m.rows for m in done), "batches": sum(m.batches for m in done)})
            system.create_dir(f"{path}/{MANIFESTS}", recursive=True)
            with system.open_output_stream(f"{path}/{MANIFESTS}/.{job}") as f:
                f.write(text.encode())
            system.move(f"{path}/{MANIFESTS}/.{job}", f"{path}/{MANIFESTS}/{job}.json")  # seen as a whole or not at all

        def abort(self, messages: list[WriterCommitMessage | None]) -> None:
            system, path = _system(root)
            if system.get_file_info(f"{path}/{job}").type != fs.FileType.NotFound:
                system.delete_dir(f"{path}/{job}")

    class Points(DataSource):
        @classmethod
        def name(cls) -> str:
            return "lodestone_points"

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
            if overwrite:
                raise ValueError("points are added; a rebuild replaces them")
            return Writer()

    return Points


def manifests(root: str) -> list[dict]:
    """What the committed inserts below ``root`` have written, in the order of their names."""
    system, path = _system(root)
    infos = system.get_file_info(fs.FileSelector(f"{path}/{MANIFESTS}", allow_not_found=True))
    out = []
    for info in sorted((i for i in infos if i.base_name.endswith(".json") and not i.base_name.startswith(".")), key=lambda i: i.base_name):
        with system.open_input_stream(info.path) as f:
            out.append(json.loads(f.read()))
    return out


def inserted_files(root: str) -> list[str]:
    """The files of all committed inserts."""
    scheme = root.split("://")[0] + "://" if "://" in root else "file://"
    return [scheme + f for m in manifests(root) for f in m["files"]]
