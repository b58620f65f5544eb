"""User-interface rows kept up to date by a stream of push and remove events, in a state store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "seq long, props string, merged long"
CHANGES = "ui_id string, seq long, kind string, props string, merged long"


class ArtifactState(StatefulProcessor):
    """A push puts a row in the place of the one before, a remove deletes it; ``merged`` counts the pushes since.

    Of the events of one batch the order is that of ``seq``; a batch comes after
    those before it, whatever its numbers.  Every key costs its own events and
    one state row; nothing else of the state is read or written.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seqs, gone, last = [], [], None
        for part in rows:  # of a key with many events only numbers and kinds are held together
            seqs.append(part["seq"].to_numpy())
            gone.append(part["kind"].to_numpy() == "remove")
            top = part.iloc[int(seqs[-1].argmax())]
            last = top if last is None or top["seq"] > last["seq"] else last
        seqs, gone = np.concatenate(seqs), np.concatenate(gone)
        removed = gone.any()
        since = int((seqs > seqs[gone].max()).sum()) if removed else len(seqs)
        before = self.row.get() if self.row.exists() else None
        merged = since if removed or before is None else since + before[2]
        if last["kind"] == "remove":
            if before is not None:
                self.row.clear()
            merged = 0
        else:
            self.row.update((int(last["seq"]), last["props"], merged))
        yield pd.DataFrame({"ui_id": [key[0]], "seq": [int(last["seq"])], "kind": [last["kind"]], "props": [last["props"]], "merged": [merged]})

    def close(self) -> None:
        pass


def changes(events: DataFrame) -> DataFrame:
    """A stream of ``ui_id, seq, kind, props, merged``, a row for every key that a batch of events touches.

    Other kinds than ``push`` and ``remove`` aren't for this reducer.
    """
    own = events.where(F.col("kind").isin("push", "remove") & F.col("ui_id").isNotNull()).select("ui_id", "seq", "kind", "props")
    return own.groupBy("ui_id").transformWithStateInPandas(ArtifactState(), CHANGES, "Update", "None")


def keep(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Runs :func:`changes` to the end of what is there; the changes go below ``out``, a folder a batch, the state stays with the checkpoint."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return changes(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``ui_id, seq, props, merged`` of the rows that stand after the last batch, read from the state store."""
    found = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "row").load()
    return found.select("key.ui_id", "value.*")
