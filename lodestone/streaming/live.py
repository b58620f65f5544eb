"""Streams of questions and of conversation turns."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.plans.pipeline import Engine


def ask_stream(engine: Engine, questions: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Answers a stream of ``question_id, question``; every micro-batch has a folder of its own, so a repeated batch replaces itself."""

    def answer(batch: DataFrame, batch_id: int) -> None:
        engine.ask_batch(batch).write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    return questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


NODES = ("rewrite", "retrieve", "answer")


def _once(batch: DataFrame, path: str) -> None:
    """Writes a batch unless it has been written as a whole already, so that a repeated batch adds nothing that a later stream could see."""
    spark = batch.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS"))
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        batch.write.mode("overwrite").parquet(path)


def node_streams(engine: Engine, questions: DataFrame, out: str, checkpoint: str) -> dict[str, Callable[[], StreamingQuery]]:
    """Starts for the streams of the three nodes, each over what the one before has written.

    A node's update of a question can hence be seen before the next node has
    begun with it.  Every micro-batch is a folder below ``out/<node>`` that
    appears as a whole and once.
    """
    spark = questions.sparkSession
    steps = {"rewrite": engine.rewrite, "retrieve": engine.retrieve, "answer": engine.answer}
    kinds = questions.limit(0) if not questions.isStreaming else spark.createDataFrame([], questions.schema)
    starts, source = {}, questions
    for node in NODES:

        def start(node=node, before=source if node == NODES[0] else (NODES[NODES.index(node) - 1], kinds.schema)) -> StreamingQuery:
            rows = before if isinstance(before, DataFrame) else spark.readStream.schema(before[1]).parquet(os.path.join(out, before[0], "*"))
            write = lambda batch, k: _once(steps[node](batch), os.path.join(out, node, f"epoch-{k}"))
            return rows.writeStream.foreachBatch(write).option("checkpointLocation", os.path.join(checkpoint, node)).trigger(availableNow=True).start()

        starts[node] = start
        kinds = steps[node](kinds)
    return starts


DELTAS = {"rewrite": ["rewritten_query"], "retrieve": ["retrieved_docs"], "answer": ["answer", "sources"]}


def updates(spark: SparkSession, out: str, nodes: Sequence[str] = NODES) -> DataFrame:
    """``question_id, step, node, delta`` of the updates that ``nodes`` have made so far."""
    found = None
    for node in nodes:
        step = F.lit(NODES.index(node) + 1)
        rows = spark.read.parquet(os.path.join(out, node, "*")).select("question_id", step.alias("step"), F.lit(node).alias("node"), F.to_json(F.struct(*DELTAS[node])).alias("delta"))
        found = rows if found is None else found.unionByName(rows)
    return found


def last_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, text``: the latest text of each conversation, kept up to date over a stream."""
    return turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
