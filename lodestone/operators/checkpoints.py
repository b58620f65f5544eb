"""Threads as forests of checkpoints.

A node is ``conv_id, checkpoint_id, parent_id`` with the message that it adds,
``id, type, content``; a root has no parent.  The state at a node is what its
path from the root adds.  Editing or regenerating a message adds a sibling, a
node with the same parent.

Paths come from pointer doubling: after k rounds a table holds each node's
ancestor 2**k steps up, so that a path of n nodes takes log2(n) joins, each on
(thread, node).  Only the asked nodes' paths are spread out, not those of all.

Defined cases: a parent that isn't there ends a path, as a root does; nodes that
are their own ancestors are an error; of a repeated node one row counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.store import settled

KEY = ["conv_id", "checkpoint_id"]
#: A path of 2**ROUNDS nodes is taken for a circle.
ROUNDS = 40


def _ups(nodes: DataFrame) -> list[DataFrame]:
    """``conv_id, checkpoint_id, up``: each node's ancestor 1, 2, 4, .. steps up, as far as any has one."""
    known = nodes.select(*KEY).distinct()
    pointers = nodes.where("parent_id IS NOT NULL").groupBy(*KEY).agg(F.min("parent_id").alias("up"))
    there = known.withColumnRenamed("checkpoint_id", "up")
    now = settled(pointers.join(there, ["conv_id", "up"], "left_semi").select(*KEY, "up"))
    found = []
    while not now.isEmpty():
        if len(found) >= ROUNDS:
            raise ValueError("a checkpoint is its own ancestor")
        found.append(now)
        next_ = now.select("conv_id", F.col("checkpoint_id").alias("up"), F.col("up").alias("further"))
        now = settled(now.join(next_, ["conv_id", "up"]).select(*KEY, F.col("further").alias("up")))
    return found


def paths(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``conv_id, leaf, checkpoint_id, height`` for the ancestors of ``wanted(conv_id, checkpoint_id)``, themselves included at height 0."""
    known = wanted.select(*KEY).distinct().join(nodes.select(*KEY).distinct(), KEY, "left_semi")
    rows = settled(known.select("conv_id", F.col("checkpoint_id").alias("leaf"), "checkpoint_id", F.lit(0).cast("long").alias("height")))
    ups = _ups(nodes)
    for k in reversed(range(len(ups))):  # every height is a sum of distinct powers of two, so each comes up once
        above = rows.join(ups[k], KEY).select("conv_id", "leaf", F.col("up").alias("checkpoint_id"), (F.col("height") + (1 << k)).alias("height"))
        rows = settled(rows.unionByName(above))  # the next round reads it twice
    return rows


def states(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``conv_id, leaf, place, checkpoint_id`` and the message of every node on the paths of ``wanted``; ``place`` counts from 0 at the root."""
    found = paths(nodes, wanted)
    depth = found.groupBy("conv_id", "leaf").agg(F.max("height").alias("depth"))
    once = nodes.groupBy(*KEY).agg(F.min(F.struct("id", "type", "content")).alias("m"))
    placed = found.join(depth, ["conv_id", "leaf"]).join(once, KEY)
    return placed.select("conv_id", "leaf", (F.col("depth") - F.col("height")).alias("place"), "checkpoint_id", "m.*")


def leaves(nodes: DataFrame) -> DataFrame:
    """``conv_id, checkpoint_id`` of the nodes that are nobody's parent."""
    parents = nodes.select("conv_id", F.col("parent_id").alias("checkpoint_id"))
    return nodes.select(*KEY).distinct().join(parents, KEY, "left_anti")


def parents_of(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``conv_id, asked, checkpoint_id``: the parent checkpoint from which each wanted node is made anew; null at a root."""
    own = nodes.select("conv_id", F.col("checkpoint_id").alias("asked"), F.col("parent_id").alias("checkpoint_id")).distinct()
    return own.join(wanted.select("conv_id", F.col("checkpoint_id").alias("asked")).distinct(), ["conv_id", "asked"], "left_semi")


def before(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``conv_id, asked, place`` and the messages from which the wanted nodes are made anew: the states of their parents."""
    asked = parents_of(nodes, wanted).where("checkpoint_id IS NOT NULL")
    found = states(nodes, asked).withColumnRenamed("leaf", "parent_id")
    return asked.withColumnRenamed("checkpoint_id", "parent_id").join(found, ["conv_id", "parent_id"]).select("conv_id", "asked", "place", "checkpoint_id", "id", "type", "content")


def edited(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """The forest with a sibling for each of ``edits(conv_id, asked, checkpoint_id, id, content)``: the parent and type of ``asked``, an id and a text of its own."""
    own = nodes.select("conv_id", F.col("checkpoint_id").alias("asked"), "parent_id", "type").distinct()
    added = edits.join(own, ["conv_id", "asked"])
    columns = [*KEY, "parent_id", "id", "type", "content"]
    return nodes.select(*columns).unionByName(added.select(*columns))


def branches(nodes: DataFrame, order: Column | None = None) -> DataFrame:
    """``conv_id, checkpoint_id, position, branches, previous, next``: each node among the siblings of its parent, in the order of their ids."""
    by = Window.partitionBy("conv_id", "parent_id")
    ordered = by.orderBy(F.col("checkpoint_id") if order is None else order)
    return nodes.select(
        *KEY, F.row_number().over(ordered).alias("position"), F.count("*").over(by).alias("branches"), F.lag("checkpoint_id").over(ordered).alias("previous"), F.lead("checkpoint_id").over(ordered).alias("next")
    )
