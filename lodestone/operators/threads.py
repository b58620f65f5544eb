"""Conversation operators over rows ``conv_id, turn, id, type, content, ..``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.partial_json import repaired
from lodestone.functions.text import strip

HIDDEN = "do-not-render-"
HANDLED = "Successfully handled tool call."  # fixed text


def last_user_text(rows: DataFrame) -> DataFrame:
    """``conv_id, text``: the last human text, else the last text, else an empty one."""
    human = F.max_by("content", F.when(F.col("type") == "human", F.col("turn")))
    return rows.groupBy("conv_id").agg(F.coalesce(F.when(F.max((F.col("type") == "human").cast("int")) == 1, human), F.max_by("content", "turn"), F.lit("")).alias("text"))


def append(rows: DataFrame, new: DataFrame) -> DataFrame:
    """``rows`` and ``new(conv_id, id, type, content)``: a known id is replaced in place, another goes to the end."""
    last = rows.groupBy("conv_id").agg(F.max("turn").alias("last"))
    known = rows.select("conv_id", "id", F.col("turn").alias("old_turn"))
    placed = new.join(known, ["conv_id", "id"], "left").join(last, "conv_id", "left")
    order = Window.partitionBy("conv_id").orderBy(F.col("old_turn").isNotNull(), "id")
    placed = placed.withColumn("turn", F.coalesce("old_turn", F.coalesce("last", F.lit(-1)) + F.row_number().over(order)))
    kept = rows.join(new.select("conv_id", "id"), ["conv_id", "id"], "left_anti")
    names = ["conv_id", "turn", "id", "type", "content"]
    return kept.select(*names).unionByName(placed.select("conv_id", F.col("turn").cast("long").alias("turn"), "id", "type", "content"))


def missing_tool_replies(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, call_no, id, tool_call_id, name, content``: a reply for each call of an AI message that no tool message follows.

    One tool message behind it stands for all calls of a message.  Ids follow
    from the place of a call, so that a repetition gives the same ones.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    after = F.lead("type").over(order)
    open_calls = rows.withColumn("after", after).where((F.col("type") == "ai") & (F.coalesce("after", F.lit("")) != "tool"))
    calls = open_calls.select("conv_id", "turn", F.posexplode("tool_calls").alias("call_no", "call"))
    own = F.md5(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("call_no").cast("string")))
    return calls.select("conv_id", "turn", "call_no", F.concat(F.lit(HIDDEN), own).alias("id"), F.coalesce("call.id", F.lit("")).alias("tool_call_id"), F.col("call.name").alias("name"), F.lit(HANDLED).alias("content"))


def visible(rows: DataFrame) -> DataFrame:
    """Without messages whose id hides them; a null id does not."""
    return rows.where(F.coalesce(~F.col("id").startswith(HIDDEN), F.lit(True)))


def titles(threads: DataFrame, rows: DataFrame) -> DataFrame:
    """``conv_id, title``: text of the first message, else the id."""
    first = rows.groupBy("conv_id").agg(F.min_by(F.coalesce("content", F.lit("")), "turn").alias("first"))
    return threads.join(first, "conv_id", "left").select("conv_id", F.coalesce("first", F.col("conv_id").cast("string")).alias("title"))


def without_reply(rows: DataFrame) -> DataFrame:
    """``conv_id`` of the threads without any AI or tool message."""
    return rows.groupBy("conv_id").agg(F.bool_or(F.col("type").isin("ai", "tool")).alias("replied")).where("NOT replied").select("conv_id")


def outgoing(content: Column, blocks: Column) -> Column:
    """The blocks of a message to send, the text first; null if there is nothing to send."""
    text = F.array(F.struct(F.lit("text").alias("type"), content.alias("text")))
    blank = strip(F.coalesce(content, F.lit(""))) == ""
    both = F.when(blank, blocks).otherwise(F.concat(text, blocks))
    return F.when(blank & (F.size(blocks) == 0), F.lit(None)).otherwise(both)


def artifacts(rows: DataFrame, ui: DataFrame) -> DataFrame:
    return rows.join(ui, rows["id"] == ui["message_id"])


def tool_calls_shown(with_args: Column, streamed: Column, bare: Column, hidden: Column) -> Column:
    """Calls with arguments, else streamed ones, else bare ones; none where they are hidden."""
    some = lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, c)
    return F.when(~hidden, F.coalesce(some(with_args), some(streamed), some(bare)))


def assembled(fragments: DataFrame) -> DataFrame:
    """``conv_id, blocks`` from streamed ``conv_id, block_no, fragment_no, type, id, name, input``.

    A block's input is its fragments in order; type, id and name are the first
    that any fragment has.
    """
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("fragment_no"))).alias(c)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fragment_no", "input"))), lambda f: f.input), "")
    blocks = fragments.groupBy("conv_id", "block_no").agg(first("type"), first("id"), first("name"), text.alias("input"))
    listed = F.array_sort(F.collect_list(F.struct("block_no", "type", "id", "name", "input")))
    return blocks.groupBy("conv_id").agg(F.transform(listed, lambda b: b.dropFields("block_no")).alias("blocks"))


def tool_use_blocks(blocks: Column) -> Column:
    """``array<struct<id, name, args>>`` of the streamed calls with an id.

    Arguments that end too early are closed; ``{}`` if that gives nothing.  A
    null name is empty.
    """
    own = F.filter(blocks, lambda b: (b.type == "tool_use") & (b.id != ""))
    args = lambda b: F.coalesce(repaired(b.input), F.lit("{}"))
    return F.transform(own, lambda b: F.struct(b.id.alias("id"), F.coalesce(b["name"], F.lit("")).alias("name"), args(b).alias("args")))


def changed_errors(errors: DataFrame) -> DataFrame:
    """The errors that differ from the one before them."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return errors.withColumn("before", F.lag("message").over(order)).where(~F.col("message").eqNullSafe(F.col("before"))).drop("before")


def first_tokens(states: DataFrame) -> DataFrame:
    """The states in which the number of messages has changed and the last one is an AI message."""
    order = Window.partitionBy("conv_id").orderBy("step")
    return states.withColumn("before", F.coalesce(F.lag("n").over(order), F.lit(0))).where((F.col("n") != F.col("before")) & (F.col("last_type") == "ai")).drop("before")


def submission(rows: DataFrame, typed: DataFrame) -> DataFrame:
    """``conv_id, place, type, id, content``: what a submission sends, missing tool replies in order and then the human message.

    ``typed(conv_id, id, content)`` has the human messages; nothing is sent to a
    conversation without one.
    """
    replies = missing_tool_replies(rows).join(typed.select("conv_id"), "conv_id", "left_semi")
    sent = replies.select("conv_id", F.lit(0).alias("last"), "turn", "call_no", F.lit("tool").alias("type"), "id", "content")
    human = typed.select("conv_id", F.lit(1).alias("last"), F.lit(None).cast(sent.schema["turn"].dataType).alias("turn"), F.lit(None).cast("int").alias("call_no"), F.lit("human").alias("type"), "id", "content")
    order = Window.partitionBy("conv_id").orderBy("last", "turn", "call_no", "id")
    return sent.unionByName(human).select("conv_id", F.row_number().over(order).alias("place"), "type", "id", "content")
