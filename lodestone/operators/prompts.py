"""Prompt texts and message lists as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import or_else

REFUSAL = "I cannot answer this from the passages I have."
SYSTEM_REWRITE = "Turn the user's question into one self-contained search query on a single line. Resolve pronouns from the conversation. Reply with the query alone."
SYSTEM_ANSWER = f"Answer from the numbered passages only and end with a note of the sources used. If they do not hold the answer, reply exactly: {REFUSAL}"
# fixed formats
EMPTY_CONTEXT = "(no context retrieved)"
CONTEXT, QUESTION = "Context passages:\n", "\n\nQuestion: "
CLOSING = "Answer using only the context above."
HISTORY, LATEST = "Conversation so far:\n", "\n\nLatest question: "


def format_context(hits: Column) -> Column:
    """``[i] (Location: L) text`` and a source line for each of ``array<struct<text, location, source>>``."""
    one = lambda p, i: F.concat(
        F.lit("["), (i + 1).cast("string"), F.lit("] (Location: "), F.coalesce(p.location, F.lit("?")), F.lit(") "), F.coalesce(p.text, F.lit("")), F.lit("\n    Source: "), F.coalesce(p.source, F.lit(""))
    )
    return F.array_join(F.transform(hits, one), "\n\n")


def answer_text(question: Column, context: Column) -> Column:
    return F.concat(F.lit(CONTEXT), or_else(context, F.lit(EMPTY_CONTEXT)), F.lit(QUESTION), question, F.lit(f"\n\n{CLOSING}"))


def rewrite_text(question: Column, history: Column) -> Column:
    """The bare question, or the question behind the conversation so far."""
    return F.when(or_else(history, F.lit(None)).isNull(), question).otherwise(F.concat(F.lit(HISTORY), history, F.lit(LATEST), question))


def messages(system: str, user: Column) -> Column:
    """``array<struct<role, content>>`` of a system and a user message."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def system_prompt(rows: Column) -> Column:
    """System contents of ``array<struct<role, content>>``, joined by a blank line; null if there are none."""
    own = F.filter(rows, lambda m: m.role == "system")
    return F.nullif(F.array_join(F.transform(own, lambda m: m.content), "\n\n"), F.lit(""))


def turns(rows: Column) -> Column:
    return F.filter(rows, lambda m: m.role.isin("user", "assistant"))


def joined_text_blocks(blocks: Column, separator: str) -> Column:
    """The texts of the text blocks of ``array<struct<type, text>>``."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b.type == "text"), lambda b: b.text), separator)


def content_string(plain: Column, blocks: Column) -> Column:
    """A content that is text as it is, else the texts of its text blocks, joined by a space."""
    return F.coalesce(plain, joined_text_blocks(blocks, " "), F.lit(""))


def role_label(kind: Column) -> Column:
    """Only the capital form of ``System`` has a label."""
    return F.when(kind == "human", "User").when(kind == "ai", "Assistant").when(kind == "tool", "Tool").when(kind == "System", "System").otherwise("")


def message_line(kind: Column, content: Column, tool_calls_json: Column) -> Column:
    """``type: text - Tool calls: json``, without the parts that are empty."""
    text = F.when(F.coalesce(content, F.lit("")) != "", F.concat(F.lit(" "), content)).otherwise("")
    calls = F.when(F.coalesce(tool_calls_json, F.lit("")) != "", F.concat(F.lit(" - Tool calls: "), tool_calls_json)).otherwise("")
    return F.concat(kind, F.lit(":"), text, calls)
