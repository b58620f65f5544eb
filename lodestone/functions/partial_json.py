"""Reading of JSON texts that end too early, as streamed tool calls do.

A push-down automaton goes over the text once: it knows the closers of the open
brackets, whether it is inside a string and whether the character before was an
escape.  What it holds at the end closes the text.  All of it is one native
expression; runs of characters that can't change the state are one step.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What can't change the automaton's state, but for ending an escape.
PLAIN = r'[^"\\{}\[\]\x00-\x1f]+'


def _step(s: Column, c: Column) -> Column:
    """The state after one character; ``open`` has the closers of the open brackets, the innermost first."""
    quote, opens, closes = c == '"', c.isin("{", "["), c.isin("}", "]")
    line = c == "\n"
    control = (c < " ") & (c != "")
    closer = F.when(c == "{", "}").otherwise("]")
    after = F.when(s.inside, s.open).when(opens, F.concat(closer, s.open)).when(closes, F.substring(s.open, 2, 1 << 30)).otherwise(s.open)
    # in a string a line feed is read as an escaped one; other control characters and a line feed behind an escape are errors
    wrong = F.when(s.inside, control & (~line | s.escaped)).otherwise(closes & (F.substring(s.open, 1, 1) != c))
    return F.struct(
        after.alias("open"),
        F.when(s.inside, ~quote | s.escaped).otherwise(quote).alias("inside"),
        (s.inside & ~s.escaped & (c == "\\")).alias("escaped"),
        (s.wrong | wrong).alias("wrong"),
    )


def closing(c: Column) -> Column:
    """What closes a truncated JSON text: a quote if it ends inside a string, then the open brackets' closers; null if its brackets don't match."""
    start = F.struct(F.lit("").alias("open"), F.lit(False).alias("inside"), F.lit(False).alias("escaped"), F.lit(False).alias("wrong"))
    shape = F.split(F.regexp_replace(c, PLAIN, "x"), "")
    return F.aggregate(shape, start, _step, lambda s: F.when(~s.wrong, F.concat(F.when(s.inside, '"').otherwise(""), s.open)))


def repaired(c: Column) -> Column:
    """The value of a JSON text that may end too early, as compact JSON with sorted keys; null if closing it gives no value.

    A text of white space alone and the value ``null`` give null, too.
    """
    one = F.from_json(F.concat(F.lit("["), c, closing(c), F.lit("]")), "variant", {"allowUnquotedControlChars": "true"})
    alone = F.try_variant_get(one, "$[1]", "variant").isNull()
    value = F.try_variant_get(one, "$[0]", "variant")
    return F.when(alone & ~F.is_variant_null(value), F.to_json(value))
