"""Text helpers as Column expressions.

Lengths and cuts count code points.  A value that Python's ``or`` would replace
(missing or empty) goes through :func:`or_else`; one that ``.get`` would replace
(missing only) through ``coalesce``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"(?U)^\s+|\s+$"


def or_else(c: Column, other: Column) -> Column:
    """``other`` where ``c`` is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, WHITE, "")


def strip_quotes(c: Column) -> Column:
    return F.regexp_replace(c, '^"+|"+$', "")


def clean_rewrite(rewrite: Column, question: Column) -> Column:
    """White space off, then quotes off, and the question if nothing is left."""
    return or_else(strip_quotes(strip(rewrite)), question)


def preview(c: Column, size: int = 200) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("…"))).otherwise(c)


def collapse(c: Column, lines: int = 4, size: int = 500) -> Column:
    """The first ``size`` characters of a long text, the first lines of a tall one, or all."""
    split = F.split(c, "\n", -1)
    short = F.concat(F.array_join(F.slice(split, 1, lines), "\n"), F.lit("\n..."))
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).when(F.size(split) > lines, short).otherwise(c)


def is_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^https?://[^\s/?#]+"), F.lit(False))


def truncate_string(c: Column, size: int = 100) -> Column:
    """Cut unless short or a URL."""
    return F.when((F.length(c) > size) & ~is_url(c), F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def truncate_json(c: Column, size: int = 100) -> Column:
    """A long JSON text gives way to a note of its length."""
    return F.when(F.length(c) > size, F.concat(F.lit("Truncated "), F.length(c).cast("string"), F.lit(" characters..."))).otherwise(c)


def is_complex(json: Column) -> Column:
    """Whether a JSON text is an array or an object."""
    kind = F.schema_of_variant(F.try_parse_json(json))
    return F.coalesce(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.lit(False))


def scalar_text(json: Column) -> Column:
    """A JSON string without its quotes; numbers, arrays and objects as JSON."""
    value = F.try_parse_json(json)
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(json)


def _items(json: Column) -> Column:
    """The items of a JSON array as ``array<struct<key, value>>``, keyed from 0; strings come without quotes."""
    return F.transform(F.from_json(json, "array<string>"), lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value")))


def _entries(json: Column) -> Column:
    return F.transform(F.map_entries(F.from_json(json, "map<string,string>")), lambda e: F.struct(e.key.alias("key"), e.value.alias("value")))


def result_rows(c: Column, items: int = 5) -> Column:
    """A tool result as ``array<struct<key, value>>``: the first items of a JSON array, the entries of an object, else the text without a key."""
    raw = F.array(F.struct(F.lit(None).cast("string").alias("key"), c.alias("value")))
    return F.when(~is_complex(c), raw).when(c.rlike(r"^\s*\["), F.slice(_items(c), 1, items)).otherwise(_entries(c))


def truncate_value(json: Column, size: int = 100, items: int = 2) -> Column:
    """A JSON value for a narrow place: a cut string, the first items of an array, a note for a long object, else the value."""
    first = F.to_json(F.transform(F.slice(F.from_json(json, "array<string>"), 1, items), lambda x: truncate_string(x, size)))
    text = scalar_text(json)
    return F.when(json.rlike(r"^\s*\[") & is_complex(json), first).when(is_complex(json), truncate_json(json, size)).otherwise(truncate_string(text, size))


def interrupt_rows(json: Column, items: int = 5, lines: int = 4, size: int = 500) -> Column:
    """Rows ``key, value`` of a collapsed interrupt: the first items of an array; an object's entries, cut only if it is tall or long."""
    big = (F.size(F.split(json, "\n", -1)) > lines) | (F.length(json) > size)
    cut = F.transform(_entries(json), lambda e: F.struct(e.key.alias("key"), F.when(is_complex(e.value), truncate_value(e.value)).otherwise(truncate_string(e.value)).alias("value")))
    return F.when(json.rlike(r"^\s*\["), F.slice(_items(json), 1, items)).when(big, cut).otherwise(_entries(json))


def prettify(c: Column) -> Column:
    """Start case: words from underscores, hyphens and camel case."""
    spaced = F.regexp_replace(F.regexp_replace(c, "[_-]+", " "), "([a-z0-9])([A-Z])", "$1 $2")
    words = F.filter(F.split(spaced, " +"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def pretty_date(c: Column) -> Column:
    """``MM/dd/yyyy hh:mm AM``; null where the text is no date."""
    return F.date_format(F.try_to_timestamp(c), "MM/dd/yyyy hh:mm a")


def cell(c: Column) -> Column:
    """A table cell: a date in its display form, else the text."""
    return F.coalesce(pretty_date(F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), c)), c)


def studio_url(base: str, deployment: Column, thread_id: Column) -> Column:
    """``base[/thread]?baseUrl=deployment`` with one trailing slash taken off the deployment."""
    path = F.when(or_else(thread_id, F.lit(None)).isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), thread_id))
    return F.concat(F.lit(base), path, F.lit("?baseUrl="), F.url_encode(F.regexp_replace(deployment, "/$", "")))


def three_decimals(c: Column) -> Column:
    """``{:.3f}`` of the exact value; Spark's own formatting rounds the shortest decimal text, which takes 0.1235 up."""

    @F.pandas_udf("string")
    def shown(part: pd.Series) -> pd.Series:
        return part.map("{:.3f}".format, na_action="ignore")

    return shown(c)


def id_abbrev(c: Column) -> Column:
    return F.concat(F.left(c, F.lit(3)), F.lit("..."), F.right(c, F.lit(3)))


def base64_text(c: Column) -> Column:
    """Base64 in one line; Spark's own may break lines."""
    return F.replace(F.base64(c), F.lit("\r\n"), F.lit(""))


def data_url_payload(c: Column) -> Column:
    """What follows the first comma of a data URL."""
    return F.split_part(c, F.lit(","), F.lit(2))


def bold_runs(c: Column) -> Column:
    """The texts between pairs of double asterisks."""
    return F.regexp_extract_all(c, F.lit(r"\*\*([^*]+)\*\*"), 1)
