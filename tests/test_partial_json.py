from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.functions.partial_json import closing, repaired


def plain(text):
    """The same by loops: close what is open and read it; None if that fails."""
    out, stack, inside, escaped = "", [], False, False
    for c in text:
        if inside:
            if c == '"' and not escaped:
                inside = False
            elif c == "\n" and not escaped:
                c = "\\n"
            escaped = c == "\\" and not escaped
        elif c == '"':
            inside, escaped = True, False
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack or stack.pop() != c:
                return None
        out += c
    try:
        value = json.loads(out + '"' * inside + "".join(reversed(stack)))
    except ValueError:
        return None
    return None if value is None else json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


WHOLE = [
    '{"a": 1, "b": [1, 2, {"c": "d\\"e\\\\", "f": null}], "g": {"h": true}}',
    '{"text": "line one\nline two {[ \\n \\u00e9 é", "x": [[], {}, [[1.5]]], "": ""}',
    '[1, "]", {"}": "{"}] ',
    '"only a string"',
    "12",
    " ",
    '{"a": 1} trailing',
    '{"a"]: 1}',
    '{"tab": "a\tb"}',
    '{"bad": "\\\n"}',
    "null",
    "}",
]


def test_all_prefixes_equal_the_plain_version(spark):
    texts = sorted({t[:k] for t in WHOLE for k in range(len(t) + 1)})
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", repaired(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in rows} == {t: plain(t) for t in texts}


def test_truncated_calls_are_closed(spark):
    cases = {'{"a": 1': '{"a":1}', '{"a": "par': '{"a":"par"}', '{"a": [1, 2': '{"a":[1,2]}', '{"a": ': None, "": None, None: None, '{"a": 1,': None}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", repaired(F.col("t")).alias("r"), closing(F.col("t")).alias("c")).collect()
    assert {r.t: r.r for r in rows} == cases
    assert {r.t: r.c for r in rows}['{"a": [1, 2'] == "]}"


def test_very_long_text(spark):
    text = '{"a": ["' + 'x\\"' * 200_000 + '", ' + "[" * 500
    assert spark.range(1).select(closing(F.lit(text)).alias("c")).first().c == "]" * 501 + "}"
