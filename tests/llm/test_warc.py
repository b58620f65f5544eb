from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import warc

RECORD = "record_id long, url string, date timestamp, kind string, status int, headers map<string,string>, payload string"
T0 = datetime(2024, 1, 1)


def test_canonical_urls(spark):
    pairs = [
        ("HTTP://WWW.Example.org:80/A/?b=2&a=1&utm_source=x#frag", "example.org/A?a=1&b=2"),
        ("https://example.org", "example.org/"),
        ("example.org/x//?", "example.org/x"),
        ("https://h:8080/?ref=1", "h:8080/"),
        ("", "/"),
        (None, None),
    ]
    got = spark.createDataFrame(pairs, "u string, k string").select(warc.canonical_url(F.col("u")), "k").collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def brute(rows):
    """rows: (id, key, time, kind, status, headers with lower names)."""
    out = {}
    for i, key, t, kind, _, h in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in rows if r[3] == "response" and r[4] == 200 and key is not None and t is not None and r[1] == key and r[2] is not None and r[2] < t]
        if not earlier:
            out[i] = ("no earlier response", None, h)
            continue
        s = max(earlier, key=lambda r: (r[2], r[0]))
        tag = lambda x: x.get("etag", "").removeprefix("W/") or None
        mine, theirs = s[5], h
        ok = tag(mine) == tag(theirs) if tag(mine) and tag(theirs) else mine.get("last-modified") is not None and mine.get("last-modified") == theirs.get("last-modified")
        out[i] = ("resolved", s[0], {**mine, **{k: v for k, v in theirs.items() if k not in warc.KEPT}}) if ok else ("validators differ", s[0], h)
    return out


def make(n):
    rows = []
    for i in range(n):
        x = (i * 7919 + 13) % 1009
        headers = {}
        if x % 3:
            headers["ETag"] = ('W/"t%d"' if x % 2 else '"t%d"') % (x % 4)
        if x % 5:
            headers["Last-Modified"] = f"d{x % 2}"
        headers["X-N"] = str(i)
        headers["Content-Length"] = str(x)
        kind = "revisit" if x % 4 in (1, 2) else "response"
        rows.append((i, f"http://h{x % 3 if i % 4 else 0}/p", T0 + timedelta(seconds=(x * 37) % 90000), kind, 304 if kind == "revisit" else 200 if x % 11 else 500, headers, "body" if kind == "response" else None))
    return rows


def test_as_of_join(spark):
    rows = make(400)
    rows += [(1000, None, T0, "revisit", 304, {}, None), (1001, "http://h0/p", None, "revisit", 304, None, None), (1002, "http://new/", T0, "revisit", 304, {"ETag": "x"}, None), (1003, "http://new/", T0, "response", 200, {"ETag": "x"}, "b")]
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORD)).collect()}
    assert len(got) == len(rows)
    low = [(i, None if u is None else u.removeprefix("http://") , t, k, s, {a.lower(): b for a, b in (h or {}).items()}) for i, u, t, k, s, h, _ in rows]
    want = brute(low)
    assert {"resolved", "validators differ", "no earlier response"} == {w[0] for w in want.values()}
    for i, (resolution, ref, headers) in want.items():
        assert (got[i].resolution, got[i].refers_to, got[i].headers) == (resolution, ref, headers)
        assert got[i].payload_from == (ref if resolution == "resolved" else None)


def test_records_round_trip(spark):
    rows = [(1, "http://a/é", T0, "response", 200, {"ETag": '"a: b"', "X": ""}, "one\r\n\r\ntwo: é\n"), (2, "http://a/é", T0, "revisit", 304, {}, None), (3, "http://b", T0 + timedelta(microseconds=7), "response", 200, {"A": "1"}, "")]
    back = warc.read_records(warc.write_records(spark.createDataFrame(rows, RECORD))).collect()
    assert sorted(map(tuple, back)) == rows


def test_repeated_headers(spark):
    """No value of a repeated header is lost, neither in a record nor in what a revisit gets."""
    rows = [(1, "http://a/", T0, "response", 200, {"Set-Cookie": "a=1\nb=2; c", "set-cookie": "d=3", "ETag": "x"}, ""), (2, "http://a/", T0 + timedelta(days=1), "revisit", 304, {"etag": "x"}, None)]
    text = warc.write_records(spark.createDataFrame(rows, RECORD))
    assert "Set-Cookie: a=1\r\nSet-Cookie: b=2; c\r\nset-cookie: d=3\r\n" in text.where("record_id = 1").first().warc
    back = warc.read_records(text)
    assert sorted(map(tuple, back.collect())) == rows
    got = {r.record_id: r for r in warc.resolve_revisits(back).collect()}
    assert got[2].resolution == "resolved" and got[2].headers == {"set-cookie": "a=1\nb=2; c\nd=3", "etag": "x"}


def test_ties_and_long_payloads(spark):
    """Of responses of one time the largest id answers, of one id the last headers; payloads of any length stay where they are."""
    long = "word " * 400_000
    tied = [(i, "http://a/", T0, "response", 200, {"ETag": "x", "N": n}, long if i == 3 else "b") for i, n in ((1, "1"), (3, "5"), (3, "7"), (3, "6"), (2, "9"))]
    df = spark.createDataFrame([*tied, (9, "http://a/", T0 + timedelta(seconds=1), "revisit", 304, {"ETag": "x"}, None)], RECORD)
    for order in (df, df.orderBy(F.desc("record_id"), F.desc(F.col("headers")["N"]))):
        got = warc.resolve_revisits(order).where("kind = 'revisit'").collect()
        assert [(r.refers_to, r.headers["n"]) for r in got] == [(3, "7")]
    whole = warc.read_records(warc.write_records(df)).where("record_id = 3").select("payload").collect()
    assert [r.payload for r in whole] == [long] * 3


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = db.execute(warc.SQL).fetchall()
    got = [tuple(r) for r in warc.op7_warc(spark, sf).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("rows", [[], [(1, "http://a/", T0, "revisit", 304, None, None)] * 2])
def test_cases(spark, rows):
    df = spark.createDataFrame([(*r, 5) for r in rows], RECORD + ", slice int")
    got = warc.resolve_revisits(df).collect()
    assert [r.resolution for r in got] == ["no earlier response"] * len(rows)
