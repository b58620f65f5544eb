"""Resolution of not-modified revisits in web archive records; DataFrame functions only.

A record is ``record_id, url, date, kind (response or revisit), status, headers
map<string, string>, payload``; :func:`write_records` and :func:`read_records`
turn it into the text of a WARC/1.1 record and back.

A revisit (profile server-not-modified, status 304) is resolved by an as-of
join: the latest full response (kind response, status 200) of the same
canonical URL that is earlier than it; of several at one time, the one with the
largest record id.  Its validators must agree: the entity tags where both have
one (weak comparison), else the last-modified dates where both have one, else
there is nothing to check and the revisit is not resolved.  A resolved revisit
has the payload of that response and its headers, updated by the headers of the
304 but for those that describe the stored body or one connection.

The join runs in two steps, so that no URL's captures must meet in one task:
within slices of time, and from the last response of the slices before, of
which there is one row a slice.

A header that a record has several times is one entry of the map, with a line
for each of its values in their order, and is written as several headers again.

Defined cases: records without a URL or date stay and are not resolved for want
of an earlier response; repeated records all stay, and of responses that share
record id, URL and time the one whose headers come last as JSON answers; header
names are compared in lower case, equal ones add up their values in order of the
names as written, and null headers count as none; equal URLs but for case of scheme
and host, default port, fragment, order of parameters and tracking parameters
are one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Header fields of a 304 that do not update a stored response.
KEPT = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade"]
#: Seconds of a slice of time.
SLICE = 3600
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"


def canonical_url(url: Column) -> Column:
    """The key of a URL: ``host[:port]/path[?sorted parameters]``, without scheme and fragment."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\d*\.", ""), ":(80|443)$", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(F.when(path == "", "/").otherwise(path), "(?<=.)/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|gclid|fbclid|ref|sessionid)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def lower_names(headers: Column) -> Column:
    """Headers with lower-case names; equal names add up their values, in order of the names as written."""
    entries = F.array_sort(F.map_entries(headers))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e.key)))
    values = lambda n: F.array_join(F.transform(F.filter(entries, lambda e: F.lower(e.key) == n), lambda e: e.value), "\n")
    return F.coalesce(F.map_from_arrays(names, F.transform(names, values)), F.create_map().cast("map<string,string>"))


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored headers with the permitted ones of the 304."""
    allowed = F.map_filter(update, lambda k, _: ~k.isin(KEPT))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(allowed, k)), allowed)


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.element_at(headers, F.lit("etag")), "^W/", "")


def validators_agree(stored: Column, revisit: Column) -> Column:
    mine, theirs = _tag(stored), _tag(revisit)
    date = lambda h: F.element_at(h, F.lit("last-modified"))
    return F.coalesce(F.when(mine.isNotNull() & theirs.isNotNull(), mine == theirs).otherwise(date(stored) == date(revisit)), F.lit(False))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``record_id, url_key, kind, resolution, refers_to, headers, payload_from`` for every record.

    ``resolution``: ``response``, ``resolved``, ``validators differ`` or ``no
    earlier response``; ``payload_from`` is the record that holds the payload.
    Payloads stay where they are: no shuffle carries them.
    """
    own = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), F.unix_micros("date").alias("at"), "kind", "status", lower_names(F.col("headers")).alias("headers"))
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("url_key").isNotNull() & F.col("at").isNotNull()
    own = own.withColumn("full", F.coalesce(full, F.lit(False))).withColumn("slice", F.floor(F.col("at") / F.lit(SLICE * 1_000_000)))
    base = written(own, "warc-records")
    answer = F.when(F.col("full"), F.struct("at", "record_id", "headers"))
    # of the same instant only larger kinds come later: revisits see strictly earlier responses
    inside = Window.partitionBy("url_key", "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    near = base.withColumn("near", F.max(F.when(F.col("full"), F.struct("at", "record_id"))).over(inside))
    last = base.where("full").groupBy("url_key", "slice").agg(F.max(F.struct("at", "record_id")).alias("last"))
    before = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = base.where("NOT full AND url_key IS NOT NULL AND slice IS NOT NULL").select("url_key", "slice").distinct().join(last, ["url_key", "slice"], "full")
    far = slices.withColumn("far", F.last("last", ignorenulls=True).over(before)).select("url_key", "slice", "far").where("far IS NOT NULL")
    revisits = near.where("kind = 'revisit'").join(far, ["url_key", "slice"], "left").withColumn("ref", F.coalesce("near", "far"))
    stored = base.where("full").select(F.col("record_id").alias("refers_to"), F.col("url_key").alias("stored_key"), F.col("at").alias("stored_at"), "headers")
    stored = stored.groupBy("refers_to", "stored_key", "stored_at").agg(F.max_by("headers", F.to_json("headers")).alias("stored"))
    found = revisits.join(stored, (F.col("ref.record_id") == F.col("refers_to")) & (F.col("ref.at") == F.col("stored_at")) & (F.col("url_key") == F.col("stored_key")), "left")
    agree = validators_agree(F.col("stored"), F.col("headers"))
    answer = F.when(F.col("refers_to").isNull(), "no earlier response").when(agree, "resolved").otherwise("validators differ")
    done = found.withColumn("resolution", answer).select(
        "record_id",
        "url_key",
        "kind",
        "resolution",
        "refers_to",
        F.when(F.col("resolution") == "resolved", merged_headers(F.col("stored"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(F.col("resolution") == "resolved", F.col("refers_to")).alias("payload_from"),
    )
    others = base.where("kind IS NULL OR kind <> 'revisit'").select("record_id", "url_key", "kind", F.lit("response").alias("resolution"), F.lit(None).cast(base.schema["record_id"].dataType).alias("refers_to"), "headers", F.col("record_id").alias("payload_from"))
    return done.unionByName(others)


def write_records(records: DataFrame) -> DataFrame:
    """``record_id, warc``: the text of each record."""
    each = lambda e: F.transform(F.split(e.value, "\n"), lambda v: F.concat(e.key, F.lit(": "), v, F.lit(CRLF)))
    lines = F.array_join(F.flatten(F.transform(F.array_sort(F.map_entries("headers")), each)), "")
    http = F.concat(F.lit("HTTP/1.1 "), F.col("status").cast("string"), F.lit(CRLF), lines, F.lit(CRLF), F.coalesce("payload", F.lit("")))
    fields = [
        ("WARC-Type", F.col("kind")),
        ("WARC-Record-ID", F.concat(F.lit("<urn:record:"), F.col("record_id").cast("string"), F.lit(">"))),
        ("WARC-Date", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Profile", F.when(F.col("kind") == "revisit", PROFILE)),
        ("Content-Type", F.lit("application/http;msgtype=response")),
        ("Content-Length", F.octet_length(http).cast("string")),
    ]
    head = F.concat(F.lit("WARC/1.1" + CRLF), *(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in fields), F.lit(CRLF))
    return records.select("record_id", F.concat(head, http, F.lit(CRLF * 2)).alias("warc"))


def _headers(block: Column) -> Column:
    lines = F.filter(F.split(block, CRLF), lambda x: F.instr(x, ":") > 1)
    names = F.transform(lines, lambda x: F.substring_index(x, ":", 1))
    first = F.array_distinct(names)
    value = lambda n: lambda x: F.trim(F.substring(x, F.length(n) + 2, F.lit(2**31 - 1)))
    return F.map_from_arrays(first, F.transform(first, lambda n: F.array_join(F.transform(F.filter(lines, lambda x: F.substring_index(x, ":", 1) == n), value(n)), "\n")))


def read_records(records: DataFrame) -> DataFrame:
    """The columns of a record from its text in ``warc``."""
    head = F.substring_index("warc", CRLF * 2, 1)
    named = records.select(_headers(head).alias("w"), F.substring(F.col("warc"), F.length(head) + 5, F.lit(2**31 - 1)).alias("rest"))
    size = F.element_at("w", F.lit("Content-Length")).cast("int")
    http = named.select("w", F.substring(F.col("rest").cast("binary"), F.lit(1), size).cast("string").alias("http"))
    top = F.substring_index("http", CRLF * 2, 1)
    field = lambda n: F.element_at("w", F.lit(n))
    kind = field("WARC-Type")
    return http.select(
        F.regexp_extract(field("WARC-Record-ID"), "<urn:record:(.*)>", 1).cast("long").alias("record_id"),
        field("WARC-Target-URI").alias("url"),
        F.to_timestamp(field("WARC-Date"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("date"),
        kind.alias("kind"),
        F.regexp_extract("http", r"^HTTP/[0-9.]+ ([0-9]+)", 1).cast("int").alias("status"),
        _headers(top).alias("headers"),
        F.when(kind == "response", F.substring("http", F.length(top) + 5, F.lit(2**31 - 1))).alias("payload"),
    )


def crawl_of(pages: DataFrame) -> DataFrame:
    """Two captures of every page: a full response, and a 304 a day later.

    Record ids are twice the page id, and that plus one.  The server's entity
    tag is the digest of the page, its last-modified date the day of the visit;
    every third page has no entity tag.
    """
    when = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id"))
    tag = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit('W/"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"')))
    day = F.date_format(when, "yyyy-MM-dd")
    some = lambda **h: F.map_filter(F.create_map(*(x for k, v in h.items() for x in (F.lit(k.replace("_", "-")), v))), lambda _, v: v.isNotNull())
    first = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", when.alias("date"), F.lit("response").alias("kind"), F.lit(200).alias("status"),
        some(ETag=tag, Last_Modified=day, Content_Type=F.lit("text/html"), Cache_Control=F.lit("max-age=60")).alias("headers"), F.coalesce("html", F.lit("")).alias("payload"),
    )
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", F.timestamp_seconds(F.lit(1_700_086_400) + F.col("page_id")).alias("date"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        some(ETag=tag, Last_Modified=day, Content_Length=F.lit("0"), Cache_Control=F.lit("max-age=600")).alias("headers"), F.lit(None).cast("string").alias("payload"),
    )
    return first.unionByName(again)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All captures of ``pages``, written as WARC records, read back and resolved."""
    records = read_records(write_records(crawl_of(table(spark, sf_dir, "pages").select("page_id", "url", "html"))))
    done = resolve_revisits(records)
    return done.select("record_id", "url_key", "resolution", "refers_to", "payload_from", F.element_at("headers", F.lit("cache-control")).alias("cache_control"), F.element_at("headers", F.lit("content-type")).alias("content_type"), F.element_at("headers", F.lit("content-length")).alias("content_length"))


SQL = r"""
WITH keyed AS (
  SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages
), parts AS (
  SELECT page_id, html,
    regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www[0-9]*\.', ''), ':(80|443)$', '') AS host,
    CASE regexp_extract(rest, '^[^/?]*([^?]*)', 1) WHEN '' THEN '/' ELSE regexp_extract(rest, '^[^/?]*([^?]*)', 1) END AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid|ref|sessionid)(=|$)'))) AS q
  FROM keyed
), pages2 AS (
  SELECT page_id, host || CASE WHEN length(path) > 1 THEN regexp_replace(path, '/+$', '') ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key,
    CASE WHEN page_id % 3 <> 0 THEN md5(coalesce(html, '')) END AS tag,
    CAST((1700000000 + page_id) // 86400 AS BIGINT) AS day
  FROM parts
), revisits AS (
  SELECT r.page_id, r.url_key, r.tag, r.day, s.page_id AS s_id, s.tag AS s_tag, s.day AS s_day,
    row_number() OVER (PARTITION BY r.page_id ORDER BY s.page_id DESC) AS k
  FROM pages2 r LEFT JOIN pages2 s ON s.url_key = r.url_key AND s.page_id < r.page_id + 86400
), judged AS (
  SELECT *, s_id IS NOT NULL AS found,
    coalesce(CASE WHEN tag IS NOT NULL AND s_tag IS NOT NULL THEN tag = s_tag ELSE day = s_day END, false) AS agree
  FROM revisits WHERE k = 1
)
SELECT page_id * 2 AS record_id, url_key, 'response' AS resolution, CAST(NULL AS BIGINT) AS refers_to, page_id * 2 AS payload_from,
  'max-age=60' AS cache_control, 'text/html' AS content_type, CAST(NULL AS VARCHAR) AS content_length
FROM pages2
UNION ALL
SELECT page_id * 2 + 1, url_key, CASE WHEN NOT found THEN 'no earlier response' WHEN agree THEN 'resolved' ELSE 'validators differ' END,
  s_id * 2, CASE WHEN agree THEN s_id * 2 END, 'max-age=600', CASE WHEN agree THEN 'text/html' END, CASE WHEN NOT agree THEN '0' END
FROM judged
"""
