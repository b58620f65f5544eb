"""Article, thread and file sources.

An article row is ``location, article_no, text, source``.  The Parquet tables
stand in for a live service; :class:`ArticleSource` reads a service through a
caller's fetch function, one partition a location, with retries and a row for
every location that failed.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from lodestone.functions.text import base64_text

ATTEMPTS, BACKOFF_S, POLITE_S = 4, 3.0, 1.5
MAX_CHARS = 1_000_000
IMAGE_TYPES = ("image/jpeg", "image/png", "image/gif", "image/webp")
PDF_TYPE = "application/pdf"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """``location, article_no, text, source`` from ``documents``; the filter reaches the scan."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.where(F.col("lang") == lang) if lang else docs
    return docs.select(F.col("source").alias("location"), F.col("doc_id").alias("article_no"), "text", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source"))


def capped(rows: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` articles of a location, the first by number."""
    rank = F.row_number().over(Window.partitionBy("location").orderBy("article_no"))
    return rows.withColumn("rn", rank).where(F.col("rn") <= limit).drop("rn")


def truncated(rows: DataFrame, size: int = MAX_CHARS) -> DataFrame:
    return rows.withColumn("text", F.substring("text", 1, size))


def retry_waits(attempts: int = ATTEMPTS, backoff: float = BACKOFF_S) -> list[float]:
    """Seconds waited after each failed attempt but the last."""
    return [backoff * k for k in range(1, attempts)]


Note = Callable[[int, float | None, Exception], None]


def with_retries(call: Callable[[], list[dict]], attempts: int = ATTEMPTS, backoff: float = BACKOFF_S, sleep: Callable[[float], None] = time.sleep, note: Note = lambda k, wait, error: None) -> list[dict]:
    """What ``call`` gives, tried again after growing waits; ``note`` hears of every failed attempt (from 1) and the wait behind it."""
    waits = [*retry_waits(attempts, backoff), None]
    for k, wait in enumerate(waits, 1):
        try:
            return call()
        except Exception as e:
            note(k, wait, e)
            if wait is None:
                raise
            sleep(wait)
    return []


class _Location(InputPartition):
    def __init__(self, location: str) -> None:
        super().__init__(location)


def no_wait(seconds: float) -> None:
    """For services that need no politeness."""


FETCHED = "location string, lang string, article_no bigint, text string, source string, attempt int, wait_s double, error string"


def article_source(fetch: Callable[[str, str, int], list[dict]], locations: list[str], lang: str = "en", max_docs: int = 1, backoff: float = BACKOFF_S, polite: float = POLITE_S, sleep: Callable[[float], None] = time.sleep) -> type[DataSource]:
    """A data source class over ``fetch(location, lang, max_docs) -> [{text, source}]``.

    A location is one partition.  Filters on ``location`` leave the others
    unasked, one on ``lang`` asks for that edition; :func:`read_articles` turns
    them on.  Rows with an ``error`` are failed attempts with the wait behind
    them (null after the last); the others are articles with the number of the
    attempt that gave them.
    """

    class Reader(DataSourceReader):
        def __init__(self) -> None:
            self.wanted, self.lang = list(dict.fromkeys(locations)), lang

        def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
            for f in filters:
                if isinstance(f, EqualTo) and f.attribute == ("location",):
                    self.wanted = [x for x in self.wanted if x == f.value]
                elif isinstance(f, In) and f.attribute == ("location",):
                    self.wanted = [x for x in self.wanted if x in f.value]
                elif isinstance(f, EqualTo) and f.attribute == ("lang",):
                    self.lang = f.value
                elif not isinstance(f, IsNotNull) or f.attribute not in (("location",), ("lang",)):
                    yield f

        def partitions(self) -> list[InputPartition]:
            return [_Location(x) for x in self.wanted]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            place = getattr(partition, "value", None)
            if place is None:  # no location is wanted
                return
            failed: list[tuple] = []
            try:
                found = with_retries(lambda: fetch(place, self.lang, max_docs), backoff=backoff, sleep=sleep, note=lambda k, wait, e: failed.append((place, self.lang, None, None, None, k, wait, str(e))))
            except Exception:
                yield from failed
                return
            sleep(polite)
            yield from failed
            for k, article in enumerate(found[:max_docs]):
                yield place, self.lang, k, (article.get("text") or "")[:MAX_CHARS], article.get("source") or place, len(failed) + 1, None, None

    class ArticleSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "lodestone_articles"

        def schema(self) -> str:
            return FETCHED

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return ArticleSource


def read_articles(spark: SparkSession, source: type[DataSource]) -> DataFrame:
    """The rows of an :func:`article_source`, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load()


#: Articles that the stand-in service gives for a location and language at most, as search services do.
SERVED = 50


def serve(rows: DataFrame, root: str) -> None:
    """Writes ``location, lang, article_no, text, source`` as the folders of a stand-in service, one a location."""
    rank = F.row_number().over(Window.partitionBy("location", "lang").orderBy("article_no"))
    kept = rows.withColumn("rn", rank).where(F.col("rn") <= SERVED)
    kept.select(F.md5("location").alias("folder"), "lang", "article_no", "text", "source").write.partitionBy("folder").parquet(root)


class ServedArticles:
    """The ``fetch`` of a stand-in service below ``root``; it fails ``fails(location)`` times before it answers."""

    def __init__(self, root: str, fails: Callable[[str], int] = lambda place: 0) -> None:
        self.root, self.fails, self.tries = root, fails, Counter()

    def __call__(self, place: str, lang: str, max_docs: int) -> list[dict]:
        from pyarrow import dataset, fs

        self.tries[place] += 1
        if self.tries[place] <= self.fails(place):
            raise ConnectionError(f"no answer for {place}")
        system, path = fs.FileSystem.from_uri(self.root)
        found = dataset.dataset(f"{path}/folder={md5(place.encode()).hexdigest()}", filesystem=system, format="parquet")
        rows = found.to_table(filter=dataset.field("lang") == lang).sort_by("article_no").slice(0, max_docs)
        return rows.select(["text", "source"]).to_pylist()


def skipped(locations: DataFrame, fetched: DataFrame) -> DataFrame:
    """The locations without an article."""
    return locations.join(fetched.where("text IS NOT NULL").select("location").distinct(), "location", "left_anti")


def ensure_rows(df: DataFrame) -> DataFrame:
    """``df``, or an error if it is empty."""
    if df.isEmpty():
        raise RuntimeError("no passages were produced")
    return df


def search_threads(threads: DataFrame, assistant: str | None, limit: int = 100) -> DataFrame:
    """Threads of an assistant (a UUID) or else of a graph; nothing without a name."""
    if not assistant:
        return threads.limit(0)
    uuid = F.lit(assistant).rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    same = F.when(uuid, F.col("assistant_id") == assistant).otherwise(F.col("graph_id") == assistant)
    return threads.where(same).orderBy("thread_id").limit(limit)


def content_blocks(files: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``name, type, mime_type, data, name_key`` of the allowed files ``(name, mime_type, content binary)``, with their columns ``keys``."""
    kind = F.when(F.col("mime_type").isin(*IMAGE_TYPES), "image").when(F.col("mime_type") == PDF_TYPE, "file")
    key = F.when(kind == "image", "name").otherwise("filename")
    return files.where(kind.isNotNull()).select(*keys, "name", kind.alias("type"), "mime_type", base64_text(F.col("content")).alias("data"), key.alias("name_key"))


def mime_of(name: Column) -> Column:
    """A file's type by its suffix."""
    types = F.create_map(*(F.lit(x) for x in ("jpg", "image/jpeg", "jpeg", "image/jpeg", "png", "image/png", "gif", "image/gif", "webp", "image/webp", "pdf", PDF_TYPE)))
    return F.coalesce(types[F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))], F.lit("application/octet-stream"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``name, mime_type, content`` of the files below ``path``, types by suffix."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(name.alias("name"), mime_of(name).alias("mime_type"), "content")
