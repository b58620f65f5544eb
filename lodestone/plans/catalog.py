"""Registry of the engine's queries and of their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import ingest_queries, review_queries, search_queries, stream_queries, thread_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [ingest_queries, search_queries, thread_queries, review_queries, stream_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best points by cosine for the vector with id 0."""
    return search_queries.topk_cosine(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
