"""Scores as they are shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.plans import search_queries


def test_three_decimals_are_those_of_the_exact_value(spark):
    scores = [0.1235, 0.4165, 0.3735, -0.4165, 0.0005, 0.0625, 0.9996, 1.0, 0.0, None]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(scores)], "k int, x double").select("k", text.three_decimals(F.col("x")).alias("t")).collect()
    assert [r.t for r in sorted(rows)] == [None if x is None else f"{x:.3f}" for x in scores]
    assert [r.t for r in sorted(rows)][:2] == ["0.123", "0.416"]


def test_shown_hits_need_a_label(spark, tmp_path):
    spark.createDataFrame([(0, 3, [1.0, 0.0]), (1, None, [1.0, 1.0])], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = search_queries.hits_display(spark, str(tmp_path)).orderBy(F.col("rank")).collect()
    assert [r.shown for r in rows] == ["[1] 3 score=1.000", None]
