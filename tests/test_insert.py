from __future__ import annotations

import glob
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators.insert import batches_of, manifests
from lodestone.operators.store import Collection

KIND = "id string, location string, embedding array<float>"


def points(spark, ids, dim=3):
    return spark.createDataFrame([(f"p{i}", f"l{i % 4}", [float(i)] * dim) for i in ids], KIND)


def ids(kept):
    return sorted(int(r.id[1:]) for r in kept.points().collect())


def test_inserts_add_batches_and_follow_a_rebuild(spark, tmp_path):
    kept = Collection(spark, f"file://{tmp_path}", "c", 3)
    with pytest.raises(ValueError, match="never built"):
        kept.points()
    kept.insert(points(spark, range(300)).repartition(1))
    kept.insert(points(spark, range(300, 310)).repartition(2))
    assert ids(kept) == list(range(310))
    found = {(m["rows"], m["batches"]) for m in manifests(f"file://{tmp_path}/c/inserts-v1")}
    assert found == {(300, 3), (10, 2)}  # 128 + 128 + 44, and one small batch a task
    kept.rebuild(points(spark, range(5)))
    kept.rebuild(points(spark, range(5)))
    kept.insert(points(spark, [7]))
    assert ids(kept) == [0, 1, 2, 3, 4, 7]
    kept.insert(points(spark, []))
    assert ids(kept) == [0, 1, 2, 3, 4, 7]


@pytest.mark.parametrize("bad", [("bad", "l0", [1.0]), ("bad", None, [1.0] * 3), ("bad", "l0", None), ("bad", "l0", [1.0, None, 2.0])])
def test_a_bad_point_leaves_nothing(spark, tmp_path, bad):
    kept = Collection(spark, f"file://{tmp_path}", "c", 3)
    kept.insert(points(spark, range(4)))
    mixed = points(spark, range(10, 400)).unionByName(spark.createDataFrame([bad], KIND)).repartition(3)
    with pytest.raises(Exception, match="not 3 components|no location"):
        kept.insert(mixed)
    assert ids(kept) == [0, 1, 2, 3]
    assert len(glob.glob(f"{tmp_path}/c/inserts-v1/*/*.parquet")) <= 4  # the files of the failed insert are gone


def test_a_task_that_dies_midway_leaves_nothing(spark, tmp_path):
    """Its rows end in an error after batches of other tasks, and of its own, are on disk."""
    kept = Collection(spark, f"file://{tmp_path}", "c", 3)
    kept.insert(points(spark, range(4)))

    @F.udf("array<float>")
    def dies(x):
        if x[0] == 2999.0:
            os._exit(1)
        return x

    with pytest.raises(Exception):  # noqa: B017, PT011
        kept.insert(points(spark, range(10, 3000)).repartition(2, "location").withColumn("embedding", dies("embedding")))
    assert ids(kept) == [0, 1, 2, 3] and len(manifests(f"file://{tmp_path}/c/inserts-v1")) == 1


def test_batches_are_cut_across_what_comes_in():
    rows = [pa.record_batch({"x": list(range(a, b))}) for a, b in ((0, 3), (3, 3), (3, 10), (10, 11))]
    assert [t["x"].to_pylist() for t in batches_of(iter(rows), 4)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10]]
