"""Every query of the catalog against its DuckDB SQL, as the driver compares them."""

from __future__ import annotations

import duckdb
import pytest

from lodestone.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda x: f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = db.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = plain(cur.fetchall(), names)
    assert len(got) == len(want)
    assert got == want


def test_flagship(spark):
    assert catalog.flagship(spark, "/root/testdata/sf0.001").count() == 10
