"""Every registered query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as se

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
SQLS = se.oracle_sql()


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (1, repr(round(v, 9)))
    if isinstance(v, bool):
        return (2, str(v))
    if isinstance(v, int):
        return (1, repr(round(float(v), 9)))
    if hasattr(v, "isoformat"):
        return (3, v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat())
    return (5, str(v))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.count() > 0 and "loss_metric" in df.columns


def test_every_query_of_the_library_has_an_oracle():
    from quire.plans.catalog import REGISTRY
    assert all(e.sql for e in REGISTRY.values()) and set(REGISTRY) <= set(se.queries())


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_matches_oracle(spark, con, name):
    df = se.queries()[name](spark, SF)
    rows = df.collect()
    cur = con.execute(SQLS[name])
    ocols = [c[0] for c in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    order = sorted(df.columns)
    a = sorted(tuple(_norm(r[df.columns.index(c)]) for c in order) for r in rows)
    b = sorted(tuple(_norm(r[ocols.index(c)]) for c in order) for r in orows)
    assert a == b
