"""Registered queries against their SQL on the smallest tables, and what the plans look like."""

import os

import pytest

import __spark_entry__
from terrane.plans.state_queries import ORACLE_SQL, QUERIES
from terrane.sources.storage import TABLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def shown(v):
    return "%.9g" % v if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = sorted(tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect())
    out = duck.sql(ORACLE_SQL[name])
    place = {c: i for i, c in enumerate(out.columns)}
    assert sorted(place) == sorted(df.columns)
    want = sorted(tuple(shown(r[place[c]]) for c in sorted(place)) for r in out.fetchall())
    assert got == want


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_filters_reach_the_scan(spark):
    plan = QUERIES["f2_compare"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity" in plan and "l_extendedprice" not in plan


def test_descriptions_are_read_by_all_cores(spark):
    """One small file of parts was one task before."""
    out = QUERIES["t8_described"](spark, "/root/testdata/sf0.001")
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
