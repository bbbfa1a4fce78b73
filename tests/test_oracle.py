"""Every registered query with SQL must equal DuckDB on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import canonical
from gatewise.sources.standins import BASE_TABLES

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, duck, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0
    spark.catalog.clearCache()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
