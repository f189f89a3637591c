"""Every registered query with a SQL twin gives the same rows as DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = con.execute(ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["u", "v", "length_m", "highway", "rfs"] and df.count() == 20
