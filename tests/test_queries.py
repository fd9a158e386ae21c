"""Every registered query of the variant engine against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from variantsets import queries

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(map(tuple, df[columns].astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.Q))
def test_query(spark, tables, name):
    assert rows(queries.Q[name](spark, SF).toPandas()) == rows(tables.sql(queries.SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
