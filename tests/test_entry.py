"""Every registered query with SQL agrees with DuckDB on the driver's tables."""

import os

import duckdb
import pytest

import __spark_entry__

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
LIBRARY = __spark_entry__.registry


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: None if v is None else round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(repr([plain(r[i]) for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(LIBRARY.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = LIBRARY.QUERIES[name](spark, DATA)
    found = duck.execute(LIBRARY.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
