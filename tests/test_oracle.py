"""Every query against its DuckDB answer on the smallest data."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver
from tests.conftest import SF_DIR

DUCK_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF_DIR}/events.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(driver.QUERIES))
def test_query(spark, duck, name):
    df = driver.queries()[name](spark, SF_DIR)
    rows = df.collect()
    assert rows
    sql = driver.oracle_sql().get(name)
    if sql is None:
        return
    answer = duck.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(answer.columns)
    types = dict(zip(answer.columns, map(str, answer.types)))
    assert {c: DUCK_TYPES[t] for c, t in df.dtypes} == types
    order = [answer.columns.index(c) for c in columns]
    expected = Counter(tuple(row[i] for i in order) for row in answer.fetchall())
    assert Counter(tuple(row[c] for c in columns) for row in rows) == expected


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
