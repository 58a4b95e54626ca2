"""Every registered query with SQL gives the SQL's rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lakesift.plans import registry

SF = "/root/testdata/sf0.001"


def normal(value):
    if value is None or type(value).__name__ in ("NaTType", "NAType") or value != value:
        return "null"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    value = value.item() if hasattr(value, "item") else value
    return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else repr(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(normal, r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql:
        assert rows(found) == rows(duck.execute(sql).df())
    else:
        assert len(found)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
