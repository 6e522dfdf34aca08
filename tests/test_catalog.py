"""Every library query runs, and those with SQL give what DuckDB gives, on the smallest tables."""

import duckdb
import pytest

from recordloom.catalog import library_queries, library_sql

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def shown(v):
    if v is None or isinstance(v, (bool, int, str)):
        return str(v)
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(library_queries()))
def test_query(spark, duck, name):
    df = library_queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    sql = library_sql().get(name)
    if sql is None:
        assert columns
        return
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in found.fetchall())
