"""Every query with SQL, against DuckDB on the smallest test data."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from lodegraph.plans import driver_queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and x != x):
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or hasattr(x, "as_integer_ratio"):
        return str(round(float(x), 6))
    return str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(driver_queries.SQL))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    got = table(df.columns, [tuple(r) for r in df.collect()])
    c = duck.execute(driver_queries.SQL[name])
    assert got == table([d[0] for d in c.description], c.fetchall())


def test_cascade_delete_over_more_than_1500_parts(spark):
    import duckdb

    data = DATA.parent / "sf0.01"
    c = duckdb.connect()
    for name in ("customer", "orders", "lineitem", "part", "supplier"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    df = entry.queries()["cascade_delete"](spark, str(data))
    c = c.execute(driver_queries.SQL["cascade_delete"])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in c.description], c.fetchall())


def test_every_query_has_sql():
    assert set(driver_queries.QUERIES) == set(driver_queries.SQL)
    assert len(driver_queries.QUERIES) > 50


def test_entry(spark):
    assert entry.entry(spark).count() > 0
