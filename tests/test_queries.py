"""Every query against its SQL, on the smallest tables."""

import os

import pytest

from loomgraph import registry
from loomgraph.plans.projection import TABLES

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows(table, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in table.to_pylist()), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    want = duck.sql(sql).to_arrow_table()
    assert sorted(df.columns) == sorted(want.column_names)
    columns = sorted(df.columns)
    assert rows(df.toArrow(), columns) == rows(want, columns)


def test_entry(spark):
    assert registry.flagship(spark, SF).count() > 0
