"""Registered queries of the training-data operators against their SQL."""

import os

import pytest

import __spark_entry__ as entry
from loomgraph.llm.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_registered():
    assert {n for n in entry.queries() if n.startswith("op")} == set(queries()) and "pipeline" in entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    df = queries()[name](spark, SF)
    want = con.sql(oracle_sql()[name]).to_arrow_table()
    columns = sorted(df.columns)
    assert columns == sorted(want.column_names)
    rows = lambda t: sorted(tuple(str(r[c]) for c in columns) for r in t.to_pylist())
    assert rows(df.toArrow()) == rows(want)
