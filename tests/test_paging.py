"""Pages of a written result."""

import re

import pytest
from pyspark.sql import functions as F

from loomgraph.plans.dsl import Engine


def test_all_pages_of_a_million_rows(spark):
    d = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).alias("k"), (F.col("id") % 10).alias("v"))
    pages = Engine.pages(d, ["k"], 99_999)
    assert pages.total == 1_000_000 and pages.count == 11
    want = sorted(i * 7919 % 1_000_003 for i in range(1_000_000))
    got = []
    for i in range(pages.count):
        p = pages.page(i)
        # a page lies in one range, or in two where it crosses a border: the others' folders are not listed
        folders = re.search(r"PartitionFilters: \[([^\]]*)\]", p._jdf.queryExecution().executedPlan().toString())[1]
        assert "__part" in folders and len(set(re.findall(r"(?:= |[(,])(\d+)(?=[),])", folders.replace("__part#", "")))) <= 2
        got += [r.k for r in p.collect()]
    assert got == want and pages.page(11).count() == 0 and pages.page(0).columns == ["k", "v"]
    pages.drop()


def test_cursors(spark):
    d = spark.createDataFrame([(i % 4, i) for i in range(25)], "a int, b int").repartition(3)
    pages = Engine.pages(d, [F.desc("a"), "b"], 10)
    rows, cursor = [], None
    for k in range(3):
        part, cursor = pages.after(cursor)
        rows += [tuple(r) for r in part.collect()]
        assert (cursor is None) == (k == 2)
    assert rows == sorted(((i % 4, i) for i in range(25)), key=lambda r: (-r[0], r[1]))
    other = Engine.pages(d, ["b"], 10)
    with pytest.raises(ValueError, match="stale_cursor"):
        other.after(pages.cursor(10))
    for bad in ("x", pages.cursor(-1), pages.cursor(26)):
        with pytest.raises(ValueError, match="cursor"):
            pages.after(bad)
    none = Engine.pages(d.limit(0), ["b"], 10)
    assert none.count == 0 and none.page(0).count() == 0 and none.after()[1] is None
    with pytest.raises(ValueError):
        pages.page(-1)
