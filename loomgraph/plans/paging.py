"""Stable pages: a result is written once in its order, and every page reads the range of it that holds the page."""

from __future__ import annotations

import bisect
import json
from base64 import urlsafe_b64decode, urlsafe_b64encode
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.tables import kept, released


@dataclass(frozen=True)
class Pages:
    """A written result: ``table`` has a folder for each range; ``first`` and ``part`` give each range's first rank and folder."""

    table: DataFrame
    columns: list[str]
    first: list[int]
    part: list[int]
    total: int
    size: int

    @property
    def count(self) -> int:
        return -(-self.total // self.size)

    def page(self, number: int) -> DataFrame:
        """Page ``number`` from 0, in order; past the end it is empty."""
        if number < 0:
            raise ValueError("pages are numbered from 0")
        return self._rows(number * self.size, (number + 1) * self.size)

    def _rows(self, lo: int, hi: int) -> DataFrame:
        lo, hi = min(lo, self.total), min(hi, self.total)
        near = range(max(0, bisect.bisect_right(self.first, lo) - 1), bisect.bisect_left(self.first, hi)) if lo < hi else range(0)
        ids: Column = F.lit(False)
        for i in near:
            a = (self.part[i] << 33) + max(0, lo - self.first[i])
            ids = ids | (F.col("__part") == self.part[i]) & (F.col("__id") >= a) & (F.col("__id") < (self.part[i] << 33) + hi - self.first[i])
        # the folder alone prunes the listing, the ids the row groups
        d = self.table.filter(F.col("__part").isin([self.part[i] for i in near])).filter(ids)
        return d.orderBy("__id").select(*self.columns)

    def cursor(self, rank: int) -> str:
        """What goes on from ``rank``; it is good for this result only."""
        return urlsafe_b64encode(json.dumps({"result": self.table._kept_path.rpartition("-")[2], "rank": rank}).encode()).decode()

    def after(self, cursor: str | None = None) -> tuple[DataFrame, str | None]:
        """The rows behind a cursor, or the first ones, and the cursor that follows; null at the end. Another result's cursor is refused."""
        rank = 0
        if cursor is not None:
            try:
                given = json.loads(urlsafe_b64decode(cursor.encode()))
                rank = int(given["rank"])
            except (ValueError, KeyError, TypeError) as e:
                raise ValueError("invalid_cursor") from e
            if given["result"] != self.table._kept_path.rpartition("-")[2] or not 0 <= rank <= self.total:
                raise ValueError("stale_cursor")
        then = rank + self.size
        return self._rows(rank, then), self.cursor(then) if then < self.total else None

    def drop(self) -> None:
        released(self.table)


def paged(df: DataFrame, order: list, size: int) -> Pages:
    """Write ``df`` in a total order, by ranges, so that no task sorts all; ranks follow from the ranges' sizes."""
    if size < 1:
        raise ValueError("a page has one row at least")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33).cast("int"))
    table = kept(d, by=["__part"])
    # one row for each range
    sizes = sorted((r["__part"], r["n"]) for r in table.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    first, total = [], 0
    for _, k in sizes:
        first.append(total)
        total += k
    return Pages(table, df.columns, first, [p for p, _ in sizes], total, size)
