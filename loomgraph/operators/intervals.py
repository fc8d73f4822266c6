"""Range joins by binning: a point or interval meets only what shares a bin of its level.

Neither side is broadcast, as a table that is small as a file may have very many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: log2 of the bin widths; an interval uses the narrowest level in which it touches two bins at most.
LEVELS = (6, 10, 14, 18, 22, 31)


def _level(lo: Column, hi: Column) -> Column:
    span = hi - lo
    out = F.lit(LEVELS[-1])
    for k in reversed(LEVELS[:-1]):
        out = F.when(span < (1 << k), F.lit(k)).otherwise(out)
    return out


def _binned(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """Each interval once per bin of its own level (two at most for all but the widest)."""
    d = df.withColumn("__level", _level(F.col(lo), F.col(hi)))
    width = F.pow(F.lit(2.0), "__level").cast("long")
    return d.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))


def _used(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """One row: the levels (``__used``) that these intervals use."""
    return df.select(_level(F.col(lo), F.col(hi)).alias("__level")).agg(F.collect_set("__level").alias("__used"))


def _probing(df: DataFrame, lo: str, hi: str, used: DataFrame, above: int = 0) -> DataFrame:
    """Each interval once per bin it touches, on every ``used`` level from its own (plus ``above``) up: two bins a level at most."""
    d = df.crossJoin(F.broadcast(used)).withColumn("__own", _level(F.col(lo), F.col(hi)))
    d = d.withColumn("__level", F.explode(F.filter("__used", lambda k: (k > F.col("__own")) if above else (k >= F.col("__own"))))).drop("__own", "__used")
    width = F.pow(F.lit(2.0), "__level").cast("long")
    return d.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))


def containing(points: DataFrame, intervals: DataFrame, key: str, point: str, lo: str, hi: str) -> DataFrame:
    """Inner join: intervals with the same key and lo <= point <= hi. A point is in one bin per level, so no pair comes twice."""
    p = _probing(points, point, point, _used(intervals, lo, hi))
    i = _binned(intervals, lo, hi)
    return p.join(i.hint("merge"), [key, "__level", "__bin"]).filter((F.col(lo) <= F.col(point)) & (F.col(point) <= F.col(hi))).drop("__level", "__bin")


def overlapping(left: DataFrame, right: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Inner join: half-open overlap a.start < b.end and max(a.end, a.start + 1) > b.start, with the same key.

    A pair meets on the level of its wider interval, in the first bin that both touch.
    """
    left = left.withColumn("__hi", F.greatest(F.col(a[1]), F.col(a[0]) + 1))
    width = F.pow(F.lit(2.0), F.col("__level")).cast("long")
    first = F.greatest(F.floor(F.col(a[0]) / width), F.floor(F.col(b[0]) / width))
    sides = ((_probing(left, a[0], "__hi", _used(right, b[0], b[1])), _binned(right, b[0], b[1])), (_binned(left, a[0], "__hi"), _probing(right, b[0], b[1], _used(left, a[0], "__hi"), above=1)))
    met = [x.join(y.hint("merge"), [key, "__level", "__bin"]).filter((F.col(a[0]) < F.col(b[1])) & (F.col("__hi") > F.col(b[0])) & (F.col("__bin") == first)).drop("__level", "__bin", "__hi") for x, y in sides]
    return met[0].unionByName(met[1])


def innermost(points: DataFrame, symbols: DataFrame, ids: list[str], line: str = "line", distinct: bool = False) -> DataFrame:
    """``points`` with the innermost symbol around them: the smallest span, then the latest start, then the name; null if none.

    ``symbols`` has path, line_start, line_end, name, kind. ``ids`` identify a point;
    ``distinct`` tells that no point is there twice.
    """
    s = symbols.select("path", F.col("line_start").alias("__lo"), F.col("line_end").alias("__hi"), F.col("name").alias("__name"), F.col("kind").alias("__kind"))
    best = (
        containing(points.select(*ids) if distinct else points.select(*ids).distinct(), s, "path", line, "__lo", "__hi")
        .groupBy(*ids)
        .agg(F.min(F.struct((F.col("__hi") - F.col("__lo")).alias("span"), (-F.col("__lo")).alias("late"), F.col("__name").alias("name"), F.col("__kind").alias("kind"))).alias("__s"))
        .select(*ids, F.col("__s.name").alias("source_name"), F.col("__s.kind").alias("source_kind"))
    )
    return points.join(best, ids, "left")


def declared_first(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """The degree rule: of symbols with the source's path, name and kind around the line, the one with the lowest line_start, then id.

    ``points`` has path, line, source_name, source_kind; adds source_line_start (null if none).
    """
    s = symbols.select("path", F.col("line_start").alias("__lo"), F.col("line_end").alias("__hi"), F.col("name").alias("source_name"), F.col("kind").alias("source_kind"), F.col("id").alias("__id"))
    keys = ["path", "line", "source_name", "source_kind"]
    p = points.select(*keys).distinct()
    # name and kind are part of the join key, so the range condition meets few rows
    best = p.join(s.hint("merge"), ["path", "source_name", "source_kind"]).filter((F.col("__lo") <= F.col("line")) & (F.col("line") <= F.col("__hi"))).groupBy(*keys).agg(F.min(F.struct("__lo", "__id")).alias("__b"))
    return points.join(best.select(*keys, F.col("__b.__lo").alias("source_line_start")), keys, "left")


def ordinal(df: DataFrame, by: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """Index among siblings, from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
