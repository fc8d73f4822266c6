"""Filters and shapes over the fact and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.resolve import STRUCTURAL
from loomgraph.operators.tables import running

EDGE_ORDER = ["source_path", "source_line", "source_col", "callee_name"]
HERITAGE = ("superclass", "include", "extend", "prepend")


def search_symbol(symbols: DataFrame, name: str, kind: str = "any") -> DataFrame:
    out = symbols.filter(F.col("name") == name)
    out = out if kind == "any" else out.filter(F.col("kind") == kind)
    return out.drop("binding").orderBy("path", "line_start", "name", "id")


def references_to(refs: DataFrame, name: str) -> DataFrame:
    return refs.filter(F.col("callee_name") == name).orderBy("path", "line", "col", "relation")


def callers_of(edges: DataFrame, name: str) -> DataFrame:
    """Call and construct edges to a name; ``Class#method`` means ``method``. Ambiguous ones are included."""
    return edges.filter((F.col("callee_name") == name.rpartition("#")[2]) & F.col("relation").isin("call", "construct")).orderBy(*EDGE_ORDER)


def subclasses_of(edges: DataFrame, name: str) -> DataFrame:
    return edges.filter((F.col("callee_name") == name) & F.col("relation").isin(*HERITAGE)).orderBy(*EDGE_ORDER)


def confident(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("confidence").isin("EXTRACTED", "INFERRED") & F.col("relation").isin(*STRUCTURAL))


def shaped(edges: DataFrame) -> DataFrame:
    """Target or candidates, never both."""
    one = F.struct(F.col("target_path").alias("path"), F.col("target_line").alias("line"), F.col("target_name").alias("name"))
    many = F.col("confidence") == "AMBIGUOUS"
    return edges.withColumn("target", F.when(~many, one)).withColumn("candidates", F.when(many, F.col("candidates"))).drop("target_path", "target_line", "target_name")


def capped(df: DataFrame, cap: int, order: list, nested: str | None = None) -> DataFrame:
    """At most ``cap`` rows of a total order, each with ``truncated`` and ``returned_count``; ``nested`` arrays are cut alike."""
    from pyspark.sql import Window

    top = df.orderBy(*order).limit(cap + 1)
    # cap + 1 rows at most: one small partition
    w = Window.partitionBy(F.lit(1)).orderBy(*order)
    out = top.withColumn("__n", F.row_number().over(w)).withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    out = out.filter(F.col("__n") <= cap).withColumn("truncated", F.col("__all") > cap).withColumn("returned_count", F.least(F.col("__all"), F.lit(cap)))
    if nested:
        out = out.withColumn(f"{nested}_truncated", F.coalesce(F.size(nested), F.lit(0)) > cap).withColumn(nested, F.slice(nested, 1, cap))
    return out.drop("__n", "__all")


def within_budget(df: DataFrame, order: list, cost: Column, budget: int, by: list[str] | None = None) -> DataFrame:
    """The prefix of the order (inside ``by``) whose summed cost stays within the budget; nothing after the first row that does not fit."""
    from pyspark.sql import Window

    if not by:
        return running(df, order, cost, "spent").filter(F.col("spent") <= budget)
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(w)).filter(F.col("spent") <= budget)
