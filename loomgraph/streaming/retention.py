"""Which generations stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retained(generations: DataFrame, keep_last: int, oldest: Column | None = None, most_bytes: int | None = None) -> DataFrame:
    """``generations`` (repo, generation, seq, created, root[, bytes]) with ``kept`` and ``reason``.

    Roots (the current one, bases of running jobs, leased ones) always stay; then the newest ``keep_last`` by seq that are
    not older than ``oldest``; then, newest first, what fits ``most_bytes`` beside the roots.
    """
    w = Window.partitionBy("repo").orderBy(F.desc("seq"), F.desc("generation"))
    d = generations.withColumn("__k", F.row_number().over(w))
    late = F.lit(False) if oldest is None else F.col("created") < oldest
    reason = F.when(F.col("root"), "root").when(F.col("__k") > keep_last, "count").when(late, "age")
    d = d.withColumn("reason", reason)
    if most_bytes is not None:
        live = F.when(F.col("reason").isNull(), F.col("bytes")).otherwise(0)
        rooted = F.sum(F.when(F.col("root"), F.col("bytes")).otherwise(0)).over(Window.partitionBy("repo"))
        d = d.withColumn("__sum", F.sum(live).over(w.rowsBetween(Window.unboundedPreceding, 0)) + rooted)
        d = d.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("__sum") > most_bytes), "bytes").otherwise(F.col("reason"))).drop("__sum")
    return d.withColumn("kept", F.col("reason").isNull() | (F.col("reason") == "root")).drop("__k")
