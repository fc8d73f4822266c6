"""Written intermediate tables for iterative operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def kept(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` below spark.checkpoint.dir and read it back: lineage is cut, a lost executor loses nothing, and the write's shuffle files go. With ``by``, a folder for each of its values."""
    path = f"{shared(df.sparkSession)}/loomgraph-step-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = df.sparkSession.conf.get(cleanup, None)
    df.sparkSession.conf.set(cleanup, "true")
    try:
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    finally:
        df.sparkSession.conf.unset(cleanup) if before is None else df.sparkSession.conf.set(cleanup, before)
    _made.append((df.sparkSession, path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def counted(df: DataFrame, *more: Column) -> tuple:
    """The written table, its number of rows and further aggregates, taken while it is written."""
    seen = Observation()
    names = [f"__{i}" for i in range(len(more))]
    out = kept(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(n) for c, n in zip(more, names, strict=True)]))
    return out, seen.get["n"], *[seen.get[n] for n in names]


#: Rows of a side that is copied to every task.
SIDE_ROWS = 100_000


def bounded(df: DataFrame, most: int = SIDE_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has no more than ``most`` rows, else as it is; it is counted up to the bound."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


@contextmanager
def together(spark: SparkSession):
    """While the block runs, tables that are dealt by some of a join's keys meet where they are."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def released(*tables: DataFrame) -> None:
    """Delete kept tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_kept_path", None):
            _remove(df.sparkSession, path)
            _made[:] = [x for x in _made if x[1] != path]


def placed(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` written with ``name``: a number that grows with the order (not gapless), dealt by ranges, so no task sorts all."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))


def running(df: DataFrame, order: list, cost: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``cost`` up to the row, in a total order; ranges are summed, then shifted."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = kept(df.withColumn("__cost", cost).repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    # one row a range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy("__part").agg(F.sum("__cost").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("__sum", F.sum("__cost").over(w)).join(F.broadcast(sizes), "__part").withColumn(name, F.col("__sum") + F.col("__shift")).drop("__part", "__sum", "__shift", "__cost")


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            _remove(spark, path)
        except Exception:  # the session is gone
            return
