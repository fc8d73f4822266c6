"""Incremental ingestion of fact files with Structured Streaming: newer versions replace, tombstones remove."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from loomgraph.operators.tables import kept, released

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Newest(StatefulProcessor):
    """Lets the rows of a path's newest version through, once; the state is one version number for each path, removed ones too."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.version = handle.getValueState("version", "version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.version.get()[0] if self.version.exists() else None
        newest, held = known, []
        for part in rows:
            top = part["version"].max()
            if newest is None or top > newest:
                newest, held = int(top), []
            held.append(part[part["version"] == newest])
        if newest != known:
            self.version.update((newest,))
            yield pd.concat(held)

    def close(self) -> None:
        pass


@contextmanager
def _stateful(spark: SparkSession):
    """State of this kind needs the RocksDB store; a started query keeps the setting."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _batches(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the batches whose pointers are whole."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/pointer")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    there = [x.getPath() for x in fs.listStatus(root)]
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName().partition("=")[2]) for p in there if fs.exists(done(p, "_SUCCESS")))


def _pointer(spark: SparkSession, table: str, number: int | None) -> dict[int, int]:
    """The batch that wrote each bucket last; as many entries as there are buckets, at most."""
    return {} if number is None else {r.bucket: r.batch for r in spark.read.parquet(f"{table}/pointer/batch={number}").collect()}


def _read(spark: SparkSession, table: str, schema: str, where: dict[int, int]) -> DataFrame:
    """The rows of these buckets, each as its batch wrote it."""
    by_batch: dict[int, list[int]] = {}
    for bucket, batch in where.items():
        by_batch.setdefault(batch, []).append(bucket)
    parts = [spark.read.schema(f"{schema}, bucket int").parquet(f"{table}/data/batch={n}").filter(F.col("bucket").isin(b)) for n, b in sorted(by_batch.items())]
    empty = spark.createDataFrame([], f"{schema}, bucket int")
    return reduce(DataFrame.unionByName, parts, empty).drop("bucket")


def ingest(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, after: Callable[[DataFrame], None] | None = None, buckets: int = 32) -> StreamingQuery:
    """Keep ``table`` equal to the newest version of every path in the Parquet files that arrive in ``source``.

    ``schema`` has path, version and deleted, and the facts' own columns. A version of a path arrives whole, in one file; a row
    with ``deleted`` is a tombstone, after which the path is gone. State holds the newest version of each path, so versions that
    are late or arrive again change nothing, whatever has been removed in between. Paths are dealt to ``buckets`` by hash: a
    batch rewrites the buckets that its paths are in, drops their old rows by path and points readers to the new files, so a
    batch that is tried again writes the same, and readers never see half of one. ``after`` sees what each batch changed.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = kept(batch.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")))
        touched = [r[0] for r in new.select("bucket").distinct().collect()]
        if touched:
            earlier = [n for n in _batches(spark, table) if n < number]
            where = _pointer(spark, table, earlier[-1] if earlier else None)
            old = _read(spark, table, schema, {b: where[b] for b in touched if b in where}).join(new.select("path").distinct(), "path", "left_anti")
            rows = old.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")).unionByName(new.filter("deleted is null or not deleted"))
            rows.repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/data/batch={number}")
            now = where | dict.fromkeys(touched, number)
            spark.createDataFrame(sorted(now.items()), "bucket int, batch int").coalesce(1).write.mode("overwrite").parquet(f"{table}/pointer/batch={number}")
            if after is not None:
                after(new.drop("bucket"))
        released(new)

    stream = spark.readStream.schema(schema).parquet(source)
    newest = stream.groupBy("path").transformWithStateInPandas(Newest(), schema, "Append", "None")
    with _stateful(spark):
        return newest.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The facts as they stand: the buckets of the last whole batch."""
    done = _batches(spark, path)
    return _read(spark, path, schema, _pointer(spark, path, done[-1] if done else None))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete batches that none of the last ``keep`` pointers reads; returns their numbers."""
    done = _batches(spark, path)
    used = {b for n in done[-keep:] for b in _pointer(spark, path, n).values()}
    gone = [n for n in done[:-keep] if n not in used]
    for folder, numbers in (("data", gone), ("pointer", done[:-keep])):
        for n in numbers:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}/batch={n}")
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return gone


def sessions(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Session windows with a watermark, on a stream or a table: (key, start, end, n)."""
    d = events.withWatermark(time, late) if events.isStreaming else events
    return d.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
