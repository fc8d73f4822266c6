"""What the operators share: written intermediate tables, distributed ranks and components.

Intermediate tables are written as Parquet below the folder that the session
names in ``spark.checkpoint.dir``, so every executor can read them again after
any other is lost. Where that setting is absent, local mode makes a private
folder and a cluster is refused.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the session names it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written whole at ``path``."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone by now, and the folder with it
            return


#: Bytes of an Arrow batch on its way to Python, so that rows of long texts do not fill a worker.
BATCH = "4m"


#: Settings while a table is written; shuffle files go as soon as the write that made them has ended.
_WRITING = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH, "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def writing(spark: SparkSession):
    """Bounded Arrow batches and no shuffle files left behind while the block runs."""
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts lineage, survives lost executors.

    ``narrow`` tables (ids, links) are a small share of the data: they are dealt
    anew to a sixteenth of the shuffle partitions, so they do not fall into tiny
    files; the stage that makes them keeps its full width.
    """
    spark = df.sparkSession
    if narrow:
        df = df.repartition(max(6, n_parts(spark) // 16))
    path = f"{shared_dir(spark)}/loomgraph-{label}-{uuid.uuid4().hex}"
    with writing(spark):
        df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_loom_path", None):
            _remove(df.sparkSession, path)
            _made[:] = [x for x in _made if x[1] != path]


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ranked(df: DataFrame, group: list[str], order: list[Column], sub: Column, name: str) -> DataFrame:
    """Append ``name``: a gapless number from 0 inside ``group``, in the order (sub, order).

    ``sub`` splits a group into pieces, so no task holds a whole one: each piece
    is numbered alone and shifted by the sizes of the pieces before it. Only
    the table of pieces is ordered per group. ``df`` is read twice; give a
    written or cheap table.
    """
    from pyspark.sql import Window

    d = df.withColumn("__sub", sub)
    w = Window.partitionBy(*group, "__sub").orderBy(*order)
    before = Window.partitionBy(*[F.col(f"__g{i}") for i in range(len(group))]).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        d.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__sub").alias("__s"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__shift", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    d = d.withColumn("__rank", F.row_number().over(w).cast("long") - 1)
    on = F.col("__sub").eqNullSafe(F.col("__s"))
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return d.join(sizes, on).withColumn(name, F.col("__rank") + F.col("__shift")).select(*df.columns, name)


def positions(df: DataFrame, group: list[str], order: list[str], name: str, total: str) -> DataFrame:
    """Append ``name``, a gapless number from 0 inside ``group`` (never null) by ``order``, and ``total``, the group's rows.

    Rows are dealt by ranges of (group, order) and sorted in their range, so a
    hot group spreads over tasks; ranges are shifted by the sizes of those
    before them. ``df`` is computed twice: give a written table.
    """
    from pyspark.sql import Window

    keys = [*group, *order]
    d = written(df.repartitionByRange(n_parts(df.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__id", 33)
    whole = Window.partitionBy(*group)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range and group in it
    sizes = d.groupBy(*group, part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    sizes = sizes.select(*group, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias(total))
    out = d.withColumn("__part", part).join(sizes, [*group, "__part"])
    return out.select(*df.columns, (F.col("__id") + F.col("__shift")).alias(name), total)


#: Links that one task takes alone (about 50 MB); more go in rounds over all tasks.
FEW_LINKS = 200_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): every id that is not the smallest of its component, with the smallest."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    for batch in batches:
        for u, v in zip(*(batch.column(c).to_pylist() for c in ("u", "v")), strict=True):
            a, b = root(u), root(v)
            if a != b:
                above[max(a, b)] = min(a, b)
    ids = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the long pairs in the first two columns: (id, component).

    ``component`` is the smallest id that links reach; only ids with a link to
    another id are returned. Alternates large-star and small-star steps (Kiveris
    et al. 2014) until the edges form stars. Every step is a minimum (combined
    before the shuffle) and an equi-join, so a hub's edges are never gathered in
    one task; tables are written between rounds. ``FEW_LINKS`` distinct links or
    fewer need no rounds: one task makes the stars.
    """
    a, b = edges.columns[:2]

    def step(df: DataFrame) -> tuple[DataFrame, tuple]:
        """The written edges, and what tells whether they have changed, counted while they are written."""
        seen = Observation()
        out = written(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "links", narrow=True)
        return out, (seen.get["n"], seen.get["sum"])

    e, now = step(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u != v").distinct())
    mark = None
    if 0 < now[0] <= FEW_LINKS:
        done, e = e, written(e.coalesce(1).mapInArrow(_stars, "u long, v long"), "stars")
        dropped(done)
        mark = now
    while now[0] and now != mark:
        mark = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(low).distinct()
        done = e
        e, now = step(small)
        dropped(done)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


LONG, INT, STR, BIN = T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType()
