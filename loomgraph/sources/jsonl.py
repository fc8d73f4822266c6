"""Canonical line export of typed records and its validating import."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars

FORMAT = "loomgraph-records-1"


def record_lines(records: DataFrame) -> DataFrame:
    """(type, id, line): records (type, payload as JSON text) in canonical form; ``id`` is a digest of type and payload."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for kind, payload in zip(b["type"], b["payload"], strict=True):
                text = json.dumps(json.loads(payload), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
                ident = hashlib.sha256(f"{FORMAT}:{kind}\0{text}".encode()).hexdigest()
                rows.append((kind, ident, f'{{"id":"{ident}","payload":{text},"type":{json.dumps(kind)}}}'))
            yield pd.DataFrame(rows, columns=["type", "id", "line"])

    return records.select("type", "payload").mapInPandas(run, "type string, id string, line string").dropDuplicates(["type", "id"])


def header(lines: DataFrame) -> DataFrame:
    """One row: number of records and a digest that does not depend on partitions: the digest of per-type digests in order."""
    part = F.substring("id", 1, 2)
    piece = lines.groupBy("type", part.alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("id")), "\n"), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    return piece.agg(F.sum("n").alias("records"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("type", "p", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"))


def export(records: DataFrame, path: str) -> None:
    """Write header and lines in order of (type, id); ranges of the order are files, so no task holds all lines."""
    lines = record_lines(records)
    head = header(lines).first()
    spark = records.sparkSession
    spark.createDataFrame([(json.dumps({"format": FORMAT, "records": head["records"], "digest": head["digest"]}, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/header")
    lines.orderBy("type", "id").select(F.col("line").alias("value")).write.text(f"{path}/lines")


def load(spark, path: str) -> DataFrame:
    """(type, id, payload) of an export; ValueError if anything was changed, lost, doubled, put in another order, or names a path
    that is not relative and normalised."""
    head = json.loads(spark.read.text(f"{path}/header").first()[0])
    if head.get("format") != FORMAT:
        raise ValueError("unsupported_format")
    raw = spark.read.text(f"{path}/lines").select(F.from_json("value", "id string, type string").alias("r"), F.col("value").alias("line"), F.input_file_name().alias("__file"), F.monotonically_increasing_id().alias("__at"))
    d = raw.select("r.type", "r.id", "line", F.get_json_object("line", "$.payload").alias("payload"), "__file", "__at")
    if d.filter("id is null or type is null").limit(1).count():
        raise ValueError("malformed_line")
    if d.groupBy("type", "id").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").limit(1).count():
        raise ValueError("duplicate_record")
    # inside a file each line comes after the one before it; files are ranges of the order, one row each
    key = F.struct("type", "id")
    before = F.lag(key).over(Window.partitionBy("__file").orderBy("__at"))
    ends = d.groupBy("__file").agg(F.min(key).alias("__lo"), F.max(key).alias("__hi"))
    last = F.max("__hi").over(Window.orderBy("__lo").rowsBetween(Window.unboundedPreceding, -1))
    if d.withColumn("__before", before).filter(F.col("__before") >= key).limit(1).count() or ends.withColumn("__last", last).filter("__last >= __lo").limit(1).count():
        raise ValueError("order_mismatch")
    place = F.get_json_object("payload", "$.path")
    if d.filter(place.isNotNull() & ~scalars.relative_path(place)).limit(1).count():
        raise ValueError("unsafe_path")
    again = record_lines(d.select("type", "payload"))
    if again.join(d, ["type", "id"], "left_anti").limit(1).count():
        raise ValueError("identity_mismatch")
    now = header(d).first()
    if now["records"] != head["records"] or now["digest"] != head["digest"]:
        raise ValueError("digest_mismatch")
    return d.select("type", "id", "payload")
