"""Operator 6, sharding: jump consistent hashing (Lamping and Veach 2014).

A key and the shard count alone decide the shard; there is no ring table. When
a shard is appended, about 1/(n+1) of the keys move, all of them into it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import docs_of, ranked, written

#: Pieces of a shard that are numbered apart.
PIECES = 4096

_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key."""
    key, at, nxt = keys.astype(np.uint64), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        at[live] = nxt[live]
        with np.errstate(over="ignore"):
            k = key[live] * _STEP + np.uint64(1)
        key[live] = k
        nxt[live] = ((at[live] + 1) * (float(1 << 31) / ((k >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        live = live[nxt[live] < shards]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Column of shards for a long column; null keys count as 0."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf(T.IntegerType())
    def udf(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64).view(np.uint64), shards))

    return udf(F.coalesce(key, F.lit(0).cast("long")))


def stable_key(df: DataFrame, key: str) -> Column:
    """Integers are taken as they are, all other types by their 64-bit hash."""
    return F.col(key).cast("long") if isinstance(df.schema[key].dataType, T.IntegralType) else F.xxhash64(F.col(key))


def assign(df: DataFrame, key: str, shards: int, name: str = "shard") -> DataFrame:
    """``df`` with its shard; narrow, no shuffle. Null keys go where key 0 goes."""
    return df.withColumn(name, shard_of(stable_key(df, key), shards))


def write_shards(df: DataFrame, key: str, shards: int, path: str) -> None:
    """Write one folder per shard. Rows spread over several files of a shard, so none is one task."""
    df = assign(df, key, shards, "shard")
    df.repartition(F.col("shard"), F.pmod(F.xxhash64(key), F.lit(16))).write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Placement of every document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``. ``size`` is the number of UTF-8 bytes and 1 more; null
    text counts as none (size 1, CRC 0, as for empty text). ``slot`` numbers a
    shard's rows from 0, by a digest of doc_id and then doc_id, size and CRC;
    repeated rows get a slot each. An empty table gives an empty result. Other
    columns are ignored. Only the narrow placement is shuffled, never the text.
    """
    d = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    d = assign(assign(d, "doc_id", shards, "shard"), "doc_id", shards + 1, "grown_shard")
    # the piece also looks at the text: many rows of one key spread over pieces
    d = written(d, "placed")
    piece = F.substring(F.md5(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("text_crc32").cast("string"))), 1, len(f"{PIECES - 1:x}"))
    out = ranked(d, ["shard"], [F.col("doc_id"), F.col("size"), F.col("text_crc32")], piece, "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(docs_of(spark, sf_dir), 8)
