"""Operator 3, exact top-k search: exhaustive term-at-a-time accumulation.

A query is a sparse row of (term, weight). For each term its posting list over
a block of candidates is scattered, weighted, into one dense score array per
query. Each partition selects its own best k, and these are merged. All rows
are scored: there is no index and no bound that prunes.

Queries travel to the candidates in waves of at most ``WAVE`` rows (a checked,
fixed size), so candidates are never shuffled and the driver holds one wave: each
wave's best rows are written before the next wave is fetched. A task streams over
its candidates whatever their number, so few long tasks read them: each returns
k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import dropped, written

#: Queries of one wave; 64 weights of 8 bytes make 25 MB.
WAVE = 50_000
#: Candidates in a block of postings, and queries that share a dense array.
BLOCK, QUERIES = 4096, 64

_SCHEMA = "q long, query_id long, own long, times long, vec_id long, score long"


def quantised(col: str) -> F.Column:
    """floor(1024 x) of every component; null unless all are finite."""
    x = F.col(col)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(x.isNotNull() & ~F.coalesce(odd, F.lit(True)), F.transform(x, lambda v: F.floor(v.cast("double") * 1024).cast("long")))


def _postings(rows: list[np.ndarray], terms: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Posting list of each term: block rows that hold it, and their weights."""
    dense = np.zeros((len(rows), terms), np.int64)
    for i, r in enumerate(rows):
        dense[i, : min(len(r), terms)] = r[:terms]
    return [(np.flatnonzero(dense[:, t]), dense[dense[:, t] != 0, t]) for t in range(terms)]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= edge)
        score, ids = score[keep], ids[keep]
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def _arrays(col: pa.ChunkedArray) -> list[np.ndarray]:
    lists = col.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    at, flat = np.asarray(lists.offsets), lists.values.to_numpy(zero_copy_only=False)
    return [flat[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, wave: int = WAVE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k best candidates by integer inner product, ties to the smaller vec_id.

    Both frames hold ``vec_id`` and ``w`` (array of long; shorter arrays end in
    zeros), and ``queries`` are rows of ``candidates``: a query meets every row
    but its own, so a row that repeats its vec_id counts, a copy of it included.
    Every query row has its rows, repeated ones too. Rows with null w or null
    vec_id take no part. Fewer candidates than k: all. No query or no candidate:
    no row. Equal query rows are asked once. Best rows are kept one more than
    asked for, and one that is the query's own by id and score is left out then.
    """
    spark = candidates.sparkSession
    cand = candidates.select("vec_id", "w").filter("vec_id is not null and w is not null")
    asked = queries.select("vec_id", "w").filter("vec_id is not null and w is not null").groupBy("vec_id", "w").agg(F.count(F.lit(1)).alias("times"))
    asked = written(asked, "asked", narrow=True)
    waves = max(1, -(-asked.count() // wave))
    found = None
    for i in range(waves):
        rows = asked.filter(F.pmod(F.xxhash64("vec_id", "w"), F.lit(waves)) == i).limit(2 * wave + 1).toArrow()
        if rows.num_rows > 2 * wave:
            raise RuntimeError("a wave of queries is over its bound")
        q_rows = _arrays(rows["w"]) if rows.num_rows else []
        own = np.array([int(x @ x) for x in q_rows], np.int64)
        asked_now = spark.sparkContext.broadcast((rows["vec_id"].to_numpy(), own, rows["times"].to_numpy(), q_rows))
        part = written(_ranked(_scored(cand.coalesce(4 * spark.sparkContext.defaultParallelism), asked_now, k + 1), k), "wave", narrow=True)
        asked_now.destroy()
        found = part if found is None else found.unionByName(part)
    dropped(asked)
    return found


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query without its own row, as often as the query occurs."""
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    d = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k + 1)
    # of rows that may be the query's own, the first one is left out
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    at = F.min(F.when(own, F.col("rank"))).over(Window.partitionBy("q"))
    d = d.withColumn("__own", at).filter(F.col("__own").isNull() | (F.col("rank") != F.col("__own")))
    d = d.withColumn("rank", F.when(F.col("__own") < F.col("rank"), F.col("rank") - 1).otherwise(F.col("rank"))).filter(F.col("rank") <= k)
    return d.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("__n")).drop("__n")


def _scored(cand: DataFrame, asked, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, own, times, q_rows = asked.value
        top_s: list[np.ndarray] = [np.empty(0, np.int64)] * len(q_ids)
        top_v: list[np.ndarray] = [np.empty(0, np.int64)] * len(q_ids)
        for batch in batches:
            all_ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            col = batch.column("w")
            for lo in range(0, len(all_ids), BLOCK):
                ids = all_ids[lo : lo + BLOCK]
                rows = [np.asarray(x.values) for x in col.slice(lo, BLOCK)]
                lists = _postings(rows, max(map(len, rows), default=0))
                for q in range(0, len(q_ids), QUERIES):
                    some = range(q, min(q + QUERIES, len(q_ids)))
                    dense = np.zeros((len(some), len(ids)), np.int64)
                    for x, j in enumerate(some):
                        acc = dense[x]
                        for t in np.flatnonzero(q_rows[j][: len(lists)]):
                            at, weight = lists[t]
                            acc[at] += q_rows[j][t] * weight
                    for x, j in enumerate(some):
                        s, v = _best(dense[x], ids, k)
                        top_s[j], top_v[j] = _best(np.concatenate([top_s[j], s]), np.concatenate([top_v[j], v]), k)
        if len(q_ids):
            n = np.array([len(x) for x in top_s])
            columns = [np.repeat(x, n) for x in (np.arange(len(q_ids)), q_ids, own, times)] + [np.concatenate(top_v), np.concatenate(top_s)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["q", "query_id", "own", "times", "vec_id", "score"])

    return cand.mapInArrow(run, _SCHEMA)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", quantised("embedding").alias("w"))
    return top_k(e, e.filter("vec_id % 100 = 0"), 10)
