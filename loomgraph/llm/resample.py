"""Operator 11, importance resampling towards a target distribution: partition-local word tries.

A task keeps its texts' features, runs of 1 to ``n`` consecutive words, in a trie:
a node is a word after its parent's, and holds how often its run occurred and the
CRC-32 state of the run's bytes, which its children's states go on from. Counts
leave the task as totals by bucket, are added up by Spark, and give every bucket a
gain: the log ratio of its smoothed share in the target texts to that in the raw
ones (Xie et al. 2023, hashed n-gram features). In a second pass the same tries
carry gains in place of counts, and a document is scored by walking its runs. Noise
from a digest of the document's id makes the highest scores a draw without
replacement in proportion to the weights (Gumbel top-k).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import docs_of, positions, written

BUCKETS = 10_000
#: Nodes of a trie; a full one hands its counts over and starts anew.
NODES = 1 << 18
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20

#: Words and what ends them, after A-Z were lower-cased, on UTF-8 bytes.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def word_lists(text: pa.Scalar, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text of any length, in lists of about ``piece`` bytes; null has none."""
    if not text.is_valid:
        return
    data = bytes(text.as_buffer()).lower()
    lo = 0
    while lo < len(data):
        end = _GAP.search(data, lo + piece)
        hi = end.start() if end else len(data)
        yield _WORD.findall(data, lo, hi)
        lo = hi


def starts(text: pa.Scalar, n: int, piece: int = PIECE) -> Iterator[tuple[list[bytes], int]]:
    """(words, k): the first k of them each start runs; the others follow in the next list, or start shorter runs at the end."""
    kept: list[bytes] = []
    for words in word_lists(text, piece):
        words = kept + words
        k = max(0, len(words) - n + 1)
        yield words, k
        kept = words[k:]
    if kept:
        yield kept, len(kept)


class Trie:
    """Runs of words; node 0 is the root. A node has its run's CRC-32 state and a number: a count, or the gain of its bucket."""

    def __init__(self, gains: np.ndarray | None = None):
        self.gains = None if gains is None else gains.tolist()
        self.kids: list[dict[bytes, int] | None] = [{}]
        self.crc, self.number = [0], [0]

    def grow(self, at: int, word: bytes) -> int:
        """The new child of ``at`` for ``word``."""
        new = len(self.crc)
        if self.kids[at] is None:
            self.kids[at] = {}
        self.kids[at][word] = new
        self.kids.append(None)
        self.crc.append(zlib.crc32(b" " + word if at else word, self.crc[at]))
        self.number.append(0 if self.gains is None else self.gains[self.crc[new] % len(self.gains)])
        return new

    def walk(self, words: list[bytes], k: int, n: int) -> Iterator[int]:
        """The nodes of all runs of up to ``n`` words that start at the first ``k``."""
        kids, grow = self.kids, self.grow
        if n == 1:
            top = kids[0]
            for w in words[:k]:
                at = top.get(w)
                yield grow(0, w) if at is None else at
            return
        for i in range(k):
            at = 0
            for w in words[i : i + n]:
                below = kids[at]
                nxt = below.get(w) if below else None
                at = grow(at, w) if nxt is None else nxt
                yield at

    def totals(self, buckets: int) -> np.ndarray:
        """Counts by bucket."""
        out = np.zeros(buckets, np.int64)
        np.add.at(out, np.array(self.crc[1:], np.int64) % buckets, np.array(self.number[1:], np.int64))
        return out


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = BUCKETS, nodes: int = NODES) -> DataFrame:
    """(bucket, n): how many features of the column ``text`` are in each bucket; buckets without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, trie = np.zeros(buckets, np.int64), Trie()
        for batch in batches:
            for text in batch.column("text"):
                for words, k in starts(text, n):
                    number = trie.number
                    for at in trie.walk(words, k, n):
                        number[at] += 1
                    if len(trie.crc) > nodes:
                        total, trie = total + trie.totals(buckets), Trie()
        total += trie.totals(buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, from counts (bucket, n): floored thousandths of the log ratio of shares, one added to each count."""
    d = raw.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    d = d.join(raw.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").fillna(0, ["s", "t"])
    sums = d.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1).cast("double") * (F.col("all_s") + buckets).cast("double") / ((F.col("s") + 1).cast("double") * (F.col("all_t") + buckets).cast("double"))
    # one row on the right
    return d.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))


def weigh(docs: DataFrame, gain: np.ndarray, n: int = 1, nodes: int = NODES) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of a document's features, 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(gain)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                n_words = found = total = 0
                for words, k in starts(text, n):
                    n_words += k
                    number = trie.number
                    for at in trie.walk(words, k, n):
                        total += number[at]
                        found += 1
                    if len(trie.crc) > nodes:
                        trie = Trie(gain)
                rows.append((n_words, found, total // found if found else 0))
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols]], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Floored thousandths of a Gumbel variable, from the digest of seed and id; a null id counts as empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, n: int = 1, buckets: int = BUCKETS, seed: int = 2024, nodes: int = NODES) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``rank`` (from 1) is null for those not drawn.

    Of the documents with ``least`` words, ``percent`` in a hundred with the
    highest scores are drawn, ties to the smaller doc_id (null first), then fewer
    features. Null and empty texts have no features, weight 0 and are never drawn
    if ``least`` is positive. Repeated rows count and are drawn each. Empty tables
    give empty results; an empty target makes all gains follow the raw counts.
    Other columns are ignored. Texts are read twice and never shuffled; the
    ``buckets`` gains are the only thing that passes through the driver.
    """
    rows = gains(bucket_counts(docs, n, buckets, nodes), bucket_counts(target, n, buckets, nodes), buckets).toPandas()
    gain = np.zeros(buckets, np.int64)
    gain[rows["bucket"].to_numpy()] = rows["gain"].to_numpy()
    d = weigh(docs, gain, n, nodes).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    d = written(d.withColumn("__low", -F.col("score")), "weighed")
    able = F.col("n_words") >= least
    placed = positions(d.filter(able), [], ["__low", "doc_id", "n_features"], "__place", "__all")
    drawn = F.col("__place") < F.floor(F.col("__all") * percent / 100)
    out = placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("__place") + 1).alias("rank"))
    return out.unionByName(d.filter(~able).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(docs_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
