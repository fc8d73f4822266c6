"""Operator 1, quality classifier: a weak-label model and a hashed linear scorer.

1. Heuristic labellers look at each whole text and vote good (1), bad (0) or
   nothing (-1). No gold label is used.
2. Votes are counted by pattern over all documents (at most 3 ** 8 patterns, so
   the table has a fixed bound). Expectation-maximisation over these counts
   estimates each labeller's accuracies and the posterior of every pattern.
3. Posteriors of a bounded sample (``SAMPLE`` documents by hash of doc_id)
   train a logistic scorer on hashed features; it scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import docs_of
from loomgraph.llm.textbytes import chunks, words

#: Most documents that train the scorer. All else covers every document.
SAMPLE = 8_000
#: Hash buckets of the scorer.
BUCKETS = 1 << 13
LABELLERS = ("letters", "symbols", "capitals", "bars", "repeats", "lines", "spread", "length")

# byte classes: letters keep case, other characters stand for themselves
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_CLASS[128:] = 97
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ASCII_LOW = np.zeros(256, bool)
_ASCII_LOW[97:123] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(33, 127) if not (_LETTER[b] or 48 <= b < 58) and chr(b) not in ".,;:'\"()-?"]] = True


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def measures(offsets: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    """What the labellers look at, for each row."""
    n, rows = np.diff(offsets), len(offsets) - 1
    row, start, end, h = words(offsets, data)
    count = np.bincount(row, minlength=rows)
    solid = np.maximum(1, np.bincount(row, weights=end - start, minlength=rows))
    same = np.zeros(rows)
    seen = np.zeros(rows)
    if len(row):
        next_ = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        same = np.bincount(row[1:][next_], minlength=rows)
        order = np.lexsort((h, row))
        first = np.ones(len(row), bool)
        first[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
        seen = np.bincount(row[order][first], minlength=rows)
    breaks = np.flatnonzero(data == 10)
    # a line is known by the hash of its words: repeated lines show as repeated sums
    line_of = np.searchsorted(breaks, start)
    if len(row):
        key = line_of + row  # a row's start begins a line too
        new = np.ones(len(row), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        line_hash = np.add.reduceat(h * (np.arange(len(h), dtype=np.uint64) - np.repeat(at, np.diff([*at, len(h)])).astype(np.uint64) + np.uint64(1)), at)
        line_row = row[at]
        o = np.lexsort((line_hash, line_row))
        again = np.zeros(len(o), bool)
        again[1:] = (line_hash[o][1:] == line_hash[o][:-1]) & (line_row[o][1:] == line_row[o][:-1])
        lines, twice = np.bincount(line_row, minlength=rows), np.bincount(line_row[o][again], minlength=rows)
    else:
        lines = twice = np.zeros(rows)
    letters = np.maximum(1, _sums(_LETTER[data], offsets))
    return {
        "bytes": n,
        "words": count,
        "letters": _sums(_LETTER[data], offsets) / solid,
        "symbols": _sums(_SYMBOL[data], offsets) / np.maximum(1, count),
        "capitals": _sums(_UPPER[data], offsets) / letters,
        "bars": _sums(data == 124, offsets) / np.maximum(1, count),
        "repeats": same / np.maximum(1, count),
        "lines": twice / np.maximum(1, lines),
        "spread": seen / np.maximum(1, count),
    }


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """rows x labellers: 1 good, 0 bad, -1 no vote."""
    def vote(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(bad, 0, np.where(good, 1, -1)).astype(np.int8)

    some, many = m["words"] >= 5, m["words"] >= 30
    x = m["letters"]
    out = [vote(x, some & (x > 0.93), some & (x < 0.8))]
    x = m["symbols"]
    out.append(vote(x, some & (x < 0.06), some & (x > 0.3)))
    x = m["capitals"]
    out.append(vote(x, some & (x < 0.15), some & (x > 0.35)))
    x = m["bars"]
    out.append(vote(x, some & (x < 0.02), some & (x > 0.15)))
    x = m["repeats"]
    out.append(vote(x, some & (x < 0.05), some & (x > 0.15)))
    x = m["lines"]
    out.append(vote(x, some & (x < 0.1), some & (x > 0.3)))
    x = m["spread"]
    out.append(vote(x, many & (x > 0.35), many & (x < 0.1)))
    x = m["words"]
    out.append(vote(x, x >= 50, x == 0))
    return np.stack(out, 1) if len(out[0]) else np.zeros((0, len(LABELLERS)), np.int8)


def features(offsets: np.ndarray, data: np.ndarray, m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight): shares of class trigrams of the text, and binned measures, all hashed to BUCKETS."""
    rows = len(offsets) - 1
    c = _CLASS[data].astype(np.uint32)
    if len(c) >= 3:
        tri = (c[:-2] * np.uint32(65599) + c[1:-1]) * np.uint32(65599) + c[2:]
        bucket = ((tri * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)
        row = np.searchsorted(offsets, np.arange(len(tri)), "right") - 1
        inside = np.arange(len(tri)) + 3 <= offsets[row + 1]
        key = np.bincount(row[inside] * BUCKETS + bucket[inside], minlength=0) if rows * BUCKETS < 1 << 21 else None
        if key is None:
            k, number = np.unique(row[inside] * BUCKETS + bucket[inside], return_counts=True)
        else:
            k = np.flatnonzero(key)
            number = key[k]
        r, b = k // BUCKETS, k % BUCKETS
        w = np.sqrt(number / np.maximum(1, np.diff(offsets) - 2)[r])
    else:
        r, b, w = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    extra_r, extra_b, extra_w = [r], [b], [w]
    for i, name in enumerate(("letters", "symbols", "capitals", "bars", "repeats", "lines", "spread")):
        bin_ = np.minimum(15, (np.asarray(m[name]) * 12).astype(np.int64))
        extra_r.append(np.arange(rows))
        extra_b.append((bin_ * 7919 + i * 104729 + 17) % BUCKETS)
        extra_w.append(np.full(rows, 0.7))
    extra_r.append(np.arange(rows))
    extra_b.append((np.minimum(12, np.log2(1 + m["words"]).astype(np.int64)) * 7919 + 999983) % BUCKETS)
    extra_w.append(np.full(rows, 0.3))
    return np.concatenate(extra_r), np.concatenate(extra_b), np.concatenate(extra_w)


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good for each pattern, accuracies, share of good).

    ``accuracies[j]`` is (P(good vote | good), P(bad vote | bad)) of labeller j among
    the documents on which it votes; votes are independent given the class, and
    no vote says nothing. The start believes a document with any bad vote to be
    bad: classes would else be free to swap.
    """
    good, bad = patterns == 1, patterns == 0
    post = np.where(bad.any(1), 0.1, 0.95)
    accuracy, share = np.full((patterns.shape[1], 2), 0.8), 0.5
    for _ in range(rounds):
        share = float(np.clip((post * counts).sum() / max(1, counts.sum()), 1e-3, 1 - 1e-3))
        log = np.full(len(post), np.log(share / (1 - share)))
        for j in range(patterns.shape[1]):
            one, none = post * counts, (1 - post) * counts
            hit = (one[good[:, j]].sum() + 2) / (one[good[:, j] | bad[:, j]].sum() + 2.5)
            miss = (none[bad[:, j]].sum() + 1) / (none[good[:, j] | bad[:, j]].sum() + 2)
            accuracy[j] = np.clip([hit, miss], 1e-4, 1 - 1e-4)
            log += good[:, j] * np.log(accuracy[j, 0] / (1 - accuracy[j, 1])) + bad[:, j] * np.log((1 - accuracy[j, 0]) / accuracy[j, 1])
        new = 1 / (1 + np.exp(-np.clip(log, -700, 700)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return post, accuracy, share


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: dict[int, int] = {}
        for _, _, offsets, data in chunks(batch.column("text")):
            v = votes(measures(offsets, data)) + 1
            code, n = np.unique(v @ (3 ** np.arange(v.shape[1])), return_counts=True)
            for a, b in zip(code.tolist(), n.tolist(), strict=True):
                total[a] = total.get(a, 0) + b
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["pattern", "n"])


def pattern_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All vote patterns and how many documents have each; at most 3 ** labellers rows."""
    rows = docs.select("text").mapInArrow(_vote_rows, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toArrow()
    code = rows["pattern"].to_numpy().astype(np.int64)
    return np.stack([code // 3**i % 3 - 1 for i in range(len(LABELLERS))], 1) if len(code) else np.zeros((0, len(LABELLERS)), np.int64), rows["n"].to_numpy().astype(np.int64)


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Fit both models; returns arrays of fixed size."""
    patterns, counts = pattern_counts(docs)
    post, prob, share = em(patterns, counts)
    by_code = dict(zip(((patterns + 1) @ (3 ** np.arange(len(LABELLERS)))).tolist(), post.tolist(), strict=True))
    total = int(counts.sum())
    model = {"weights": np.zeros(BUCKETS), "bias": 0.0, "share": share, "accuracy": prob}
    if not total:
        return model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offsets, data in chunks(batch.column("text")):
                m = measures(offsets, data)
                code = (votes(m) + 1) @ (3 ** np.arange(len(LABELLERS)))
                r, b, w = features(offsets, data, m)
                order = np.argsort(r, kind="stable")
                at = np.searchsorted(r[order], np.arange(hi - lo + 1))
                b, w = b[order].astype(np.int32), w[order].astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column("__h").slice(lo, hi - lo), pa.array([by_code[c] for c in code.tolist()]), pa.array([b[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.array([w[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["h", "post", "b", "w"])

    # by hash, twice as many as wanted at most; the sample's size does not follow the input
    h = F.xxhash64(F.col("doc_id").cast("string"), F.crc32("text"))
    kept = 1.0 if total <= sample else sample / total
    some = docs.select(h.alias("__h"), "text").filter((F.pmod(F.col("__h"), F.lit(1 << 30)) < F.lit(int(kept * (1 << 30)))))
    rows = some.mapInArrow(run, "h long, post double, b binary, w binary").orderBy("h", "b", "w").limit(2 * sample).toArrow()
    y = rows["post"].to_numpy()
    lists = [(np.frombuffer(rows["b"][i].as_py(), np.int32), np.frombuffer(rows["w"][i].as_py(), np.float32)) for i in range(len(y))]
    return model | _train(lists, y)


def _train(lists: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 60, rate: float = 1.0) -> dict:
    """Logistic regression by full-batch AdaGrad on soft labels: fixed order, so the same sample gives the same model."""
    if not lists:
        return {}
    at = np.repeat(np.arange(len(lists)), [len(b) for b, _ in lists])
    b, w = np.concatenate([x for x, _ in lists]), np.concatenate([x for _, x in lists]).astype(np.float64)
    weights, bias, seen, seen_b = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(epochs):
        z = np.bincount(at, weights=w * weights[b], minlength=len(y)) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(y)
        grad = np.bincount(b, weights=w * g[at], minlength=BUCKETS) + 1e-6 * weights
        seen += grad**2
        seen_b += g.sum() ** 2
        weights -= rate * 0.3 * grad / np.sqrt(seen)
        bias -= rate * 0.3 * g.sum() / np.sqrt(seen_b)
    return {"weights": weights, "bias": float(bias)}


def score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """``keep`` columns with quality_score (0 to 1) and good (score of 0.5 or more)."""
    sent = docs.sparkSession.sparkContext.broadcast((model["weights"], model["bias"]))
    schema = docs.select(*keep).withColumn("quality_score", F.lit(0.0)).withColumn("good", F.lit(True)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for lo, hi, offsets, data in chunks(batch.column("__text")):
                r, b, w = features(offsets, data, measures(offsets, data))
                z[lo:hi] = np.bincount(r, weights=w * weights[b], minlength=hi - lo) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            cols = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p), pa.array(p >= 0.5)], names=[*keep, "quality_score", "good"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, quality_score, good) of every document.

    Null text counts as empty. A text without words is bad by the labellers and
    scored like any other; very long texts are read whole. Repeated rows are
    scored each. An empty table gives an empty result. Other columns are
    ignored.
    """
    return score(docs, fit(docs, sample), ["doc_id"])


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(docs_of(spark, sf_dir))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return _kept(docs, fit(docs))


def _kept(docs: DataFrame, model: dict) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((model["weights"], model["bias"]))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for lo, hi, offsets, data in chunks(batch.column(at)):
                r, b, w = features(offsets, data, measures(offsets, data))
                z[lo:hi] = np.bincount(r, weights=w * weights[b], minlength=hi - lo) + bias
            yield batch.filter(pa.array(z >= 0))

    return docs.mapInArrow(run, docs.schema)
