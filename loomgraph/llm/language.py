"""Operator 4, language identification: hierarchical discrimination.

First the language family is predicted, then one-versus-one linear support
vector machines tell its closely related languages apart. All machines are
linear in hashed byte trigrams of the lower-cased whole text, so one pass over
the bytes scores every machine at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import docs_of
from loomgraph.llm.textbytes import _LOWER, chunks

#: Most documents of a language that train; all are scored.
SAMPLE = 1_500
#: Most languages that can be learned; more is an error.
MOST_LANGUAGES = 64
BUCKETS = 1 << 14
#: Families of widely used languages; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
_FAMILY = {lang: f for f, langs in FAMILIES.items() for lang in langs}
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Every document whose crc32(doc_id as text) mod 4 is 2 teaches nothing."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == 2


def _fold(data: np.ndarray) -> np.ndarray:
    """Lower-case letters (ASCII, and the Latin-1 letters behind byte 0xC3); digits and signs to one value each."""
    d = _LOWER[data]
    latin = np.zeros(len(d), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    d = np.where(latin, d + 32, d).astype(np.uint8)
    plain = (d >= 97) & (d <= 122) | (d >= 128)
    return np.where(plain, d, 32).astype(np.uint8)


def trigrams(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every byte trigram that does not cross rows; runs of other characters act as one space."""
    c = _fold(data).astype(np.uint32)
    if len(c) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = ((c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]) * np.uint32(2654435761)
    bucket = (h >> np.uint32(18)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(h)]
    ok = (np.arange(3, len(c) + 1) <= offsets[row + 1]) & ~((c[1:-1] == 32) & ((c[:-2] == 32) | (c[2:] == 32)))
    return row[ok], bucket[ok]


def _counted(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, bucket = trigrams(offsets, data)
    key, n = np.unique(row * BUCKETS + bucket, return_counts=True)
    return key // BUCKETS, key % BUCKETS, n


def _machine(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 150, cost: float = 1e-4) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss; full-batch AdaGrad, so it is deterministic."""
    at = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    b, x = np.concatenate([r[0] for r in rows]).astype(np.int64), np.concatenate([r[1] for r in rows])
    w, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-10)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    for _ in range(epochs):
        z = np.bincount(at, weights=x * w[b], minlength=len(y)) + w[-1]
        g = -2 * y * np.maximum(0, 1 - y * z) * weight
        grad = np.append(np.bincount(b, weights=x * g[at], minlength=BUCKETS), g.sum() * 0.1) + cost * w
        seen += grad**2
        w -= 0.5 * grad / np.sqrt(seen)
    return w


def _training(docs: DataFrame, sample: int) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """Languages and feature rows of at most ``sample`` documents each, by hash of doc_id."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    langs = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offsets, data in chunks(batch.column("text")):
                r, b, n = _counted(offsets, data)
                at = np.searchsorted(r, np.arange(hi - lo + 1))
                b, n = b.astype(np.uint16), n.astype(np.uint32)
                packed = [(b[x:y].tobytes(), n[x:y].tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("h").slice(lo, hi - lo), batch.column("lang").slice(lo, hi - lo), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())], names=["h", "lang", "b", "n"])

    h = F.xxhash64(F.col("doc_id").cast("string"))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(min(1.0, sample / n) * (1 << 30)))) for k, n in langs.items()], F.lit(0))
    some = known.withColumn("h", h).filter(F.pmod("h", F.lit(1 << 30)) < share).select("h", "lang", "text")
    rows = some.mapInArrow(run, "h long, lang string, b binary, n binary").orderBy("h", "lang", "b", "n").limit(2 * sample * max(1, len(langs))).toArrow()
    lang, out = rows["lang"].to_pylist(), []
    for i in range(rows.num_rows):
        n = np.frombuffer(rows["n"][i].as_py(), np.uint32).astype(np.float64)
        out.append((np.frombuffer(rows["b"][i].as_py(), np.uint16), np.sqrt(n / max(1.0, n.sum()))))
    return lang, out


class Model:
    """Families, their languages, and one weight column per machine."""

    def __init__(self, lang: list[str], rows: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(set(lang))
        self.families = sorted({_FAMILY.get(x, x) for x in self.langs})
        self.members = {f: [x for x in self.langs if _FAMILY.get(x, x) == f] for f in self.families}
        self.family_pairs = list(combinations(self.families, 2))
        self.lang_pairs = [p for f in self.families for p in combinations(self.members[f], 2)]
        by_lang = {x: [r for r, y in zip(rows, lang, strict=True) if y == x] for x in self.langs}
        columns = []
        for a, b in self.family_pairs:
            one, two = ([r for x in self.members[f] for r in by_lang[x]] for f in (a, b))
            columns.append(_machine(one + two, np.r_[np.ones(len(one)), -np.ones(len(two))]))
        for a, b in self.lang_pairs:
            columns.append(_machine(by_lang[a] + by_lang[b], np.r_[np.ones(len(by_lang[a])), -np.ones(len(by_lang[b]))]))
        self.w = np.stack(columns, 1) if columns else np.zeros((BUCKETS + 1, 0))

    def margins(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        r, b, n = _counted(offsets, data)
        total = np.bincount(r, weights=n, minlength=rows)
        x = np.sqrt(n / total[r])
        out = [np.bincount(r, weights=x * self.w[b, j], minlength=rows) + self.w[-1, j] for j in range(self.w.shape[1])]
        return np.stack(out, 1) if out else np.zeros((rows, 0))

    @staticmethod
    def _won(names: list[str], pairs: list[tuple[str, str]], z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the name that wins most pairs, ties by summed margin and then by name; logistic of its least margin)."""
        wins, least = np.zeros((len(z), len(names))), np.full((len(z), len(names)), 30.0)
        for j, (a, b) in enumerate(pairs):
            ia, ib, m = names.index(a), names.index(b), np.clip(z[:, j], -30, 30)
            wins[:, ia] += (m >= 0) + m / 1e6
            wins[:, ib] += (m < 0) - m / 1e6
            least[:, ia], least[:, ib] = np.minimum(least[:, ia], m), np.minimum(least[:, ib], -m)
        best = wins.argmax(1)
        return best, 1 / (1 + np.exp(-3 * least[np.arange(len(z)), best]))

    def predict(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = self.margins(offsets, data)
        k = len(self.family_pairs)
        fam, p = self._won(self.families, self.family_pairs, z[:, :k])
        out, score = np.full(len(z), UNKNOWN, object), np.zeros(len(z))
        for i, f in enumerate(self.families):
            at = np.flatnonzero(fam == i)
            own = [(j, pair) for j, pair in enumerate(self.lang_pairs) if pair[0] in self.members[f]]
            best, q = self._won(self.members[f], [x for _, x in own], z[at][:, [k + j for j, _ in own]])
            out[at] = np.array(self.members[f], object)[best]
            score[at] = p[at] * q
        return out, score


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    return Model(*_training(docs, sample))


def _predict(docs: DataFrame, model: Model, schema, finish) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            lang, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            known = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            if m.langs and known.any():
                for lo, hi, offsets, data in chunks(batch.column(batch.num_columns - 2)):
                    lang[lo:hi], score[lo:hi] = m.predict(offsets, data)
                lang[~known], score[~known] = UNKNOWN, 0.0
            yield finish(batch, lang, score)

    text = F.col("text")
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return docs.select(*[F.col(f"`{c}`") for c in schema[1]], text.alias("__text"), letters.alias("__letters")).mapInArrow(run, schema[0])


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document.

    Learns from text and non-null lang of documents that are not held out;
    lang, source and doc_id are no inputs of a prediction. ``lang_pred`` is
    ``und`` with score 0 for null text, text without a letter, or if there is
    nothing to learn from. Whole texts are read. Repeated rows are each
    predicted, alike. An empty table gives an empty result. Other columns are
    ignored. More than ``MOST_LANGUAGES`` languages raise an error.
    """
    model = fit(docs, sample)
    d = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    schema = d.select("doc_id", "held_out").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def finish(batch: pa.RecordBatch, lang: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return _predict(d, model, (schema, ["doc_id", "held_out"]), finish)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(docs_of(spark, sf_dir))


#: A prediction below this score tells no language.
LEAST = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: null text, text without a letter, predictions below ``LEAST``.

    ``lang`` of the others becomes the predicted language, so wrong and missing labels are mended. Where no language was
    learned every prediction is ``und``, the letters alone decide, and ``lang`` stays as it was.
    """
    model, names = fit(docs), docs.columns
    learned = bool(model.langs)

    def finish(batch: pa.RecordBatch, lang: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        told = pa.array((lang != UNKNOWN) & (score >= LEAST)) if learned else batch.column(batch.num_columns - 1)
        kept, lang = batch.filter(told), pa.array(lang, pa.string()).filter(told)
        columns = [lang.cast(c.type) if learned and n == "lang" else c for n, c in zip(names, kept.columns[:-2], strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return _predict(docs, model, (docs.schema, docs.columns), finish)
