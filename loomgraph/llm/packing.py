"""Operator 9, best-fit packing of documents into token sequences: bulk-synchronous rounds of distributed successor sweeps.

Every round range-sorts the documents that are left together with the gaps of the
open sequences, largest first and gaps before documents of their size. A task
sweeps its range: gaps are pushed on a stack, and a document takes the topmost,
which is its successor, the smallest gap that still holds it. Documents that find
none in their range wait, and gaps that nobody took stay open: these meet across
ranges. They are ranked as if one stack went through all ranges: running sums and
minima over the ranges' counts give each its height, so every document and gap has
a slot, and documents that want the same gap get different ones by rank. Gaps
shrink by what they took, and the next round goes over what is left. Documents
longer than every gap open sequences, as many as they need at least. Where a length
has more documents than there are gaps, equally long ones go together, so rounds
follow the documents that a sequence holds, not the copies.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import docs_of, n_parts, written

CAPACITY = 2048
#: Appended to each document.
END = 0
_encodings: dict[str, object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The byte that each printable character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class Encoder:
    """Ids as the ``tokenizers`` file gives them without added special tokens.

    Where merges are in order of their ids (checked), the same byte-pair merges
    run by rank in tiktoken, several times as fast; otherwise ``tokenizers`` runs.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        byte = _byte_of_char()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in merges]
        first = len(vocab) - len(joined) - sum(t in vocab for t in special)
        pre = spec.get("pre_tokenizer") or {}
        ordered = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and spec.get("normalizer") is None and all(vocab[t] == first + i for i, t in enumerate(joined))
        if ordered:
            import public_tokenizers
            import tiktoken

            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
            self._fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self._slow = None
        else:
            from tokenizers import Tokenizer

            self._fast, self._slow = None, Tokenizer.from_file(path)

    def __call__(self, text: str) -> np.ndarray:
        if self._fast is not None:
            return self._fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str) -> Encoder:
    if path not in _encodings:
        _encodings[path] = Encoder(path)
    return _encodings[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, after a first one with the rest."""
    rest = n % capacity
    out = [(0, rest)] if rest or not n else []
    return out + [(s, capacity) for s in range(rest, n, capacity)]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, ids: bool = False) -> DataFrame:
    """Token pieces of every document: its ids and ``END``; null text is empty. ``ids`` adds them, little-endian."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                rows: list[tuple] = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    t = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                    for k, (s, n) in enumerate(cut(len(t), capacity)):
                        raw = t[s : s + n].tobytes()
                        rows.append((doc, k, s, n, zlib.crc32(raw), raw))
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:5]]]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(cols[5], pa.binary())] * ids, names=names + ["ids"] * ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES + ", ids binary" * ids)


#: Part of a sequence that documents of one length may take in a round; documents and gaps that one task sweeps alone.
SHARE, ALONE = 8, 200_000


class _Sweep:
    """The sweep of one range: ``stack`` has the gaps that nobody took yet, (sequence_id, gap)."""

    def __init__(self, many: list[int], capacity: int):
        self.many, self.capacity = many, capacity
        self.stack: list[tuple[int, int]] = []
        self._done: list[tuple[int, int]] = []
        self._bin: tuple[int, int] | None = None
        self._unit, self._count, self._inside, self._waits = -1, 0, 0, 0

    def _close(self) -> None:
        if self._bin is not None:
            self._done.append((self._bin[0], self._bin[1] - self._inside - self._unit))
            self._bin = None

    def over(self, lengths: list, bins: list, gaps: list) -> list[tuple]:
        """(sequence_id, offset, at, in) of the documents among the next rows, in their order."""
        out: list[tuple] = []
        for length, seq, gap in zip(lengths, bins, gaps, strict=True):
            if seq is None and length == self._unit and self._count < self.many[length]:
                self._count, self._inside = self._count + 1, self._inside + length
            else:
                self._close()
                if seq is not None:
                    self.stack.append((seq, gap))
                    self._unit = -1
                    continue
                self._unit, self._count, self._inside = length, 1, 0
                self._bin = self.stack.pop() if self.stack else None
                self._waits += self._bin is None
            b = self._bin
            out.append((None, None, self._waits - 1, self._inside) if b is None else (b[0], self.capacity - b[1] + self._inside, None, self._inside))
        return out

    def shrunk(self, end: bool = False) -> list[tuple[int, int]]:
        """What is left of the gaps that were taken since the last call; at the end, of the one in use too."""
        if end:
            self._close()
        out, self._done = self._done, []
        return out


def _opening(counts: np.ndarray, gaps: np.ndarray, capacity: int) -> tuple[int, int, np.ndarray]:
    """What a round begins with, from the documents and gaps of each size: the smallest gap of use, how many sequences open, and how
    many documents of each length go together."""
    size = np.arange(capacity + 1)
    least = int(np.flatnonzero(counts)[0])  # gaps below the smallest document are closed
    gaps = gaps * (size >= least)
    over = counts * (size > (np.flatnonzero(gaps).max() if gaps.any() else 0))  # documents that no gap holds
    more = max(int(over[size > capacity // 2].sum()), -(-int((over * size).sum()) // capacity))
    return least, more, np.maximum(1, np.minimum(counts // (gaps.sum() + more), capacity // SHARE // np.maximum(size, 1)))


def _finished(rows: DataFrame, names: list[str], opened: int, capacity: int) -> DataFrame:
    """All rounds that are left, where one task sweeps the documents and gaps alone: (names, sequence_id, offset). ``rows`` has a
    document's __tie too; ``opened`` is the first free sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if not found:
            return
        table = pa.Table.from_batches(found)
        docs = table.filter(pc.is_null(table.column("sequence_id")))
        free = table.filter(pc.is_valid(table.column("sequence_id")))
        seq, gap = (free.column(c).to_numpy() for c in ("sequence_id", "gap"))
        length, tie, last = docs.column("length").to_numpy(), docs.column("__tie").to_numpy(), opened
        where, offset = np.full(len(length), -1, np.int64), np.zeros(len(length), np.int64)
        left = np.arange(len(length))
        while len(left):
            counts = np.bincount(length[left], minlength=capacity + 1)
            least, more, together = _opening(counts, np.bincount(gap, minlength=capacity + 1), capacity)
            seq, gap = seq[gap >= least], gap[gap >= least]
            seq, gap = np.append(seq, np.arange(last, last + more)), np.append(gap, np.full(more, capacity))
            last += more
            # largest first, gaps before documents of their size
            n = length[left]
            key = np.append(-gap, -n * together[n])
            order = np.lexsort((np.append(seq, tie[left]), np.append(np.zeros(len(gap), np.int64), n), np.arange(len(key)) >= len(gap), key))
            at = order - len(gap)
            sweep = _Sweep(together.tolist(), capacity)
            of_bin = [None if a >= 0 else q for a, q in zip(at.tolist(), np.append(seq, n)[order].tolist(), strict=True)]
            got = sweep.over(np.append(gap, n)[order].tolist(), of_bin, np.append(gap, n)[order].tolist())
            swept = left[at[at >= 0]]
            where[swept] = [-1 if g[0] is None else g[0] for g in got]
            offset[swept] = [0 if g[1] is None else g[1] for g in got]
            rest = sweep.shrunk(end=True) + sweep.stack
            seq, gap = (np.array(x, np.int64) for x in zip(*rest, strict=True))
            left = left[where[left] < 0]
        for lo in range(0, len(length), 10_000):
            part = docs.slice(lo, 10_000).combine_chunks()
            more = [pa.array(x[lo : lo + 10_000], pa.int64()) for x in (where, offset)]
            yield from pa.Table.from_arrays([*[part.column(c) for c in names], *more], names=[*names, "sequence_id", "offset"]).combine_chunks().to_batches()

    types = dict(rows.dtypes)
    return rows.coalesce(1).mapInArrow(run, ", ".join(f"`{n}` {types[n]}" for n in names) + ", sequence_id long, offset long")


def _swept(rows: DataFrame, names: list[str], together: np.ndarray, capacity: int) -> DataFrame:
    """One sweep of each range. Documents have sequence_id and offset, or else their unit's number among those that wait in the
    range (__at) and their place in the unit (__in). Gaps that shrank come with what is left of them; those that nobody took have
    their number from the bottom of the stack (__at)."""
    many = together.tolist()
    added = {"sequence_id": pa.int64(), "offset": pa.int64(), "gap": pa.int64(), "__part": pa.int32(), "__at": pa.int64(), "__in": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        sweep = _Sweep(many, capacity)
        kinds = None

        def gaps_of(some: list[tuple[int, int, int | None]]) -> pa.RecordBatch:
            seq, gap, at = zip(*some, strict=True)
            n = len(some)
            more = [pa.array(seq, pa.int64()), pa.nulls(n, pa.int64()), pa.array(gap, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(at, pa.int64()), pa.nulls(n, pa.int64())]
            return pa.RecordBatch.from_arrays([*[pa.nulls(n, kinds[c]) for c in names], *more], names=[*names, *added])

        for batch in batches:
            kinds = {n: batch.schema.field(n).type for n in names}
            out = sweep.over(*(batch.column(c).to_pylist() for c in ("length", "sequence_id", "gap")))
            docs = batch.filter(pc.is_null(batch.column("sequence_id")))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            more = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.nulls(len(out), pa.int64()), pa.array([part] * len(out), pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[docs.column(n) for n in names], *more], names=[*names, *added])
            if shrunk := sweep.shrunk():
                yield gaps_of([(q, g, None) for q, g in shrunk])
        if shrunk := sweep.shrunk(end=True):
            yield gaps_of([(q, g, None) for q, g in shrunk])
        for lo in range(0, len(sweep.stack), 10_000):
            yield gaps_of([(q, g, lo + i) for i, (q, g) in enumerate(sweep.stack[lo : lo + 10_000])])

    types = dict(rows.dtypes)
    schema = ", ".join(f"`{n}` {types[n]}" for n in names) + ", sequence_id long, offset long, gap long, __part int, __at long, __in long"
    return rows.mapInArrow(run, schema)


def _met(swept: DataFrame, names: list[str], capacity: int) -> DataFrame:
    """The waiting documents of a sweep with the gaps that other ranges have left: (names, sequence_id, offset, gap). Documents that
    still wait have no offset; gaps come with what is left of them."""
    waits = swept.filter("gap is null and offset is null")
    free = swept.filter("gap is not null and __at is not null")
    # one row for each range and side: what waits is taken from the stack, then what is free is put on it
    steps = waits.groupBy("__part").agg((-F.max("__at") - 1).alias("__n")).withColumn("__side", F.lit(0))
    steps = steps.unionByName(free.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__side", F.lit(1)))
    w = Window.orderBy("__part", "__side").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("__sum", F.sum("__n").over(w)).withColumn("__low", F.least(F.lit(0), F.min("__sum").over(w)))
    before = steps.withColumn("__top", F.coalesce(F.lag(F.col("__sum") - F.col("__low")).over(Window.orderBy("__part", "__side")), F.lit(0))).select("__part", "__side", "__top")
    height = lambda side: F.broadcast(before.filter(F.col("__side") == side).drop("__side"))
    took = waits.join(height(0), "__part").withColumn("__slot", F.col("__top") - 1 - F.col("__at"))
    gave = free.join(height(1), "__part").withColumn("__slot", F.col("__top") + F.col("__at"))
    both = took.filter("__slot >= 0").unionByName(gave)
    # in a slot a gap is followed by the documents of the unit that takes it, if any does
    slot = Window.partitionBy("__slot").orderBy("__part", F.col("gap").isNotNull(), "__in")
    both = both.withColumn("__turn", F.count("gap").over(slot)).withColumn("__gap", F.last("gap", True).over(slot)).withColumn("sequence_id", F.last("sequence_id", True).over(slot))
    both = both.withColumn("__taken", F.sum("length").over(Window.partitionBy("__slot", "__turn")))
    offset = F.when(F.col("gap").isNull(), capacity - F.col("__gap") + F.col("__in"))
    both = both.select(*names, "sequence_id", offset.alias("offset"), (F.col("gap") - F.coalesce("__taken", F.lit(0))).alias("gap"))
    return both.unionByName(took.filter("__slot < 0").select(*names, "sequence_id", "offset", "gap"))


def _histograms(capacity: int, **tables: DataFrame) -> dict[str, np.ndarray]:
    """Rows by the size in each table's last column; at most ``capacity`` sizes each, in one job."""
    out = {k: np.zeros(capacity + 1, np.int64) for k in tables}
    each = [d.groupBy(F.lit(k).alias("of"), F.col(d.columns[-1]).alias("size")).agg(F.count(F.lit(1)).alias("n")) for k, d in tables.items()]
    for r in reduce(DataFrame.unionByName, each).limit(len(tables) * (capacity + 1)).collect():
        out[r["of"]][r["size"]] = r["n"]
    return out


def place(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Append sequence_id and offset to a written table of pieces."""
    spark, names = table.sparkSession, table.columns
    left, counts = table, _histograms(capacity, left=table.select("length"))["left"]
    bins, gaps, opened, placed = None, np.zeros(capacity + 1, np.int64), 0, []
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    tie = F.xxhash64("doc_id", "piece", "ids_crc32").alias("__tie")
    while counts.any():
        if counts.sum() + gaps.sum() <= ALONE:
            rows = left.select(*names, null("sequence_id", "long"), null("gap", "long"), tie)
            if bins is not None:
                rows = rows.unionByName(bins.select(*[null(c, k) for c, k in table.dtypes], "sequence_id", "gap", null("__tie", "long")))
            placed.append(written(_finished(rows, names, opened, capacity), "finished"))
            break
        least, more, together = _opening(counts, gaps, capacity)
        if more:
            fresh = spark.range(opened, opened + more).select(F.col("id").alias("sequence_id"), F.lit(capacity).cast("long").alias("gap"))
            bins = fresh if bins is None else bins.unionByName(fresh)
            opened += more
        wide = F.broadcast(spark.createDataFrame([(int(n), int(n * together[n])) for n in np.flatnonzero(counts)], "length long, __wide long"))
        docs = left.join(wide, "length").select(*names, null("sequence_id", "long"), null("gap", "long"), (-F.col("__wide")).alias("__key"), tie)
        free = bins.filter(F.col("gap") >= least).select(*[null(c, k) for c, k in table.dtypes], "sequence_id", "gap", (-F.col("gap")).alias("__key"), F.col("sequence_id").alias("__tie"))
        order = ["__key", F.col("sequence_id").isNull(), "length", "__tie"]
        rows = free.unionByName(docs).repartitionByRange(n_parts(spark), *order)
        swept = written(_swept(rows.sortWithinPartitions(*order).select(*names, "sequence_id", "gap"), names, together, capacity), "swept")
        rest = written(_met(swept, names, capacity), "met")
        placed += [x.filter("offset is not null").select(*names, "sequence_id", "offset") for x in (swept, rest)]
        bins = swept.filter("gap is not null and __at is null").select("sequence_id", "gap").unionByName(rest.filter("gap is not null").select("sequence_id", "gap"))
        left = rest.filter("gap is null and offset is null").select(*names)
        found = _histograms(capacity, left=left.select("length"), bins=bins.select("gap"))
        counts, gaps = found["left"], found["bins"]
    if not placed:
        return table.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    return reduce(DataFrame.unionByName, placed)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    Null or empty text makes one piece of one id. Texts of any length are
    tokenized whole and cut. Repeated rows are packed each. An empty table
    gives an empty result. Other columns are ignored. Text is read once and
    never shuffled.
    """
    return place(written(pieces(docs, capacity, tokenizer), "pieces"), capacity)


def sequences(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, little-endian unsigned 32-bit ids."""
    table = written(pieces(docs, capacity, tokenizer, ids=True).withColumn("__row", F.monotonically_increasing_id()), "pieces")
    placed = place(table.drop("ids"), capacity).select("__row", "sequence_id", "offset").join(table.select("__row", "ids"), "__row")
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.expr("concat(unhex(''))").alias("__e"), parts.alias("__p")).select("sequence_id", F.aggregate(F.transform("__p", lambda p: p["ids"]), F.col("__e"), lambda a, b: F.concat(a, b)).alias("ids"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(docs_of(spark, sf_dir))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: where each piece of each remaining document goes."""
    return pack(docs)
