"""Operator 10, suffix-array dedup: repeated byte strings found by column-wise construction over many documents.

The collection of all suffixes cannot be built in one place, so it is first
split into parts in which equal strings always meet: the anchor of a string of
``SPAN`` bytes is its leftmost smallest ``ANCHOR``-byte substring by hash, so
equal strings have equal anchors at equal places. Strings whose anchor occurs
once in the corpus cannot repeat; the text around all other anchors goes to the
anchor's part. In a part, each anchored text is a document of the construction:
every round inserts one symbol (column) per document, outward from the anchor,
and updates the ranks of all texts by (rank so far, new symbol). Two texts keep
equal ranks for as long as their common prefix reaches. A string is the pair of
its left and its right rank; of equal strings all but the first are removed.
Columns are in memory: a part has a bounded size. Parts that grow beyond it, by
an anchor in very many contexts, are told apart by whole strings instead: their
strings are named by 128 bits, each name's first place is an aggregate that is
combined before the shuffle, and an equi-join finds the later ones.

The corpus-wide Burrows-Wheeler transform is not formed: inserting one symbol per
document takes as many passes over the corpus as the longest document has
bytes. The ranks of the columns within SPAN are the part of it that is needed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import docs_of, dropped, n_parts, written
from loomgraph.llm.textbytes import by_bucket, chunks, prefix_hashes, span_hashes

SPAN, ANCHOR = 100, 32
#: Bytes of text in a bucket of documents, anchors in a bucket of hashes, bytes of anchored text in a part (on average, at most).
TEXT, HASHES, PART, MOST = 3 << 20, 1 << 18, 1 << 20, 4 << 20
#: A longer text is looked at in pieces of so many bytes.
PIECE = 1 << 20
_POS = np.uint64(27)
_NULL = -(1 << 63)


def anchored(offsets: np.ndarray, data: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, anchor, anchor's hash) of every string of ``span`` bytes that lies within a row; places are in ``data``."""
    n, width = len(data), span - ANCHOR + 1
    none = np.empty(0, np.int64)
    size = np.diff(offsets)
    if not (size >= span).any():
        return none, none, np.empty(0, np.uint64)
    m = n - ANCHOR + 1
    at = np.arange(m)
    h = span_hashes(prefix_hashes(data), at, at + ANCHOR)
    key = np.full(-(-m // width) * width + width, np.iinfo(np.uint64).max)
    key[:m] = (h >> _POS << _POS) | at.astype(np.uint64)
    block = key.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    inside = np.zeros(n + 1, np.int8)
    ok = size >= span
    np.add.at(inside, offsets[:-1][ok], 1)
    np.add.at(inside, offsets[1:][ok] - span + 1, -1)
    start = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    anchor = (np.minimum(behind[start], ahead[start + width - 1]) & np.uint64((1 << int(_POS)) - 1)).astype(np.int64)
    return start, anchor, h[anchor]


def _pieces(column: pa.Array, span: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, first byte, offsets, bytes) of runs of rows; a long text comes in pieces that overlap by span - 1 bytes, so each string is in one."""
    for lo, hi, offsets, data in chunks(column):
        if hi - lo > 1 or len(data) <= PIECE:
            yield lo, 0, offsets, data
            continue
        for at in range(0, len(data) - span + 1, PIECE):
            part = data[at : at + PIECE + span - 1]
            yield lo, at, np.array([0, len(part)]), part


def _all(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


_HASH_NAMES = ("h", "g", "often", "known_h", "known_g")


def _anchor_hashes(docs: DataFrame, span: int, buckets: int) -> DataFrame:
    """Distinct (anchor hash, document bucket), packed by hash. What is already repeated in a block of documents
    is reported at once, and only one entry of it goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column("db").to_numpy(zero_copy_only=False)
            hs, gs = [], []
            for lo, _, offsets, data in _pieces(batch.column("text"), span):
                start, anchor, h = anchored(offsets, data, span)
                if not len(start):
                    continue
                new = np.ones(len(anchor), bool)
                new[1:] = anchor[1:] != anchor[:-1]
                row = np.searchsorted(offsets, anchor[new], "right") - 1
                hs.append(h[new])
                gs.append(group[lo + row])
            if not hs:
                continue
            h, g = np.concatenate(hs), np.concatenate(gs).astype(np.uint32)
            order = np.lexsort((g, h))
            h, g = h[order], g[order]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            size = np.diff(np.append(np.flatnonzero(first), len(h)))
            often = np.repeat(size > 1, size)
            pair = first.copy()
            pair[1:] |= g[1:] != g[:-1]
            known = often & pair
            keep = first  # one entry of each hash; those known to repeat are marked
            for at, cols, names in ((h[keep], (h[keep], g[keep], often[keep]), _HASH_NAMES[:3]), (h[known], (h[known], g[known]), _HASH_NAMES[3:])):
                there, packed = by_bucket((at % np.uint64(buckets)).astype(np.int64), *cols)
                if len(there):
                    given = dict(zip(names, packed, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), *[pa.array(given.get(n, [b""] * len(there)), pa.binary()) for n in _HASH_NAMES]], names=["bucket", *_HASH_NAMES])

    return docs.select("db", "text").mapInArrow(run, "bucket int, " + ", ".join(f"{n} binary" for n in _HASH_NAMES))


def _shared(table: pa.Table) -> pa.Table:
    """Hashes that occur twice at least, packed by document bucket."""
    h, g, often = _all(table.column("h"), np.uint64), _all(table.column("g"), np.uint32), _all(table.column("often"), bool)
    _, which, n = np.unique(h, return_inverse=True, return_counts=True)
    many = np.bincount(which, weights=often, minlength=len(n)) > 0
    tell = ((n > 1) | many)[which]
    h = np.concatenate([h[tell], _all(table.column("known_h"), np.uint64)])
    g = np.concatenate([g[tell], _all(table.column("known_g"), np.uint32)]).astype(np.int64)
    there, (packed,) = by_bucket(g, h)
    return pa.table({"db": pa.array(there, pa.int32()), "h": pa.array(packed, pa.binary()), "n": pa.array([len(x) // 8 for x in packed], pa.int64())})


def _runs(start: np.ndarray, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of stretches of consecutive starts in one row with one anchor hash."""
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1] + 1) | (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(start)) - 1


_TEXTS = "part int, db int, bytes long, doc binary, text binary, start binary, size binary, data binary, gone binary"


def _anchored_texts(span: int, parts: int):
    """Text around repeated anchors, packed by part. In a bucket of documents equal stretches go on once;
    the later ones are removed right away."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shared = np.unique(_all(right.column("h"), np.uint64))
        doc, mark_ = (left.column(c).to_numpy().astype(np.int64) for c in ("doc", "th"))
        found: list[tuple[np.ndarray, ...]] = []
        if len(shared) and left.num_rows:
            for lo, from_, offsets, data in _pieces(left.column("text"), span):
                start, anchor, h = anchored(offsets, data, span)
                if not len(start):
                    continue
                spot = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
                use = shared[spot] == h
                start, h = start[use], h[use]
                if not len(start):
                    continue
                row = np.searchsorted(offsets, start, "right") - 1
                a, b = _runs(start, h, row)
                begin, end = start[a], start[b] + span
                mark = span_hashes(prefix_hashes(data), begin, end)
                size = end - begin
                take = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
                found.append((doc[lo + row[a]], mark_[lo + row[a]], from_ + begin - offsets[row[a]], size, h[a], mark, data[take]))
        names = ["part", "db", "bytes", "doc", "text", "start", "size", "data", "gone"]
        kinds = [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 6
        if not found:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds, strict=True)})
        d, x, s, size, h, mark, data = (np.concatenate(c) for c in zip(*found, strict=True))
        at = np.cumsum(size) - size
        order = np.lexsort((s, x, d, size, mark))
        same = np.zeros(len(order), bool)
        same[1:] = (mark[order][1:] == mark[order][:-1]) & (size[order][1:] == size[order][:-1])
        lead = order[np.maximum.accumulate(np.where(~same, np.arange(len(order)), 0))]
        later = order[same & ((d[order] != d[lead]) | (x[order] != x[lead]) | (s[order] != s[lead]))]
        gone = np.stack([d[later], x[later], s[later], s[later] + size[later]], 1).astype(np.int64)
        keep = np.sort(order[~same])
        d, x, s, size, h, at = d[keep], x[keep], s[keep], size[keep], h[keep], at[keep]
        part = (h % np.uint64(parts)).astype(np.int64)
        o = np.argsort(part, kind="stable")
        there, first = np.unique(part[o], return_index=True)
        edge = np.append(first, len(o))
        rows = []
        db = int(left.column("db")[0].as_py())
        for p, lo, hi in zip(there.tolist(), edge[:-1], edge[1:], strict=True):
            i = o[lo:hi]
            raw = b"".join(data[y : y + z].tobytes() for y, z in zip(at[i].tolist(), size[i].tolist(), strict=True))
            rows.append((p, db, len(raw), d[i].tobytes(), x[i].tobytes(), s[i].tobytes(), size[i].tobytes(), raw, b""))
        if len(gone):
            rows.append((db % parts, db, 0, b"", b"", b"", b"", b"", gone.tobytes()))
        return pa.table({n: pa.array([r[k] for r in rows], kind) for k, (n, kind) in enumerate(zip(names, kinds, strict=True))})

    return run


def _refined(rank: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New dense ranks by (rank, symbol), and whether another text has the same."""
    _, new, n = np.unique(rank * 256 + symbol, return_inverse=True, return_counts=True)
    return new, n[new] > 1


def repeats(offsets: np.ndarray, data: np.ndarray, doc: np.ndarray, begin: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Starts (places in ``data``) of strings of ``span`` bytes that start earlier too.

    Row i of the collection is a stretch of document doc[i] from its byte
    begin[i]; equal strings must all be in the collection.
    """
    found, lo = [], 0
    while lo < len(doc):  # rows of about PIECE / 4 bytes at once
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE // 4, "right")) - 1)
        at, a, _ = anchored(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]], span)
        found.append((at + offsets[lo], a + offsets[lo]))
        lo = hi
    start, anchor = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(start):
        return start
    reach = span - ANCHOR
    row = np.searchsorted(offsets, start, "right") - 1
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    a, row = anchor[first], row[first]
    left, least = a - start[first], a - start[last]  # columns to the left: at most, at least
    right = reach - least
    m = len(a)
    # rank by the anchor itself
    eight = [np.ascontiguousarray(data[a[:, None] + np.arange(8 * k, 8 * k + 8)]).view(np.uint64).ravel() for k in range(ANCHOR // 8)]
    order = np.lexsort(eight)
    step = np.zeros(m, np.int64)
    step[1:] = np.any([e[order][1:] != e[order][:-1] for e in eight], axis=0)
    rank = np.empty(m, np.int64)
    rank[order] = np.cumsum(step)
    some = np.bincount(rank)[rank] > 1
    ranks = []
    for columns, most in ((lambda i, k: data[a[i] - k], left), (lambda i, k: data[a[i] + ANCHOR + k - 1], right)):
        by_column = np.full((reach + 1, m), -1, np.int32)
        now = rank.copy()
        live = np.flatnonzero(some)
        by_column[0, live] = now[live]
        for k in range(1, reach + 1):
            live = live[most[live] >= k]
            if not len(live):
                break
            r, twice = _refined(now[live], columns(live, k))
            live, r = live[twice], r[twice]
            now[live] = r
            by_column[k, live] = r
        ranks.append(by_column)
    out = []
    for k in range(reach + 1):
        one, two = ranks[0][k], ranks[1][reach - k]
        i = np.flatnonzero((one >= 0) & (two >= 0) & (k <= left) & (k >= least))
        if len(i) < 2:
            continue
        key = one[i].astype(np.int64) * m + two[i]
        d, s = doc[row[i]], begin[row[i]] + a[i] - k - offsets[row[i]]
        o = np.lexsort((s, d, key))
        head = np.ones(len(o), bool)
        head[1:] = key[o][1:] != key[o][:-1]
        lead = o[np.maximum.accumulate(np.where(head, np.arange(len(o)), 0))]
        out.append(a[i[o[(d[o] != d[lead]) | (s[o] != s[lead])]]] - k)
    return np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)


def _ids(doc: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Numbers in the order of (doc, text hash); equal pairs have equal ones."""
    return np.unique(np.stack([doc, text], 1), axis=0, return_inverse=True)[1].ravel()


def _found(span: int):
    """Byte ranges to remove, packed by document bucket."""

    def run(table: pa.Table) -> pa.Table:
        rows: list[tuple[int, bytes]] = []
        db = table.column("db").to_numpy().astype(np.int64)
        gone = table.column("gone").to_pylist()
        rows += [(int(b), g) for b, g in zip(db, gone, strict=True) if g]
        raw = [table.column(c).to_pylist() for c in ("doc", "text", "start", "size", "data")]
        doc, text, begin, size = (np.frombuffer(b"".join(r), np.int64) for r in raw[:4])
        data = np.frombuffer(b"".join(raw[4]), np.uint8)
        where = np.repeat(db, [len(x) // 8 for x in raw[0]])
        if len(doc):
            offsets = np.concatenate([[0], np.cumsum(size)])
            at = repeats(offsets, data, _ids(doc, text), begin, span)
            if len(at):
                row = np.searchsorted(offsets, at, "right") - 1
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
                i = np.flatnonzero(new)
                j = np.append(i[1:], len(at)) - 1
                r = row[i]
                span_ = np.stack([doc[r], text[r], begin[r] + at[i] - offsets[r], begin[r] + at[j] - offsets[r] + span], 1).astype(np.int64)
                for b in np.unique(where[r]):
                    rows.append((int(b), span_[where[r] == b].tobytes()))
        return pa.table({"db": pa.array([r[0] for r in rows], pa.int32()), "gone": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _by_strings(texts: DataFrame, span: int) -> DataFrame:
    """Byte ranges to remove (db, gone), from the names of all strings of anchored texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            db = batch.column("db").to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                doc, text, start, size = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("doc", "text", "start", "size"))
                data = np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8)
                many = size - span + 1
                at = np.repeat(np.cumsum(size) - size - np.cumsum(many) + many, many) + np.arange(many.sum())
                prefix = prefix_hashes(data)
                one = span_hashes(prefix, at, at + span)
                two = span_hashes(prefix, at, at + span // 2) * np.uint64(0x9E3779B97F4A7C15) + span_hashes(prefix, at + span // 2, at + span)
                inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                cols = [np.full(len(at), db[i], np.int32), np.repeat(doc, many), np.repeat(text, many), np.repeat(start, many) + inside, one.view(np.int64), two.view(np.int64)]
                for lo in range(0, len(at), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 100_000]) for c in cols], names=["db", "doc", "text", "start", "one", "two"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            db, doc, text, start = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("db", "doc", "text", "start"))
            there, (gone,) = by_bucket(db.astype(np.int64), np.stack([doc, text, start, start + span]).astype(np.int64))
            gone = [np.frombuffer(g, np.int64).reshape(4, -1).T.tobytes() for g in gone]
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(gone, pa.binary())], names=["db", "gone"])

    strings = written(texts.filter("bytes > 0").mapInArrow(run, "db int, doc long, text long, start long, one long, two long"), "strings")
    place = F.struct("doc", "text", "start")
    first = strings.groupBy("one", "two").agg(F.min(place).alias("__first"), F.max(place).alias("__last")).filter("__first != __last").drop("__last")
    later = strings.join(first, ["one", "two"]).filter(place != F.col("__first")).select("db", "doc", "text", "start")
    return later.mapInArrow(packed, "db int, gone binary")


def _covered(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, offsets, bytes, whether removed) of runs of rows of ``left``."""
    gone = _all(right.column("gone"), np.int64).reshape(-1, 4)
    doc, text = (left.column(c).to_numpy().astype(np.int64) for c in ("doc", "th"))
    ids = _ids(np.concatenate([doc, gone[:, 0]]), np.concatenate([text, gone[:, 1]]))
    doc, of = ids[: len(doc)], ids[len(doc) :]
    order = np.argsort(of, kind="stable")
    of, gone = of[order], gone[order]
    for lo, hi, offsets, data in chunks(left.column("text")):
        edge = np.zeros(len(data) + 1, np.int32)
        for i in range(lo, hi):
            a, b = np.searchsorted(of, doc[i], "left"), np.searchsorted(of, doc[i], "right")
            if a < b:
                np.add.at(edge, offsets[i - lo] + gone[a:b, 2], 1)
                np.add.at(edge, offsets[i - lo] + gone[a:b, 3], -1)
        yield lo, hi, offsets, data, np.cumsum(edge[:-1]) > 0


def _ranges(docs: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their bucket (__db), doc_id (__doc, null as the smallest) and text hash (__th), and the ranges to remove by bucket."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(n_parts(spark), math.ceil(size / TEXT))
    d = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL))).withColumn("__th", F.xxhash64("text"))
    d = d.withColumn("__db", F.pmod(F.xxhash64("__doc", "__th"), F.lit(groups)).cast("int"))
    buckets = max(n_parts(spark), math.ceil(size / 35 / HASHES))
    long_ = d.filter(F.octet_length("text") >= span).select(F.col("__db").alias("db"), F.col("__doc").alias("doc"), F.col("__th").alias("th"), "text")
    shared = written(_anchor_hashes(long_, span, buckets).groupBy("bucket").applyInArrow(_shared, "db int, h binary, n long"), "shared")
    total = shared.agg(F.sum("n")).first()[0] or 0
    parts = max(n_parts(spark), math.ceil(total * 140 / PART))
    texts = written(long_.groupBy("db").cogroup(shared.groupBy("db")).applyInArrow(_anchored_texts(span, parts), _TEXTS), "stretches")
    over = written(texts.groupBy("part").agg(F.sum("bytes").alias("__b")).filter(F.col("__b") > MOST).select("part"), "over", narrow=True)
    if over.isEmpty():
        gone = written(texts.groupBy("part").applyInArrow(_found(span), "db int, gone binary"), "ranges")
    else:
        rest = texts.join(over.withColumn("__over", F.lit(True)), "part", "left")
        same = rest.filter("__over is null or bytes = 0").drop("__over").groupBy("part").applyInArrow(_found(span), "db int, gone binary")
        gone = written(same.unionByName(_by_strings(rest.filter("__over").drop("__over"), span)), "ranges")
    dropped(shared, texts, over)
    return d, gone


def removed(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document.

    A byte goes if a string of ``span`` bytes around it also starts earlier: in
    a smaller doc_id, or in the same document; null counts as the smallest
    doc_id, null text as empty. Rows that repeat a doc_id and its text are one
    document as far as order goes, so a string at the same place of both stays;
    rows of one doc_id with different texts are documents in an order of their
    own. Overlaps count; strings never cross documents. Texts may have any
    length. An empty table gives an empty result; other columns are ignored.
    """
    d, gone = _ranges(docs, span)
    short = F.coalesce(F.octet_length("text"), F.lit(0)) < span
    zero = lambda c: F.lit(0).cast("long").alias(c)
    text = F.coalesce("text", F.lit(""))
    few = d.filter(short).select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), zero("n_removed"), zero("n_spans"), F.sha2(text, 256).alias("kept_sha256"))
    t = d.filter(~short).select(F.col("__db").alias("db"), "doc_id", F.col("__doc").alias("doc"), F.col("__th").alias("th"), "text")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for _, _, offsets, data, cut in _covered(left, right):
            rows = len(offsets) - 1
            total = np.concatenate([[0], np.cumsum(cut)])
            begin = cut.copy()
            begin[1:] &= ~cut[:-1]
            inner = offsets[:-1][offsets[:-1] < len(data)]
            begin[inner] = cut[inner]
            starts = np.concatenate([[0], np.cumsum(begin)])
            kept = data[~cut].tobytes()
            at = offsets - total[offsets]
            for i in range(rows):
                out.append((int(offsets[i + 1] - offsets[i]), int(total[offsets[i + 1]] - total[offsets[i]]), int(starts[offsets[i + 1]] - starts[offsets[i]]), hashlib.sha256(kept[at[i] : at[i + 1]]).hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        return pa.table({"doc_id": left.column("doc_id").cast(pa.int64()), **{n: pa.array(c, pa.int64()) for n, c in zip(("n_bytes", "n_removed", "n_spans"), cols[:3], strict=True)}, "kept_sha256": pa.array(cols[3], pa.string())})

    cut = t.groupBy("db").cogroup(gone.groupBy("db")).applyInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return cut.unionByName(few)


def deduplicated(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``docs`` with repeated strings cut out of the text: characters all of whose bytes go. ``n_chars``, if there, is set anew."""
    d, gone = _ranges(docs, span)
    names = docs.columns
    short = F.coalesce(F.octet_length("text"), F.lit(0)) < span
    kind = dict(docs.dtypes)
    few = d.filter(short).select(*[F.length("text").cast(kind[c]).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in names])
    t = d.filter(~short).select(F.col("__db").alias("db"), F.col("__doc").alias("doc"), F.col("__th").alias("th"), F.col("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != "text"])
    schema = docs.select(*[F.col(f"`{c}`") for c in names]).schema

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts: list[str | None] = []
        null = left.column("text").is_null().to_pylist()
        for lo, _, offsets, data, cut in _covered(left, right):
            if cut.any():
                first = np.flatnonzero((data & 0xC0) != 0x80)
                whole = np.minimum.reduceat(cut, first)
                cut = np.repeat(whole, np.diff(np.append(first, len(data))))
            kept, at = data[~cut].tobytes(), offsets - np.concatenate([[0], np.cumsum(cut)])[offsets]
            texts += [None if null[lo + i] else kept[a:b].decode("utf-8", "replace") for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]
        cols = []
        for i, c in enumerate(names):
            if c == "text":
                cols.append(pa.array(texts, pa.string()))
            elif c == "n_chars":
                cols.append(pa.array([None if x is None else len(x) for x in texts], left.column(f"c{i}").type))
            else:
                cols.append(left.column(f"c{i}"))
        return pa.table(cols, names=names)

    return t.groupBy("db").cogroup(gone.groupBy("db")).applyInArrow(run, schema).union(few)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(docs_of(spark, sf_dir))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes and more that an earlier document (or place) has are cut out; every document stays."""
    return deduplicated(docs)
