"""Operator 7, n-gram Jaccard join: parity sketches, pigeonhole-joined per size band, then verified.

A document's set of shingle hashes is XORed into a bit sketch of k words: each
shingle toggles one bit of one word, so the Hamming distance of two sketches is
at most the symmetric difference of the sets. Sets that link differ in at most d
shingles (d follows from the sizes), so at least k - d words are equal. Documents
meet when a word is equal. Words are wide and sparse (2 ** 64 positions) and are
held as the XOR of their positions' codes. Dense sketches, first of 1,024 bits and
then of about four bits a shingle, discard pairs whose distance is over the
bound; what is left is verified on the texts.

Equal sets are one class from the start, so copies cost nothing. Where many
documents share a word, they meet its smallest member first; those that are not
connected by then are tied into clusters and compared in blocks of bounded size,
sketch against sketch, nearest first. A block verifies what it compares and gives
a forest of links, so no group is written out as its pairs and no link is lost.
Groups that links have connected by then are not gathered again. More than
``WAVE`` shingles go in waves of words, which bounds what is on disk at once.
Documents that link share k - d words, not just one: each may leave out its
k - d - 1 most common words, and the rarest word that both have is still there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import components, docs_of, dropped, n_parts, written
from loomgraph.llm.textbytes import by_bucket, chunks, distinct, mix, shingles, words

#: Members of one equal word that are paired all with all; larger groups meet their smallest member.
SMALL = 8
#: Longs of the dense sketch; sketch words in a bucket of the join, and in a block of documents that is looked at before.
LONGS, BUCKET, BLOCK = 16, 200_000, 300_000
#: Shingles of all documents above which their words meet in so many waves, one after the other: a wave's words alone are on disk at once.
WAVE, WAVES = 20_000_000, 2
#: Bit of a code: its document stands for a group that is large in its task. The bits below hold the rest of the code.
STANDS = 128
#: A band spans this many steps of the similarity.
STEPS = 2

_ROW = [f"s{i}" for i in range(LONGS)]


class Bands:
    """Size bands for similarity num / den: any two sizes that can link are in one band or in neighbours."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        low = [1]
        while low[-1] < 1 << 40:
            low.append(low[-1] * den**STEPS // num**STEPS + 1)
        self.low = np.array(low)
        self.differ = 2 * (self.low[1:] - 1) * (den - num) // (den + num)
        self.spare = np.where(self.differ > 0, 2 + (0.8 * np.sqrt(self.differ) + 0.12 * self.differ).astype(np.int64), 0)
        self.words = self.differ + 1 + self.spare

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, "right") - 1


def _sets(offsets: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    row, _, _, h = words(offsets, data)
    return distinct(*shingles(row, h, len(offsets) - 1, k))


def _marks(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    one, two = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    np.bitwise_xor.at(one, row, mix(h ^ np.uint64(0xA5A5F00D12345677)))
    np.add.at(two, row, mix(h + np.uint64(0x51ED270B7F4A7C15)))
    return one, two


def _fine(row: np.ndarray, h: np.ndarray, rows: int) -> pa.Array:
    """Parity sketches whose size follows the set: the power of two of 4 to 8 bits a shingle; none for sets that the other sketch serves well.

    A larger sketch folds onto a smaller one, so any two compare.
    """
    n = np.bincount(row, minlength=rows)
    size = np.where(n > 256, 1 << np.minimum(np.ceil(np.log2(np.maximum(n, 1) * 4)).astype(np.int64), 22), 0) >> 6
    first = np.concatenate([[0], np.cumsum(size)])
    use = size[row] > 0
    r = row[use]
    bit = mix(h[use]) & ((size[r] << 6) - 1).astype(np.uint64)
    words_ = np.zeros(first[-1], np.uint64)
    np.bitwise_xor.at(words_, first[r] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return pa.array([words_[a:b].tobytes() if b > a else None for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())


def _near(pairs: DataFrame, table: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the (u, v) pairs whose fine sketches do not prove that they are too far apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_u").to_numpy() + batch.column("n_v").to_numpy()
            keep = np.ones(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("fine_u"), batch.column("fine_v"), strict=True)):
                if x.is_valid and y.is_valid:
                    a, b = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                    m = min(len(a), len(b))
                    a, b = (np.bitwise_xor.reduce(z.reshape(-1, m), axis=0) for z in (a, b))
                    keep[i] = int(np.bitwise_count(a ^ b).sum()) * (den + num) <= n[i] * (den - num)
            yield batch.filter(pa.array(keep)).select(["u", "v"])

    side = lambda x: table.filter("n > 0").select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("fine").alias(f"fine_{x}"))
    p = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "n_u", "n_v", "fine_u", "fine_v")
    return p.mapInArrow(run, "u long, v long").distinct()


def described(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, f1, f2, dense sketch) of every document; f1 and f2 tell sets apart, whatever the order of words."""
    schema = "doc_id long, n long, f1 long, f2 long, " + ", ".join(f"{s} long" for s in _ROW) + ", fine binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offsets, data in chunks(batch.column("text")):
                row, h = _sets(offsets, data, k)
                f1, f2 = _marks(row, h, hi - lo)
                dense = np.zeros((hi - lo, LONGS), np.uint64)
                bit = h % np.uint64(64 * LONGS)
                np.bitwise_xor.at(dense, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
                out = [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.bincount(row, minlength=hi - lo), pa.int64())]
                out += [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (f1, f2, *dense.T)]
                out.append(_fine(row, h, hi - lo))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n", "f1", "f2", *_ROW, "fine"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _sketch_words(row: np.ndarray, h: np.ndarray, rows: int, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, code) of the sketch words by which documents meet, in their own band and, if a link can reach it, the next.

    The lowest bit of a code says that the band is the document's own; the others, how many of these words any document
    that links has too, at least (63 if more).
    """
    n = np.bincount(row, minlength=rows)
    own = bands.of(np.maximum(n, 1))
    out = []
    token = mix(h ^ np.uint64(0x3C6EF372FE94F82B))
    spot = mix(h ^ np.uint64(0x1F83D9ABFB41BD6B)) >> np.uint64(20)
    for home, band in ((1, own), (0, own + 1)):
        k, d = bands.words[band], bands.differ[band]
        use = (n > 0) & (d > 0)
        if not home:
            use &= n * bands.den >= bands.low[band] * bands.num
        k = np.where(use, k, 0)
        first = np.concatenate([[0], np.cumsum(k)])
        mine = use[row]
        r = row[mine]
        slot = first[r] + (spot[mine] % k[r].astype(np.uint64)).astype(np.int64)
        word, filled = np.zeros(first[-1], np.uint64), np.zeros(first[-1], bool)
        np.bitwise_xor.at(word, slot, token[mine])
        filled[slot] = True
        who = np.repeat(np.arange(rows), k)
        part = np.arange(first[-1]) - first[who]
        # empty words say little: they are used only by documents that have so many that no other word may agree
        empty = np.bincount(who[~filled], minlength=rows)
        most = empty >= k - d
        keep = filled | most[who]
        # a document that uses its empty words may meet one that does not: nothing but one word is certain then
        shared = np.minimum(np.where(most, 1, k - d - empty), 63)
        who, part, word = who[keep], part[keep], word[keep]
        key = mix(word + mix((band[who] * 1_000_003 + part).astype(np.uint64)))
        out.append((who, key, (shared[who] * 2 + home).astype(np.uint8)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _groups(key: np.ndarray, ident: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct (key, ident) with code, and where each key's run begins; members at home come first."""
    order = np.lexsort((code < STANDS, ident, ~code & 1, key))
    key, ident, code = key[order], ident[order], code[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])
    key, ident, code = key[new], ident[new], code[new]
    start = np.ones(len(key), bool)
    start[1:] = key[1:] != key[:-1]
    return key, ident, code, np.flatnonzero(start)


def _members(key: np.ndarray, ident: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.stack([key, ident, (code & (STANDS - 1)).astype(np.uint64)])


def _met(key: np.ndarray, ident: np.ndarray, code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs 2 x m, and 3 x m (key, member, code) of large groups; a group with a member that stands for others is large."""
    size = np.diff(np.concatenate([at, [len(key)]]))
    stands = np.logical_or.reduceat(code >= STANDS, at) if len(at) else np.zeros(0, bool)
    large = (size > SMALL) | stands
    home = (code & 1).astype(bool)
    pairs, members = [np.empty((2, 0), np.uint64)], [np.empty((3, 0), np.uint64)]
    for c in np.unique(size[(size > 1) & ~large]):
        first = at[(size == c) & ~large]
        i, j = np.triu_indices(c, 1)
        a, b = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
        ok = home[a] | home[b]
        pairs.append(np.stack([ident[a[ok]], ident[b[ok]]]))
    if large.any():
        of = np.repeat(np.arange(len(at)), size)
        m = np.flatnonzero(large[of])
        lead = at[of[m]]
        ok = home[lead] & (lead != m)
        pairs.append(np.stack([ident[lead[ok]], ident[m[ok]]]))
        members.append(_members(key[m], ident[m], code[m]))
    return np.concatenate(pairs, 1), np.concatenate(members, 1)


_FAT_NAMES = ("keys", "ids", "codes", "pairs", "large")
_FAT = "bucket int, " + ", ".join(f"{n} binary" for n in _FAT_NAMES)


class _Hot:
    """The keys of a task's large groups, each with the member that went on for it, and whether that one is at home."""

    def __init__(self):
        self.key, self.lead, self.home = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool)

    def add(self, key: np.ndarray, lead: np.ndarray, home: np.ndarray) -> None:
        at = np.searchsorted(self.key, key)
        self.key, self.lead, self.home = np.insert(self.key, at, key), np.insert(self.lead, at, lead), np.insert(self.home, at, home)

    def split(self, key: np.ndarray, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows are of a known group, and the pairs of those with its first member."""
        if not len(self.key):
            return np.zeros(len(key), bool), np.empty((2, 0), np.uint64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        seen = self.key[at] == key
        use = seen & self.home[at] & (self.lead[at] != ident)
        return seen, np.stack([self.lead[at[use]], ident[use]])


def _emit(docs: DataFrame, k: int, bands: Bands, buckets: int, wave: int = 0, waves: int = 1) -> DataFrame:
    """Sketch words of one wave packed by bucket; a word is of one wave with all its documents. Blocks of documents are looked at before: equal sets count once, and a group that is
    large in one meets there. One member of it goes on for the whole task, marked, so what a word's bucket gets does not
    follow the group; the members are dealt evenly over all buckets."""

    def packed(found: list[tuple[np.ndarray, ...]], hot: _Hot) -> Iterator[pa.RecordBatch]:
        key, ident, code, _ = _groups(*[np.concatenate(x) for x in zip(*found, strict=True)])
        seen, late = hot.split(key, ident)
        members = _members(key[seen], ident[seen], code[seen])
        key, ident, code = key[~seen], ident[~seen], code[~seen]
        first = np.append(True, key[1:] != key[:-1])[: len(key)]
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(key)))
        big = np.repeat(size > SMALL, size)
        pairs, large = _met(key[big], ident[big], code[big], np.flatnonzero(first[big]))
        hot.add(key[big & first], ident[big & first], (code[big & first] & 1).astype(bool))
        code = np.where(big, code | STANDS, code).astype(np.uint8)
        keep = ~big | first
        key, ident, code = key[keep], ident[keep], code[keep]
        pairs, large = np.concatenate([pairs, late], 1), np.concatenate([large, members], 1)
        even = mix(large[0] ^ mix(large[1]))
        for at_, cols, names in ((key, (key, ident, code), ("keys", "ids", "codes")), (pairs[0] ^ pairs[1], (pairs,), ("pairs",)), (even, (large,), ("large",))):
            there, values = by_bucket((at_ % np.uint64(buckets)).astype(np.int64), *cols)
            if len(there):
                given = dict(zip(names, values, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), *[pa.array(given.get(n, [b""] * len(there)), pa.binary()) for n in _FAT_NAMES]], names=["bucket", *_FAT_NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, hot = [], 0, _Hot()
        for batch in batches:
            for lo, hi, offsets, data in chunks(batch.column("text")):
                row, h = _sets(offsets, data, k)
                if not len(row):
                    continue
                ident, _ = _marks(row, h, hi - lo)
                who, key, code = _sketch_words(row, h, hi - lo, bands)
                if waves > 1:
                    mine = (key >> np.uint64(40)) % np.uint64(waves) == wave
                    who, key, code = who[mine], key[mine], code[mine]
                found.append((key, ident[who], code))
                held += len(key)
                if held > BLOCK:
                    yield from packed(found, hot)
                    found, held = [], 0
        if held:
            yield from packed(found, hot)

    return docs.select("text").mapInArrow(run, _FAT)


def _joined(b: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(b.to_pylist()), dtype)


def _meet(table: pa.Table) -> pa.Table:
    stacked = lambda c, n: np.concatenate([np.frombuffer(x, np.uint64).reshape(n, -1) for x in table.column(c).to_pylist()], 1)
    early, before = stacked("pairs", 2), stacked("large", 3)
    key, ident, code, at = _groups(_joined(table.column("keys"), np.uint64), _joined(table.column("ids"), np.uint64), _joined(table.column("codes"), np.uint8))
    pairs, large = _met(key, ident, code, at)
    pairs, large = np.concatenate([pairs, early], 1), np.concatenate([large, before], 1)
    pairs = pairs[:, pairs[0] != pairs[1]]
    pairs = np.unique(np.sort(pairs, 0), axis=1) if pairs.size else pairs
    kind = np.repeat([False, True], [pairs.shape[1], large.shape[1]])
    a, b = (np.concatenate([pairs[i], large[i]]).view(np.int64) for i in (0, 1))
    return pa.table({"large": pa.array(kind), "a": pa.array(a), "b": pa.array(b), "code": pa.array(np.concatenate([np.zeros(pairs.shape[1]), large[2]]), pa.int32(), safe=False)})


#: Partners that one copy of a text meets, about.
MEET = 500


def _verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of the (u, v) pairs that link, by the sets of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                b = batch.slice(lo, 100)
                sides = []
                for c in ("ta", "tb"):
                    r, h = [], []
                    for x, y, offsets, data in chunks(b.column(c)):
                        row, hash_ = _sets(offsets, data, k)
                        r.append(row + x)
                        h.append(hash_)
                    sides.append((np.concatenate(r), np.concatenate(h)))
                row, h = (np.concatenate(x) for x in zip(*sides, strict=True))
                order = np.lexsort((h, row))
                same = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1])
                both = np.bincount(row[order][1:][same], minlength=b.num_rows)
                total = np.bincount(row, minlength=b.num_rows) - both
                yield b.filter(pa.array((den * both >= num * total) & (both > 0))).select(["u", "v"])

    t = texts.select(F.col("doc_id").alias("__d"), "text")
    # the first of a large group meets all its members: its text goes to as many places as they need
    places = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / MEET).alias("__places"))
    p = pairs.join(places, "u").withColumn("__place", F.pmod(F.xxhash64("v"), F.col("__places"))).drop("__places")
    ta = t.join(places, F.col("__d") == F.col("u")).select("u", F.col("text").alias("ta"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__places") - 1)).alias("__place"))
    p = p.join(t.select(F.col("__d").alias("v"), F.col("text").alias("tb")), "v").join(ta, ["u", "__place"])
    return p.select("u", "v", "ta", "tb").mapInArrow(run, "u long, v long").distinct()


#: Bytes of shingle sets and rows of one side of a task that compares members of a large group; rows compared with all at once.
SIDE, ROWS, STRIP = 1 << 23, 4096, 64


def _width(n: np.ndarray) -> np.ndarray:
    """Longs of a set's own sketch in a group: a power of two of 8 to 16 bits a shingle, 1,024 bits at least."""
    return 1 << np.ceil(np.log2(np.clip(np.maximum(n, 1) * 8, 1024, 1 << 22))).astype(np.int64) >> 6


def _parity(sets: list[np.ndarray], width: int) -> np.ndarray:
    """Parity sketches of ``width`` longs; narrower ones are foldings of wider ones."""
    out = np.zeros((len(sets), width), np.uint64)
    h = mix(np.concatenate(sets))
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bit = h & np.uint64(64 * width - 1)
    np.bitwise_xor.at(out, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


def _forest(ids: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect members of one group which were apart: at most one fewer than members.

    Row i meets row j if ``left[i]`` and ``right[j]``; both lists cover what has to be compared. Pairs are ordered by the
    Hamming distance of their sketches, those beyond the bound or connected by then are skipped, and the rest is verified.
    """
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    ids, left, right, n, sets = ids[order], left[order], right[order], n[order], [sets[i] for i in order]
    _, root = np.unique(comp[order], return_inverse=True)
    wide, cache, links = _width(n), {}, []
    rows, cols = np.flatnonzero(left), np.flatnonzero(right)
    for s in range(0, len(rows), STRIP):
        a = rows[s : s + STRIP]
        lo, hi = np.searchsorted(n[cols], (n[a[0]] * num + den - 1) // den), np.searchsorted(n[cols], n[a[-1]] * den // num, "right")
        b = cols[lo:hi]
        if not len(b) or root[a].min() == root[a].max() == root[b].min() == root[b].max():
            continue
        w = int(min(wide[a[0]], wide[b[0]]))
        if w not in cache:
            cache.clear()
            cache[w] = _parity(sets, w)
        sketch, far = cache[w], np.zeros((len(a), len(b)), np.int32)
        at, bt = np.ascontiguousarray(sketch[a].T), np.ascontiguousarray(sketch[b].T)
        for x, y in zip(at, bt, strict=True):
            far += np.bitwise_count(x[:, None] ^ y[None, :])
        both = n[a][:, None] + n[b][None, :]
        near = (far * (den + num) <= both * (den - num)) & (root[a][:, None] != root[b][None, :])
        twice = right[a][:, None] & left[b][None, :]
        near &= ~twice | (a[:, None] < b[None, :])
        i, j = np.nonzero(near)
        for k in np.argsort(far[i, j], kind="stable"):
            u, v = a[i[k]], b[j[k]]
            if root[u] == root[v]:
                continue
            same = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
            if same and den * same >= num * (n[u] + n[v] - same):
                root[root == root[v]] = root[u]
                links.append((int(ids[u]), int(ids[v])))
    return links


def _compared(num: int, den: int):
    """Links of the groups of one task; columns unit, id, component, first and second (the sides a row stands on), h."""

    def run(table: pa.Table) -> pa.Table:
        unit, ids, comp, one, two = (table.column(c).to_numpy() for c in ("unit", "id", "component", "first", "second"))
        h, links = table.column("h"), []
        order = np.argsort(unit, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
            if len(rows) > 1 and comp[rows].min() != comp[rows].max():
                sets = [np.frombuffer(h[int(i)].as_buffer(), np.uint64) for i in rows]
                links += _forest(ids[rows], comp[rows], one[rows], two[rows], sets, num, den)
        u, v = zip(*links, strict=True) if links else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _completed(members: DataFrame, texts: DataFrame, links: DataFrame, comp: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Components after all links inside large groups are known.

    ``members`` (key, id) of large groups, ``texts`` (doc_id, text). Members that any chain of keys ties together form a
    cluster. A cluster is compared once as a whole where that means fewer pairs than key by key, else key by key: what is
    compared is a unit, and a unit of more than ``SIDE`` bytes is cut into parts by set size. First every part is compared
    with itself, then parts with those of similar sizes that are not all connected by then. A task verifies what it compares
    and returns no more links than it has members.
    """
    spark = members.sparkSession

    def placed(m: DataFrame) -> DataFrame:
        return m.join(comp.select("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))

    ends = members.groupBy("key").agg(F.min("id").alias("__first"))
    tied = components(members.join(ends, "key").select("id", "__first").filter("id != __first").distinct())
    m = placed(members).join(tied.select("id", F.col("component").alias("__tied")), "id")
    m = written(m, "tied", narrow=True)
    keys = m.groupBy("key").agg(F.min("__tied").alias("__tied"), F.count(F.lit(1)).cast("double").alias("__m"), (F.min("component") != F.max("component")).alias("__split"))
    cost = keys.groupBy("__tied").agg(F.sum(F.when(F.col("__split"), F.col("__m") * F.col("__m")).otherwise(0)).alias("__keys"), F.max("__split").alias("__any"))
    size = m.select("__tied", "id").distinct().groupBy("__tied").agg(F.count(F.lit(1)).cast("double").alias("__all"))
    how = cost.filter("__any").join(size, "__tied").select(F.col("__tied").alias("__t"), (F.col("__all") * F.col("__all") <= F.col("__keys")).alias("__whole"))
    # what holds for a cluster reaches the members by their keys, so that no task gets a whole cluster
    of_key = keys.join(how, F.col("__tied") == F.col("__t")).select("key", "__split", "__whole")
    m = m.join(of_key, "key")
    whole = m.filter("__whole").select(F.col("__tied").alias("unit"), "id", "component", F.lit(0).alias("kind")).distinct()
    units = whole.union(m.filter("not __whole and __split").select(F.col("key").alias("unit"), "id", "component", F.lit(1).alias("kind")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offsets, data in chunks(batch.column("text")):
                row, h = _sets(offsets, data, k)
                edge = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(edge), pa.int64()), pa.array([h[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], names=["id", "n", "h"]
                )

    wanted = written(units.select(F.col("id").alias("doc_id")).distinct(), "wanted", narrow=True)
    sets = texts.join(wanted, "doc_id", "left_semi").mapInArrow(run, "id long, n long, h binary").filter("n > 0")
    sets = written(sets, "members")
    units = written(units.join(sets.groupBy("id").agg(F.max("n").alias("n")), "id").select("kind", "unit", "id", "component", "n"), "units", narrow=True)
    # a unit's members are cut into parts by size: only parts whose sizes can link meet
    unit, weight = ["kind", "unit"], F.greatest(F.col("n") * 8, F.lit(SIDE // ROWS))
    sizes = units.groupBy(*unit, "n").agg(F.sum(weight).alias("__b"), (F.min("component") != F.max("component")).alias("__two"), F.min("component").alias("__c"))
    until = F.sum("__b").over(Window.partitionBy(*unit).orderBy("n"))
    whole = Window.partitionBy(*unit)
    sizes = sizes.withColumn("__to", until).withColumn("__split", F.max("__two").over(whole) | (F.min("__c").over(whole) != F.max("__c").over(whole))).filter("__split")
    sizes = sizes.select(*unit, "n", F.floor((F.col("__to") - F.col("__b")) / SIDE).alias("__p0"), F.floor((F.col("__to") - 1) / SIDE).alias("__p1"), (F.max("__to").over(whole) > SIDE).alias("__many"))
    units = written(units.join(sizes, [*unit, "n"]).withColumn("part", F.col("__p0") + F.pmod(F.xxhash64("id"), F.col("__p1") - F.col("__p0") + 1)).drop("__p0", "__p1"), "units", narrow=True)
    load = units.agg(F.sum(weight)).first()[0]
    if not load:
        return comp
    # small units share tasks; a part of a unit that has several is a task of its own
    tasks = max(n_parts(spark), math.ceil(2 * load / SIDE))
    many = F.col("__many")
    task = [F.when(many, F.col("kind")).alias("__k"), F.when(many, F.col("unit")).otherwise(F.pmod(F.xxhash64(*unit), F.lit(tasks))).alias("__u"), F.when(many, F.col("part")).alias("__p")]
    yes = F.lit(True)
    dealt = units.select(*task, "unit", "id", "component", yes.alias("first"), yes.alias("second")).join(sets.select("id", "h"), "id")
    found = written(dealt.groupBy("__k", "__u", "__p").applyInArrow(_compared(num, den), "u long, v long"), "inside", narrow=True)
    if not found.isEmpty():
        links = links.union(found)
        comp = written(components(links), "connected", narrow=True)
    rest = units.filter("__many").drop("component", "__many")
    if not rest.isEmpty():
        rest = written(placed(rest), "apart", narrow=True)
        part = rest.groupBy(*unit, "part").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("component").alias("low"), F.max("component").alias("high"))
        other = part.select(*unit, *[F.col(c).alias(f"o_{c}") for c in ("part", "least", "most", "low", "high")])
        meet = part.join(other, unit).filter((F.col("part") < F.col("o_part")) & (F.col("o_least") * num <= F.col("most") * den) & (F.col("least") * num <= F.col("o_most") * den))
        meet = written(meet.filter(~((F.col("low") == F.col("high")) & (F.col("low") == F.col("o_low")) & (F.col("low") == F.col("o_high")))).select(*unit, F.col("part").alias("x"), F.col("o_part").alias("y")), "meet", narrow=True)
        side = lambda c, one: rest.join(meet.withColumn("part", F.col(c)), [*unit, "part"]).select(*unit, "x", "y", "id", "component", F.lit(one).alias("first"), F.lit(not one).alias("second"))
        sides = side("x", True).union(side("y", False)).join(sets.select("id", "h"), "id")
        found = written(sides.groupBy(*unit, "x", "y").applyInArrow(_compared(num, den), "u long, v long"), "across", narrow=True)
        if not found.isEmpty():
            comp = written(components(links.union(found)), "connected", narrow=True)
    dropped(sets, units, m)
    return comp


def jaccard_components(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D, A-Z in lower case;
    the set holds the distinct k-word shingles of the whole text (with fewer
    words the whole sequence as one). Documents link when |A n B| / |A u B| is
    num / den or more. Null text and text without words has an empty set and
    links with nothing. Repeated rows and copies share a component. An empty
    table gives an empty result. Other columns are ignored.
    """
    spark, bands = docs.sparkSession, Bands(num, den)
    table = written(described(docs, k), "sets")
    total = table.agg(F.sum("n")).first()[0] or 0
    classes = table.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), *[F.first(s).alias(s) for s in _ROW])
    classes = written(classes, "classes", narrow=True)
    out = table.select("doc_id", F.col("n").alias("n_shingles"), "f1", "f2")
    waves = WAVES if total > WAVE else 1
    buckets = max(n_parts(spark), math.ceil(total / 3 / BUCKET / waves))
    tables = [written(_emit(docs, k, bands, buckets, i, waves).groupBy("bucket").applyInArrow(_meet, "large boolean, a long, b long, code int"), "met") for i in range(waves)]
    met = reduce(DataFrame.union, tables)
    side = lambda x: classes.select(F.col("f1").alias(x), F.col("n").alias(f"n_{x}"), F.col("rep").alias(f"r_{x}"), *[F.col(s).alias(f"{s}_{x}") for s in _ROW])
    far = sum((F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in _ROW), F.lit(0))
    pairs = met.filter("not large").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").filter("r_a != r_b")
    pairs = pairs.filter((F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num) & (far * (den + num) <= (F.col("n_a") + F.col("n_b")) * (den - num)))
    pairs = written(pairs.select(F.least("r_a", "r_b").alias("u"), F.greatest("r_a", "r_b").alias("v")).distinct(), "pairs", narrow=True)
    pairs = written(_near(pairs, table, num, den), "pairs", narrow=True)
    # written first: where few texts are needed, the plan sees it and does not move all of them
    needed = written(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct(), "needed", narrow=True)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = written(text.join(needed, "doc_id", "left_semi"), "texts")
    # first each document and its smallest partner; then only what that leaves unconnected
    first = pairs.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
    links = written(_verified(first, texts, k, num, den), "first", narrow=True)
    comp = written(components(links), "connected", narrow=True)
    rest = _apart(pairs.join(first, ["u", "v"], "left_anti"), comp)
    more = written(_verified(rest, texts, k, num, den), "more", narrow=True)
    dropped(texts)
    if not more.isEmpty():
        links = links.union(more)
        comp = written(components(links), "connected", narrow=True)
    large = _split(tables, classes, comp, waves)
    dropped(*tables)
    if large is not None:
        # every document leaves out its most common words, one fewer than it shares with any that links
        often = large.groupBy("key").agg(F.count(F.lit(1)).alias("__size"))
        w = Window.partitionBy("f1", F.col("code") % 2).orderBy(F.desc("__size"), "key")
        large = large.join(often, "key").withColumn("__k", F.row_number().over(w)).filter(F.col("__k") >= F.floor(F.col("code") / 2))
        member = written(large.join(classes.select("f1", F.col("rep").alias("id")), "f1").select("key", "id").distinct(), "members", narrow=True)
        comp = _completed(member, text, links, comp, k, num, den)
    rep = classes.select(F.col("n").alias("n_shingles"), "f1", "f2", "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    out = out.join(rep, ["n_shingles", "f1", "f2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def _split(met: list[DataFrame], classes: DataFrame, comp: DataFrame, parts: int) -> DataFrame | None:
    """(key, f1, code) of the large groups whose members are not all connected yet; None if there is none.

    Documents that link and are apart share only such groups (smaller ones were verified as all their pairs), so what holds for the
    words that they share holds for these alone. Groups are looked at in ``parts`` by their keys, one after the other.
    """
    of = classes.select("f1", F.col("rep").alias("id")).join(comp, "id", "left").select("f1", F.coalesce("component", "id").alias("__c"))
    of = written(of, "placed", narrow=True)
    found = []
    for table in met:
        for i in range(parts):
            some = table.filter("large").select(F.col("a").alias("key"), F.col("b").alias("f1"), "code").filter(F.pmod(F.xxhash64("a"), F.lit(parts)) == i)
            ends = some.select("key", "f1").join(of, "f1").groupBy("key").agg(F.min("__c").alias("__low"), F.max("__c").alias("__high"))
            keys = written(ends.filter("__low != __high").select("key"), "split", narrow=True)
            if not keys.isEmpty():
                found.append(written(some.join(keys, "key", "left_semi").distinct(), "apart"))
            dropped(keys)
    dropped(of)
    return reduce(DataFrame.union, found) if found else None


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs that are in different components."""
    c = lambda x: comp.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}"))
    p = pairs.join(c("u"), "u", "left").join(c("v"), "v", "left")
    return p.filter(F.coalesce("c_u", "u") != F.coalesce("c_v", "v")).select("u", "v")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(docs_of(spark, sf_dir), 4, 85, 100)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity of 0.8 or more) stays: the smallest doc_id.

    A doc_id that is repeated stays once.
    """
    found = written(jaccard_components(docs, 5, 8, 10), "components", narrow=True)
    goes = written(found.filter("doc_id != component_id").select("doc_id").distinct(), "goes", narrow=True)
    kept = docs.join(goes, "doc_id", "left_anti").select(*docs.columns)
    twice = found.filter("n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).union(kept.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))
