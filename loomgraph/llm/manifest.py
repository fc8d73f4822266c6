"""Operator 12, Merkle dataset manifest: fractal traversal of aligned blocks.

Leaves are numbered inside their source by a distributed sort and cut into aligned
blocks of ``ARITY ** height``. A block is traversed leaf by leaf (Jakobsson et al.
2003): for each band of levels it keeps the existing subtree above the current
leaf, which has the siblings of the leaf's path, and grows the desired one, which
follows it, by a leaf a step, so it is whole when the traversal enters it. What is
held beside the block's leaves is two small subtrees a band, whatever the block's
size. Blocks' roots are the leaves of the tree above; it is cut into blocks and
traversed in the same way, until each source has one root, and so are the sources'
roots. The paths above a block are then appended to the paths inside it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import docs_of, dropped, positions, written

ARITY = 3
#: Levels of a block, and of a subtree that is held whole.
HEIGHT, BAND = 6, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[bytes]) -> bytes:
    """Lower-case hex SHA-256 of the parts one after another."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def levels_of(n: int) -> int:
    """Levels above ``n`` nodes."""
    k = 0
    while n > 1:
        n, k = -(-n // ARITY), k + 1
    return k


class Subtree:
    """The nodes of levels ``low`` to ``high`` below the ``root``-th node of level ``high``, grown leaf by leaf."""

    def __init__(self, leaves: list[bytes], low: int, high: int, root: int):
        self.leaves, self.low, self.high, self.root = leaves, low, high, root
        self.at = root * ARITY**high
        self.end = min(len(leaves), self.at + ARITY**high)
        #: Nodes of each level so far; below ``low`` only those of the run that is not yet whole.
        self.nodes: list[list[bytes]] = [[] for _ in range(high + 1)]
        self.seen = [0] * (high + 1)

    def _add(self, level: int, node: bytes) -> None:
        row = self.nodes[level]
        row.append(node)
        self.seen[level] += 1
        if level == self.high:
            return
        place = self.seen[level] % ARITY
        if place == 0 or self.at == self.end and self.root * ARITY ** (self.high - level) + self.seen[level] == -(-len(self.leaves) // ARITY**level):
            run = row[-(place or ARITY) :]
            if level < self.low:
                row.clear()
            self._add(level + 1, digest(run))

    def step(self) -> None:
        """One leaf more."""
        if self.at < self.end:
            self.at += 1
            self._add(0, self.leaves[self.at - 1])

    def whole(self) -> Subtree:
        while self.at < self.end:
            self.step()
        return self


def traverse(leaves: list[bytes], levels: int, band: int = BAND) -> Iterator[tuple[bytes, str]]:
    """For each leaf its siblings, level by level and left to right, and for each level its place in the run and the run's size.

    After the last leaf comes the root, with an empty text.
    """
    bands = [(low, min(low + band, levels)) for low in range(0, levels, band)]
    exist = [Subtree(leaves, low, high, 0).whole() for low, high in bands]
    desire = [Subtree(leaves, low, high, 1) for low, high in bands]
    for j in range(len(leaves)):
        path, places = [], []
        for i, (low, high) in enumerate(bands):
            if j and j % ARITY**high == 0:
                exist[i] = desire[i].whole()
                desire[i] = Subtree(leaves, low, high, exist[i].root + 1)
            for level in range(low, high):
                at = j // ARITY**level - exist[i].root * ARITY ** (high - level)
                place = at % ARITY
                run = exist[i].nodes[level][at - place : at - place + ARITY]
                path += run[:place] + run[place + 1 :]
                places.append(f"{place}{len(run)}")
            desire[i].step()
        yield b"".join(path), "".join(places)
    yield exist[-1].nodes[levels][0] if bands else leaves[0], ""


def folded(leaf: bytes, path: bytes, places: str) -> bytes:
    """The root that a leaf and its path lead to."""
    at = 0
    for k in range(0, len(places), 2):
        place, n = int(places[k]), int(places[k + 1])
        run = path[at : at + 64 * (n - 1)]
        leaf, at = digest([run[: 64 * place], leaf, run[64 * place :]]), at + 64 * (n - 1)
    return leaf


def leaf_of(*columns: Column) -> Column:
    """The digest of a row: ``-`` for null, else the value's UTF-8 bytes counted, a colon and the value."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(one, columns)), 256)


def _paths(nodes: DataFrame, height: int) -> DataFrame:
    """``nodes`` (group, pos, n, leaf, ...) with path, places and, in each block's first row, the block's root."""
    size = ARITY**height
    names = nodes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def done(block: pa.RecordBatch, n: int) -> tuple[list[str], list[str], list[str | None]]:
            leaves = [x.encode() for x in block.column("leaf").to_pylist()]
            *steps, (root, _) = traverse(leaves, height if n > size else levels_of(n))
            return [p.decode() for p, _ in steps], [w for _, w in steps], [root.decode()] + [None] * (len(leaves) - 1)

        for batch in batches:
            kept.append(batch)
            rows = pa.concat_batches(kept)
            # a block is whole by its place and the group's size
            out: list[list] = [[], [], []]
            lo = 0
            pos, total = rows.column("pos").to_pylist(), rows.column("n").to_pylist()
            while lo < len(pos) and (hi := lo + min(size, total[lo] - pos[lo])) <= len(pos):
                for column, more in zip(out, done(rows.slice(lo, hi - lo), total[lo]), strict=True):
                    column += more
                lo = hi
            if lo:
                yield pa.RecordBatch.from_arrays([*rows.slice(0, lo).columns, *[pa.array(c, pa.string()) for c in out]], names=[*names, "path", "places", "root"])
            kept = [rows.slice(lo)]

    block = F.floor(F.col("pos") / size)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + ", path string, places string, root string"
    return nodes.repartition("group", block).sortWithinPartitions("group", "pos").mapInArrow(run, schema)


def _raised(nodes: DataFrame, height: int, label: str) -> DataFrame:
    """Every node's path up to its group's top: ``nodes`` with path, places and root. Groups may have any size."""
    size = ARITY**height
    d = written(_paths(nodes, height), label)
    tops = d.filter("root is not null").select("group", F.floor(F.col("pos") / size).alias("pos"), F.ceil(F.col("n") / size).alias("n"), F.col("root").alias("leaf"))
    if tops.filter("n > 1").isEmpty():
        above = tops.select(F.col("group").alias("__up"), F.col("pos").alias("__b"), F.lit("").alias("__path"), F.lit("").alias("__places"), F.col("leaf").alias("__root"))
    else:
        above = _raised(written(tops, "tops"), height, label).select(F.col("group").alias("__up"), F.col("pos").alias("__b"), F.col("path").alias("__path"), F.col("places").alias("__places"), F.col("root").alias("__root"))
    d = d.join(above, (F.col("group") == F.col("__up")) & (F.floor(F.col("pos") / size) == F.col("__b")))
    return d.select(*nodes.columns, F.concat("path", "__path").alias("path"), F.concat("places", "__places").alias("places"), F.col("__root").alias("root"))


def manifest(leaves: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(..., pos, n, subroot, root, path, places): every leaf's place and its path to the root over all sources.

    ``leaves`` has doc_id, source, leaf and any other columns, which are kept
    unless they clash with these. In a source leaves ascend by doc_id (null
    first), ties by leaf; sources ascend by their UTF-8 bytes (null first, then
    empty). ``path`` holds the siblings as hex text, ``places`` two digits a
    level: the place in the run and the run's size. Repeated rows are a leaf each.
    An empty table gives an empty result, and no root.
    """
    d = leaves.withColumn("group", F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("0"), "source"))).withColumn("__salt", F.monotonically_increasing_id())
    d = written(d, "leaves")
    placed = positions(d, ["group"], ["doc_id", "leaf", "__salt"], "pos", "n").drop("__salt")
    dropped(d)
    low = written(_raised(placed, height, "paths"), "raised")
    tops = written(low.groupBy("group").agg(F.first("root").alias("leaf")), "subroots")
    tops = positions(tops, [], ["group"], "pos", "n").select(F.lit("all").alias("group"), "pos", "n", "leaf", F.col("group").alias("__g"))
    high = written(_raised(tops, height, "sources"), "sources").select("__g", F.col("path").alias("__path"), F.col("places").alias("__places"), F.col("root").alias("__root"))
    out = low.withColumnRenamed("root", "subroot").join(high, F.col("group") == F.col("__g"))
    return out.select(*leaves.columns, "pos", "n", "subroot", F.col("__root").alias("root"), F.concat("path", "__path").alias("path"), F.concat("places", "__places").alias("places"))


def fold(rows: DataFrame, leaf: str, name: str = "folded_root") -> DataFrame:
    """``rows`` of a manifest with the root that the column ``leaf`` leads to; path and places are left out."""
    kept = [f for f in rows.schema if f.name not in ("path", "places")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in (leaf, "path", "places"))
            roots = pa.array([folded(a.encode(), p.encode(), w).decode() for a, p, w in zip(*cols, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], roots], names=[*[f.name for f in kept], name])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{name}` string")


def document_manifest(docs: DataFrame, tampered: Column, text: Column, height: int = HEIGHT) -> DataFrame:
    """Each document's leaf, roots, the digest of its path, and whether the row with ``text``, where ``tampered``, leads to the root.

    Columns other than :data:`FIELDS` are ignored. Nulls have leaves of their own;
    a change that leaves the text as it was is verified. Texts are read once.
    """
    fields = [F.col(c) for c in FIELDS]
    d = docs.select(*FIELDS).withColumn("leaf", leaf_of(*fields))
    d = d.select("doc_id", "source", "leaf", F.when(tampered, leaf_of(*fields[:-1], text)).otherwise(F.col("leaf")).alias("__now"))
    d = fold(manifest(d, height).withColumn("proof_sha256", F.sha2("path", 256)), "__now")
    return d.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return document_manifest(docs_of(spark, sf_dir), odd, F.translate("text", "\n", ""))
