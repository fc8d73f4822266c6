"""Operator 8, embedding near-duplicates: spherical-cap filters.

A filter is a direction: one random unit vector per block of dimensions, put
together (a product code). A vector belongs to every filter whose direction
exceeds a threshold; list decoding goes block by block and drops a prefix as soon
as the best remaining blocks cannot lift it over the threshold. Vectors are joined
on label and filter, and every pair is verified by its cosine in double
precision. A pair counts at its smallest common filter only.

The number of filters follows the size of the largest label, so that a filter
holds about ``HELD`` unrelated vectors at every scale, and the expected number of
filters shared by a linked pair stays the same. Fuller filters are cut into
chunks, and pairs of chunks are tasks of bounded size; tasks return counts and
forest edges, not pairs. Rows with equal label and vector are one class from the
start and count by their number, so copies meet nothing twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import components, written

THRESHOLD = 0.93
#: Unrelated vectors in a filter; chance that a pair at the threshold shares none, as planned.
HELD, MISSED = 64, 1e-4
#: Every vector has so many filters at least: its best ones.
LEAST = 8
#: Vectors of one side of a task, and rows of one group of tasks.
CHUNK, GROUP = 2048, 20_000
#: Most codes of a block before another block is used.
CODES = 256


def design(n: int, threshold: float) -> tuple[float, int, int]:
    """(z, blocks, codes): threshold in standard deviations, and the product code, for n vectors of a label."""
    p = min(0.05, HELD / max(1, n))
    z = NormalDist().inv_cdf(1 - p)
    x = np.linspace(z, z + 8, 4000)
    weight = np.exp(-(x**2) / 2)
    tail = np.array([1 - NormalDist().cdf((z - threshold * v) / math.sqrt(1 - threshold**2)) for v in x])
    both = float((weight * tail).sum() / weight.sum())
    filters = 1.5 * -math.log(MISSED) / both / p
    blocks = max(2, math.ceil(math.log(filters) / math.log(CODES)))
    return z, blocks, math.ceil(filters ** (1 / blocks))


def codes(dim: int, blocks: int, count: int) -> list[tuple[slice, np.ndarray]]:
    """(dimensions, unit code vectors) of each block; fixed by the three numbers."""
    rng = np.random.Generator(np.random.PCG64([dim, blocks, count]))
    edges = np.linspace(0, dim, min(blocks, dim) + 1).astype(int)
    out = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        c = rng.standard_normal((count, hi - lo))
        out.append((slice(int(lo), int(hi)), c / np.linalg.norm(c, axis=1, keepdims=True)))
    return out


def list_decode(x: np.ndarray, code: list[tuple[slice, np.ndarray]], z: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters that rows of unit vectors exceed, and of each row's LEAST best ones."""
    need = z / math.sqrt(x.shape[1]) * math.sqrt(len(code))
    score = [x[:, s] @ c.T for s, c in code]
    rest = [np.zeros(len(x))]
    for s in reversed(score):
        rest.append(rest[-1] + s.max(1))
    rest = rest[::-1]
    count = code[0][1].shape[0]

    def grown(row: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, total = np.zeros(len(row), np.int64), np.zeros(len(row))
        for k, s in enumerate(score):
            both = total[:, None] + s[row]
            i, c = np.nonzero(both + rest[k + 1][row][:, None] >= floor[row][:, None] - 1e-12)
            row, at, total = row[i], at[i] * count + c, both[i, c]
        return row, at, total

    floor = np.full(len(x), need)
    row, at, total = grown(np.arange(len(x)), floor)
    got = np.bincount(row, minlength=len(x))
    few = np.flatnonzero(got < LEAST)
    while len(few):
        floor[few] -= 0.05 + 0.1 * np.abs(floor[few])
        r, a, t = grown(few, floor)
        order = np.lexsort((a, -t, r))
        r, a = r[order], a[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        enough = np.bincount(r, minlength=len(x))[few] >= min(LEAST, count ** len(code))
        done = np.isin(r, few[enough]) & (place < LEAST)
        keep = ~np.isin(row, few[enough])
        row, at = np.concatenate([row[keep], r[done]]), np.concatenate([at[keep], a[done]])
        few = few[~enough]
    order = np.lexsort((at, row))
    return row[order], at[order]


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


_DECODED = "vec_id long, label long, rows long, dim int, wide boolean, vec binary, filters array<long>"


def decoded(vectors: DataFrame, n: int, threshold: float) -> DataFrame:
    """Valid vectors (vec_id, label, rows, embedding) with their filters; a vector keeps the precision that it came in."""
    z, blocks, count = design(n, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, list] = {}
        for whole in batches:
            size = pc.list_value_length(whole.column("embedding"))
            for dim in pc.unique(size).to_pylist():
                part = whole.filter(pc.equal(size, dim))
                if dim not in made:
                    made[dim] = codes(dim, blocks, count)
                for lo in range(0, part.num_rows, 256):
                    b = part.slice(lo, 256)
                    x = _matrix(b.column("embedding"), dim)
                    row, at = list_decode(x / np.linalg.norm(x, axis=1, keepdims=True), made[dim], z)
                    offsets = np.searchsorted(row, np.arange(len(x) + 1))
                    short = x.astype(np.float32)
                    wide = not (short == x).all()
                    columns = [b.column("vec_id"), b.column("label"), b.column("rows"), pa.array(np.full(len(x), dim, np.int32)), pa.array([wide] * len(x)), pa.array([v.tobytes() for v in (x if wide else short)], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(at, pa.int64()))], names=["vec_id", "label", "rows", "dim", "wide", "vec", "filters"])

    return vectors.mapInArrow(run, _DECODED)


def forest(mask: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix, the smallest row that it is joined with."""
    comp = np.arange(len(mask))
    while True:
        low = np.where(mask, comp[None, :], len(mask)).min(1, initial=len(mask))
        new = np.minimum(comp, low)
        new = np.minimum(new, new[new])
        if (new == comp).all():
            return comp
        comp = new


def _verify(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "rows", "dim", "wide", "filter", "one", "two", "chunk")}
        order = np.lexsort((cols["vec_id"], cols["two"], cols["one"], cols["filter"], cols["dim"], cols["label"]))
        cols = {k: v[order] for k, v in cols.items()}
        vec = table.column("vec").combine_chunks()
        lists = table.column("filters").combine_chunks()
        at, flat = np.asarray(lists.offsets), lists.values.to_numpy(zero_copy_only=False)
        keys = np.stack([cols[k] for k in ("label", "dim", "filter", "one", "two")])
        edge = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [len(order)]])
        out_u, out_v, out_n = [], [], []
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if hi - lo < 2:
                continue
            rows, ids = order[lo:hi], cols["vec_id"][lo:hi]
            x = np.stack([np.frombuffer(vec[int(r)].as_buffer(), np.float64 if w else np.float32).astype(np.float64) for r, w in zip(rows, cols["wide"][lo:hi], strict=True)])
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            mask = x @ x.T >= threshold
            mask &= ids[:, None] != ids[None, :]
            if cols["one"][lo] != cols["two"][lo]:
                chunk = cols["chunk"][lo:hi]
                mask &= chunk[:, None] != chunk[None, :]
            linked = np.flatnonzero(mask.any(1))
            if not len(linked):
                continue
            mask, ids, rows, many = mask[np.ix_(linked, linked)], ids[linked], rows[linked], cols["rows"][lo:hi][linked]
            # smaller filters that a pair has in common
            mine = [flat[at[r] : at[r + 1]] for r in rows]
            small = [m[m < cols["filter"][lo]] for m in mine]
            names, which = np.unique(np.concatenate(small), return_inverse=True)
            if len(names):
                has = np.zeros((len(rows), len(names)), np.float32)
                has[np.repeat(np.arange(len(rows)), [len(s) for s in small]), which] = 1
                mask &= (has @ has.T) == 0
            n = mask @ many
            comp = forest(mask)
            out_u.append(ids)
            out_v.append(ids[comp])
            out_n.append(n)
        cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        u, v, n = cat(out_u), cat(out_v), cat(out_n)
        if len(u):  # one row per vector and partner in this group
            pair, which = np.unique(np.stack([u, v]), axis=1, return_inverse=True)
            u, v, n = pair[0], pair[1], np.bincount(which.ravel(), weights=n).astype(np.int64)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Two rows link if their labels are equal and not null, they have equally many
    dimensions, different vec_ids, and a cosine of ``threshold`` or more. Null,
    zero, or non-finite vectors, and those with null components, link with
    nothing: n_links 0, their own component, kept. Rows equal in vec_id, label
    and vector count once; a vec_id of several vectors has the links of all. An
    empty table gives an empty result; other columns are ignored.
    """
    e = F.col("embedding")
    odd = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    some = F.exists(e, lambda v: v != 0)
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), e.cast("array<double>").alias("embedding"))
    valid = base.filter("vec_id is not null and label is not null and embedding is not null").filter(~F.coalesce(odd, F.lit(True)) & F.coalesce(some, F.lit(False)))
    largest = valid.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    own = base.select("vec_id")
    alone = own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not largest:
        return alone
    same = ["label", "embedding"]
    members = valid.distinct()
    classes = written(members.groupBy(*same).agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("rows")), "classes")
    more = classes.filter("rows > 1").withColumnRenamed("vec_id", "first")
    copies = written(members.join(more, same).select("vec_id", "first", "rows"), "copies", narrow=True)
    table = written(decoded(classes, largest, threshold), "filters")
    total = table.agg(F.sum(F.size("filters"))).first()[0]
    each = table.withColumn("filter", F.explode("filters"))
    full = written(each.groupBy("label", "dim", "filter").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 2 * CHUNK), "full", narrow=True)
    chunk = F.lit(0).cast("long")
    each = each.withColumn("chunk", chunk).withColumn("one", chunk).withColumn("two", chunk)
    if not full.isEmpty():
        parts = F.ceil(F.coalesce(F.col("__n"), F.lit(1)) / CHUNK)
        each = each.join(full, ["label", "dim", "filter"], "left").withColumn("__parts", F.when(F.col("__n").isNull(), F.lit(1)).otherwise(parts))
        each = each.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "vec"), F.col("__parts"))).withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts").cast("long") - 1)))
        each = each.withColumn("one", F.least("chunk", "__other")).withColumn("two", F.greatest("chunk", "__other")).drop("__n", "__parts", "__other")
    groups = max(1, -(-total // GROUP))
    each = each.withColumn("g", F.pmod(F.xxhash64("label", "dim", "filter", "one", "two"), F.lit(groups)))
    found = written(each.groupBy("g").applyInArrow(_verify(threshold), "u long, v long, n long"), "joined", narrow=True)
    # a row links with what its class links with, and with the other rows of the class
    per = classes.filter("rows = 1").select("vec_id", F.col("vec_id").alias("first"), "rows").union(copies)
    links = per.join(found.groupBy(F.col("u").alias("first")).agg(F.sum("n").alias("n")), "first", "left")
    links = links.groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n")).filter("n > 0")
    comp = components(found.filter("u != v").select("u", "v").union(copies.select("vec_id", "first").filter("vec_id != first")))
    out = own.join(links, "vec_id", "left").join(comp.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    c = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), c.alias("component_id"), F.coalesce(F.col("vec_id") == c, F.lit(True)).alias("kept"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
