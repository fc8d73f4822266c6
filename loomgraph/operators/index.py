"""A written inverted index: ranked retrieval with exact max-score pruning, and phrases by position.

Documents are dealt to blocks by a hash of their id, and the index is a table bucketed by block: a document's postings lie in
one bucket, so scores are added up where the postings are read and only the best rows of each task are shuffled. Terms carry
their document frequency and the largest share that any document gets from them. A query's rarest terms give a bound that its
last place reaches at least; terms that cannot reach the bound together are looked up only for documents that hold one of the
others (Turtle and Flood 1995), where that means fewer rows than reading all postings. Both ways give the same result.
"""

from __future__ import annotations

import atexit
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.tables import bounded, kept, released, shared, together
from loomgraph.operators.text import tokens

_tables: list[tuple[SparkSession, str]] = []


@dataclass(frozen=True)
class Index:
    """``postings`` (block, term, doc_id, len, tf, and at with positions), ``terms`` (term, df, top), and the collection's size and mean length."""

    name: str
    postings: DataFrame
    terms: DataFrame
    n: int
    avg: float
    k1: float
    b: float

    def share(self) -> Column:
        """What a posting adds to a score, over the term's weight; the collection's mean length may be 0."""
        return F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("len") / (self.avg or 1.0)))

    def weight(self) -> Column:
        return F.log((self.n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)

    def drop(self) -> None:
        """Delete the written tables."""
        released(self.terms)
        _drop(self.postings.sparkSession, self.name)


def _drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    released_path = f"{shared(spark)}/{name}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(released_path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _tables[:] = [x for x in _tables if x[1] != name]


@atexit.register
def _sweep() -> None:
    for spark, name in list(_tables):
        try:
            _drop(spark, name)
        except Exception:  # the session is gone
            return


def build(docs: DataFrame, terms: DataFrame | list[str] | None = None, positions: bool = False, block: int = 1024, k1: float = 1.2, b: float = 0.75) -> Index:
    """Index of ``docs`` (doc_id, text), each doc_id one document; null and empty texts count as documents without terms.

    With ``terms`` only these are indexed: a table with a column ``term``, or a short list. All documents count in the
    statistics. ``positions`` adds where a term stands.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(parts, math.ceil(docs.count() / block))
    seen = Observation()
    d = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")).repartition(parts, "block")
    d = d.select("block", "doc_id", tokens(F.col("text")).alias("__t")).withColumn("len", F.size("__t"))
    d = d.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("len").alias("sum"), F.count("len").alias("some"))
    if isinstance(terms, list):
        words = F.filter(F.transform("__t", lambda t, i: F.struct(i.alias("pos"), t.alias("term"))), lambda x: x["term"].isin(terms))
        d = d.select("block", "doc_id", "len", F.explode(words).alias("__w")).select("block", "doc_id", "len", "__w.term", "__w.pos")
    else:
        d = d.select("block", "doc_id", "len", F.posexplode("__t").alias("pos", "term"))
        if terms is not None:
            d = d.join(bounded(terms.select("term").distinct()), "term", "left_semi")
    tf = [F.count(F.lit(1)).alias("tf"), *[F.sort_array(F.collect_list("pos")).alias("at")] * positions]
    postings = d.groupBy("block", "doc_id", "len", "term").agg(*tf)
    name = f"loomgraph_index_{uuid.uuid4().hex}"
    _tables.append((spark, name))
    with together(spark):
        postings.write.bucketBy(parts, "block").sortBy("block", "term").format("parquet").option("path", f"{shared(spark)}/{name}").saveAsTable(name)
    n, avg = seen.get["n"], (seen.get["sum"] or 0) / (seen.get["some"] or 1)
    made = Index(name, spark.table(name), None, n, avg, k1, b)
    terms_ = kept(made.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max(made.share()).alias("top")))
    return Index(name, made.postings, terms_, n, avg, k1, b)


#: What looking up a posting of a document costs, in postings that are read in passing.
LOOKUP = 4
#: Relative and absolute room for sums of doubles in another order.
_ROOM = 1e-9


def _best(scores: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round(-F.col("s"), 9), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("query_id", "doc_id", "rank", (-F.col("s")).alias("score"))


def _planned(index: Index, queries: DataFrame, top: int) -> DataFrame:
    """(query_id, term, w, needed, rest, bound): each query's terms, and whether documents are found by them or only completed."""
    q = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    qt = q.join(index.terms, "term").withColumn("w", index.weight()).withColumn("most", F.col("w") * F.col("top"))
    qt = kept(qt.select("query_id", "term", "w", "most", "df"))
    w = Window.partitionBy("query_id").orderBy(F.desc("most"), "term")
    before = F.coalesce(F.sum("df").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seeds = qt.withColumn("__b", before).filter(F.col("__b") < 4 * top).select("query_id", "term", "w")
    found = index.postings.join(bounded(seeds), "term").groupBy("block", "query_id", "doc_id").agg(F.sum(F.col("w") * index.share()).alias("s"))
    # rows of one query that reach the bound: the last place has at least that much
    bound = _best(found, top).filter(F.col("rank") == top).select("query_id", (-F.col("score")).alias("bound"))
    qt = qt.join(bound, "query_id", "left").fillna(0.0, ["bound"])
    low = Window.partitionBy("query_id").orderBy("most", F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("query_id")
    qt = qt.withColumn("__out", F.sum("most").over(low) * (1 + _ROOM) + _ROOM < F.col("bound"))
    lookups = F.sum(F.when(F.col("__out"), 0).otherwise(F.col("df"))).over(whole) * (1 + LOOKUP * F.sum(F.col("__out").cast("long")).over(whole))
    qt = qt.withColumn("needed", ~F.col("__out") | (lookups >= F.sum("df").over(whole)))
    rest = F.sum(F.when(F.col("needed"), 0.0).otherwise(F.col("most"))).over(whole)
    out = kept(qt.withColumn("rest", rest).select("query_id", "term", "w", "needed", "rest", "bound"))
    released(qt)
    return out


def search(index: Index, queries: DataFrame, top: int = 100) -> DataFrame:
    """(query_id, doc_id, rank, score) of the ``top`` best documents of each query (query_id, query): a negated BM25, lower is better, ties by doc_id.

    No term and no document that could be among the best is left out. Queries without an indexed term have no rows.
    """
    spark = index.postings.sparkSession
    plan = _planned(index, queries, top)
    part = (F.col("w") * index.share()).alias("p")
    scored = lambda terms: index.postings.join(bounded(terms.select("query_id", "term", "w", "rest", "bound")), "term").groupBy("block", "query_id", "doc_id")
    full = scored(plan.filter("rest = 0")).agg(F.sum(part).alias("s"))
    lean = plan.filter("rest > 0")
    if lean.isEmpty():
        return _best(full.select("query_id", "doc_id", "s"), top)
    with together(spark):
        some = scored(lean.filter("needed")).agg(F.sum(part).alias("s"), F.max("rest").alias("rest"), F.max("bound").alias("bound"))
        some = kept(some.filter((F.col("s") + F.col("rest")) * (1 + _ROOM) + _ROOM >= F.col("bound")).select("block", "query_id", "doc_id", "s"))
        asked = some.drop("s").join(bounded(lean.filter("not needed").select("query_id", "term", "w")), "query_id")
        more = asked.join(index.postings, ["block", "doc_id", "term"]).select("block", "query_id", "doc_id", part)
        some = kept(some.withColumnRenamed("s", "p").unionByName(more).groupBy("query_id", "doc_id").agg(F.sum("p").alias("s")))
    return _best(full.select("query_id", "doc_id", "s").unionByName(some), top)


def _back(i: int):
    return lambda p: p - i


def phrase(index: Index, query: list[str]) -> DataFrame:
    """(doc_id, n): documents that hold the tokens of ``query`` one after another, and how often without overlap; the index needs positions."""
    held = None
    for term in dict.fromkeys(query):
        at = index.postings.filter(F.col("term") == term).select("block", "doc_id", F.col("at").alias(f"__{len(held.columns) - 2 if held is not None else 0}"))
        held = at if held is None else held.join(at, ["block", "doc_id"])
    place = {term: f"__{i}" for i, term in enumerate(dict.fromkeys(query))}
    starts = F.col(place[query[0]])
    for i, term in enumerate(query[1:], 1):
        starts = F.array_intersect(starts, F.transform(place[term], _back(i)))
    free = F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, p: F.when(p >= acc["end"], F.struct((p + len(query)).alias("end"), (acc["n"] + 1).alias("n"))).otherwise(acc)
    out = held.select("doc_id", F.aggregate(F.array_sort(starts), free, step)["n"].alias("n"))
    return out.filter("n > 0")
