"""Task context: atoms of several kinds for each query, admitted in order under shared budgets, spread over files, with source text inline.

Kinds: ``definition`` and ``lexical_file`` for retrieved candidates, ``relationship`` for each step around the first of them,
``path`` instead of these where a query names a target. An atom is whole or absent.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import graph, text
from loomgraph.operators.tables import kept

#: Tiers and kinds in rank order.
TIERS = ("exact_entity_id", "exact_qualified_label", "exact_path", "exact_name", "lexical")
KINDS = ("definition", "lexical_file", "relationship", "path")
_SOURCES = "array<struct<path:string,start_byte:long,end_byte:long>>"
_ATOM = ["query_id", "kind", "atom_id", "tier", "seed_rank", "distance", "path", "owner", "sources"]


@dataclass(frozen=True)
class Limits:
    """Of one query: seeds that are followed, their depth, atoms, bytes of atoms and frontiers, bytes of inline text, and a seed's search."""

    seeds: int = 8
    depth: int = 2
    atoms: int = 128
    bytes: int = 64_000
    inline: int = 16_000
    nodes: int = 1000
    edges: int = 1000


@dataclass(frozen=True)
class Context:
    """``atoms`` in their order (place); ``sources``: each atom's spans with the text or why it is not there; ``frontiers``: how each
    seed's search ended; ``outcomes``: what stopped a query's collection, null if all was admitted."""

    atoms: DataFrame
    sources: DataFrame
    frontiers: DataFrame
    outcomes: DataFrame


def atom_bytes() -> Column:
    """The size that admission counts: ids and paths in UTF-8, 64 for an atom and 32 for the numbers of each source."""
    spans = F.aggregate("sources", F.lit(0), lambda n, s: n + 32 + F.coalesce(F.octet_length(s["path"]), F.lit(0)))
    return F.lit(64) + F.octet_length("atom_id") + F.coalesce(F.octet_length("path"), F.lit(0)) + F.coalesce(F.octet_length("owner"), F.lit(0)) + spans


def _span(path: str = "path", start: str = "start_byte", end: str = "end_byte") -> Column:
    return F.array(F.struct(F.col(path).alias("path"), F.col(start).cast("long").alias("start_byte"), F.col(end).cast("long").alias("end_byte"))).cast(_SOURCES)


def _retrieved(candidates: DataFrame, entities: DataFrame, files: DataFrame) -> DataFrame:
    """Definitions and whole files, in the order of retrieval; a candidate without an entity or a file gives none."""
    c = candidates.select("query_id", F.col("place").cast("int").alias("seed_rank"), F.col("tier").cast("int").alias("tier"), "kind", F.col("id").cast("string").alias("atom_id"))
    e = entities.select(F.col("entity_id").alias("atom_id"), "path", "owner", _span().alias("sources"))
    f = files.select(F.col("path").alias("atom_id"), "path", F.lit(None).cast("string").alias("owner"), F.array(F.struct(F.col("path"), F.lit(0).cast("long").alias("start_byte"), F.octet_length("content").cast("long").alias("end_byte"))).cast(_SOURCES).alias("sources"))
    found = [c.filter(F.col("kind") == was).drop("kind").join(d, "atom_id").withColumn("kind", F.lit(kind)) for was, d, kind in (("entity", e, "definition"), ("file", f, "lexical_file"))]
    return found[0].unionByName(found[1]).withColumn("distance", F.lit(0)).select(*_ATOM)


def assembled(candidates: DataFrame, entities: DataFrame, files: DataFrame, assertions: DataFrame, queries: DataFrame, limits: Limits = Limits(),
              relations: Sequence[str] = ("call",), confidences: Sequence[str] = ("EXTRACTED", "INFERRED")) -> Context:
    """The context of every query (query_id, target: an entity or null).

    ``candidates`` (query_id, place, tier: index in :data:`TIERS`, kind: entity or file, id), ``entities`` (entity_id, path,
    owner, start_byte, end_byte: null if no definition is known), ``files`` (path, content: bytes), ``assertions``
    (assertion_id, source, target, relation, confidence, path, start_byte, end_byte; an id is one between two ends). Candidates come first, in their order;
    then, for each of the first ``limits.seeds`` entities among those admitted, its frontier and the steps around it in the
    order of discovery, or the whole path to the target. Counts and bytes run on through all of these, and the first that does
    not fit ends the collection (bundle_limit or collection_limit). A span's text is inline if its file is there and its bytes
    fit into what is left of ``limits.inline`` at its turn; a later, smaller one may still fit. All bounds are a query's own.
    """
    first = kept(_retrieved(candidates, entities, files))
    turn = Window.partitionBy("query_id").orderBy("seed_rank", "kind", "atom_id")
    so_far = turn.rowsBetween(Window.unboundedPreceding, 0)
    fits = (F.count(F.lit(1)).over(so_far) <= limits.atoms) & (F.sum(atom_bytes()).over(so_far) <= limits.bytes)
    seeds = first.withColumn("__fits", fits).withColumn("__all", F.min("__fits").over(Window.partitionBy("query_id"))).filter("__all and kind = 'definition'")
    seeds = seeds.withColumn("__n", F.row_number().over(turn)).filter(F.col("__n") <= limits.seeds)
    seeds = kept(seeds.select("query_id", "seed_rank", "tier", F.col("atom_id").alias("seed")).join(queries.select("query_id", "target"), "query_id"))
    how = {"relations": relations, "confidences": confidences}
    owner = entities.select(F.col("entity_id").alias("source"), "owner").dropDuplicates(["source"])
    ends = ["atom_id", "source", "target"]
    proof = kept(assertions.select(F.col("assertion_id").cast("string").alias("atom_id"), "source", "target", "path", _span().alias("sources")).dropDuplicates(ends).join(owner, "source", "left"))

    around = seeds.filter("target is null").drop("target")
    _, edges, ended = graph.traverse(assertions, around.select("seed").distinct(), limits.depth, max_nodes=limits.nodes, max_edges=limits.edges, order=True, **how)
    steps = around.join(edges.select("seed", "at", F.col("assertion_id").cast("string").alias("atom_id"), "source", "target", (F.col("distance") + 1).alias("distance")), "seed")
    steps = steps.join(proof, ends).withColumn("kind", F.lit("relationship")).select(*_ATOM, "at")

    aimed = seeds.filter("target is not null")
    ways = kept(graph.shortest_paths(assertions, aimed.select("seed", "target").distinct(), limits.depth, **how))
    hops = ways.filter("nodes is not null").select("seed", F.col("target").alias("__aim"), "distance", "nodes", F.posexplode_outer("hops").alias("__i", "__hop"))
    hops = hops.withColumns({"atom_id": F.col("__hop").cast("string"), "source": F.get("nodes", F.col("__i")), "target": F.get("nodes", F.col("__i") + 1)})
    hops = hops.join(proof.select(*ends, F.col("sources")[0].alias("__s")), ends, "left").drop("target").withColumnRenamed("__aim", "target")
    listed = F.sort_array(F.collect_list(F.when(F.col("__hop").isNotNull(), F.struct("__i", "__s", "atom_id"))))
    whole = hops.groupBy("seed", "target", "distance").agg(listed.alias("__h"))
    here = entities.select(F.col("entity_id").alias("seed"), "path", "owner").dropDuplicates(["seed"])
    whole = aimed.join(whole, ["seed", "target"]).join(here, "seed").withColumn("kind", F.lit("path")).withColumn("sources", F.transform("__h", lambda h: h["__s"]).cast(_SOURCES))
    whole = whole.withColumn("atom_id", F.concat_ws(" ", "seed", F.array_join(F.transform("__h", lambda h: h["atom_id"]), " "))).select(*_ATOM)

    found = around.join(ended, "seed").unionByName(aimed.join(ways.select("seed", "target", "outcome", "stop_reason"), ["seed", "target"]).drop("target"))
    found = kept(found.select("query_id", "seed_rank", "seed", "outcome", "stop_reason"))

    # everything in its turn: candidates, then for each seed its frontier and what it leads to
    none = F.lit(None).cast(dict(steps.dtypes)["at"]).alias("at")
    size = atom_bytes().alias("__size")
    row = lambda d, phase, kind, at: d.select(F.lit(phase).alias("__phase"), F.lit(kind).alias("__atom"), at, size, *_ATOM)
    mark = found.withColumns({"kind": F.lit("frontier"), "atom_id": F.col("seed"), "tier": F.lit(0), "distance": F.lit(0), "path": F.col("outcome"), "owner": F.col("stop_reason"), "sources": F.array().cast(_SOURCES)})
    every = row(first, 0, 1, none).unionByName(row(mark, 1, 0, none)).unionByName(row(steps, 1, 1, F.col("at"))).unionByName(row(whole, 1, 1, none))
    w = Window.partitionBy("query_id").orderBy("__phase", "seed_rank", "__atom", "at", "kind", "atom_id").rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("__n", F.sum("__atom").over(w)).withColumn("__spent", F.sum("__size").over(w))
    over = F.when(F.col("__n") > limits.atoms, "bundle_limit").when(F.col("__spent") > limits.bytes, "collection_limit")
    every = kept(every.withColumn("__over", over).withColumn("__turn", F.row_number().over(w)))
    stop = every.filter("__over is not null").groupBy("query_id").agg(F.min_by("__over", "__turn").alias("stop_reason"))
    outcomes = queries.select("query_id").distinct().join(stop, "query_id", "left")

    admitted = every.filter("__over is null and __atom = 1")
    there = files.select("path", F.octet_length("content").cast("long").alias("__bytes"))
    spans = admitted.select("query_id", "kind", "atom_id", "seed_rank", F.posexplode("sources").alias("source_no", "__s")).select("query_id", "kind", "atom_id", "seed_rank", "source_no", "__s.*")
    spans = spans.join(there, "path", "left").withColumn("__there", F.coalesce(F.col("start_byte").isNotNull() & (F.col("end_byte") <= F.col("__bytes")), F.lit(False)))
    known = spans.groupBy("query_id", "kind", "atom_id").agg(F.max("__there").alias("__there"))
    kind_no = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    # the same atom from several seeds counts once, at its best rank
    ranked = admitted.join(known, ["query_id", "kind", "atom_id"], "left").withColumn("rank", F.struct("tier", "seed_rank", "distance", (~F.coalesce("__there", F.lit(False))).alias("unavailable"), kind_no.alias("kind_no")))
    ranked = kept(ranked.groupBy("query_id", "kind", "atom_id").agg(F.min("rank").alias("rank"), F.min_by(F.struct("path", "owner"), "rank").alias("__p")).select("query_id", "kind", "atom_id", "rank", "__p.*"))
    key = F.struct("kind", "atom_id")
    order = text.diversified(ranked.select("query_id", key.alias("atom_id"), "rank", "path", "owner", ((F.col("kind") == "definition") & (F.col("rank.tier") < len(TIERS) - 1)).alias("exact")), limits.atoms)
    atoms = kept(order.select("query_id", "atom_id.*", "place").join(ranked, ["query_id", "kind", "atom_id"]).select("query_id", "place", "kind", "atom_id", "rank.tier", "rank.seed_rank", "rank.distance", "path", "owner"))

    mine = spans.join(atoms.select("query_id", "kind", "atom_id", "place"), ["query_id", "kind", "atom_id"]).dropDuplicates(["query_id", "place", "source_no"])
    mine = kept(mine.select("query_id", "place", "source_no", "path", "start_byte", "end_byte", "__there"))
    # the spans of a query are as many as its atoms and their hops; each takes from what those before it left
    turns = F.sort_array(F.collect_list(F.struct("place", "source_no", (F.col("end_byte") - F.col("start_byte")).alias("size"), "__there")))
    empty = F.struct(F.lit(limits.inline).cast("long").alias("left"), F.array().cast("array<struct<place:int,source_no:int,reason:string>>").alias("out"))

    def take(acc: Column, s: Column) -> Column:
        ok = s["__there"] & (s["size"] <= acc["left"])
        reason = F.when(~s["__there"], "source_unavailable").when(~ok, "inline_budget")
        entry = F.struct(s["place"].cast("int").alias("place"), s["source_no"].cast("int").alias("source_no"), reason.alias("reason"))
        return F.struct(F.when(ok, acc["left"] - s["size"]).otherwise(acc["left"]).alias("left"), F.concat(acc["out"], F.array(entry)).alias("out"))

    chosen = mine.groupBy("query_id").agg(turns.alias("__t")).select("query_id", F.inline(F.aggregate("__t", empty, take)["out"]))
    got = mine.drop("__there").join(chosen, ["query_id", "place", "source_no"])
    raw = F.when(F.col("reason").isNull(), F.substring(F.col("content"), F.col("start_byte").cast("int") + 1, (F.col("end_byte") - F.col("start_byte")).cast("int")))
    got = got.join(files.select("path", "content"), "path", "left").withColumn("__raw", raw)
    utf8 = F.is_valid_utf8(F.col("__raw").cast("string"))
    sources = got.select("query_id", "place", "source_no", "path", "start_byte", "end_byte", "reason", F.when(utf8, "utf8").when(~utf8, "base64").alias("encoding"), F.when(utf8, F.col("__raw").cast("string")).when(~utf8, F.base64("__raw")).alias("inline"))
    return Context(atoms, sources, found, outcomes)
