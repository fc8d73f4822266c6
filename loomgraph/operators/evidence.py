"""Provenance records, validation of references, status, and the composite analyses built on the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars
from loomgraph.operators.tables import kept
from loomgraph.operators import graph, overlays, text


def own_kinds(entities: DataFrame) -> DataFrame:
    """Entities that come from sources, not from imported indexes or coverage runs."""
    return entities.filter(~F.col("kind").like("scip\\_%") & (F.col("kind") != "coverage_test"))


def proofs(assertions: DataFrame, evidence: DataFrame, occurrences: DataFrame, producers: DataFrame) -> DataFrame:
    """Assertions with the evidence, occurrence and producer that prove them; a proof whose byte ranges differ is dropped.

    Keys: assertion.evidence_id, evidence.(occurrence_id, producer_id, start_byte, end_byte), occurrence.(start_byte, end_byte).
    """
    o = occurrences.select("occurrence_id", F.col("start_byte").alias("__a"), F.col("end_byte").alias("__b"), "path", "line")
    d = assertions.join(evidence, "evidence_id").join(o, "occurrence_id").join(producers, "producer_id")
    return d.filter((F.col("start_byte") == F.col("__a")) & (F.col("end_byte") == F.col("__b"))).drop("__a", "__b")


def dangling(assertions: DataFrame, entities: DataFrame) -> DataFrame:
    """(assertion_id, side): endpoints that no entity has; must be empty in a valid store."""
    e = entities.select(F.col("entity_id").alias("__e"))
    one = assertions.join(e, F.col("source_id") == F.col("__e"), "left_anti").select("assertion_id", F.lit("source").alias("side"))
    two = assertions.filter("target_id is not null").join(e, F.col("target_id") == F.col("__e"), "left_anti").select("assertion_id", F.lit("target").alias("side"))
    return one.unionByName(two)


def same_name_tests(refs: DataFrame, entities: DataFrame, changed: DataFrame) -> DataFrame:
    """(name, test, line): tests that spell the name of a changed entity; the first reference of each."""
    r = refs.join(changed.select("name").distinct(), refs["callee_name"] == F.col("name")).select("name", "source_id", "line", "assertion_id")
    t = entities.filter("is_test").select(F.col("entity_id").alias("source_id"), F.col("name").alias("test"))
    return r.join(t, "source_id").groupBy("name", "test").agg(F.min(F.struct("line", "assertion_id")).alias("__f")).select("name", "test", F.col("__f.line").alias("line"))


def boundaries(names: DataFrame, refs: DataFrame) -> DataFrame:
    """(name, unresolved, ambiguous, complete): what about a name's references is not known."""
    n = refs.groupBy(F.col("callee_name").alias("name")).agg(F.count_if(F.col("confidence").isNull()).alias("__u"), F.count_if(F.col("confidence") == "AMBIGUOUS").alias("__a"))
    d = names.select("name").distinct().join(n, "name", "left")
    u, a = F.coalesce("__u", F.lit(0)), F.coalesce("__a", F.lit(0))
    return d.select("name", u.alias("unresolved"), a.alias("ambiguous"), ((u == 0) & (a == 0)).alias("complete"))


def digest(df: DataFrame, line: Column, by: list[str]) -> DataFrame:
    """Content digest of each group's record lines, whatever their order: a tree of 65,536 pieces by the lines' own hash, 256 of
    them to a branch, so that a piece is a small share of the largest group."""
    joined = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), ""), 256)
    leaf = df.select(*by, F.sha2(line, 256).alias("__h")).groupBy(*by, F.substring("__h", 1, 4).alias("__p")).agg(joined("__h").alias("__d"))
    branch = leaf.groupBy(*by, F.substring("__p", 1, 2).alias("__b")).agg(joined(F.concat("__p", "__d")).alias("__d"))
    return branch.groupBy(*by).agg(joined(F.concat("__b", "__d")).alias("digest"))


def status(files: DataFrame) -> DataFrame:
    """Files by language and state: (lang, indexed, failed, unsupported, disabled, complete)."""
    states = ("indexed", "failed", "unsupported", "disabled")
    d = files.groupBy("lang").agg(*[F.count_if(F.col("state") == s).alias(s) for s in states])
    return d.withColumn("complete", F.col("failed") == 0)


def projected_facts(facts: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active, historical): facts of indexed files, and those kept of files that fail to parse now; never mixed."""
    f = facts.join(files.select("path", "state"), "path")
    return f.filter("state = 'indexed'").drop("state"), f.filter("state = 'failed'").drop("state")


def cache_misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files that the extraction cache does not hold under the same source, path, language and version."""
    return files.join(cache, ["sha256", "path", "lang", "version"], "left_anti")


def superseded(old: DataFrame, new: DataFrame, cap: int) -> DataFrame:
    """Ids that a new overlay no longer has, the first ``cap`` in order."""
    return old.select("id").distinct().join(new.select("id").distinct(), "id", "left_anti").orderBy("id").limit(cap)


def excerpts(texts: DataFrame) -> DataFrame:
    """(sha256, content): each distinct text once, under its digest."""
    return texts.filter("text is not null").select(F.sha2("text", 256).alias("sha256"), F.col("text").alias("content")).dropDuplicates(["sha256"])


def cross_repo_impact(changed: DataFrame, links: DataFrame, reverse: bool = False) -> DataFrame:
    """(id, other, kind) one step along the links of package consumers to providers, or back."""
    here, there = ("provider", "consumer") if reverse else ("consumer", "provider")
    return links.join(changed.select(F.col("id").alias(here)), here, "left_semi").select(F.col(here).alias("id"), F.col(there).alias("other"), "kind").distinct()


def validation_plan(spans: DataFrame, executions: DataFrame, structural: DataFrame, same_name: DataFrame, observed: DataFrame, stale: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recommended tests per changed span, state per span).

    ``spans`` (path, span_id, start, stop, header_end); ``structural`` (span_id, test, distance) from reverse paths;
    ``same_name`` (span_id, test). State: observed, structural_only or gap, with the coverage state as its reason.
    """
    c = overlays.covered_spans(executions, spans)
    none = F.lit(0).cast("long")
    seen = c.select("span_id", "test", F.when(F.col("body"), 0).otherwise(2).alias("basis"), F.lit(1).cast("long").alias("spans"), F.col("lines").cast("long").alias("body_lines"), none.alias("distance"))
    path = structural.select("span_id", "test", F.lit(3).alias("basis"), none.alias("spans"), none.alias("body_lines"), F.col("distance").cast("long").alias("distance"))
    name = same_name.select("span_id", "test", F.lit(4).alias("basis"), none.alias("spans"), none.alias("body_lines"), none.alias("distance"))
    plan = overlays.recommendations(seen.unionByName(path).unionByName(name))
    state = overlays.coverage_state(spans, c, observed, stale).withColumnRenamed("state", "reason")
    best = plan.groupBy("span_id").agg(F.min("basis").alias("__b"))
    state = state.join(best, "span_id", "left").withColumn("state", overlays.first_of((F.col("__b") <= 2, "observed"), (F.col("__b").isNotNull(), "structural_only"), default="gap")).drop("__b")
    return plan, state


def retrieval_coverage(files: DataFrame) -> DataFrame:
    """(reason, files, bytes) of what retrieval covers and leaves out: reason null for sources that are searched.

    ``files`` (path, state, content): a file that is not indexed counts as ``observation_`` and its state, an indexed one
    whose bytes are no UTF-8 as ``non_utf8``.
    """
    reason = F.when(F.col("state") != "indexed", F.concat(F.lit("observation_"), "state")).when(~F.is_valid_utf8(F.col("content").cast("string")), "non_utf8")
    return files.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("bytes"))


def binding_units(*paths: DataFrame) -> DataFrame:
    """(path): each path of the given tables (files, rationale comments, references, imports) once."""
    out = paths[0].select("path")
    for p in paths[1:]:
        out = out.union(p.select("path"))
    return out.filter("path is not null").distinct()


def context_pack(docs: DataFrame, queries: DataFrame, budget: int, most: int = 128) -> DataFrame:
    """(query_id, doc_id, place, spent): retrieved texts in diversity order, whole ones only, as long as they fit ``budget`` bytes.

    ``docs`` (doc_id, text, path, owner); ``queries`` (query_id, query, anchor: the doc_id of an exact definition, or null).
    """
    ranked = text.bm25(docs.select("doc_id", "text"), queries.select("query_id", "query"), top=most)
    a = ranked.join(docs.select("doc_id", "path", "owner", F.octet_length("text").alias("__n")), "doc_id").join(queries.select("query_id", "anchor"), "query_id")
    order = text.diversified(a.select("query_id", F.col("doc_id").alias("atom_id"), "rank", "path", "owner", F.coalesce(F.col("doc_id") == F.col("anchor"), F.lit(False)).alias("exact")), most)
    sized = order.withColumnRenamed("atom_id", "doc_id").join(docs.select("doc_id", F.octet_length("text").alias("__n")), "doc_id")
    w = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return sized.withColumn("spent", F.sum("__n").over(w)).filter(F.col("spent") <= budget).select("query_id", "doc_id", "place", "spent")


def raw_changes(log: DataFrame) -> DataFrame:
    """(commit_id, parents, path, mode, status) from the raw diff records of a history walk.

    ``log`` (commit_id, parents, raw): NUL-separated records ``:old new sha sha status`` NUL ``path``. A rename counts as both
    its paths; paths that are no relative UTF-8 paths are left out.
    """
    parts = F.filter(F.split("raw", "\\x00"), lambda p: p != "")
    d = log.select("commit_id", "parents", parts.alias("all"))
    # each part goes on with the two before it only
    near = F.transform("all", lambda x, i: F.struct(x.alias("part"), F.get("all", i - 1).alias("one"), F.get("all", i - 2).alias("two")))
    d = d.select("commit_id", "parents", F.inline(near))
    head, one, two = F.col("part").startswith(":"), F.col("one"), F.col("two")
    owner = F.when(~head, F.coalesce(F.when(one.startswith(":"), one), F.when(two.startswith(":"), two)))
    f = F.split(F.substring(owner, 2, 1 << 20), " ")
    return d.filter(owner.isNotNull()).select("commit_id", "parents", F.col("part").alias("path"), F.when(f[1] == "000000", f[0]).otherwise(f[1]).alias("mode"), F.substring(f[4], 1, 1).alias("status")).filter(scalars.relative_path(F.col("path")))


def community_quality(assertions: DataFrame) -> DataFrame:
    links = kept(assertions.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct())
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    return graph.quality(graph.communities(nodes, links), links)
