"""External evidence joined onto snapshots: coverage, traces, history, contracts, packages, decisions, feedback, frameworks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars
from loomgraph.operators.intervals import overlapping


def first_of(*cases: tuple[Column, str], default: str | None = None) -> Column:
    """The name of the first condition that holds."""
    out = None
    for cond, name in cases:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(default)


# coverage


def covered_spans(executions: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, span_id, test, lines, body): tests that ran a line of a span; ``body`` if any line is after the header's end.

    ``executions`` (path, line_from, line_to exclusive, test); ``spans`` (path, span_id, start, stop exclusive, header_end).
    """
    # a test runs the same lines many times: equal executions become one, with their number, before they meet spans
    runs = executions.groupBy("path", "line_from", "line_to", "test").agg(F.count(F.lit(1)).alias("__runs"))
    met = overlapping(runs, spans, "path", ("line_from", "line_to"), ("start", "stop"))
    lines = F.least("line_to", "stop") - F.greatest("line_from", "start")
    body = F.greatest("line_to", F.col("line_from") + 1) - 1 > F.col("header_end")
    return met.groupBy("path", "span_id", "test").agg(F.sum(F.greatest(lines, F.lit(1)) * F.col("__runs")).alias("lines"), F.bool_or(body).alias("body"))


def coverage_state(spans: DataFrame, covered: DataFrame, observed_files: DataFrame, stale_files: DataFrame, listed_files: DataFrame | None = None) -> DataFrame:
    """(path, span_id, state) by precedence: not_applicable, unsupported_language, observation_limit, executed, declaration_only,
    no_observation_in_span, no_observation_in_file, stale_only, no_coverage_source.

    ``spans`` may tell whether a span is applicable, its language supported, and its observations cut off (limited).
    ``listed_files`` are files that a source knows, with or without observations.
    """
    flag = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in spans.columns else F.lit(default)
    listed = observed_files if listed_files is None else listed_files
    c = covered.groupBy("path", "span_id").agg(F.bool_or("body").alias("__body"))
    d = spans.join(c, ["path", "span_id"], "left").join(observed_files.select("path", F.lit(True).alias("__seen")).distinct(), "path", "left").join(stale_files.select("path", F.lit(True).alias("__stale")).distinct(), "path", "left")
    d = d.join(listed.select("path", F.lit(True).alias("__listed")).distinct(), "path", "left")
    state = first_of(
        (~flag("applicable", True), "not_applicable"), (~flag("supported", True), "unsupported_language"), (flag("limited", False), "observation_limit"), (F.coalesce("__body", F.lit(False)), "executed"), (F.col("__body").isNotNull(), "declaration_only"),
        (F.col("__seen"), "no_observation_in_span"), (F.col("__listed"), "no_observation_in_file"), (F.col("__stale"), "stale_only"), default="no_coverage_source",
    )
    return d.select("path", "span_id", state.alias("state"))


#: Why a span without observed tests has none, by coverage state and by structural state.
COVERAGE_REASONS = {
    "no_observation_in_span": "no_observation_in_span", "no_observation_in_file": "no_observation_in_file", "no_coverage_source": "no_coverage_source", "observation_limit": "observation_limit",
    "unsupported_language": "unsupported_language", "stale_only": "stale_coverage_only", "declaration_only": "declaration_only_execution",
}
STRUCTURAL_REASONS = {"none": "no_structural_test", "incomplete": "structural_discovery_incomplete", "unsupported_language": "unsupported_language"}


def gap_reasons(coverage: Column, structural: Column) -> Column:
    """Sorted array of the reasons that a coverage state and a structural state (found, incomplete, unsupported_language, none) give."""
    name = lambda names, c: F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[c]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(name(COVERAGE_REASONS, coverage), name(STRUCTURAL_REASONS, structural)))))


def observations(rows: DataFrame) -> DataFrame:
    """(test, path, line, phases): the sorted set of phases in which a test ran a line; no test: the line is unattributed."""
    return rows.groupBy("test", "path", "line").agg(F.sort_array(F.collect_set("phase")).alias("phases"))


# traces


def span_parents(spans: DataFrame) -> DataFrame:
    """Spans with their place: root, child, or boundary (the parent is not in the trace)."""
    p = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("__there"))
    d = spans.join(p, ["trace_id", "parent_id"], "left")
    return d.withColumn("place", first_of((F.col("parent_id").isNull(), "root"), (F.col("__there"), "child"), default="boundary")).drop("__there")


def linkage(spans: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Linkage class of each span by precedence, from its file and line attributes.

    ``spans`` (span_id, file, line, build_ok); ``files`` (path, indexed, n_lines, symbol_until).
    """
    inside = F.col("file").startswith(root)
    d = spans.withColumn("path", F.when(inside, F.substring("file", len(root) + 1, 1 << 20))).join(files, "path", "left")
    line = F.expr("try_cast(line AS bigint)")
    return d.select("span_id", first_of(
        (F.col("file").isNull() | F.col("line").isNull(), "missing"), (line.isNull() | (line < 1), "malformed"), (~F.col("build_ok"), "build_mismatch"), (~inside, "path_outside_root"),
        (F.col("n_lines").isNull(), "file_not_in_snapshot"), (~F.col("indexed"), "file_not_indexed"), (line > F.col("n_lines"), "line_out_of_range"), (line <= F.col("symbol_until"), "linked_symbol"), default="linked_file",
    ).alias("linkage"))


def trace_summary(spans: DataFrame) -> DataFrame:
    p = span_parents(spans)
    return p.agg(F.count(F.lit(1)).alias("spans"), F.countDistinct("trace_id").alias("traces"), F.count_if(F.col("place") == "root").alias("roots"), F.count_if(F.col("place") == "boundary").alias("orphans"))


#: How a span is linked to the sources, or why not.
LINKAGES = ("linked_symbol", "linked_file", "missing", "malformed", "build_mismatch", "path_outside_root", "file_not_in_snapshot", "file_not_indexed", "line_out_of_range")


def linkage_counts(links: DataFrame) -> DataFrame:
    """(linkage, spans) of every class of :func:`linkage`, those that do not occur with 0."""
    every = links.sparkSession.createDataFrame([(x,) for x in LINKAGES], "linkage string")
    n = links.groupBy("linkage").agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, "linkage", "left").select("linkage", F.coalesce("n", F.lit(0)).cast("long").alias("spans"))


# history


#: Pieces of a shuffle partition that commits are dealt to: a task holds the distinct paths of its commits.
PIECES = 8


def commit_classes(commits: DataFrame, bulk: int, prefixes: tuple[str, ...] = (), names: tuple[str, ...] = (), suffixes: tuple[str, ...] = (), most_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Eligible (commit_id, path) rows, and (commit_id, n, class): merge, oversized, bulk, empty, single or pair.

    With ``most_bytes`` a commit whose diff (column diff_bytes) is larger is oversized. Generated paths and links to other repositories (mode 160000) go before the size is taken.
    """
    n = PIECES * int(commits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    commits = commits.repartition(n, "commit_id")
    keep = ~scalars.generated(F.col("path"), prefixes, names, suffixes) & (F.col("mode") != "160000")
    per = commits.groupBy("commit_id").agg(F.max("parents").alias("parents"), F.countDistinct(F.when(keep, F.col("path"))).alias("n"), F.max((F.col("diff_bytes") > most_bytes) if most_bytes is not None else F.lit(False)).alias("__large"))
    per = per.withColumn("class", first_of((F.col("parents") > 1, "merge"), (F.col("__large"), "oversized"), (F.col("n") > bulk, "bulk"), (F.col("n") == 0, "empty"), (F.col("n") == 1, "single"), default="pair"))
    return commits.filter(keep).select("commit_id", "path").distinct(), per.drop("parents", "__large")


def co_change(commits: DataFrame, bulk: int, **generated) -> DataFrame:
    """(a, b, support, commits): pairs of paths changed together; a commit has ``bulk`` paths at most, so pairs stay linear in commits."""
    rows, classes = commit_classes(commits, bulk, **generated)
    r = rows.join(classes.filter("class = 'pair'").select("commit_id"), "commit_id", "left_semi")
    # no more than ``bulk`` paths a commit: the pairs come from their array, without a second look at the rows
    r = r.groupBy("commit_id").agg(F.sort_array(F.collect_list("path")).alias("__paths")).select("commit_id", "__paths", F.posexplode("__paths").alias("__i", "a"))
    p = r.select("commit_id", "a", F.explode(F.slice("__paths", F.col("__i") + 2, F.size("__paths"))).alias("b"))
    return p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("support"), F.sort_array(F.collect_list("commit_id")).alias("commits"))


def history_gaps(commits: DataFrame, parents: DataFrame, start: object) -> DataFrame:
    """(commit_id, parent_id): links of the window's commits to parents that the listing lacks. ``start`` lies outside the window."""
    known = commits.select(F.col("commit_id").alias("parent_id")).distinct()
    inside = parents.join(commits.select("commit_id").distinct(), "commit_id", "left_semi")
    return inside.filter(F.col("parent_id") != F.lit(start)).join(known, "parent_id", "left_anti").select("commit_id", "parent_id")


def co_change_overlay(commits: DataFrame, parents: DataFrame, start: object, bulk: int, truncated: bool = False, **generated) -> tuple[DataFrame, list[str]]:
    """Co-change records of the window after ``start``, and the reasons why they are withheld.

    A history that is not whole supports no count: where a parent is missing (object_missing) or the listing was cut off
    (commit_budget_exhausted) there are no records at all. ``parents`` (commit_id, parent_id).
    """
    window = commits.filter(F.col("commit_id") != F.lit(start))
    reasons = ["commit_budget_exhausted"] * truncated + ["object_missing"] * (not history_gaps(window, parents, start).isEmpty())
    records = co_change(window, bulk, **generated)
    return (records.limit(0) if reasons else records), sorted(reasons)


# contracts


def contract_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, method, kind): operation_removed, operation_added, newly_required_parameter or review_required.

    Sides have path, method, required (set of parameter keys), digest, complete. An identity that occurs twice on a side is
    ambiguous and goes to review, like an incomplete one.
    """
    keys = ["path", "method"]

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{s}_n"), F.min("required").alias(f"{s}_req"), F.min("digest").alias(f"{s}_dig"), F.bool_and("complete").alias(f"{s}_ok"))

    j = side(before, "b").join(side(after, "a"), keys, "full_outer")
    odd = (F.coalesce("b_n", F.lit(1)) > 1) | (F.coalesce("a_n", F.lit(1)) > 1) | ~F.coalesce("b_ok", F.lit(True)) | ~F.coalesce("a_ok", F.lit(True))
    kind = first_of(
        (odd, "review_required"), (F.col("a_n").isNull(), "operation_removed"), (F.col("b_n").isNull(), "operation_added"), (F.size(F.array_except("a_req", "b_req")) > 0, "newly_required_parameter"), (F.col("a_dig") != F.col("b_dig"), "review_required")
    )
    return j.select(*keys, kind.alias("kind")).filter("kind is not null")


#: Kinds of contract findings.
FINDING_KINDS = ("operation_removed", "newly_required_parameter", "review_required", "operation_added")


def finding_counts(findings: DataFrame) -> DataFrame:
    """(kind, n, action) of every kind of finding, those that do not occur with 0."""
    kinds = findings.sparkSession.createDataFrame([(k, "informational" if k == "operation_added" else "review") for k in FINDING_KINDS], "kind string, action string")
    n = findings.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(n, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "action")


# packages


def provider_links(refs: DataFrame, packages: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref_id, resolution, path) of import references to another repository's package.

    ``refs`` (ref_id, form_ok, shadowed, package, version, module, name, kind); ``packages`` (package, version, available);
    ``symbols`` (package, module, name, kind, path, reexported, rebound); a re-exported row is an import of the provider's
    module, no declaration. One fixed precedence.
    """
    pk = packages.groupBy("package", "version").agg(F.bool_or("available").alias("__av"))
    declared = F.when(~F.col("reexported"), F.struct("kind", "path"))
    sy = symbols.groupBy("package", "module", "name").agg(F.count(declared).alias("__n"), F.min(declared).alias("__d"), F.bool_or(F.col("rebound") & ~F.col("reexported")).alias("__rb"))
    d = refs.join(pk, ["package", "version"], "left").join(sy, ["package", "module", "name"], "left")
    res = first_of(
        (~F.col("form_ok"), "unsupported_reference_form"), (F.col("shadowed"), "local_module_shadow"), (F.col("__av").isNull(), "version_mismatch"), (~F.col("__av"), "provider_snapshot_unavailable"),
        (F.col("__n") > 1, "ambiguous_provider_symbol"), (F.col("__n").isNull(), "not_declared"), (F.col("__n") == 0, "re_export"), (F.col("kind") != F.col("__d.kind"), "kind_mismatch"), (F.col("__rb"), "rebound"), default="linked",
    )
    return d.select("ref_id", res.alias("resolution"), F.when(res == "linked", F.col("__d.path")).alias("path"))


def package_binding(wanted: DataFrame, locked: DataFrame) -> DataFrame:
    """(coordinate, outcome) by the first check that fails: coordinate, artifact, lock, environment, provider, sources; else bound."""
    d = wanted.join(locked.withColumn("__there", F.lit(True)), "coordinate", "left")
    same = lambda c: F.col(c) != F.col(f"locked_{c}")
    outcome = first_of((F.col("__there").isNull(), "coordinate"), (same("artifact"), "artifact"), (same("lock"), "lock"), (same("environment"), "environment"), (~F.col("provider"), "provider"), (same("sources"), "sources"), default="bound")
    return d.select("coordinate", outcome.alias("outcome"))


# decisions


def decision_links(mappings: DataFrame, documents: DataFrame, entities: DataFrame) -> DataFrame:
    """(mapping_id, reason): why a mapping from a decision's span to a declaration is refused; null if it is accepted.

    ``mappings`` (mapping_id, path, sha, start, stop, span_sha, target_path, target_kind, target_name); ``documents`` (path,
    sha, text); ``entities`` (path, kind, name).
    """
    d = mappings.join(documents.select("path", F.col("sha").alias("__sha"), "text"), "path", "left")
    e = entities.groupBy(F.col("path").alias("target_path"), F.col("name").alias("target_name")).agg(F.count(F.lit(1)).alias("__n"), F.collect_set("kind").alias("__kinds"))
    d = d.join(e, ["target_path", "target_name"], "left")
    span = F.expr("substring(encode(text, 'UTF-8'), start + 1, stop - start)")
    reason = first_of(
        (F.col("__sha").isNull(), "document_not_in_snapshot"), (F.col("__sha") != F.col("sha"), "document_digest_mismatch"), (F.col("stop") > F.octet_length("text"), "span_out_of_range"), (~F.is_valid_utf8(span), "span_not_utf8"), (F.sha2(span, 256) != F.col("span_sha"), "span_digest_mismatch"),
        (F.col("__n").isNull(), "target_not_found"), (~F.col("target_kind").isin("class", "function", "method", "module"), "target_kind_unsupported"), (~F.array_contains("__kinds", F.col("target_kind")), "target_descriptor_mismatch"), (F.col("__n") > 1, "target_definition_ambiguous"),
    )
    return d.select("mapping_id", reason.alias("reason"))


def drift(mappings: DataFrame, changes: DataFrame, documents: DataFrame) -> DataFrame:
    """(mapping_id, outcome, reason): whether the decision behind a declaration needs a look.

    ``changes`` (entity_id, category, failed, and if known path_partial and ordinal_shift); ``documents`` (path, changed). A
    changed source with an unchanged decision is review_needed; what is not known, or named by a number among siblings that
    shifted, is unknown_history; a missing decision is unresolved.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in changes.columns else F.lit(False)
    d = mappings.join(changes, "entity_id", "left").join(documents.withColumn("__doc", F.lit(True)), "path", "left")
    reason = first_of(
        (F.col("failed"), "file_failed"), (F.col("category").isNull(), "unconfirmed"), (F.col("category") == "unknown", "change_unknown"), (flag("path_partial"), "path_partial"), (flag("ordinal_shift"), "ordinal_shift"), (F.col("category") == "removed", "target_removed"), (F.col("__doc").isNull(), "document_missing"),
        (F.col("category").isin("signature", "body") & ~F.col("changed"), "source_changed"), (F.col("category").isin("signature", "body"), "both_changed"), default="source_unchanged",
    )
    outcome = first_of((reason.isin("file_failed", "unconfirmed", "change_unknown", "path_partial", "ordinal_shift"), "unknown_history"), (reason.isin("target_removed", "document_missing"), "unresolved"), (reason == "source_changed", "review_needed"), default="no_finding")
    return d.select("mapping_id", outcome.alias("outcome"), reason.alias("reason"))


# feedback


def feedback_classes(events: DataFrame, files: DataFrame, generation: str) -> DataFrame:
    """Events with why they do not count: path_not_indexed, source_fingerprint_mismatch, generation_mismatch; null if active."""
    d = events.join(files.select("path", F.col("sha").alias("__sha")), "path", "left")
    return d.withColumn("excluded", first_of((F.col("__sha").isNull(), "path_not_indexed"), (F.col("__sha") != F.col("sha"), "source_fingerprint_mismatch"), (F.col("generation") != generation, "generation_mismatch"))).drop("__sha")


def feedback_order(items: DataFrame, events: DataFrame) -> DataFrame:
    """(query_id, item, delta, place): items move up by the distinct artifacts that verified them, three places at most; the first stays.

    ``items`` (query_id, item, pos from 0); ``events`` (item, artifact, selector, outcome, excluded).
    """
    e = events.filter("excluded is null and outcome = 'passed'").groupBy("item").agg(F.least(F.lit(3), F.countDistinct("artifact", "selector")).cast("int").alias("delta"))
    d = items.join(e, "item", "left").withColumn("delta", F.when(F.col("pos") == 0, 0).otherwise(F.coalesce("delta", F.lit(0))))
    w = Window.partitionBy("query_id").orderBy((F.col("pos") != 0).cast("int"), F.col("pos") - F.col("delta"), -F.col("delta"), "pos", "item")
    return d.withColumn("place", F.row_number().over(w) - 1).select("query_id", "item", "delta", "place")


def merged_events(events: DataFrame, key: list[str], value: str) -> DataFrame:
    """One row per key; a key with different values is a conflict."""
    d = events.groupBy(*key).agg(F.min(value).alias(value), F.countDistinct(value).alias("__n"))
    return d.withColumn("conflict", F.col("__n") > 1).drop("__n")


# frameworks


def routes(declared: DataFrame, methods: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(route_id, outcome, path): the action method of a route's controller.

    ``declared`` (route_id, controller, action); ``methods`` (owner, name, path, and category if known). Unique: INFERRED, several
    files: AMBIGUOUS. Of methods with a category only those of instances count. With ``classes`` (owner, path) a controller is
    there if it is declared, and an action counts only in a file that declares its controller.
    """
    d = declared.withColumn("owner", F.concat(scalars.camelize(F.col("controller")), F.lit("Controller")))
    own = (methods if classes is None else classes).groupBy("owner").agg(F.lit(True).alias("__there"))
    if "category" in methods.columns:
        methods = methods.filter("category = 'instance'")
    if classes is not None:
        methods = methods.join(classes.select("owner", "path").distinct(), ["owner", "path"], "left_semi")
    m = methods.groupBy("owner", F.col("name").alias("action")).agg(F.countDistinct("path").alias("__n"), F.min("path").alias("path"))
    d = d.join(own, "owner", "left").join(m, ["owner", "action"], "left")
    outcome = first_of((F.col("__there").isNull(), "CONTROLLER_NOT_FOUND"), (F.col("__n").isNull(), "ACTION_NOT_FOUND"), (F.col("__n") > 1, "AMBIGUOUS"), default="INFERRED")
    return d.select("route_id", outcome.alias("outcome"), F.when(outcome == "INFERRED", F.col("path")).alias("path"))


def associations(declared: DataFrame, models: DataFrame) -> DataFrame:
    """(assoc_id, outcome, model): the model that an association names; candidate names go through the owner's namespaces.

    Unique only if exactly one candidate name exists and one model has it.
    """
    parts = F.split("owner", "::")
    names = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.regexp_replace(F.concat_ws("::", F.array_join(F.slice(parts, 1, F.size(parts) - k), "::"), F.col("name")), "^::", ""))
    c = declared.select("assoc_id", F.explode(F.array_distinct(names)).alias("model"))
    m = models.groupBy(F.col("name").alias("model")).agg(F.count(F.lit(1)).alias("__m"))
    hit = c.join(m, "model").groupBy("assoc_id").agg(F.count(F.lit(1)).alias("__names"), F.sum("__m").alias("__rows"), F.min("model").alias("model"))
    d = declared.select("assoc_id").join(hit, "assoc_id", "left")
    outcome = first_of((F.col("__names").isNull(), "UNRESOLVED"), (F.col("__rows") == 1, "INFERRED"), default="AMBIGUOUS")
    return d.select("assoc_id", outcome.alias("outcome"), F.when(outcome == "INFERRED", F.col("model")).alias("model"))


def jobs(enqueued: DataFrame, performs: DataFrame) -> DataFrame:
    """(call_id, outcome): the perform method behind an enqueue call, with its positional arity.

    ``enqueued`` (call_id, job, method, args); ``performs`` (job, required, optional).
    """
    p = performs.groupBy("job").agg(F.count(F.lit(1)).alias("__n"), F.min("required").alias("__lo"), (F.min("required") + F.min("optional")).alias("__hi"))
    d = enqueued.join(p, "job", "left")
    outcome = first_of(
        (F.col("method").isin("perform_in", "perform_at"), "unsupported_delay"), (~F.col("method").isin("perform_async", "perform_later"), "not_an_enqueue"), (F.col("__n").isNull(), "job_not_found"), (F.col("__n") > 1, "AMBIGUOUS"), ((F.col("args") < F.col("__lo")) | (F.col("args") > F.col("__hi")), "arity_mismatch"), default="INFERRED"
    )
    return d.select("call_id", outcome.alias("outcome"))


# recommendation


def recommendations(evidence: DataFrame) -> DataFrame:
    """(span_id, test, basis, rank): the best basis of each test for a span, ranked.

    ``evidence`` (span_id, test, basis 0 to 4, spans, body_lines, distance): observed after in the body, observed before in the
    body, observed otherwise, structural reverse path, same name. ``category_weight``, if there, comes before the distance.
    """
    weight = F.col("category_weight") if "category_weight" in evidence.columns else F.lit(0)
    best = evidence.groupBy("span_id", "test").agg(F.min(F.struct("basis", (-F.col("spans")).alias("s"), (-F.col("body_lines")).alias("b"), weight.alias("w"), "distance")).alias("e"))
    w = Window.partitionBy("span_id").orderBy("e", "test")
    return best.withColumn("rank", F.row_number().over(w)).select("span_id", "test", F.col("e.basis").alias("basis"), "rank")
