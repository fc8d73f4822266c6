"""Differences of two OpenAPI contracts as keyed joins of their parts: operations, regions, parameters, path items, document regions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a finding; what does not apply is null.
FINDING = ["kind", "reason", "region", "path", "method", "parameter", "change", "blocked", "before_at", "after_at"]


@dataclass(frozen=True)
class Contract:
    """One side. ``operations`` (path, method, template, at, whole): path has its parameters unnamed, ``whole`` tells whether regions
    are known; ``regions`` (at, region, sha256, complete, region_at); ``parameters`` (at, place, key, required, reserved, sha256,
    rest_sha256, parameter_at), rest without the flag ``required``; ``items`` (template, path or null, at, sha256, complete);
    ``documents`` (at, sha256, complete). ``at`` are JSON pointers, of the operation in regions and parameters."""

    operations: DataFrame
    regions: DataFrame
    parameters: DataFrame
    items: DataFrame
    documents: DataFrame


def _found(df: DataFrame, kind: Column | str, **given: Column | str) -> DataFrame:
    as_column = lambda c: F.lit(c) if isinstance(c, str) else c
    given = {"kind": kind, **given}
    return df.select(*[as_column(given[c]).cast("string").alias(c) if c in given else F.lit(None).cast("string").alias(c) for c in FINDING])


def _sided(df: DataFrame, side: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in keys])


def _blockers(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first path item (by template) that is not whole: for each path, and of those whose path is not known (one row)."""
    odd = items.filter("not complete")
    first = F.min(F.struct("template", "at"))
    return odd.filter("path is not null").groupBy("path").agg(first.alias("__own")), odd.filter("path is null").agg(first.alias("__any"))


def _one_sided(ops: DataFrame, own: str, other: Contract, kind: str) -> DataFrame:
    """Operations that only one side has: removed or added, unless the other side's path item is not whole."""
    by_path, any_ = _blockers(other.items)
    by_template = other.items.groupBy("template").agg(F.min("at").alias("__t"))
    first = other.items.filter("path is not null").groupBy("path").agg(F.min(F.struct("template", "at")).alias("__p"))
    d = ops.withColumnRenamed(f"{own}_template", "template").join(by_path, "path", "left").join(F.broadcast(any_)).join(by_template, "template", "left").join(first, "path", "left")
    d = d.withColumn("__block", F.least("__own", "__any")["at"])
    here, there = F.col(f"{own}_at"), F.coalesce("__block", "__t", F.col("__p.at"), F.lit("/paths"))
    at = {"before_at": here, "after_at": there} if own == "b" else {"before_at": there, "after_at": here}
    stuck = F.col("__block").isNotNull()
    odd = lambda text: F.when(stuck, text)
    return _found(d, F.when(stuck, "review_required").otherwise(kind), reason=odd("incomplete_region"), region=odd("path_item"), blocked=odd(kind), path=F.col("path"), method=F.col("method"), **at)


def _parameters(changed: DataFrame, before: Contract, after: Contract) -> DataFrame:
    """Findings of the operations whose parameters differ, parameter by parameter."""
    ids = ["path", "method", "key"]
    side = lambda c, s: _sided(changed.select("path", "method", F.col(f"{s}_at").alias("at")).join(c.parameters, "at").drop("at"), s, ids)
    d = side(before, "b").join(side(after, "a"), ids, "full_outer").join(changed.select("path", "method", "b_at", "a_at"), ["path", "method"])
    at = {"before_at": F.coalesce("b_parameter_at", "b_at"), "after_at": F.coalesce("a_parameter_at", "a_at")}
    new, gone = F.col("b_sha256").isNull(), F.col("a_sha256").isNull()
    in_path = F.coalesce("a_place", "b_place") == "path"
    differs = new | gone | (F.col("b_sha256") != F.col("a_sha256"))
    demands = F.col("a_required") & ~F.col("a_reserved")
    now = ~in_path & ~gone & F.when(new, demands).otherwise(~F.col("b_required") & demands)
    d = d.filter(differs)
    common = {"path": F.col("path"), "method": F.col("method"), "parameter": F.col("key"), **at}
    required = _found(d.filter(now), "newly_required_parameter", change=F.when(new, "added_required").otherwise("optional_to_required"), **common)
    # what is newly required is to be reviewed too if anything else about it differs
    reason = F.when(in_path, "path_parameter_changed").when(new, "parameter_added").when(gone, "parameter_removed").otherwise("parameter_changed")
    review = _found(d.filter(~now | ~new & ~gone & (F.col("b_rest_sha256") != F.col("a_rest_sha256"))), "review_required", reason=reason, **common)
    return required.unionByName(review)


def findings(before: Contract, after: Contract) -> DataFrame:
    """Every finding between two contracts: (:data:`FINDING`).

    Kinds: operation_removed, operation_added, newly_required_parameter and review_required, the last with a reason:
    ambiguous_identity (an operation stands twice on a side), incomplete_region (of a region, an operation, a path item or the
    document; ``blocked`` names the finding that it keeps back), path_parameter_changed, parameter_added, parameter_removed,
    parameter_changed, region_changed, document_region_changed.
    """
    ids = ["path", "method"]
    one = lambda c, s: c.operations.groupBy(*ids).agg(F.count(F.lit(1)).alias(f"{s}_n"), *[F.min_by(x, "at").alias(f"{s}_{x}") for x in ("template", "at", "whole")])
    j = one(before, "b").join(one(after, "a"), ids, "full_outer").withColumn("__twice", F.greatest(F.coalesce("b_n", F.lit(0)), F.coalesce("a_n", F.lit(0))) > 1)
    out = []
    for c, s, at in ((before, "b", "before_at"), (after, "a", "after_at")):
        twice = c.operations.join(j.filter(F.col(f"{s}_n") > 1).select(*ids), ids, "left_semi")
        out.append(_found(twice, "review_required", reason="ambiguous_identity", path=F.col("path"), method=F.col("method"), **{at: F.col("at")}))
    single = j.filter("not __twice")
    out.append(_one_sided(single.filter("a_n is null"), "b", after, "operation_removed"))
    out.append(_one_sided(single.filter("b_n is null"), "a", before, "operation_added"))
    both = single.filter("a_n is not null and b_n is not null")
    name = {"path": F.col("path"), "method": F.col("method")}
    out.append(_found(both.filter("not (b_whole and a_whole)"), "review_required", reason="incomplete_region", region="operation", before_at=F.col("b_at"), after_at=F.col("a_at"), **name))
    known = both.filter("b_whole and a_whole").select(*ids, "b_at", "a_at")
    side = lambda c, s: _sided(known.select(*ids, F.col(f"{s}_at").alias("at")).join(c.regions, "at").drop("at"), s, [*ids, "region"])
    r = side(before, "b").join(side(after, "a"), [*ids, "region"], "full_outer").join(known, ids)
    odd = ~(F.coalesce("b_complete", F.lit(False)) & F.coalesce("a_complete", F.lit(False)))
    r = r.withColumn("reason", F.when(odd, "incomplete_region").when(F.col("b_sha256") != F.col("a_sha256"), "region_changed")).filter("reason is not null")
    by_parameter = (F.col("region") == "parameters") & (F.col("reason") == "region_changed")
    at = {"before_at": F.coalesce("b_region_at", "b_at"), "after_at": F.coalesce("a_region_at", "a_at")}
    out.append(_found(r.filter(~by_parameter), "review_required", reason=F.col("reason"), region=F.col("region"), **at, **name))
    out.append(_parameters(r.filter(by_parameter).select(*ids, "b_at", "a_at"), before, after))

    used = before.operations.select("template").union(after.operations.select("template")).distinct().withColumn("__used", F.lit(True))
    i = _sided(before.items, "b", ["template"]).join(_sided(after.items, "a", ["template"]), "template", "full_outer").join(used, "template", "left")
    odd = ~(F.coalesce("b_complete", F.lit(True)) & F.coalesce("a_complete", F.lit(True)))
    bare = F.col("__used").isNull() & ~F.col("b_sha256").eqNullSafe(F.col("a_sha256"))
    i = i.withColumn("reason", F.when(odd, "incomplete_region").when(bare, "region_changed")).filter("reason is not null")
    out.append(_found(i, "review_required", reason=F.col("reason"), region="path_item", before_at=F.col("b_at"), after_at=F.col("a_at")))
    d = _sided(before.documents, "b", ["at"]).join(_sided(after.documents, "a", ["at"]), "at", "full_outer")
    d = d.withColumn("reason", F.when(odd, "incomplete_region").when(~F.col("b_sha256").eqNullSafe(F.col("a_sha256")), "document_region_changed")).filter("reason is not null")
    there = lambda s: F.when(F.col(f"{s}_sha256").isNotNull(), F.col("at"))
    out.append(_found(d, "review_required", reason=F.col("reason"), region="document", before_at=there("b"), after_at=there("a")))
    return reduce(DataFrame.unionByName, out)
