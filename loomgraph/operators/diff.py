"""Snapshot comparison: alignment, classification, rename candidates, seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Fixed value: a declaration of fewer tokens says too little to be found again elsewhere.
LEAST_TOKENS = 6


def fingerprinted(entities: DataFrame) -> DataFrame:
    """Adds sha256 of signature, body and the two together with white space folded (``own``), and whether the body, or the
    signature where there is none, has ``LEAST_TOKENS`` words and signs (``telling``)."""
    token = r"(?:\w++|[^\w\s])"
    told = F.when(F.col("body") != "", F.col("body")).otherwise(F.col("signature")).rlike(token + r"(?:\s*+" + token + "){%d}" % (LEAST_TOKENS - 1))
    entities = entities.withColumn("telling", told)
    flat = lambda c: F.sha2(F.regexp_replace(F.col(c), r"\s+", " "), 256)
    return entities.withColumn("signature_sha", flat("signature")).withColumn("body_sha", flat("body")).withColumn("own_sha", F.sha2(F.concat("signature", F.lit("\0"), "body"), 256))


def aligned(before: DataFrame, after: DataFrame, failed: DataFrame | None = None, same: DataFrame | None = None) -> DataFrame:
    """Full outer alignment on (path, entity_id) with a category each.

    unknown (a side has no fingerprint, or the file is one of ``failed``: a side could not read it), added, removed, else the
    first that differs of signature, body, format, location; else unchanged. Entities of files that are the ``same`` bytes on
    both sides take no part: they are unchanged without being compared. Both tables have a path column.
    """
    if same is not None:
        before, after = (df.join(same.select("path").distinct(), "path", "left_anti") for df in (before, after))
    cols = ["language", "kind", "name", "line", "signature_sha", "body_sha", "own_sha", "telling"]
    side = lambda df, s: df.select("path", "entity_id", *[F.col(c).alias(f"{s}_{c}") for c in cols], F.lit(True).alias(f"__{s}"))
    j = side(before, "before").join(side(after, "after"), ["path", "entity_id"], "full_outer")
    differs = lambda c: F.col(f"before_{c}") != F.col(f"after_{c}")
    if failed is not None:
        j = j.join(failed.select("path", F.lit(True).alias("__failed")).distinct(), "path", "left")
    category = (
        F.when(F.col("__failed") if failed is not None else F.lit(False), "unknown")
        .when(F.col("__before").isNull(), "added")
        .when(F.col("__after").isNull(), "removed")
        .when(F.col("before_own_sha").isNull() | F.col("after_own_sha").isNull(), "unknown")
        .when(differs("signature_sha"), "signature")
        .when(differs("body_sha"), "body")
        .when(differs("own_sha"), "format")
        .when(differs("line"), "location")
        .otherwise("unchanged")
    )
    return j.withColumn("category", category).drop("__before", "__after", "__failed")


def summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def rename_candidates(changes: DataFrame) -> DataFrame:
    """Removed and added entities with equal language, kind and fingerprints, unique on both sides: rename, move, or both.

    Declarations of fewer than ``LEAST_TOKENS`` tokens are none. Candidates are reported beside added and removed, never merged.
    """
    keys = ["language", "kind", "signature_sha", "body_sha"]

    def side(category: str, s: str) -> DataFrame:
        d = changes.filter((F.col("category") == category) & F.col(f"{s}_telling")).select(*[F.col(f"{s}_{k}").alias(k) for k in keys], F.struct(F.col("path"), "entity_id", F.col(f"{s}_name").alias("name")).alias("__e"))
        one = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__e").alias("__e")).filter("__n = 1")
        return one.select(*keys, F.col("__e.path").alias(f"{s}_path"), F.col("__e.entity_id").alias(f"{s}_id"), F.col("__e.name").alias(f"{s}_name"))

    j = side("removed", "before").join(side("added", "after"), keys)
    same_path, same_name = F.col("before_path") == F.col("after_path"), F.col("before_name") == F.col("after_name")
    relation = F.when(same_path, "rename").when(same_name, "move").otherwise("rename_and_move")
    return j.select("before_id", "after_id", "before_path", "after_path", relation.alias("relation"))


def seeds(changes: DataFrame) -> DataFrame:
    """Impact seeds: removed from before; added, signature, body from after; format and location never."""
    side = F.when(F.col("category") == "removed", "before").when(F.col("category").isin("added", "signature", "body", "unknown"), "after")
    return changes.withColumn("side", side).filter(F.col("side").isNotNull()).select(F.col("entity_id").alias("seed"), "category", "side")


def set_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys that were added, removed or kept."""
    o, n = old.select(key).distinct().withColumn("__o", F.lit(1)), new.select(key).distinct().withColumn("__n", F.lit(1))
    return o.join(n, key, "full_outer").select(key, F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").otherwise("common").alias("state"))
