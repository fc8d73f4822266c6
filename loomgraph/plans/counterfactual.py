"""What a patch would change: facts taken anew from the patched files, compared with those before, and rules on both sides."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import scalars
from loomgraph.operators import diff, graph
from loomgraph.operators import rules as checking
from loomgraph.operators.tables import kept
from loomgraph.sources import readers


@dataclass(frozen=True)
class Rule:
    """No file that ``sources`` select may reach one that ``targets`` select by imports."""

    rule_id: str
    sources: Sequence[str]
    targets: Sequence[str]


@dataclass(frozen=True)
class Outcome:
    """Tables of a run: patched files, symbol changes, rule states of each side, and violations with their delta."""

    files: DataFrame
    changes: DataFrame
    rules: DataFrame
    delta: DataFrame


def import_edges(facts: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """File-level imports (source, target), and boundary files (path): those with an import that stays open.

    ``from a.b import c`` leads to the module a.b.c if there is one, else to a.b; relative imports start at the file's folder.
    An import is open if its first part is a module or folder of these files but nothing answers to it, or if the level
    climbs out of them.
    """
    dotted = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"(^|/)__init__$", ""), "/", ".")
    modules = files.filter(F.col("path").endswith(".py")).select(dotted.alias("module"), F.col("path").alias("target"))
    modules = modules.groupBy("module").agg(F.min("target").alias("target"))
    i = facts.filter("fact = 'import'").select("path", "level", "module", F.col("qualifier").alias("name"))
    folder = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    i = i.withColumn("__dir", folder).withColumn("__keep", F.size("__dir") - F.col("level") + 1)
    base = F.slice("__dir", 1, F.greatest(F.col("__keep"), F.lit(0)))
    parts = F.filter(F.concat(F.when(F.col("level") > 0, base).otherwise(F.array().cast("array<string>")), F.split(F.coalesce("module", F.lit("")), r"\.")), lambda x: x != "")
    i = i.withColumn("__long", F.array_join(F.when(F.col("name").isNotNull(), F.concat(parts, F.array("name"))).otherwise(parts), ".")).withColumn("__short", F.array_join(parts, "."))
    long_, short = (modules.select(F.col("module").alias(f"__{c}"), F.col("target").alias(f"t_{c}")) for c in ("long", "short"))
    i = i.join(long_, "__long", "left").join(short, "__short", "left").withColumn("target", F.coalesce("t_long", "t_short"))
    tops = files.select(F.regexp_replace(F.split("path", "/")[0], r"\.py$", "").alias("__top"), F.lit(True).alias("__own")).distinct()
    i = kept(i.withColumn("__top", F.split("__long", r"\.")[0]).join(tops, "__top", "left"))
    edges = i.filter("target is not null").select(F.col("path").alias("source"), "target").filter("source != target").distinct()
    open_ = i.filter((F.col("target").isNull() & (F.col("__own") | (F.col("level") > 0))) | ((F.col("level") > 0) & (F.col("__keep") < 0)))
    return edges, open_.select("path").distinct()


def entities(files: DataFrame) -> DataFrame:
    """Declarations of Python files as :func:`diff.fingerprinted` takes them; equal names in a file are told apart by their order."""

    def parse(path: str, text: str) -> list[tuple]:
        try:
            found = readers.fingerprints(text or "")
        except (SyntaxError, ValueError):
            return []
        out, seen = [], {}
        for line, (name, signature, body) in enumerate(found):
            k = seen[name] = seen.get(name, -1) + 1
            out.append((path, f"{path}::{name}#{k}", "python", "class" if signature.startswith("class") else "function", name.rpartition(".")[2], signature, body, line))
        return out

    return readers._per_file(files.filter(F.col("path").endswith(".py")), "text", "path string, entity_id string, language string, kind string, name string, signature string, body string, line int", parse)


def _any(path: Column, selectors: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [scalars.selected(path, s) for s in selectors], F.lit(False))


def checked(files: DataFrame, rules: Sequence[Rule], depth: int = 16) -> tuple[DataFrame, DataFrame]:
    """Violations (rule_id, source, target) and rule states (rule_id, outcome, exhaustive, reasons) over the files' imports."""
    facts = kept(readers.python_facts(files.filter(F.col("path").endswith(".py"))))
    edges, open_ = import_edges(facts, files)
    vague = kept(open_.union(facts.filter("fact = 'failed'").select("path")).distinct())
    edges = kept(edges)
    spark = files.sparkSession
    starts = kept(files.select("path", F.array_compact(F.array(*[F.when(_any(F.col("path"), r.sources), r.rule_id) for r in rules])).alias("__r")).filter(F.size("__r") > 0).select(F.col("path").alias("seed"), F.explode("__r").alias("rule_id")))
    aims = reduce(DataFrame.unionByName, [files.filter(_any(F.col("path"), r.targets)).select(F.lit(r.rule_id).alias("rule_id"), "path") for r in rules])
    found = checking.check(edges, starts.select("rule_id", F.col("seed").alias("path")), aims, vague, depth)
    states = checking.outcomes(spark.createDataFrame([(r.rule_id,) for r in rules], "rule_id string"), found)
    return kept(checking.violations(found)), states.select("rule_id", "outcome", "exhaustive", "reasons")


def run(files: DataFrame, patch: str, rules: Sequence[Rule] = (), depth: int = 16) -> Outcome:
    """Apply a unified diff to ``files`` (path, text), take the facts of both sides and compare them. Nothing is stored.

    A file that does not parse on a side makes its changes unknown; files whose bytes are equal are not compared. What only
    one side violates counts as introduced or resolved only if the other side's search was whole. A patch that does not apply
    raises ValueError.
    """
    after = kept(readers.counterfactual(files, patch))
    sha = lambda d, c: d.select("path", F.sha2("text", 256).alias(c))
    both = sha(files, "b").join(sha(after, "a"), "path", "full_outer")
    same, touched = both.filter("a = b").select("path"), kept(both.filter("a is null or b is null or a != b").select("path"))
    changed = [d.select("path", "text").join(touched, "path", "left_semi") for d in (files, after)]
    failed = reduce(DataFrame.union, [readers.python_facts(d.filter(F.col("path").endswith(".py"))).filter("fact = 'failed'").select("path") for d in changed]).distinct()
    changes = diff.aligned(*[diff.fingerprinted(entities(d)) for d in changed], failed=failed, same=same)
    changes = changes.filter("category != 'unchanged'").select("path", "entity_id", "category")
    if not rules:
        spark = files.sparkSession
        return Outcome(after, changes, spark.createDataFrame([], "rule_id string, before string, after string"), spark.createDataFrame([], "rule_id string, source string, target string, delta string"))
    (was, old), (now, new) = checked(files, rules, depth), checked(after, rules, depth)
    states = old.select("rule_id", F.col("outcome").alias("before"), F.col("exhaustive").alias("before_exhaustive")).join(new.select("rule_id", F.col("outcome").alias("after"), F.col("exhaustive").alias("after_exhaustive")), "rule_id")
    known = states.select("rule_id", F.col("before_exhaustive").alias("before"), F.col("after_exhaustive").alias("after"))
    return Outcome(after, changes, states, graph.rule_delta(was, now, known))
