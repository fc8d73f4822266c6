"""Resolution of references to declarations: candidates, confidence tiers, scopes, owners, imports."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.intervals import innermost
from loomgraph.operators.tables import kept

CALLABLE = ("method", "function", "mixin", "class", "module")
HERITABLE = ("class", "module")
STRUCTURAL = ("call", "construct", "superclass", "include", "extend", "prepend")
REF_KEY = ["lang", "callee_name", "relation", "qualified", "path", "line", "col"]


def declared(symbols: DataFrame) -> DataFrame:
    """One row per (lang, name): how many callable and heritable declarations it has, the first of each, and all of them in order.

    Columns that a plan does not use are not aggregated: counts and firsts need no arrays.
    """
    one = F.struct("path", F.col("line_start").alias("line"), "name")
    of = lambda kinds: F.when(F.col("kind").isin(*kinds), one)
    sides = (("callable", CALLABLE), ("heritable", HERITABLE))
    by = [x for n, kinds in sides for x in (F.count(of(kinds)).alias(f"__n_{n}"), F.min(of(kinds)).alias(f"__1_{n}"), F.sort_array(F.collect_list(of(kinds))).alias(f"__{n}"))]
    return symbols.filter(F.col("kind").isin(*CALLABLE)).groupBy("lang", "name").agg(*by, F.bool_and(F.col("kind").isin(*HERITABLE)).alias("__types"))


def _graded(refs: DataFrame, table: DataFrame) -> DataFrame:
    """References with the number of their candidates, the one target if there is one, and confidence; all columns of ``table`` stay."""
    # names are few as a file of copies but may be as many as symbols
    r = refs.join(table.withColumnRenamed("name", "callee_name").hint("merge"), ["lang", "callee_name"], "left")
    call = F.col("relation") == "call"
    pick = lambda p: F.when(call, F.col(f"{p}callable")).otherwise(F.col(f"{p}heritable"))
    made = call & F.coalesce("__types", F.lit(False))
    n = F.coalesce(pick("__n_"), F.lit(0))
    sure = F.col("qualified") | (n > 0) & (made | ~call)
    tier = F.when((n == 1) & sure, "EXTRACTED").when(n == 1, "INFERRED").when(n > 1, "AMBIGUOUS")
    r = r.withColumn("__n", n).withColumn("__target", F.when(n == 1, pick("__1_"))).withColumn("resolved_relation", F.when(made, "construct").otherwise(F.col("relation")))
    return r.withColumn("confidence", tier).withColumn("unresolved_reason", F.when(n == 0, "no_visible_target"))


def resolved(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """References with candidates and confidence, by name within the language (languages without scopes).

    ``confidence``: EXTRACTED (one candidate, qualified), INFERRED (one), AMBIGUOUS (several), null with
    ``unresolved_reason`` (none). A call whose candidates are all classes or modules is a qualified construct.
    """
    table = declared(symbols)
    r = _graded(refs, table)
    empty = F.array().cast(table.schema["__callable"].dataType)
    found = F.coalesce(F.when(F.col("relation") == "call", F.col("__callable")).otherwise(F.col("__heritable")), empty)
    return r.withColumn("candidates", found).select(*refs.columns, "candidates", "resolved_relation", "confidence", "unresolved_reason")


#: A place shows a list of ``LONG_LIST`` candidates to ``SHOWN`` references, and others in proportion; a list with more to show stands in several places.
LONG_LIST, SHOWN = 1_000, 10_000


def _listed(refs: DataFrame, lists: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """``refs`` with the columns of ``lists`` (keys, __n, others), which has one row for each key; refs have ``__n`` of their key, 0 or null if it has none.

    Lists have copies by what is shown, candidates times references, and references are dealt over them by ``by``. Both sides go
    to as many tasks as there are shuffle partitions: what comes in is small, but what goes out may be many times as much.
    """
    places = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shown = F.col("__n").cast("long") * F.count(F.lit(1))
    copies = refs.filter("__n > 0").groupBy(*keys, "__n").agg(F.least(F.lit(places), F.floor(shown / F.lit(LONG_LIST * SHOWN)) + 1).cast("int").alias("__copies"))
    copies = copies.filter("__copies > 1").drop("__n")
    dealt = F.when(F.coalesce("__n", F.lit(0)) == 0, places).otherwise(F.coalesce("__copies", F.lit(1)))
    r = refs.join(copies, keys, "left").withColumn("__place", F.pmod(F.xxhash64(by), dealt).cast("int")).drop("__n", "__copies")
    t = lists.join(copies, keys, "left").withColumn("__place", F.explode(F.sequence(F.lit(0), F.coalesce("__copies", F.lit(1)) - 1))).drop("__n", "__copies")
    at = [*keys, "__place"]
    return r.repartition(places, *at).join(t.repartition(places, *at), at, "left").drop("__place")


def edges(refs: DataFrame, symbols: DataFrame, around: DataFrame | None = None, candidates: bool = True, show: Callable[[Column], Column] | None = None) -> DataFrame:
    """The edge table: resolved references with their innermost source symbol and target.

    Only counts and single targets take part in the joins; ambiguous references meet their candidates last, and not at all
    without ``candidates`` (the column is null then). ``around`` has the symbols that may surround a reference, if not all.
    ``show`` makes something else of a candidate array, once for each name and not for each reference.
    """
    table = declared(symbols)
    r = _graded(refs, table.drop("__callable", "__heritable")).filter(F.col("confidence").isNotNull())
    r = innermost(r.select(*refs.columns, "resolved_relation", "confidence", "__target"), symbols if around is None else around, ["path", "line"])
    kind = table.schema["__callable"].dataType
    if candidates:
        many = table.filter("__n_callable > 1").select("lang", F.col("name").alias("callee_name"), F.lit("AMBIGUOUS").alias("confidence"), *[(show or F.col)(c).alias(c) for c in ("__callable", "__heritable")])
        r = r.join(many.hint("merge"), ["lang", "callee_name", "confidence"], "left")
        listed = F.when(F.col("relation") == "call", F.col("__callable")).otherwise(F.col("__heritable"))
    else:
        listed = F.lit(None).cast(kind)
    t = F.col("__target")
    return r.select(
        F.col("resolved_relation").alias("relation"), F.col("path").alias("source_path"), F.col("line").alias("source_line"), F.col("col").alias("source_col"),
        "source_name", "source_kind", "callee_name", "confidence", t["path"].alias("target_path"), t["line"].alias("target_line"), t["name"].alias("target_name"),
        F.when(F.col("confidence") == "AMBIGUOUS", listed).alias("candidates"), "lang",
    )


def list_id(found: Column) -> Column:
    """SHA-256 of a candidate array: as ``show``, an edge carries it in place of the array, so a table of edges grows with its references alone."""
    return F.sha2(F.to_json(found), 256)


def relisted(edge_table: DataFrame, symbols: Sequence[DataFrame], show: Callable[[Column], Column] | None = None) -> DataFrame:
    """Edges that carry :func:`list_id`, with the candidates themselves, from the tables of symbols that they were bound against."""
    each = lambda c: F.struct(F.size(c).alias("__n"), list_id(F.col(c)).alias("__list"), (show or F.col)(c).alias("candidates"))
    lists = [declared(s).filter("__n_callable > 1").select(F.inline(F.array(each("__callable"), each("__heritable")))).filter("__n > 1") for s in symbols]
    lists = kept(reduce(DataFrame.unionByName, lists).dropDuplicates(["__list"]))
    e = edge_table.withColumnRenamed("candidates", "__list").join(lists.select("__list", "__n").hint("merge"), "__list", "left")
    return _listed(e, lists, ["__list"], F.struct("source_path", "source_line", "source_col")).select(*edge_table.columns)


def edges_for(refs: DataFrame, symbols: DataFrame, candidates: bool = True, show: Callable[[Column], Column] | None = None) -> DataFrame:
    """Edges of some references: only the declarations of their names and the symbols of their files take part."""
    names = refs.select("lang", F.col("callee_name").alias("name")).distinct()
    near = symbols.join(refs.select("path").distinct(), "path", "left_semi")
    return edges(refs, symbols.join(names, ["lang", "name"], "left_semi"), near, candidates, show)


def unresolved(refs: DataFrame, edge_table: DataFrame) -> DataFrame:
    """References without an edge. A call also matches a construct edge: calls are one key on both sides, so the anti join is a hash join."""
    merged = lambda c: F.when(c == "construct", F.lit("call")).otherwise(c)
    e = edge_table.select(F.col("source_path").alias("path"), F.col("source_line").alias("line"), F.col("source_col").alias("col"), "lang", F.col("relation").alias("__r"))
    exact = e.select("path", "line", "col", "lang", F.col("__r").alias("relation"))
    loose = e.select("path", "line", "col", "lang", merged(F.col("__r")).alias("__call"))
    call = refs.filter(F.col("relation") == "call").withColumn("__call", F.lit("call")).join(loose.filter("__call = 'call'"), ["path", "line", "col", "lang", "__call"], "left_anti").drop("__call")
    other = refs.filter(F.col("relation") != "call").join(exact, ["path", "line", "col", "lang", "relation"], "left_anti")
    return call.unionByName(other)


def visible(refs: DataFrame, declarations: DataFrame, blockers: DataFrame) -> DataFrame:
    """Scope-chain resolution: the first scope outward that blocks or declares the name decides.

    ``refs`` (ref_id, path, callee_name, scopes innermost first); ``declarations`` (path, scope, name, kind, line_start);
    ``blockers`` (path, scope, name, binding_kind). A blocker wins over a declaration of its scope; the name ``*`` blocks all.
    Adds ``candidates`` and ``reason``: unsupported_scope, unknown_import_alias, shadowed_noncallable, no_visible_target.
    """
    r = refs.select("ref_id", "path", "callee_name", F.posexplode("scopes").alias("pos", "scope"))
    named = declarations.withColumnRenamed("name", "callee_name")
    d = named.groupBy("path", "scope", "callee_name").agg(F.lit(True).alias("found"))
    rank = F.when(F.col("binding_kind") == "unsupported", 0).when(F.col("binding_kind") == "import", 2).otherwise(1)
    b = blockers.filter("name != '*'").groupBy("path", "scope", F.col("name").alias("callee_name")).agg(F.min(rank).alias("__block"))
    star = blockers.filter("name = '*'").select("path", "scope", F.lit(0).alias("__star")).distinct()
    r = r.join(d, ["path", "scope", "callee_name"], "left").join(b, ["path", "scope", "callee_name"], "left").join(star, ["path", "scope"], "left")
    r = r.withColumn("block", F.coalesce("__star", "__block")).filter("found is not null or block is not null")
    # the deciding scope first; its declarations join it last
    first = r.groupBy("ref_id").agg(F.min_by(F.struct("found", "block", "scope"), "pos").alias("__f"))
    listed = named.groupBy("path", F.col("scope").alias("__scope"), "callee_name").agg(F.sort_array(F.collect_list(F.struct("path", F.col("line_start").alias("line"), F.col("callee_name").alias("name")))).alias("__found"))
    out = refs.join(first, "ref_id", "left").withColumn("__scope", F.when(F.col("__f.block").isNull(), F.col("__f.scope"))).join(listed, ["path", "__scope", "callee_name"], "left")
    reason = (
        F.when(F.col("__f").isNull(), "no_visible_target")
        .when(F.col("__f.block") == 0, "unsupported_scope")
        .when(F.col("__f.block") == 2, "unknown_import_alias")
        .when(F.col("__f.block") == 1, "shadowed_noncallable")
    )
    return out.select(*refs.columns, F.col("__found").alias("candidates"), reason.alias("reason"))


def namespaced(refs: DataFrame, declarations: DataFrame, show: Callable[[Column], Column] | None = None) -> DataFrame:
    """Ruby constant lookup: the deepest of A::B::Name, A::Name, Name that is declared.

    ``refs`` (ref_id, namespace, callee_name); ``declarations`` (full_name, path, line_start). Adds ``full_name`` and ``candidates``;
    ``show`` makes something else of a candidate array, once for each name.
    """
    parts = F.when(F.coalesce("namespace", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("namespace", "::"))
    tried = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.concat_ws("::", F.array_join(F.slice(parts, 1, F.size(parts) - k), "::"), F.col("callee_name")))
    tried = F.transform(tried, lambda t: F.regexp_replace(t, "^::", ""))
    r = refs.select("ref_id", F.posexplode(tried).alias("pos", "full_name"))
    # the deepest name first; its declarations join it last
    there = declarations.groupBy("full_name").agg(F.count(F.lit(1)).alias("__n"))
    first = r.join(there, "full_name").groupBy("ref_id").agg(F.min_by(F.struct("full_name", "__n"), "pos").alias("__f")).select("ref_id", "__f.full_name", "__f.__n")
    found = F.sort_array(F.collect_list(F.struct("path", F.col("line_start").alias("line"))))
    d = declarations.groupBy("full_name").agg(F.count(F.lit(1)).alias("__n"), found.alias("__found")).select("full_name", "__n", (show or F.col)("__found").alias("candidates"))
    return _listed(refs.join(first, "ref_id", "left"), d, ["full_name"], F.col("ref_id")).select(*refs.columns, "full_name", "candidates")


def members(refs: DataFrame, types: DataFrame, declared: DataFrame, show: Callable[[Column], Column] | None = None) -> DataFrame:
    """Receiver to class to member of the same owner, category and path.

    ``refs`` (ref_id, path, receiver, callee_name, category or null); ``types`` (name, path, identity); ``declared``
    (owner, name, category, path, line_start). Adds ``candidates`` and ``reason``: unknown_receiver, owner_has_no_member. Candidates
    are gathered once for each receiver, path, name and category, not for each reference; ``show`` makes something else of the array.
    """
    at = ["receiver", "path"]
    t = types.select(F.col("name").alias("receiver"), "path", F.col("identity").alias("owner")).join(refs.select(*at).distinct(), at, "left_semi").distinct()
    known = t.groupBy(*at).agg(F.count("owner").alias("__owners"))
    # a member answers references to its category and those that name none
    asked = F.explode(F.array(F.concat(F.lit("="), "category"), F.lit("any")))
    d = declared.filter("category != 'unknown'").select("owner", F.col("name").alias("callee_name"), asked.alias("__cat"), "path", "line_start")
    keys = [*at, "callee_name", "__cat"]
    got = t.join(d, ["owner", "path"]).groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("path", F.col("line_start").alias("line")))).alias("__found"))
    got = got.select(*keys, F.size("__found").alias("__n"), (show or F.col)("__found").alias("candidates"))
    r = refs.withColumn("__cat", F.when(F.col("category").isNull(), "any").otherwise(F.concat(F.lit("="), "category")))
    r = r.join(known, at, "left").join(got.select(*keys, "__n"), keys, "left")
    out = _listed(r, got, keys, F.col("ref_id")).drop("__cat")
    reason = F.when(F.coalesce("__owners", F.lit(0)) == 0, "unknown_receiver").when(F.col("candidates").isNull(), "owner_has_no_member")
    return out.withColumn("reason", reason).select(*refs.columns, "candidates", "reason")


def relative_imports(imports: DataFrame, modules: DataFrame, exports: DataFrame) -> DataFrame:
    """Targets of ``from ..a.b import name`` in packages that have an initialiser at each level.

    ``imports`` (import_id, path, level, module array, name); ``modules`` (path); ``exports`` (path, name, line_start, blocked,
    conditional). Adds ``target_path``, ``target_line`` and ``reason``: no_package, outside_package, missing_module,
    ambiguous_module, blocked_export, conditional_export, missing_target, ambiguous_target.
    """
    parts = F.split("path", "/")
    folder = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    i = imports.withColumn("__dir", folder).withColumn("__keep", F.size("__dir") - (F.col("level") - 1))
    base = F.slice(F.col("__dir"), 1, F.greatest(F.col("__keep"), F.lit(0)))
    i = i.withColumn("__base", F.concat(base, F.col("module")))
    # the file's own folder and every folder above it that the level climbs through
    inits = modules.filter(F.col("path").endswith("__init__.py")).select(F.regexp_replace("path", r"/?__init__\.py$", "").alias("__pkg")).distinct()
    climbed = F.transform(F.sequence(F.lit(0), F.least(F.greatest(F.col("level"), F.lit(1)), F.greatest(F.size("__dir"), F.lit(1))) - 1), lambda k: F.array_join(F.slice("__dir", 1, F.greatest(F.size("__dir") - k, F.lit(0))), "/"))
    bare = i.select("import_id", F.explode(climbed).alias("__pkg")).join(inits, "__pkg", "left_anti").select("import_id", F.lit(True).alias("__bare")).distinct()
    i = i.join(bare, "import_id", "left")
    stem = modules.select(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"(^|/)__init__$", "").alias("__stem"), F.col("path").alias("__file"))
    hits = stem.groupBy("__stem").agg(F.count(F.lit(1)).alias("__n"), F.min("__file").alias("__file"))
    i = i.withColumn("__stem", F.array_join("__base", "/")).join(hits, "__stem", "left")
    e = exports.groupBy(F.col("path").alias("__file"), "name").agg(F.count(F.lit(1)).alias("__m"), F.min("line_start").alias("__line"), F.bool_or("blocked").alias("__blocked"), F.bool_or("conditional").alias("__cond"))
    i = i.join(e, ["__file", "name"], "left")
    reason = (
        F.when(F.col("__bare"), "no_package")
        .when(F.col("__keep") < 1, "outside_package")
        .when(F.col("__n").isNull(), "missing_module")
        .when(F.col("__n") > 1, "ambiguous_module")
        .when(F.col("__blocked"), "blocked_export")
        .when(F.col("__cond"), "conditional_export")
        .when(F.col("__m").isNull(), "missing_target")
        .when(F.col("__m") > 1, "ambiguous_target")
    )
    ok = reason.isNull()
    return i.select(*imports.columns, F.when(ok, F.col("__file")).alias("target_path"), F.when(ok, F.col("__line")).alias("target_line"), reason.alias("reason"))
