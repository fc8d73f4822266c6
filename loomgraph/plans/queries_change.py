"""Queries on snapshot changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import diff
from loomgraph.plans.edges_sql import EDGES_SQL
from loomgraph.plans.projection import PROJECTIONS, projected, with_sql
from loomgraph.registry import query

_FP = "sha256(regexp_replace({}, '\\s+', ' ', 'g'))"
_SIDE = "{0}f AS (SELECT *, len(regexp_extract_all(CASE WHEN body <> '' THEN body ELSE signature END, '\\w+|[^\\w\\s]')) >= 6 AS tell, " + _FP.format("signature") + " AS sig, " + _FP.format("body") + " AS bod, sha256(signature || chr(0) || body) AS own FROM {0})"
_CHANGES = (
    with_sql("before", "after") + ", " + _SIDE.format("before") + ", " + _SIDE.format("after") + """, ch AS (SELECT coalesce(b.path, a.path) AS path, coalesce(b.entity_id, a.entity_id) AS entity_id,
 CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' WHEN b.sig <> a.sig THEN 'signature' WHEN b.bod <> a.bod THEN 'body' WHEN b.own <> a.own THEN 'format' WHEN b.line <> a.line THEN 'location' ELSE 'unchanged' END AS category,
 b.language AS bl, a.language AS al, b.kind AS bk, a.kind AS ak, b.sig AS bs, a.sig AS sa, b.bod AS bb, a.bod AS ab, coalesce(b.tell, false) AS bt, coalesce(a.tell, false) AS atl, b.name AS bn, a.name AS an FROM beforef b FULL JOIN afterf a ON b.path = a.path AND b.entity_id = a.entity_id)"""
)


def _changes(spark, sf_dir):
    b, a = (diff.fingerprinted(projected(spark, sf_dir, x)) for x in ("before", "after"))
    return diff.aligned(b, a)


@query(_CHANGES + " SELECT path, entity_id, category FROM ch")
def symbol_diff(spark, sf_dir):
    return _changes(spark, sf_dir).select("path", "entity_id", "category")


@query(_CHANGES + " SELECT category, count(*) AS n FROM ch GROUP BY 1")
def change_summary(spark, sf_dir):
    return diff.summary(_changes(spark, sf_dir))


@query(_CHANGES + """, r AS (SELECT bl AS l, bk AS k, bs AS s, bb AS b, path, entity_id, bn AS name FROM ch WHERE category = 'removed' AND bt QUALIFY count(*) OVER (PARTITION BY bl, bk, bs, bb) = 1),
 d AS (SELECT al AS l, ak AS k, sa AS s, ab AS b, path, entity_id, an AS name FROM ch WHERE category = 'added' AND atl QUALIFY count(*) OVER (PARTITION BY al, ak, sa, ab) = 1)
 SELECT r.entity_id AS before_id, d.entity_id AS after_id, r.path AS before_path, d.path AS after_path, CASE WHEN r.path = d.path THEN 'rename' WHEN r.name = d.name THEN 'move' ELSE 'rename_and_move' END AS relation FROM r JOIN d USING (l, k, s, b)""")
def rename_candidates(spark, sf_dir):
    return diff.rename_candidates(_changes(spark, sf_dir))


@query(_CHANGES + " SELECT entity_id AS seed, category, CASE category WHEN 'removed' THEN 'before' ELSE 'after' END AS side FROM ch WHERE category IN ('removed', 'added', 'signature', 'body')")
def impact_seeds(spark, sf_dir):
    return diff.seeds(_changes(spark, sf_dir))


@query(with_sql("before", "after") + " SELECT name, CASE WHEN b.name IS NULL THEN 'added' WHEN a.name IS NULL THEN 'removed' ELSE 'common' END AS state FROM (SELECT DISTINCT name FROM before) b FULL JOIN (SELECT DISTINCT name FROM after) a USING (name)")
def set_changes(spark, sf_dir):
    return diff.set_changes(projected(spark, sf_dir, "before"), projected(spark, sf_dir, "after"), "name")


#: A nation is a project and a supplier a file; digests are taken by the engine that runs the text.
_UNIT = """SELECT s_nationkey AS project, concat('src/f', CAST(s_suppkey AS STRING), '.py') AS path, {language} AS language, {sha}({local}{end} AS local, {sha}({bucket}{end} AS bucket, {sha}({output}{end} AS output FROM supplier WHERE {where}"""
_KEY = "concat('{0}', CAST({1} AS STRING))"


def _units(spark_sql: bool) -> list[str]:
    """The stored witness, the one of the old tables, and the new one: some files change, come or go; some projects have no
    stored witness, a tampered one, or outputs that are not what they were."""
    sha, end = ("sha2", ", 256)") if spark_sql else ("sha256", ")")
    key = lambda k, c: _KEY.format(k, c)
    when = lambda test, k, c: f"CASE WHEN {test} THEN {key(k + '2', c)} ELSE {key(k, c)} END"
    old = {"language": "'python'", "local": key("l", "s_suppkey"), "bucket": key("b", "s_nationkey"), "output": key("o", "s_suppkey"), "where": "s_suppkey % 17 <> 0"}
    stored = old | {"output": when("s_nationkey % 6 = 1 AND s_suppkey % 7 = 0", "o", "s_suppkey"), "where": "s_suppkey % 17 <> 0 AND s_nationkey % 6 <> 2"}
    new = {"language": "CASE WHEN s_suppkey % 13 = 0 THEN 'ruby' ELSE 'python' END", "local": when("s_suppkey % 5 = 0", "l", "s_suppkey"), "bucket": when("s_nationkey % 7 = 3", "b", "s_nationkey"),
           "output": when("s_nationkey % 6 = 0 AND s_suppkey % 3 = 0", "o", "s_suppkey"), "where": "s_suppkey % 11 <> 0"}
    return [_UNIT.format(sha=sha, end=end, **x) for x in (stored, old, new)]


_S, _O, _N = _units(False)


@query(f"""WITH s AS ({_S}), o AS ({_O}), n AS ({_N}), d AS (SELECT *, s.path IS NOT NULL AS has_s, o.path IS NOT NULL AS has_o, n.path IS NOT NULL AS has_n,
  s.local IS NOT DISTINCT FROM o.local AND s.bucket IS NOT DISTINCT FROM o.bucket AND s.output IS NOT DISTINCT FROM o.output AS sound, coalesce(n.language = o.language AND n.local = o.local AND n.bucket = o.bucket, false) AS held,
  n.output IS DISTINCT FROM o.output AS other FROM s FULL JOIN o USING (project, path) FULL JOIN n USING (project, path)),
 p AS (SELECT project, CASE WHEN NOT bool_or(has_s) THEN 'missing_witness' WHEN NOT bool_or(has_o) THEN 'unknown_dependency_inputs' WHEN NOT bool_and(sound) THEN 'invalid_witness' WHEN bool_or(held AND other) THEN 'unavailable_prior_outputs' ELSE 'complete_dependency_match' END AS reason FROM d GROUP BY project)
 SELECT project, path, CASE WHEN NOT has_n THEN 'removed' WHEN held AND reason = 'complete_dependency_match' THEN 'reused' ELSE 'selected' END AS action, CASE reason WHEN 'complete_dependency_match' THEN 'affected' ELSE 'full' END AS mode, reason FROM d JOIN p USING (project)""")
def incremental_plan(spark, sf_dir):
    from loomgraph.operators import incremental

    spark.read.parquet(f"{sf_dir}/supplier.parquet").createOrReplaceTempView("supplier")
    return incremental.plan(*map(spark.sql, _units(True)), by=["project"])


@query("WITH RECURSIVE symbols AS (" + PROJECTIONS["file_symbols"] + "), refs AS (" + PROJECTIONS["file_refs"] + "), " + EDGES_SQL + " SELECT * FROM edges")
def incremental_edges(spark, sf_dir):
    """The edge table after an update that adds, changes and removes files and renames declarations: it equals the one built anew."""
    from loomgraph.operators import incremental, resolve
    from loomgraph.operators.tables import kept

    refs, symbols = kept(projected(spark, sf_dir, "file_refs")), projected(spark, sf_dir, "file_symbols")
    gone = F.concat(F.lit("old/"), "path")
    was_refs = refs.filter("line % 31 != 7").withColumn("qualified", F.col("qualified") != (F.col("line") % 41 == 3)).withColumn("path", F.when(F.col("line") % 53 < 10, gone).otherwise(F.col("path")))
    was_symbols = symbols.withColumn("name", F.when(F.col("id") % 211 == 0, F.concat("name", F.lit("~"))).otherwise(F.col("name")))
    files = lambda r, s: r.select("path", F.col("lang").alias("language")).union(s.select("path", "lang")).distinct()
    # edges carry their lists' digests until the last join
    old = kept(resolve.edges(was_refs, was_symbols, show=resolve.list_id))
    made = kept(incremental.outputs(old))
    before = kept(incremental.witness(files(was_refs, was_symbols), was_refs, was_symbols, old, made))
    planned = kept(incremental.plan(before, before, incremental.witness(files(refs, symbols), refs, symbols, old, made)))
    e = kept(incremental.maintained(old, planned, refs, symbols, show=resolve.list_id))
    return resolve.relisted(e, [was_symbols, symbols], lambda found: F.array_join(F.transform(found, lambda c: F.concat_ws(":", c["path"], c["line"])), ","))


@query("""WITH g AS (SELECT o_orderkey AS generation, o_custkey AS repo, o_orderdate AS seq, o_totalprice AS bytes, o_orderstatus = 'P' AS root FROM orders),
 r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq DESC, generation DESC) AS k FROM g)
 SELECT repo, generation, CASE WHEN root THEN 'root' WHEN k > 5 THEN 'count' WHEN seq < TIMESTAMP '1996-01-01' THEN 'age' END AS reason, root OR k <= 5 AND seq >= TIMESTAMP '1996-01-01' AS kept FROM r""")
def retention(spark, sf_dir):
    from loomgraph.streaming.retention import retained

    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    g = o.select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("generation"), F.col("o_orderdate").alias("seq"), F.col("o_orderdate").alias("created"), (F.col("o_orderstatus") == "P").alias("root"))
    return retained(g, keep_last=5, oldest=F.lit("1996-01-01").cast("timestamp")).select("repo", "generation", F.when(F.col("reason").isin("count", "age", "root"), F.col("reason")).alias("reason"), "kept")
