"""Queries on symbols, references, edges and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import graph, lookup, resolve, rules
from loomgraph.operators.intervals import declared_first, innermost, ordinal
from loomgraph.operators.tables import kept
from loomgraph.plans.edges_sql import CANDIDATES, EDGES_SQL, INNERMOST
from loomgraph.plans.paging import paged
from loomgraph.plans.projection import assertion_links, projected, reference_places, references_of, with_sql
from loomgraph.registry import query

CALLEE = "hot plate/SMALL/16"

_WITH = with_sql("symbols", "refs") + ", " + EDGES_SQL
_STRUCT = "('call', 'construct', 'superclass', 'include', 'extend', 'prepend')"
_CONF = f"conf AS (SELECT * FROM edges WHERE confidence IN ('EXTRACTED', 'INFERRED') AND relation IN {_STRUCT})"


def listed(candidates: Column | str) -> Column:
    """The candidates of one name as text."""
    return F.array_join(F.transform(candidates, lambda c: F.concat_ws(":", c["path"], c["line"])), ",")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.edges(projected(spark, sf_dir, "refs"), projected(spark, sf_dir, "symbols"), show=listed)


def _bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges for what does not look at candidates."""
    return resolve.edges(projected(spark, sf_dir, "refs"), projected(spark, sf_dir, "symbols"), candidates=False)


def _edges_to(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # few lines of many: written once, as their names and files select what takes part
    return resolve.edges_for(kept(references_of(spark, sf_dir, name)), projected(spark, sf_dir, "symbols"), show=listed)


@query(_WITH + " SELECT * FROM edges")
def edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(_WITH + f" SELECT * FROM edges WHERE callee_name = '{CALLEE}' AND relation IN ('call', 'construct')")
def callers_of(spark, sf_dir):
    return lookup.callers_of(_edges_to(spark, sf_dir, CALLEE), "Any#" + CALLEE)


@query(_WITH + " SELECT * FROM edges WHERE callee_name = (SELECT min(callee_name) FROM edges WHERE relation = 'superclass') AND relation IN ('superclass', 'include', 'extend', 'prepend')")
def subclasses_of(spark, sf_dir):
    # the first name with an heir: a reference that some class or module answers
    heir = projected(spark, sf_dir, "symbols").filter("kind in ('class', 'module')").select("lang", F.col("name").alias("callee_name"))
    first = projected(spark, sf_dir, "refs").filter("relation = 'superclass'").join(heir, ["lang", "callee_name"], "left_semi").agg(F.min("callee_name")).first()[0] or ""
    return lookup.subclasses_of(_edges_to(spark, sf_dir, first), first)


@query(with_sql("symbols") + f" SELECT * FROM symbols WHERE name = '{CALLEE}'")
def search_symbol(spark, sf_dir):
    return lookup.search_symbol(projected(spark, sf_dir, "symbols"), CALLEE)


@query(with_sql("refs") + f" SELECT * FROM refs WHERE callee_name = '{CALLEE}'")
def definitions_references(spark, sf_dir):
    return lookup.references_to(projected(spark, sf_dir, "refs"), CALLEE)


@query(_WITH + f", {_CONF} SELECT relation, confidence, count(*) AS n, count(DISTINCT callee_name) AS names FROM conf GROUP BY ALL")
def confident_edges(spark, sf_dir):
    return lookup.confident(_bare(spark, sf_dir)).groupBy("relation", "confidence").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("callee_name").alias("names"))


@query(_WITH + " SELECT relation, source_path, source_line, source_col, callee_name, CASE WHEN confidence <> 'AMBIGUOUS' THEN target_path || ':' || target_line || ':' || target_name END AS target, CASE WHEN confidence = 'AMBIGUOUS' THEN candidates END AS candidates FROM edges")
def edge_shapes(spark, sf_dir):
    t = lookup.shaped(_edges(spark, sf_dir))
    return t.select("relation", "source_path", "source_line", "source_col", "callee_name", F.when(F.col("target").isNotNull(), F.concat_ws(":", "target.path", "target.line", "target.name")).alias("target"), "candidates")


@query(with_sql("symbols", "refs") + f", {CANDIDATES} SELECT coalesce(confidence, 'UNRESOLVED') AS tier, rel2 AS relation, count(*) AS n FROM tier GROUP BY ALL")
def confidence_tiers(spark, sf_dir):
    r = resolve.resolved(projected(spark, sf_dir, "refs"), projected(spark, sf_dir, "symbols"))
    return r.groupBy(F.coalesce("confidence", F.lit("UNRESOLVED")).alias("tier"), F.col("resolved_relation").alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@query(_WITH + " SELECT count(*) AS ambiguous FROM edges WHERE confidence = 'AMBIGUOUS'")
def ambiguous_edge_count(spark, sf_dir):
    return _bare(spark, sf_dir).filter("confidence = 'AMBIGUOUS'").agg(F.count(F.lit(1)).alias("ambiguous"))


@query(_WITH + """ SELECT r.relation, count(*) AS n FROM refs r WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.source_path = r.path AND e.source_line = r.line AND e.source_col = r.col AND e.lang = r.lang
  AND (e.relation = r.relation OR r.relation = 'call' AND e.relation = 'construct')) GROUP BY r.relation""")
def unresolved_refs(spark, sf_dir):
    r = projected(spark, sf_dir, "refs")
    return resolve.unresolved(r, _bare(spark, sf_dir)).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("symbols", "refs") + f", {INNERMOST} SELECT p.path, p.line, source_name, source_kind FROM (SELECT DISTINCT path, line FROM refs) p LEFT JOIN src USING (path, line)")
def enclosing_symbol(spark, sf_dir):
    return innermost(reference_places(spark, sf_dir), projected(spark, sf_dir, "symbols"), ["path", "line"], distinct=True)


_DECL = """decl AS (SELECT path, line, source_name, source_kind, min(line_start) AS source_line_start FROM (SELECT p.path, p.line, p.source_name, p.source_kind, s.line_start FROM
  (SELECT DISTINCT source_path AS path, source_line AS line, source_name, source_kind FROM conf WHERE target_path IS NOT NULL AND source_name IS NOT NULL) p
  JOIN symbols s ON s.path = p.path AND s.name = p.source_name AND s.kind = p.source_kind AND s.line_start <= p.line AND p.line <= s.line_end) GROUP BY ALL)"""


@query(_WITH + f", {_CONF}, {_DECL} SELECT * FROM decl")
def source_declaration(spark, sf_dir):
    e = lookup.confident(_bare(spark, sf_dir)).filter("target_path is not null and source_name is not null")
    p = e.select(F.col("source_path").alias("path"), F.col("source_line").alias("line"), "source_name", "source_kind").distinct()
    return declared_first(p, projected(spark, sf_dir, "symbols"))


@query(_WITH + f""", {_CONF}, {_DECL}, o AS (SELECT d.path, d.source_line_start AS line, d.source_name AS name, count(*) AS out_degree FROM conf c
  JOIN decl d ON d.path = c.source_path AND d.line = c.source_line AND d.source_name = c.source_name AND d.source_kind = c.source_kind WHERE c.target_path IS NOT NULL GROUP BY ALL),
 i AS (SELECT target_path AS path, target_line AS line, target_name AS name, count(*) AS in_degree FROM conf WHERE target_path IS NOT NULL GROUP BY ALL)
 SELECT path, line, name, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) + coalesce(out_degree, 0) AS degree, kind FROM i FULL JOIN o USING (path, line, name) LEFT JOIN (SELECT path, line_start AS line, name, min(kind) AS kind FROM symbols GROUP BY ALL) USING (path, line, name)""")
def god_nodes(spark, sf_dir):
    return graph.degrees(_bare(spark, sf_dir), projected(spark, sf_dir, "symbols"))


@query(_WITH + f", {_CONF} SELECT 'confident_edges' AS analysis_basis, (SELECT count(*) FROM conf) AS resolved_edge_count, (SELECT count(*) FROM edges WHERE confidence = 'AMBIGUOUS') AS ambiguous_edges_excluded")
def degree_basis(spark, sf_dir):
    return graph.degree_basis(_bare(spark, sf_dir))


@query(_WITH + """, top AS (SELECT source_path, source_line, source_col, callee_name, relation, row_number() OVER (ORDER BY source_path, source_line, source_col, callee_name, relation) AS k FROM edges)
  SELECT source_path, source_line, source_col, callee_name, relation, (SELECT max(k) FROM top WHERE k <= 201) > 200 AS truncated, 200 AS returned_count FROM top WHERE k <= 200""")
def truncation_flags(spark, sf_dir):
    e = _bare(spark, sf_dir).select(*lookup.EDGE_ORDER, "relation")
    return lookup.capped(e, 200, [*lookup.EDGE_ORDER, "relation"])


@query(with_sql("symbols") + " SELECT path, kind, name, id, row_number() OVER (PARTITION BY path, kind, name ORDER BY line_start, id) - 1 AS ordinal FROM symbols")
def sibling_ordinal(spark, sf_dir):
    return ordinal(projected(spark, sf_dir, "symbols").select("path", "kind", "name", "id", "line_start"), ["path", "kind", "name"], ["line_start", "id"]).drop("line_start")


@query(with_sql("symbols") + " SELECT path, name, line_start, sum(length(name)) OVER w AS spent FROM symbols WINDOW w AS (PARTITION BY path ORDER BY line_start, id ROWS UNBOUNDED PRECEDING) QUALIFY spent <= 500")
def budget_prefix(spark, sf_dir):
    s = projected(spark, sf_dir, "symbols")
    return lookup.within_budget(s, ["line_start", "id"], F.length("name"), 500, ["path"]).select("path", "name", "line_start", "spent")


# scopes: three levels per reference; blockers and declarations are drawn from lineitem
_SCOPE = """ds AS (SELECT p_brand AS path, CAST(p_size % 4 AS STRING) AS scope, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_type || '~' || p_partkey % 7 END AS name, p_partkey AS line_start FROM part),
bs AS (SELECT DISTINCT p_brand AS path, CAST(p_size % 4 AS STRING) AS scope, CASE WHEN p_partkey % 19 <> 1 THEN p_type || '-' || p_partkey % 7 WHEN p_partkey % 41 = 0 THEN '*' ELSE p_type END AS name,
  CASE p_partkey % 3 WHEN 0 THEN 'import' WHEN 1 THEN 'assignment' ELSE 'unsupported' END AS binding_kind FROM part)"""


@query("WITH " + _SCOPE + """, rs AS (SELECT p_partkey AS ref_id, p_brand AS path, p_type AS callee_name, [CAST(p_size % 5 AS STRING), CAST(p_size % 3 AS STRING), '0'] AS scopes FROM part),
x AS (SELECT ref_id, path, callee_name, unnest(scopes) AS scope, generate_subscripts(scopes, 1) AS pos FROM rs),
y AS (SELECT x.*, (SELECT string_agg(d.path || ':' || d.line_start, ',' ORDER BY d.path, d.line_start) FROM ds d WHERE d.path = x.path AND d.scope = x.scope AND d.name = x.callee_name) AS found,
  (SELECT min(CASE b.binding_kind WHEN 'unsupported' THEN 0 WHEN 'import' THEN 2 ELSE 1 END) FROM bs b WHERE b.path = x.path AND b.scope = x.scope AND b.name = x.callee_name) AS b1,
  (SELECT 0 FROM bs b WHERE b.path = x.path AND b.scope = x.scope AND b.name = '*' LIMIT 1) AS b2 FROM x),
z AS (SELECT *, coalesce(b2, b1) AS block FROM y WHERE found IS NOT NULL OR coalesce(b2, b1) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY pos) = 1)
SELECT r.ref_id, CASE WHEN z.block IS NULL THEN z.found END AS candidates, CASE WHEN z.ref_id IS NULL THEN 'no_visible_target' WHEN z.block = 0 THEN 'unsupported_scope' WHEN z.block = 2 THEN 'unknown_import_alias' WHEN z.block = 1 THEN 'shadowed_noncallable' END AS reason
FROM rs r LEFT JOIN z USING (ref_id)""")
def scope_chain(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = lambda c: c.cast("string")
    refs = p.select(F.col("p_partkey").alias("ref_id"), F.col("p_brand").alias("path"), F.col("p_type").alias("callee_name"), F.array(text(F.col("p_size") % 5), text(F.col("p_size") % 3), F.lit("0")).alias("scopes"))
    other = lambda mark: F.concat("p_type", F.lit(mark), F.col("p_partkey") % 7)
    d = p.select(F.col("p_brand").alias("path"), text(F.col("p_size") % 4).alias("scope"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(other("~")).alias("name"), F.lit("function").alias("kind"), F.col("p_partkey").alias("line_start"))
    kind = F.when(F.col("p_partkey") % 3 == 0, "import").when(F.col("p_partkey") % 3 == 1, "assignment").otherwise("unsupported")
    b = p.select(F.col("p_brand").alias("path"), text(F.col("p_size") % 4).alias("scope"), F.when(F.col("p_partkey") % 19 != 1, other("-")).when(F.col("p_partkey") % 41 == 0, "*").otherwise(F.col("p_type")).alias("name"), kind.alias("binding_kind")).distinct()
    out = resolve.visible(refs, d, b)
    return out.select("ref_id", F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["path"], c["line"])), ",").alias("candidates"), "reason")


@query("""WITH rs AS (SELECT p_partkey AS ref_id, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN p_type ELSE p_type || '::' || split_part(p_name, ' ', 1) END AS ns, split_part(p_name, ' ', 2) AS callee FROM part),
ds AS (SELECT CASE p_size % 3 WHEN 0 THEN split_part(p_name, ' ', 2) WHEN 1 THEN p_type || '::' || split_part(p_name, ' ', 2) ELSE p_type || '::' || split_part(p_name, ' ', 1) || '::' || split_part(p_name, ' ', 2) END AS full_name, p_brand AS path, p_partkey AS line_start FROM part),
t AS (SELECT ref_id, unnest(CASE WHEN ns = '' THEN [callee] WHEN contains(ns, '::') THEN [ns || '::' || callee, split_part(ns, '::', 1) || '::' || callee, callee] ELSE [ns || '::' || callee, callee] END) AS full_name, unnest(CASE WHEN ns = '' THEN [0] WHEN contains(ns, '::') THEN [0, 1, 2] ELSE [0, 1] END) AS pos FROM rs),
f AS (SELECT t.ref_id, t.full_name, t.pos, string_agg(d.path || ':' || d.line_start, ',' ORDER BY d.path, d.line_start) AS candidates FROM t JOIN ds d USING (full_name) GROUP BY t.ref_id, t.full_name, t.pos QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY pos) = 1)
SELECT r.ref_id, f.full_name, f.candidates FROM rs r LEFT JOIN f USING (ref_id)""")
def ruby_namespace(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    one, two, size = F.split("p_name", " ")[0], F.split("p_name", " ")[1], F.col("p_size") % 3
    refs = p.select(F.col("p_partkey").alias("ref_id"), F.when(size == 0, "").when(size == 1, F.col("p_type")).otherwise(F.concat_ws("::", "p_type", one)).alias("namespace"), two.alias("callee_name"))
    d = p.select(F.when(size == 0, two).when(size == 1, F.concat_ws("::", "p_type", two)).otherwise(F.concat_ws("::", "p_type", one, two)).alias("full_name"), F.col("p_brand").alias("path"), F.col("p_partkey").alias("line_start"))
    return resolve.namespaced(refs, d, listed).select("ref_id", "full_name", "candidates")


@query("""WITH rs AS (SELECT p_partkey AS ref_id, p_brand AS path, p_type AS receiver, split_part(p_name, ' ', 1) AS callee_name, CASE WHEN p_size % 2 = 0 THEN 'instance' END AS category FROM part),
ty AS (SELECT DISTINCT CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_type || '~' END AS name, p_brand AS path, p_brand || p_type AS identity FROM part),
de AS (SELECT p_brand || p_type AS owner, split_part(p_name, ' ', 1) AS name, CASE p_size % 3 WHEN 0 THEN 'instance' WHEN 1 THEN 'class' ELSE 'unknown' END AS category, p_brand AS path, p_partkey AS line_start FROM part),
o AS (SELECT r.*, t.identity FROM rs r LEFT JOIN ty t ON t.name = r.receiver AND t.path = r.path),
m AS (SELECT o.ref_id, string_agg(DISTINCT d.path || ':' || lpad(CAST(d.line_start AS STRING), 9, '0'), ',' ORDER BY d.path || ':' || lpad(CAST(d.line_start AS STRING), 9, '0')) AS candidates FROM o JOIN de d ON d.owner = o.identity AND d.name = o.callee_name AND d.path = o.path AND d.category <> 'unknown' AND (o.category IS NULL OR o.category = d.category) GROUP BY 1)
SELECT o.ref_id, m.candidates, CASE WHEN o.identity IS NULL THEN 'unknown_receiver' WHEN m.candidates IS NULL THEN 'owner_has_no_member' END AS reason FROM o LEFT JOIN m USING (ref_id)""")
def receiver_members(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    one, owner = F.split("p_name", " ")[0], F.concat("p_brand", "p_type")
    refs = p.select(F.col("p_partkey").alias("ref_id"), F.col("p_brand").alias("path"), F.col("p_type").alias("receiver"), one.alias("callee_name"), F.when(F.col("p_size") % 2 == 0, "instance").alias("category"))
    types = p.select(F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")).otherwise(F.concat("p_type", F.lit("~"))).alias("name"), F.col("p_brand").alias("path"), owner.alias("identity")).distinct()
    kind = F.when(F.col("p_size") % 3 == 0, "instance").when(F.col("p_size") % 3 == 1, "class").otherwise("unknown")
    d = p.select(owner.alias("owner"), one.alias("name"), kind.alias("category"), F.col("p_brand").alias("path"), F.col("p_partkey").alias("line_start"))
    shown = lambda found: F.array_join(F.transform(found, lambda c: F.concat(c["path"], F.lit(":"), F.lpad(c["line"].cast("string"), 9, "0"))), ",")
    return resolve.members(refs, types, d, shown).select("ref_id", "candidates", "reason")


# breadth-first search over supplier chains
_STEP = "st AS (SELECT {a} AS here, {b} AS there, min(struct_pack(r := relation, i := assertion_id)) AS s FROM assertions WHERE relation IN ({r}) AND confidence IN ('EXTRACTED', 'INFERRED') GROUP BY 1, 2)"
_STARTS = "('s1'), ('s7'), ('s42')"


def _levels(depth: int, starts: str) -> str:
    """Breadth-first levels as one CTE each: node, distance, parent, relation, place."""
    parts = [f"l0 AS (SELECT x0 AS seed, x0 AS node, 0 AS distance, NULL::VARCHAR AS parent, NULL::VARCHAR AS relation, NULL::BIGINT AS assertion_id, 1 AS place FROM (VALUES {starts}) v(x0)), s0 AS (SELECT * FROM l0)"]
    for k in range(1, depth + 1):
        parts.append(f"""l{k} AS (SELECT seed, node, {k} AS distance, parent, s.r AS relation, s.i AS assertion_id, row_number() OVER (PARTITION BY seed ORDER BY pp, s, node) AS place FROM (
          SELECT l.seed, st.there AS node, l.place AS pp, st.s, l.node AS parent FROM l{k - 1} l JOIN st ON st.here = l.node
          WHERE NOT EXISTS (SELECT 1 FROM s{k - 1} s WHERE s.seed = l.seed AND s.node = st.there) QUALIFY row_number() OVER (PARTITION BY l.seed, st.there ORDER BY l.place, st.s, l.node) = 1)),
          s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM l{k})""")
    return ", ".join(parts)


@query(with_sql("assertions") + ", " + _STEP.format(a="source", b="target", r="'call'") + ", " + _levels(3, _STARTS) + " SELECT seed, node, distance, parent, relation, assertion_id FROM s3")
def neighborhood(spark, sf_dir):
    starts = spark.createDataFrame([("s1",), ("s7",), ("s42",)], "seed string")
    return graph.neighborhood(projected(spark, sf_dir, "assertions"), starts, 3)


@query(with_sql("assertions") + ", " + _STEP.format(a="target", b="source", r="'call', 'import'") + ", " + _levels(2, _STARTS) + " SELECT seed, node, distance, parent, relation, assertion_id FROM s2")
def neighborhood_incoming(spark, sf_dir):
    starts = spark.createDataFrame([("s1",), ("s7",), ("s42",)], "seed string")
    return graph.neighborhood(projected(spark, sf_dir, "assertions"), starts, 2, ("call", "import"), incoming=True)


@query(with_sql("assertions") + ", " + _STEP.format(a="source", b="target", r="'call'") + ", " + _levels(3, "('s1'), ('s2'), ('s3'), ('nowhere')") + """,
 w AS (SELECT x0 AS seed, x1 AS target FROM (VALUES ('s1', 's5'), ('s2', 'p60'), ('s3', 'nowhere'), ('nowhere', 's1'), ('s1', 's1'), ('s2', 's0'), ('s3', 'p7')) v(x0, x1)), ent AS (SELECT source AS e FROM assertions UNION SELECT target FROM assertions),
 walk(seed, target, node, path, hops, distance) AS (SELECT w.seed, w.target, s.node, s.node, '', s.distance FROM w JOIN s3 s ON s.seed = w.seed AND s.node = w.target
   UNION ALL SELECT k.seed, k.target, s.parent, s.parent || ' > ' || k.path, s.assertion_id || ',' || k.hops, k.distance FROM walk k JOIN s3 s ON s.seed = k.seed AND s.node = k.node WHERE s.parent IS NOT NULL),
 o AS (SELECT w.seed, w.target, k.distance, k.path AS nodes, rtrim(k.hops, ',') AS hops, CASE WHEN w.seed NOT IN (SELECT e FROM ent) OR w.target NOT IN (SELECT e FROM ent) THEN 'no_evidence' WHEN k.path IS NOT NULL THEN 'complete' WHEN w.seed IN (SELECT seed FROM l3) THEN 'partial' ELSE 'no_path' END AS outcome
  FROM w LEFT JOIN (SELECT * FROM walk WHERE node = seed) k USING (seed, target))
 SELECT seed, target, CASE WHEN outcome = 'complete' THEN distance END AS distance, CASE WHEN outcome = 'complete' THEN nodes END AS nodes, CASE WHEN outcome = 'complete' THEN hops END AS hops, outcome, CASE WHEN outcome = 'partial' THEN 'depth_limit' END AS stop_reason FROM o""")
def shortest_path(spark, sf_dir):
    pairs = spark.createDataFrame([("s1", "s5"), ("s2", "p60"), ("s3", "nowhere"), ("nowhere", "s1"), ("s1", "s1"), ("s2", "s0"), ("s3", "p7")], "seed string, target string")
    a = projected(spark, sf_dir, "assertions")
    entities = a.select(F.col("source").alias("entity_id")).union(a.select("target")).distinct()
    return graph.shortest_paths(a, pairs, 3, entities).withColumn("nodes", F.array_join("nodes", " > ")).withColumn("hops", F.array_join("hops", ","))


# the budgets cut after a fixed number of edges and nodes; the order of examination is that of the levels
_EXAMINED = """ex AS (SELECT s.seed, (s.distance, s.place, a.relation, a.assertion_id) AS pos, s.distance, a.* FROM s2 s JOIN assertions a ON a.source = s.node WHERE s.distance < 2 AND a.relation = 'call'),
 er AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY pos) AS n FROM ex), nr AS (SELECT s.*, CASE WHEN s.parent IS NOT NULL THEN (p.distance, p.place, s.relation, s.assertion_id) END AS pos, row_number() OVER (PARTITION BY s.seed ORDER BY s.distance, s.place) AS n FROM s2 s LEFT JOIN s2 p ON p.seed = s.seed AND p.node = s.parent),
 st0 AS (SELECT seed, pos, 'examined_edge_limit' AS reason FROM er WHERE n = 301 UNION ALL SELECT seed, pos, 'visited_node_limit' FROM nr WHERE n = 201), stop AS (SELECT seed, min(pos) AS pos, arg_min(reason, pos) AS reason FROM st0 GROUP BY 1)"""
_TRAVERSED = with_sql("assertions") + ", " + _STEP.format(a="source", b="target", r="'call'") + ", " + _levels(2, _STARTS) + ", " + _EXAMINED


def _traversed(spark, sf_dir):
    starts = spark.createDataFrame([("s1",), ("s7",), ("s42",)], "seed string")
    return graph.traverse(projected(spark, sf_dir, "assertions"), starts, 2, max_nodes=200, max_edges=300)


@query(_TRAVERSED + " SELECT nr.seed, node, distance, parent, relation, assertion_id FROM nr LEFT JOIN stop USING (seed) WHERE stop.pos IS NULL OR nr.pos IS NULL OR nr.pos < stop.pos")
def traversal_nodes(spark, sf_dir):
    return _traversed(spark, sf_dir)[0]


@query(_TRAVERSED + " SELECT er.seed, assertion_id, source, target, relation, confidence, distance FROM er LEFT JOIN stop USING (seed) WHERE (stop.pos IS NULL OR er.pos < stop.pos) AND confidence IN ('EXTRACTED', 'INFERRED')")
def traversal_edges(spark, sf_dir):
    return _traversed(spark, sf_dir)[1]


@query(_TRAVERSED + " SELECT seed, CASE WHEN reason IS NULL AND seed NOT IN (SELECT seed FROM l2) THEN 'complete' ELSE 'partial' END AS outcome, coalesce(reason, CASE WHEN seed IN (SELECT seed FROM l2) THEN 'depth_limit' END) AS stop_reason FROM l0 LEFT JOIN stop USING (seed)")
def traversal_outcomes(spark, sf_dir):
    return _traversed(spark, sf_dir)[2]


@query("""WITH e AS (SELECT CAST(p_partkey AS STRING) AS entity_id, p_name AS name FROM part), w(wanted) AS (VALUES ('17'), ('small ring'), ('no such'), ((SELECT min(p_name) FROM part))),
 r AS (SELECT w.wanted, (SELECT entity_id FROM e WHERE entity_id = w.wanted) AS i, (SELECT count(*) FROM e WHERE name = w.wanted) AS n, (SELECT min(entity_id) FROM e WHERE name = w.wanted) AS m FROM (SELECT DISTINCT wanted FROM w) w)
 SELECT wanted, CASE WHEN i IS NOT NULL OR n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'absent' END AS outcome, CASE WHEN i IS NOT NULL THEN i WHEN n = 1 THEN m END AS entity_id FROM r""")
def endpoint_resolution(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    wanted = spark.createDataFrame([("17",), ("small ring",), ("no such",)], "wanted string").union(p.agg(F.min("p_name"))).distinct()
    return graph.endpoint(p.select(F.col("p_partkey").cast("string").alias("entity_id"), F.col("p_name").alias("name")), wanted)


@query()
def communities(spark, sf_dir):
    """Order-dependent by definition: no SQL form; the tests compare with one loop over the whole graph."""
    a = assertion_links(spark, sf_dir).filter("confidence in ('EXTRACTED', 'INFERRED')")
    links = kept(a.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct())
    return graph.communities(links.select(F.col("a").alias("node")).union(links.select("b")).distinct(), links)


_RULES = "rules AS (SELECT x0 AS rule_id, x1 AS from_prefix, x2 AS to_prefix FROM (VALUES ('r1', 's10', 's99'), ('r2', 's2', 's3'), ('r3', 'zz', 's1'), ('r4', 's5', 'q')) v(x0, x1, x2))"


@query(with_sql("assertions") + f""", {_RULES}, fe AS (SELECT DISTINCT source, target FROM assertions WHERE relation = 'import'), files AS (SELECT source AS path FROM fe UNION SELECT target FROM fe),
 b AS (SELECT DISTINCT source AS path FROM assertions WHERE confidence = 'AMBIGUOUS'), reach(seed, node, d) AS (SELECT path, path, 0 FROM files WHERE path[1:3] = 's10' OR path[1:2] IN ('s2', 's5', 'zz') UNION SELECT r.seed, fe.target, r.d + 1 FROM reach r JOIN fe ON fe.source = r.node WHERE r.d < 5),
 m AS (SELECT seed, node, min(d) AS d, min(d) FILTER (d > 0) AS led FROM reach GROUP BY 1, 2), met AS (SELECT r.rule_id, m.seed, m.node, m.d, m.led, starts_with(m.node, r.to_prefix) AS bad FROM rules r JOIN m ON starts_with(m.seed, r.from_prefix)),
 v AS (SELECT rule_id, count(*) AS n, arg_min(seed, (seed, node)) AS s, arg_min(node, (seed, node)) AS t FROM met WHERE bad AND led <= 4 GROUP BY 1), deep AS (SELECT DISTINCT rule_id FROM met WHERE d = 5 OR bad AND led = 5),
 odd AS (SELECT DISTINCT rule_id FROM met JOIN b ON b.path = met.node WHERE met.d <= 4)
 SELECT r.rule_id, CASE WHEN v.n > 0 THEN 'violated' WHEN rule_id IN (FROM deep) THEN 'incomplete_due_to_budget' WHEN rule_id IN (FROM odd) THEN 'unknown' ELSE 'satisfied_within_scope' END AS outcome, coalesce(v.n, 0) AS violations, v.s AS first_source, v.t AS first_target,
   concat_ws(',', CASE WHEN rule_id IN (FROM deep) THEN 'depth_limit' END, CASE WHEN rule_id IN (FROM odd) THEN 'import_boundary' END) AS reasons FROM rules r LEFT JOIN v USING (rule_id)""")
def architecture_rules(spark, sf_dir):
    a = assertion_links(spark, sf_dir)
    fe = kept(a.filter("relation = 'import'").select("source", "target").distinct())
    files = fe.select(F.col("source").alias("path")).union(fe.select("target")).distinct()
    given = spark.createDataFrame([("r1", "s10", "s99"), ("r2", "s2", "s3"), ("r3", "zz", "s1"), ("r4", "s5", "q")], "rule_id string, from_prefix string, to_prefix string")
    checked = rules.rule_check(fe, files, given, a.filter("confidence = 'AMBIGUOUS'").select(F.col("source").alias("path")), 4)
    return checked.drop("exhaustive").withColumn("reasons", F.array_join(F.array_sort(F.map_keys("reasons")), ","))


@query(with_sql("assertions") + """, b AS (SELECT DISTINCT relation AS rule_id, source, target FROM assertions WHERE confidence <> 'EXTRACTED'), a AS (SELECT DISTINCT relation AS rule_id, source, target FROM assertions WHERE confidence <> 'INFERRED')
 SELECT rule_id, source, target, CASE WHEN (rule_id, source, target) NOT IN (SELECT (rule_id, source, target) FROM b) THEN 'introduced' WHEN (rule_id, source, target) NOT IN (SELECT (rule_id, source, target) FROM a) THEN 'resolved' ELSE 'persisting' END AS delta
 FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def rule_delta(spark, sf_dir):
    a = projected(spark, sf_dir, "assertions").withColumnRenamed("relation", "rule_id")
    return graph.rule_delta(a.filter("confidence != 'EXTRACTED'"), a.filter("confidence != 'INFERRED'"))


@query(with_sql("assertions") + ", " + _STEP.format(a="target", b="source", r="'call', 'construct', 'superclass', 'include', 'extend', 'prepend'") + ", " + _levels(3, "('s1'), ('s7'), ('s42')") + """,
 sd AS (SELECT x0 AS seed, x1 AS category, x2 AS side FROM (VALUES ('s1', 'body', 'after'), ('s7', 'removed', 'before'), ('s42', 'added', 'after')) v(x0, x1, x2)),
 r AS (SELECT s.node, s.distance, s.seed, sd.category, sd.side, CASE sd.category WHEN 'removed' THEN 0 WHEN 'signature' THEN 1 WHEN 'body' THEN 2 WHEN 'unknown' THEN 3 ELSE 4 END AS weight FROM s3 s JOIN sd USING (seed) WHERE s.distance > 0)
 SELECT node, distance, seed, category, (SELECT count(DISTINCT seed) FROM r q WHERE q.node = r.node) AS reached_from_seeds FROM r QUALIFY row_number() OVER (PARTITION BY node ORDER BY distance, weight, side, seed) = 1""")
def impact(spark, sf_dir):
    seeds = spark.createDataFrame([("s1", "body", "after"), ("s7", "removed", "before"), ("s42", "added", "after")], "seed string, category string, side string")
    return graph.impact(projected(spark, sf_dir, "assertions"), seeds)


_SPANS = "sp AS (SELECT trace_id, span_id, CASE WHEN ts - prev_ts <= INTERVAL 90 MINUTE THEN prev_id END AS parent_id FROM spans)"


@query(with_sql("spans") + f""", {_SPANS}, walk(trace_id, span_id, path) AS (SELECT trace_id, span_id, CAST(span_id AS STRING) FROM sp WHERE parent_id IS NULL
   UNION ALL SELECT s.trace_id, s.span_id, w.path || '/' || s.span_id FROM walk w JOIN sp s ON s.trace_id = w.trace_id AND s.parent_id = w.span_id)
 SELECT trace_id, path FROM walk w WHERE NOT EXISTS (SELECT 1 FROM sp s WHERE s.trace_id = w.trace_id AND s.parent_id = w.span_id)""")
def runtime_paths(spark, sf_dir):
    s = projected(spark, sf_dir, "spans").withColumn("parent_id", F.when(F.col("ts") - F.col("prev_ts") <= F.expr("INTERVAL 90 MINUTE"), F.col("prev_id")))
    return graph.span_paths(s).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "/"))


_WALK = f"""{_SPANS}, own AS (SELECT *, CASE WHEN span_id % 7 = 0 AND parent_id IS NULL THEN -1 ELSE parent_id END AS named FROM sp), walk(trace_id, leaf, path) AS (SELECT trace_id, span_id, [span_id] FROM sp WHERE parent_id IS NULL
   UNION ALL SELECT s.trace_id, s.span_id, list_append(w.path, s.span_id) FROM walk w JOIN sp s ON s.trace_id = w.trace_id AND s.parent_id = w.leaf),
 chain AS (SELECT trace_id, path FROM walk w WHERE NOT EXISTS (SELECT 1 FROM sp s WHERE s.trace_id = w.trace_id AND s.parent_id = w.leaf)),
 cut AS (SELECT trace_id, path[1:3] AS path, bool_or(len(path) > 3) AS truncated FROM chain GROUP BY 1, path[1:3]), shown AS (SELECT *, row_number() OVER (ORDER BY trace_id, path) AS place FROM cut QUALIFY place <= 5000)"""


def _bounded_paths(spark, sf_dir):
    s = projected(spark, sf_dir, "spans").withColumn("parent_id", F.when(F.col("ts") - F.col("prev_ts") <= F.expr("INTERVAL 90 MINUTE"), F.col("prev_id")))
    # some first spans name a parent that no report holds
    return graph.bounded_paths(s.withColumn("parent_id", F.when(F.col("parent_id").isNull() & (F.col("span_id") % 7 == 0), F.lit(-1)).otherwise(F.col("parent_id"))), 5000, 3)


@query(with_sql("spans") + f", {_WALK} SELECT s.trace_id, array_to_string(path, '/') AS path, CASE WHEN o.named IS NULL THEN 'trace_root' ELSE 'parent_not_in_artifact' END AS origin, truncated, place FROM shown s JOIN own o ON o.trace_id = s.trace_id AND o.span_id = s.path[1]")
def runtime_paths_bounded(spark, sf_dir):
    return _bounded_paths(spark, sf_dir)[0].withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "/"))


@query(with_sql("spans") + f", {_WALK} SELECT (SELECT count(*) FROM chain) AS paths_total, (SELECT count(*) FROM shown) < (SELECT count(*) FROM chain) OR (SELECT bool_or(truncated) FROM shown) AS paths_truncated")
def runtime_path_totals(spark, sf_dir):
    return _bounded_paths(spark, sf_dir)[1]


@query(with_sql("refs") + " SELECT path, line, col, callee_name, relation FROM refs ORDER BY path, line, col, callee_name, relation LIMIT 1000 OFFSET 2000")
def result_page(spark, sf_dir):
    """The third page of all references in order."""
    r = projected(spark, sf_dir, "refs").select("path", "line", "col", "callee_name", "relation")
    return paged(r, r.columns, 1000).page(2)
