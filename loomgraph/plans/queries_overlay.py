"""Queries on external evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import scalars
from loomgraph.operators import overlays
from loomgraph.plans.projection import projected, views, with_sql
from loomgraph.registry import query

_PART_SPANS = "SELECT p_brand AS path, p_partkey AS span_id, p_partkey AS start, p_partkey + p_size AS stop, p_partkey + p_size % 4 AS header_end FROM part"
_COVER = f"""ps AS ({_PART_SPANS}), cov AS (SELECT e.path, s.span_id, e.test, sum(greatest(least(e.line_to, s.stop) - greatest(e.line_from, s.start), 1)) AS lines, bool_or(greatest(e.line_to, e.line_from + 1) - 1 > s.header_end) AS body
 FROM executions e JOIN ps s ON s.path = e.path AND e.line_from < s.stop AND greatest(e.line_to, e.line_from + 1) > s.start GROUP BY ALL)"""


def _sql(spark, sf_dir, text):
    views(spark, sf_dir)
    return spark.sql(text)


def _covered(spark, sf_dir):
    return overlays.covered_spans(projected(spark, sf_dir, "executions"), _sql(spark, sf_dir, _PART_SPANS))


@query(with_sql("executions") + f", {_COVER} SELECT * FROM cov")
def coverage_overlap(spark, sf_dir):
    return _covered(spark, sf_dir)


@query(with_sql("executions") + f""", {_COVER}, c AS (SELECT path, span_id, bool_or(body) AS body FROM cov GROUP BY ALL)
 SELECT s.path, s.span_id, CASE WHEN c.body THEN 'executed' WHEN c.path IS NOT NULL THEN 'declaration_only' WHEN s.path IN (SELECT path FROM executions WHERE path <> 'Brand#3') THEN 'no_observation_in_span' WHEN s.path = 'Brand#3' THEN 'stale_only' ELSE 'no_coverage_source' END AS state
 FROM ps s LEFT JOIN c ON c.path = s.path AND c.span_id = s.span_id""")
def coverage_states(spark, sf_dir):
    ex = projected(spark, sf_dir, "executions")
    stale = spark.createDataFrame([("Brand#3",)], "path string")
    return overlays.coverage_state(_sql(spark, sf_dir, _PART_SPANS), _covered(spark, sf_dir), ex.filter("path != 'Brand#3'"), stale)


@query("""SELECT event_type AS test, CAST(user_id AS STRING) AS path, CAST(floor(value / 10) AS BIGINT) AS line, array_to_string(list_sort(list(DISTINCT CASE event_id % 3 WHEN 0 THEN 'setup' WHEN 1 THEN 'call' ELSE 'teardown' END)), ',') AS phases FROM events GROUP BY ALL""")
def coverage_observations(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    phase = F.when(F.col("event_id") % 3 == 0, "setup").when(F.col("event_id") % 3 == 1, "call").otherwise("teardown")
    rows = e.select(F.col("event_type").alias("test"), F.col("user_id").cast("string").alias("path"), F.floor(F.col("value") / 10).cast("long").alias("line"), phase.alias("phase"))
    return overlays.observations(rows).withColumn("phases", F.array_join("phases", ","))


_PARENT = "sp AS (SELECT trace_id, span_id, CASE WHEN prev_id % 7 = 0 THEN prev_id + 1000000 WHEN ts - prev_ts <= INTERVAL 90 MINUTE THEN prev_id END AS parent_id FROM spans)"


def _spans(spark, sf_dir):
    s = projected(spark, sf_dir, "spans")
    near = F.col("ts") - F.col("prev_ts") <= F.expr("INTERVAL 90 MINUTE")
    return s.select("trace_id", "span_id", F.when(F.col("prev_id") % 7 == 0, F.col("prev_id") + 1000000).when(near, F.col("prev_id")).alias("parent_id"))


@query(with_sql("spans") + f", {_PARENT} SELECT s.trace_id, s.span_id, s.parent_id, CASE WHEN s.parent_id IS NULL THEN 'root' WHEN p.span_id IS NOT NULL THEN 'child' ELSE 'boundary' END AS place FROM sp s LEFT JOIN sp p ON p.trace_id = s.trace_id AND p.span_id = s.parent_id")
def span_parents(spark, sf_dir):
    return overlays.span_parents(_spans(spark, sf_dir))


@query(with_sql("spans") + f", {_PARENT} SELECT count(*) AS spans, count(DISTINCT s.trace_id) AS traces, count(*) FILTER (s.parent_id IS NULL) AS roots, count(*) FILTER (s.parent_id IS NOT NULL AND p.span_id IS NULL) AS orphans FROM sp s LEFT JOIN sp p ON p.trace_id = s.trace_id AND p.span_id = s.parent_id")
def trace_summary(spark, sf_dir):
    return overlays.trace_summary(_spans(spark, sf_dir))


_LINK_SPANS = """SELECT event_id AS span_id, CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN '/else/x.py' ELSE concat('/app/f', CAST(user_id AS STRING), '.py') END AS file,
 CASE event_id % 13 WHEN 0 THEN NULL WHEN 1 THEN 'abc' WHEN 2 THEN '0' ELSE CAST(CAST(floor(value) AS BIGINT) AS STRING) END AS line, event_id % 17 <> 3 AS build_ok FROM events"""
_LINK_FILES = "SELECT concat('f', CAST(c_custkey AS STRING), '.py') AS path, c_custkey % 5 <> 0 AS indexed, 40 + c_custkey % 100 AS n_lines, 20 + c_custkey % 10 AS symbol_until FROM customer WHERE c_custkey % 3 <> 0"


@query(f"""WITH s AS ({_LINK_SPANS}), f AS ({_LINK_FILES}) SELECT span_id, CASE WHEN file IS NULL OR line IS NULL THEN 'missing' WHEN try_cast(line AS BIGINT) IS NULL OR try_cast(line AS BIGINT) < 1 THEN 'malformed' WHEN NOT build_ok THEN 'build_mismatch'
 WHEN NOT starts_with(file, '/app/') THEN 'path_outside_root' WHEN f.path IS NULL THEN 'file_not_in_snapshot' WHEN NOT indexed THEN 'file_not_indexed' WHEN try_cast(line AS BIGINT) > n_lines THEN 'line_out_of_range' WHEN try_cast(line AS BIGINT) <= symbol_until THEN 'linked_symbol' ELSE 'linked_file' END AS linkage
 FROM s LEFT JOIN f ON starts_with(file, '/app/') AND f.path = substr(file, 6)""")
def trace_linkage(spark, sf_dir):
    return overlays.linkage(_sql(spark, sf_dir, _LINK_SPANS), spark.sql(_LINK_FILES), "/app/")


_COMMITS = with_sql("commit_paths") + """, ok AS (SELECT DISTINCT commit_id, path FROM commit_paths WHERE NOT starts_with(path, 'gen/') AND mode <> '160000'),
 cl AS (SELECT c.commit_id, c.n, CASE WHEN parents > 1 THEN 'merge' WHEN n > 5 THEN 'bulk' WHEN n = 0 THEN 'empty' WHEN n = 1 THEN 'single' ELSE 'pair' END AS class FROM
  (SELECT commit_id, max(parents) AS parents, count(DISTINCT CASE WHEN NOT starts_with(path, 'gen/') AND mode <> '160000' THEN path END) AS n FROM commit_paths GROUP BY 1) c)"""


@query(_COMMITS + " SELECT class, count(*) AS commits, CAST(sum(n) AS BIGINT) AS paths FROM cl GROUP BY 1")
def commit_classes(spark, sf_dir):
    per = overlays.commit_classes(projected(spark, sf_dir, "commit_paths"), 5, ("gen/",))[1]
    return per.groupBy("class").agg(F.count(F.lit(1)).alias("commits"), F.sum("n").alias("paths"))


@query(_COMMITS + """, r AS (SELECT ok.* FROM ok JOIN cl USING (commit_id) WHERE class = 'pair') SELECT x.path AS a, y.path AS b, count(*) AS support, string_agg(CAST(commit_id AS STRING), ',' ORDER BY commit_id) AS commits FROM r x JOIN r y USING (commit_id) WHERE x.path < y.path GROUP BY 1, 2""")
def co_change(spark, sf_dir):
    return overlays.co_change(projected(spark, sf_dir, "commit_paths"), 5, prefixes=("gen/",)).withColumn("commits", F.array_join("commits", ","))


def _contract(side: str) -> str:
    keep, req, dig = ("<> 0", "", "0") if side == "before" else ("<> 1", "+ CASE WHEN page_id % 6 = 0 THEN 1 ELSE 0 END", "CASE WHEN page_id % 8 = 0 THEN 1 ELSE 0 END")
    return f"SELECT CAST(page_id % 200 AS STRING) AS path, CASE page_id % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS method, CAST(page_id % 3 {req} AS INT) AS nreq, concat('d', CAST(page_id % 200 + {dig} AS STRING)) AS digest, page_id % 37 <> 5 AS complete FROM pages WHERE page_id % 10 {keep}"


@query(f"""WITH b AS (SELECT path, method, count(*) AS n, min(nreq) AS req, min(digest) AS dig, bool_and(complete) AS ok FROM ({_contract('before')}) GROUP BY 1, 2), a AS (SELECT path, method, count(*) AS n, min(nreq) AS req, min(digest) AS dig, bool_and(complete) AS ok FROM ({_contract('after')}) GROUP BY 1, 2)
 SELECT path, method, kind FROM (SELECT coalesce(b.path, a.path) AS path, coalesce(b.method, a.method) AS method, CASE WHEN coalesce(b.n, 1) > 1 OR coalesce(a.n, 1) > 1 OR NOT coalesce(b.ok, true) OR NOT coalesce(a.ok, true) THEN 'review_required'
 WHEN a.n IS NULL THEN 'operation_removed' WHEN b.n IS NULL THEN 'operation_added' WHEN a.req > b.req THEN 'newly_required_parameter' WHEN a.dig <> b.dig THEN 'review_required' END AS kind FROM b FULL JOIN a ON a.path = b.path AND a.method = b.method) WHERE kind IS NOT NULL""")
def contract_diff(spark, sf_dir):
    def side(s):
        req = F.when(F.col("nreq") > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.col("nreq"), F.lit(1))), lambda i: F.concat(F.lit("query:p"), i))).otherwise(F.array().cast("array<string>"))
        return _sql(spark, sf_dir, _contract(s)).withColumn("required", req)

    return overlays.contract_changes(side("before"), side("after"))


@query(f"""WITH b AS (SELECT path, method, count(*) AS n, min(nreq) AS req, min(digest) AS dig, bool_and(complete) AS ok FROM ({_contract('before')}) GROUP BY 1, 2), a AS (SELECT path, method, count(*) AS n, min(nreq) AS req, min(digest) AS dig, bool_and(complete) AS ok FROM ({_contract('after')}) GROUP BY 1, 2),
 f AS (SELECT CASE WHEN coalesce(b.n, 1) > 1 OR coalesce(a.n, 1) > 1 OR NOT coalesce(b.ok, true) OR NOT coalesce(a.ok, true) THEN 'review_required'
 WHEN a.n IS NULL THEN 'operation_removed' WHEN b.n IS NULL THEN 'operation_added' WHEN a.req > b.req THEN 'newly_required_parameter' WHEN a.dig <> b.dig THEN 'review_required' END AS kind FROM b FULL JOIN a ON a.path = b.path AND a.method = b.method)
 SELECT k.kind, (SELECT count(*) FROM f WHERE f.kind = k.kind) AS n, k.action FROM (VALUES ('operation_removed', 'review'), ('newly_required_parameter', 'review'), ('review_required', 'review'), ('operation_added', 'informational')) k(kind, action)""")
def contract_counts(spark, sf_dir):
    return overlays.finding_counts(contract_diff(spark, sf_dir))

#: A contract drawn from pages: two operations a path, regions and parameters of each, path items and regions of the document; side 1 changes, adds and drops some.
_SIDE = {
    "operations": """SELECT concat('/r', CAST(page_id % 97 AS STRING), '/', CAST(CAST(floor(page_id / 97) AS BIGINT) AS STRING), '/{{}}') AS path, CASE WHEN page_id % 31 = 0 THEN 'GET' WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
  concat('/r', CAST(page_id % 97 AS STRING), '/', CAST(CAST(floor(page_id / 97) AS BIGINT) AS STRING), '/{{id}}') AS template, concat('/paths/', CAST(page_id AS STRING), '/', CAST(twin AS STRING)) AS ptr, page_id % 23 <> 4 AS whole
  FROM pages CROSS JOIN (SELECT 0 AS twin UNION ALL SELECT 1) t WHERE (twin = 0 OR page_id % 37 = 5 + {v}) AND (page_id + {v} * 3) % 11 <> 2""",
    "regions": """SELECT o.ptr, r.region, concat('r', CAST(length(o.ptr) * 7 + r.i + CASE WHEN {v} = 1 AND (length(o.template) + length(o.method) + r.i) % 3 = 0 THEN 100 ELSE 0 END AS STRING), o.ptr) AS sha256, (length(o.template) * 5 + r.i * 3) % 19 <> 7 AS complete, concat(o.ptr, '/', r.region) AS region_at
  FROM operations{v} o CROSS JOIN (SELECT 'parameters' AS region, 0 AS i UNION ALL SELECT 'request_body', 1 UNION ALL SELECT 'responses', 2 UNION ALL SELECT 'security', 3) r""",
    "parameters": """SELECT ptr, place, concat(place, ':', name) AS key, required, reserved, concat(rest, CASE WHEN required THEN '!' ELSE '' END) AS sha256, rest AS rest_sha256, concat(ptr, '/parameters/', name) AS parameter_at FROM (
  SELECT o.ptr, p.place, p.name, (p.i + {v} * h) % 2 = 0 AS required, p.i = 5 AS reserved, concat(p.name, CASE WHEN {v} = 1 AND (h + p.i) % 4 = 1 THEN 'x' ELSE '' END) AS rest, (h + p.i + {v}) % 5 AS gone
  FROM (SELECT ptr, CAST(substring(ptr, length(ptr) - 2, 1) AS INT) AS h FROM operations{v}) o CROSS JOIN (SELECT 'path' AS place, 'a' AS name, 1 AS i UNION ALL SELECT 'query', 'b', 2 UNION ALL SELECT 'query', 'c', 3 UNION ALL SELECT 'cookie', 'd', 4 UNION ALL SELECT 'header', 'accept', 5) p) x WHERE gone <> 0""",
    "items": """SELECT DISTINCT concat('/r', CAST(page_id % 97 AS STRING), '/', CAST(CAST(floor(page_id / 97) AS BIGINT) AS STRING), '/{{id}}') AS template, CASE WHEN page_id % 151 = 3 THEN NULL ELSE concat('/r', CAST(page_id % 97 AS STRING), '/', CAST(CAST(floor(page_id / 97) AS BIGINT) AS STRING), '/{{}}') END AS path,
  concat('/items/', CAST(page_id AS STRING)) AS ptr, concat('i', CAST(page_id + CASE WHEN page_id % 4 = {v} THEN 1 ELSE 0 END AS STRING)) AS sha256, (page_id + {v}) % 41 <> 6 AS complete FROM pages WHERE (page_id + {v}) % 13 <> 0""",
    "documents": "SELECT concat('/components/', n_name) AS ptr, concat('d', CAST(CASE WHEN n_nationkey % 4 = {v} THEN 1 ELSE 0 END AS STRING)) AS sha256, n_nationkey % 11 <> 3 + {v} AS complete FROM nation WHERE n_nationkey % 5 <> {v}",
}
_BOTH = ", ".join(f"{t}{v} AS ({sql.format(v=v)})" for v in (0, 1) for t, sql in _SIDE.items())
_NO = "NULL::VARCHAR"


@query(f"""WITH {_BOTH}, one0 AS (SELECT path, method, count(*) AS n, arg_min(template, ptr) AS template, min(ptr) AS a, arg_min(whole, ptr) AS whole FROM operations0 GROUP BY 1, 2), one1 AS (SELECT path, method, count(*) AS n, arg_min(template, ptr) AS template, min(ptr) AS a, arg_min(whole, ptr) AS whole FROM operations1 GROUP BY 1, 2),
 j AS (SELECT path, method, b.n AS bn, a.n AS an, b.template AS bt, a.template AS at_, b.a AS ba, a.a AS aa, b.whole AS bw, a.whole AS aw FROM one0 b FULL JOIN one1 a USING (path, method)), s AS (SELECT * FROM j WHERE greatest(coalesce(bn, 0), coalesce(an, 0)) <= 1),
 anchor0 AS (SELECT s.path, s.method, coalesce((SELECT arg_min(ptr, template) FROM items0 i WHERE NOT complete AND (i.path = s.path OR i.path IS NULL)), NULL) AS blocked, coalesce((SELECT min(ptr) FROM items0 i WHERE i.template = s.at_), (SELECT arg_min(ptr, template) FROM items0 i WHERE i.path = s.path), '/paths') AS there, aa AS here FROM s WHERE bn IS NULL),
 anchor1 AS (SELECT s.path, s.method, coalesce((SELECT arg_min(ptr, template) FROM items1 i WHERE NOT complete AND (i.path = s.path OR i.path IS NULL)), NULL) AS blocked, coalesce((SELECT min(ptr) FROM items1 i WHERE i.template = s.bt), (SELECT arg_min(ptr, template) FROM items1 i WHERE i.path = s.path), '/paths') AS there, ba AS here FROM s WHERE an IS NULL),
 known AS (SELECT * FROM s WHERE bw AND aw), reg AS (SELECT path, method, b.region AS region, ba, aa, b.region_at AS bp, a.region_at AS ap, CASE WHEN NOT (b.complete AND a.complete) THEN 'incomplete_region' WHEN b.sha256 <> a.sha256 THEN 'region_changed' END AS reason FROM known JOIN regions0 b ON b.ptr = ba JOIN regions1 a ON a.ptr = aa AND a.region = b.region),
 diff AS (SELECT path, method, ba, aa FROM reg WHERE region = 'parameters' AND reason = 'region_changed'), p0 AS (SELECT path, method, p.* FROM diff JOIN parameters0 p ON p.ptr = ba), p1 AS (SELECT path, method, p.* FROM diff JOIN parameters1 p ON p.ptr = aa),
 par AS (SELECT path, method, key, coalesce(a.place, b.place) AS place, b.sha256 IS NULL AS new, a.sha256 IS NULL AS gone, b.required AS br, a.required AND NOT a.reserved AS need, b.rest_sha256 IS DISTINCT FROM a.rest_sha256 AS other, coalesce(b.parameter_at, d.ba) AS bp, coalesce(a.parameter_at, d.aa) AS ap
  FROM p0 b FULL JOIN p1 a USING (path, method, key) JOIN diff d USING (path, method) WHERE b.sha256 IS DISTINCT FROM a.sha256),
 now AS (SELECT *, place <> 'path' AND NOT gone AND need AND (new OR NOT br) AS now FROM par),
 it AS (SELECT template, b.ptr AS ba, a.ptr AS aa, CASE WHEN NOT coalesce(b.complete, true) OR NOT coalesce(a.complete, true) THEN 'incomplete_region' WHEN template NOT IN (SELECT template FROM operations0 UNION SELECT template FROM operations1) AND b.sha256 IS DISTINCT FROM a.sha256 THEN 'region_changed' END AS reason FROM items0 b FULL JOIN items1 a USING (template)),
 doc AS (SELECT ptr, b.sha256 AS bs, a.sha256 AS "as", CASE WHEN NOT coalesce(b.complete, true) OR NOT coalesce(a.complete, true) THEN 'incomplete_region' WHEN b.sha256 IS DISTINCT FROM a.sha256 THEN 'document_region_changed' END AS reason FROM documents0 b FULL JOIN documents1 a USING (ptr))
 SELECT 'review_required' AS kind, 'ambiguous_identity' AS reason, {_NO} AS region, path, method, {_NO} AS parameter, {_NO} AS change, {_NO} AS blocked, ptr AS before_at, {_NO} AS after_at FROM operations0 JOIN j USING (path, method) WHERE bn > 1
 UNION ALL SELECT 'review_required', 'ambiguous_identity', NULL, path, method, NULL, NULL, NULL, NULL, ptr FROM operations1 JOIN j USING (path, method) WHERE an > 1
 UNION ALL SELECT CASE WHEN blocked IS NULL THEN 'operation_added' ELSE 'review_required' END, CASE WHEN blocked IS NOT NULL THEN 'incomplete_region' END, CASE WHEN blocked IS NOT NULL THEN 'path_item' END, path, method, NULL, NULL, CASE WHEN blocked IS NOT NULL THEN 'operation_added' END, coalesce(blocked, there), here FROM anchor0
 UNION ALL SELECT CASE WHEN blocked IS NULL THEN 'operation_removed' ELSE 'review_required' END, CASE WHEN blocked IS NOT NULL THEN 'incomplete_region' END, CASE WHEN blocked IS NOT NULL THEN 'path_item' END, path, method, NULL, NULL, CASE WHEN blocked IS NOT NULL THEN 'operation_removed' END, here, coalesce(blocked, there) FROM anchor1
 UNION ALL SELECT 'review_required', 'incomplete_region', 'operation', path, method, NULL, NULL, NULL, ba, aa FROM s WHERE bn IS NOT NULL AND an IS NOT NULL AND NOT (bw AND aw)
 UNION ALL SELECT 'review_required', reason, region, path, method, NULL, NULL, NULL, bp, ap FROM reg WHERE reason IS NOT NULL AND NOT (region = 'parameters' AND reason = 'region_changed')
 UNION ALL SELECT 'newly_required_parameter', NULL, NULL, path, method, key, CASE WHEN new THEN 'added_required' ELSE 'optional_to_required' END, NULL, bp, ap FROM now WHERE now
 UNION ALL SELECT 'review_required', CASE WHEN place = 'path' THEN 'path_parameter_changed' WHEN new THEN 'parameter_added' WHEN gone THEN 'parameter_removed' ELSE 'parameter_changed' END, NULL, path, method, key, NULL, NULL, bp, ap FROM now WHERE NOT now OR NOT new AND NOT gone AND other
 UNION ALL SELECT 'review_required', reason, 'path_item', NULL, NULL, NULL, NULL, NULL, ba, aa FROM it WHERE reason IS NOT NULL
 UNION ALL SELECT 'review_required', reason, 'document', NULL, NULL, NULL, NULL, NULL, CASE WHEN bs IS NOT NULL THEN ptr END, CASE WHEN "as" IS NOT NULL THEN ptr END FROM doc WHERE reason IS NOT NULL""")
def contract_findings(spark, sf_dir):
    """Every kind of finding between two contracts that are drawn from the tables."""
    from loomgraph.operators import contracts

    views(spark, sf_dir)

    def side(v: int) -> contracts.Contract:
        tables = {}
        for t, sql in _SIDE.items():
            spark.sql(sql.format(v=v)).createOrReplaceTempView(f"{t}{v}")
            tables[t] = spark.table(f"{t}{v}").withColumnRenamed("ptr", "at")
        return contracts.Contract(**tables)

    return contracts.findings(side(0), side(1))


_PREFS = """SELECT p_partkey AS ref_id, p_size % 13 <> 0 AS form_ok, p_size % 17 = 1 AS shadowed, concat('pkg', CAST(p_partkey % 7 AS STRING)) AS package, CASE p_partkey % 9 WHEN 0 THEN '2.0' ELSE '1.0' END AS version,
 p_type AS module, concat('n', CAST(p_size % 20 AS STRING)) AS name, CASE p_partkey % 2 WHEN 0 THEN 'class' ELSE 'function' END AS kind FROM part"""
_PKGS = "SELECT concat('pkg', CAST(n_nationkey AS STRING)) AS package, '1.0' AS version, n_nationkey <> 4 AS available FROM nation WHERE n_nationkey < 6 UNION ALL SELECT 'pkg3' AS package, '1.0' AS version, true AS available FROM region WHERE r_regionkey = 0"
_PSYM = """SELECT concat('pkg', CAST(s_suppkey % 6 AS STRING)) AS package, CASE s_nationkey % 3 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'SMALL' ELSE 'PROMO' END AS module, concat('n', CAST(s_suppkey % 20 AS STRING)) AS name,
 CASE s_suppkey % 3 WHEN 0 THEN 'class' ELSE 'function' END AS kind, s_name AS path, s_suppkey % 11 = 0 AS reexported, s_suppkey % 13 = 0 AS rebound FROM supplier"""


@query(f"""WITH r AS ({_PREFS}), k AS (SELECT package, version, bool_or(available) AS av FROM ({_PKGS}) GROUP BY 1, 2), s AS (SELECT package, module, name, count(*) FILTER (NOT reexported) AS n, arg_min(kind, (kind, path)) FILTER (NOT reexported) AS kind, arg_min(path, (kind, path)) FILTER (NOT reexported) AS path, bool_or(rebound AND NOT reexported) AS rb FROM ({_PSYM}) GROUP BY 1, 2, 3),
 x AS (SELECT ref_id, s.path, CASE WHEN NOT form_ok THEN 'unsupported_reference_form' WHEN shadowed THEN 'local_module_shadow' WHEN av IS NULL THEN 'version_mismatch' WHEN NOT av THEN 'provider_snapshot_unavailable' WHEN s.n > 1 THEN 'ambiguous_provider_symbol' WHEN s.n IS NULL THEN 'not_declared' WHEN s.n = 0 THEN 're_export'
  WHEN r.kind <> s.kind THEN 'kind_mismatch' WHEN rb THEN 'rebound' ELSE 'linked' END AS resolution FROM r LEFT JOIN k USING (package, version) LEFT JOIN s ON s.package = r.package AND s.module = r.module AND s.name = r.name) SELECT ref_id, resolution, CASE WHEN resolution = 'linked' THEN path END AS path FROM x""")
def cross_repo_links(spark, sf_dir):
    return overlays.provider_links(_sql(spark, sf_dir, _PREFS), spark.sql(_PKGS), spark.sql(_PSYM))


_WANT = "SELECT concat('c', CAST(c_custkey AS STRING)) AS coordinate, c_custkey % 5 AS artifact, c_custkey % 7 AS lock, c_nationkey % 3 AS environment, c_custkey % 11 <> 0 AS provider, c_custkey % 2 AS sources FROM customer"
_LOCK = "SELECT concat('c', CAST(c_custkey AS STRING)) AS coordinate, CASE WHEN c_custkey % 4 = 0 THEN 9 ELSE c_custkey % 5 END AS locked_artifact, CASE WHEN c_custkey % 6 = 1 THEN 9 ELSE c_custkey % 7 END AS locked_lock, CASE WHEN c_custkey % 10 = 3 THEN 9 ELSE c_nationkey % 3 END AS locked_environment, CASE WHEN c_custkey % 14 = 2 THEN 9 ELSE c_custkey % 2 END AS locked_sources FROM customer WHERE c_custkey % 9 <> 8"


@query(f"""SELECT w.coordinate, CASE WHEN l.coordinate IS NULL THEN 'coordinate' WHEN artifact <> locked_artifact THEN 'artifact' WHEN lock <> locked_lock THEN 'lock' WHEN environment <> locked_environment THEN 'environment' WHEN NOT provider THEN 'provider' WHEN sources <> locked_sources THEN 'sources' ELSE 'bound' END AS outcome FROM ({_WANT}) w LEFT JOIN ({_LOCK}) l ON l.coordinate = w.coordinate""")
def package_binding(spark, sf_dir):
    return overlays.package_binding(_sql(spark, sf_dir, _WANT), spark.sql(_LOCK))


@query("""WITH d AS (SELECT doc_id, text, sha256(text) AS sha, octet_length(encode(text)) AS nb FROM documents), m AS (SELECT l.doc_id AS mapping_id, CASE l.doc_id % 11 WHEN 0 THEN -1 ELSE l.doc_id END AS pid, l.doc_id % 7 AS q FROM labels l),
 x AS (SELECT m.mapping_id, m.q, d.*, CASE WHEN q = 5 THEN 1000000 ELSE 10 END AS stop FROM m LEFT JOIN d ON d.doc_id = m.pid)
 SELECT mapping_id, CASE WHEN sha IS NULL THEN 'document_not_in_snapshot' WHEN q = 1 THEN 'document_digest_mismatch' WHEN stop > nb THEN 'span_out_of_range' WHEN q = 2 THEN 'span_digest_mismatch' WHEN q = 3 THEN 'target_not_found' WHEN q = 4 THEN 'target_kind_unsupported' END AS reason FROM x""")
def decision_mapping(spark, sf_dir):
    """The first characters stand as ASCII of the same number of bytes, so a span never cuts one; repeated documents are told apart by their place among their kin."""
    from pyspark.sql import Window

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.sha2("text", 256).alias("sha"))
    d = d.withColumn("path", F.concat_ws(":", "doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("sha"))))
    head = F.substring("text", 1, 10)
    for chars, mark in ((r"[\x{80}-\x{7FF}]", "xx"), (r"[\x{800}-\x{FFFF}]", "xxx"), (r"[\x{10000}-\x{10FFFF}]", "xxxx")):
        head = F.regexp_replace(head, chars, mark)
    docs = d.select("path", "sha", F.concat(head, F.expr("substring(text, 11)")).alias("text"))
    own = d.select(F.col("doc_id").alias("pid"), "path", F.col("sha").alias("__sha"), F.sha2(F.substring(F.encode(head, "UTF-8"), 1, 10), 256).alias("__span"))
    q = F.col("doc_id") % 7
    m = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.when(F.col("doc_id") % 11 == 0, -1).otherwise(F.col("doc_id")).alias("pid")).join(own, "pid", "left")
    m = m.select(F.col("doc_id").alias("mapping_id"), "path", F.when(q == 1, "no").otherwise(F.col("__sha")).alias("sha"), F.lit(0).alias("start"), F.when(q == 5, 1000000).otherwise(10).alias("stop"), F.when(q == 2, "no").otherwise(F.col("__span")).alias("span_sha"),
                 F.lit("a.py").alias("target_path"), F.when(q == 4, "field").otherwise("class").alias("target_kind"), F.when(q == 3, "Gone").otherwise("Here").alias("target_name"))
    return overlays.decision_links(m, docs, spark.createDataFrame([("a.py", "class", "Here")], "path string, kind string, name string"))


@query("""WITH m AS (SELECT doc_id AS mapping_id, quality, toxic FROM labels), x AS (SELECT mapping_id, CASE WHEN mapping_id % 13 = 0 THEN 'file_failed' WHEN mapping_id % 5 = 4 THEN 'unconfirmed' WHEN mapping_id % 6 = 0 THEN 'change_unknown' WHEN mapping_id % 6 = 1 THEN 'target_removed' WHEN toxic = 1 THEN 'document_missing'
 WHEN mapping_id % 6 IN (2, 3) AND quality = 1 THEN 'source_changed' WHEN mapping_id % 6 IN (2, 3) THEN 'both_changed' ELSE 'source_unchanged' END AS reason FROM m)
 SELECT mapping_id, CASE WHEN reason IN ('file_failed', 'unconfirmed', 'change_unknown') THEN 'unknown_history' WHEN reason IN ('target_removed', 'document_missing') THEN 'unresolved' WHEN reason = 'source_changed' THEN 'review_needed' ELSE 'no_finding' END AS outcome, reason FROM x""")
def decision_drift(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("mapping_id"), F.col("doc_id").alias("entity_id"), F.col("doc_id").alias("path"), "quality", "toxic")
    k = F.col("entity_id") % 6
    category = F.when(k == 0, "unknown").when(k == 1, "removed").when(k == 2, "signature").when(k == 3, "body").otherwise("unchanged")
    # a failed file has no category of its own
    changes = labels.filter("entity_id % 5 != 4 or entity_id % 13 = 0").select("entity_id", category.alias("category"), (F.col("entity_id") % 13 == 0).alias("failed"))
    return overlays.drift(labels.select("mapping_id", "entity_id", "path"), changes, labels.filter("toxic = 0").select("path", (F.col("quality") == 0).alias("changed")))


_EVENTS = "SELECT event_id, concat('f', CAST(user_id AS STRING)) AS path, CASE WHEN event_id % 6 = 0 THEN 'old' ELSE 'sha' END AS sha, CASE WHEN event_id % 10 = 0 THEN 'g0' ELSE 'g1' END AS generation, CAST(user_id AS BIGINT) AS item, event_id % 4 AS artifact, event_type AS selector, CASE WHEN value > 20 THEN 'passed' ELSE 'failed' END AS outcome FROM events"
_FB = f"fb AS (SELECT *, CASE WHEN user_id % 8 = 0 THEN 'path_not_indexed' WHEN sha <> 'sha' THEN 'source_fingerprint_mismatch' WHEN generation <> 'g1' THEN 'generation_mismatch' END AS excluded FROM (SELECT e.*, CAST(substr(e.path, 2) AS BIGINT) AS user_id FROM ({_EVENTS}) e))"


def _feedback(spark, sf_dir):
    events = _sql(spark, sf_dir, _EVENTS)
    files = events.filter("item % 8 != 0").select("path", F.lit("sha").alias("sha")).distinct()
    return overlays.feedback_classes(events, files, "g1")


@query(f"WITH {_FB} SELECT coalesce(excluded, 'active') AS state, outcome, count(*) AS n FROM fb GROUP BY ALL")
def feedback_states(spark, sf_dir):
    return _feedback(spark, sf_dir).groupBy(F.coalesce("excluded", F.lit("active")).alias("state"), "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_FB}, d AS (SELECT item, CAST(least(3, count(DISTINCT (artifact, selector))) AS INTEGER) AS delta FROM fb WHERE excluded IS NULL AND outcome = 'passed' GROUP BY 1),
 i AS (SELECT c_nationkey AS query_id, c_custkey AS item, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1 AS INTEGER) AS pos FROM customer),
 x AS (SELECT i.*, CASE WHEN pos = 0 THEN 0 ELSE coalesce(delta, 0) END AS delta FROM i LEFT JOIN d USING (item)) SELECT query_id, item, delta, row_number() OVER (PARTITION BY query_id ORDER BY pos <> 0, pos - delta, -delta, pos, item) - 1 AS place FROM x""")
def feedback_ranking(spark, sf_dir):
    items = _sql(spark, sf_dir, "SELECT c_nationkey AS query_id, c_custkey AS item, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1 AS INT) AS pos FROM customer")
    return overlays.feedback_order(items, _feedback(spark, sf_dir))


@query("SELECT user_id, event_type, min(CAST(event_id % 3 AS INTEGER)) AS verdict, count(DISTINCT event_id % 3) > 1 AS conflict FROM events GROUP BY 1, 2")
def merged_events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", (F.col("event_id") % 3).cast("int").alias("verdict"))
    return overlays.merged_events(e, ["user_id", "event_type"], "verdict")


@query("SELECT doc_id, CAST(('0x' || left(sha256(CAST(doc_id AS STRING)), 8))::BIGINT % 5 AS INTEGER) AS fold FROM documents")
def evaluation_fold(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", scalars.fold(F.sha2(F.col("doc_id").cast("string"), 256), 5).alias("fold"))


@query("""WITH r AS (SELECT p_partkey AS route_id, lower(p_type) || '_' || split_part(p_name, ' ', 1) AS controller, split_part(p_name, ' ', 2) AS action FROM part),
 m AS (SELECT upper(p_type[1]) || lower(p_type)[2:] || upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] || 'Controller' AS owner, split_part(p_name, ' ', 2) AS name, p_brand AS path FROM part),
 g AS (SELECT owner, name, count(DISTINCT path) AS n, min(path) AS path FROM m GROUP BY 1, 2), x AS (SELECT r.*, upper(controller[1]) || split_part(controller, '_', 1)[2:] || upper(split_part(controller, '_', 2)[1]) || split_part(controller, '_', 2)[2:] || 'Controller' AS owner FROM r)
 SELECT route_id, CASE WHEN x.owner NOT IN (SELECT owner FROM m) THEN 'CONTROLLER_NOT_FOUND' WHEN g.n IS NULL THEN 'ACTION_NOT_FOUND' WHEN g.n > 1 THEN 'AMBIGUOUS' ELSE 'INFERRED' END AS outcome, CASE WHEN g.n = 1 THEN g.path END AS path FROM x LEFT JOIN g ON g.owner = x.owner AND g.name = x.action""")
def rails_routes(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    one, two = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    declared = p.select(F.col("p_partkey").alias("route_id"), F.concat_ws("_", F.lower("p_type"), one).alias("controller"), two.alias("action"))
    methods = p.select(F.concat(scalars.camelize(F.concat_ws("_", F.lower("p_type"), one)), F.lit("Controller")).alias("owner"), two.alias("name"), F.col("p_brand").alias("path"))
    return overlays.routes(declared, methods)


#: A statement of a route file for each part, by its key; files hold the parts of one brand and two hundred keys.
_ROUTE = """CASE p_partkey % 13 WHEN 0 THEN concat('  get "/p', k, '", to: "', a, '#show"') WHEN 1 THEN concat('  post(', q, '/p', k, q, ', to: ', q, 'api/', a, '#make', q, ', as: :n', k, ')')
 WHEN 2 THEN concat('  resources :a do', n, '    get "/hidden", to: "a#b"', n, '    if x', n, '    end', n, '  end') WHEN 3 THEN concat('  namespace :admin do  # ', k, n, '    root to: "a#b"', n, '  end') WHEN 4 THEN concat('  get "/p', k, '" => "a#b"')
 WHEN 5 THEN concat('  delete "/p', k, '"') WHEN 6 THEN concat('  get "/p#{{x}}', k, '", to: "a#b"') WHEN 7 THEN '  put path, to: "a#b"' WHEN 8 THEN concat('  get "/p', k, '", to: "Bad', k, '"') WHEN 9 THEN concat('  get "/p', k, '", to: "a#b" if test?')
 WHEN 10 THEN concat('  # get "/c', k, '", to: "c#d"') WHEN 11 THEN concat('  patch "/p', k, '",  # on', n, '', n, '    to: ', q, a, '#edit', q) ELSE concat('  match "/p', k, '", via: [:get]') END"""
_ROUTE_FILES = f"""SELECT file, path, line FROM (SELECT concat(brand, '/', CAST(CAST(floor(p_partkey / 200) AS BIGINT) AS STRING), '/routes.rb') AS file, p_partkey AS path, {_ROUTE} AS line
 FROM (SELECT *, p_brand AS brand, CAST(p_partkey AS STRING) AS k, lower(p_type) AS a, chr(10) AS n, chr(39) AS q FROM part) x) y"""


@query("""WITH f AS (SELECT concat(p_brand, '/', p_partkey // 200, '/routes.rb') AS file, CAST(p_partkey AS STRING) AS k, lower(p_type) AS a, p_partkey % 13 AS m FROM part)
 SELECT file, CASE m WHEN 0 THEN 'get' WHEN 1 THEN 'post' WHEN 11 THEN 'patch' END AS verb, CASE WHEN m IN (0, 1, 11) THEN '/p' || k END AS route, CASE m WHEN 0 THEN a || '#show' WHEN 1 THEN 'api/' || a || '#make' WHEN 11 THEN a || '#edit' END AS target,
  CASE m WHEN 2 THEN 'resources' WHEN 3 THEN 'namespace' WHEN 4 THEN 'hash_rocket_target' WHEN 5 THEN 'missing_target' WHEN 6 THEN 'interpolated_literal' WHEN 7 THEN 'non_literal_path' WHEN 8 THEN 'malformed_target' WHEN 9 THEN 'conditional' WHEN 12 THEN 'match' END AS construct FROM f WHERE m <> 10""")
def rails_route_scan(spark, sf_dir):
    """Route files are composed from the parts, as the tables hold none, and scanned."""
    from loomgraph.operators import rails

    views(spark, sf_dir)
    rows = spark.sql(_ROUTE_FILES.replace("{{", "{").replace("}}", "}"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "line"))), lambda x: x["line"]), "\n")
    files = rows.groupBy(F.col("file").alias("path")).agg(F.concat(F.lit("Rails.application.routes.draw do\n"), body, F.lit("\nend\nputs 1\n")).alias("text"))
    return rails.route_declarations(files).select(F.col("path").alias("file"), "verb", "route", "target", "construct")


@query("""WITH a AS (SELECT p_partkey AS assoc_id, CASE p_size % 3 WHEN 0 THEN 'A::B' WHEN 1 THEN 'A' ELSE 'C' END AS owner, p_type AS name FROM part), m AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'A::B::' WHEN 1 THEN 'A::' ELSE '' END || CASE s_suppkey % 7 WHEN 0 THEN 'SMALL' WHEN 1 THEN 'ECONOMY' WHEN 2 THEN 'LARGE' ELSE 'X' || s_suppkey END AS name FROM supplier),
 c AS (SELECT DISTINCT assoc_id, unnest(CASE owner WHEN 'A::B' THEN ['A::B::' || name, 'A::' || name, name] ELSE [owner || '::' || name, name] END) AS model FROM a), g AS (SELECT name AS model, count(*) AS n FROM m GROUP BY 1),
 h AS (SELECT assoc_id, sum(n) AS n, min(model) AS model FROM c JOIN g USING (model) GROUP BY 1) SELECT a.assoc_id, CASE WHEN h.n IS NULL THEN 'UNRESOLVED' WHEN h.n = 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS outcome, CASE WHEN h.n = 1 THEN h.model END AS model FROM a LEFT JOIN h USING (assoc_id)""")
def rails_associations(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    head = F.when(k % 4 == 0, "A::B::").when(k % 4 == 1, "A::").otherwise("")
    tail = F.when(k % 7 == 0, "SMALL").when(k % 7 == 1, "ECONOMY").when(k % 7 == 2, "LARGE").otherwise(F.concat(F.lit("X"), k))
    z = F.col("p_size") % 3
    declared = p.select(F.col("p_partkey").alias("assoc_id"), F.when(z == 0, "A::B").when(z == 1, "A").otherwise("C").alias("owner"), F.col("p_type").alias("name"))
    return overlays.associations(declared, s.select(F.concat(head, tail).alias("name")))


_ENQ = "SELECT event_id AS call_id, concat('Job', CAST(user_id AS STRING)) AS job, CASE event_id % 5 WHEN 0 THEN 'perform_async' WHEN 1 THEN 'perform_later' WHEN 2 THEN 'perform_in' WHEN 3 THEN 'perform_now' ELSE 'perform_async' END AS method, CAST(floor(value) AS BIGINT) % 5 AS args FROM events"
_PERF = "SELECT concat('Job', CAST(CASE WHEN s_suppkey % 25 = 24 THEN s_suppkey - 21 ELSE s_suppkey END AS STRING)) AS job, s_suppkey % 3 AS required, s_suppkey % 2 AS optional FROM supplier"


@query(f"""WITH e AS ({_ENQ}), p AS (SELECT job, count(*) AS n, min(required) AS lo, min(required) + min(optional) AS hi FROM ({_PERF}) GROUP BY 1)
 SELECT call_id, CASE WHEN method IN ('perform_in', 'perform_at') THEN 'unsupported_delay' WHEN method NOT IN ('perform_async', 'perform_later') THEN 'not_an_enqueue' WHEN p.n IS NULL THEN 'job_not_found' WHEN p.n > 1 THEN 'AMBIGUOUS' WHEN args < lo OR args > hi THEN 'arity_mismatch' ELSE 'INFERRED' END AS outcome FROM e LEFT JOIN p USING (job)""")
def rails_jobs(spark, sf_dir):
    return overlays.jobs(_sql(spark, sf_dir, _ENQ), spark.sql(_PERF))


_EVID = "SELECT l_suppkey AS span_id, (l_suppkey + l_partkey) % 3 AS category_weight, concat('t', CAST(l_partkey % 40 AS STRING)) AS test, l_linenumber % 5 AS basis, CAST(l_quantity AS BIGINT) AS spans, l_orderkey % 7 AS body_lines, l_partkey % 3 AS distance FROM lineitem"


@query(f"""WITH e AS (SELECT * FROM ({_EVID}) QUALIFY row_number() OVER (PARTITION BY span_id, test ORDER BY basis, spans DESC, body_lines DESC, category_weight, distance) = 1)
 SELECT span_id, test, basis, row_number() OVER (PARTITION BY span_id ORDER BY basis, spans DESC, body_lines DESC, category_weight, distance, test) AS rank FROM e""")
def recommendation_ranking(spark, sf_dir):
    return overlays.recommendations(_sql(spark, sf_dir, _EVID))
