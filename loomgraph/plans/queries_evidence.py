"""Queries on provenance, validation, status and composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import spans
from loomgraph.operators import evidence, resolve
from loomgraph.plans.projection import assertion_links, projected, views, with_sql
from loomgraph.plans.queries_text import BM25_SQL, DIVERSITY
from loomgraph.plans.queries_overlay import _COVER, _PART_SPANS
from loomgraph.registry import query

_A = "SELECT l_orderkey * 10 + l_linenumber AS assertion_id, l_partkey AS evidence_id, l_suppkey AS source_id, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_partkey END AS target_id FROM lineitem"
_E = "SELECT p_partkey AS evidence_id, p_partkey % 500 AS occurrence_id, p_size % 7 AS producer_id, p_size AS start_byte, p_size + 10 AS end_byte FROM part"
_O = "SELECT s_suppkey AS occurrence_id, CAST(s_suppkey % 50 + 1 AS INT) AS start_byte, CAST(s_suppkey % 50 + 11 AS INT) AS end_byte, s_name AS path, s_nationkey AS line FROM supplier"
_P = "SELECT n_nationkey AS producer_id, n_name AS producer FROM nation WHERE n_nationkey < 6"


def _sql(spark, sf_dir, *texts):
    views(spark, sf_dir)
    return [spark.sql(t) for t in texts]


@query(f"SELECT a.assertion_id, e.evidence_id, o.occurrence_id, p.producer_id, o.path, o.line, p.producer FROM ({_A}) a JOIN ({_E}) e USING (evidence_id) JOIN ({_O}) o ON o.occurrence_id = e.occurrence_id AND o.start_byte = e.start_byte AND o.end_byte = e.end_byte JOIN ({_P}) p USING (producer_id)")
def proof_hydration(spark, sf_dir):
    return evidence.proofs(*_sql(spark, sf_dir, _A, _E, _O, _P)).select("assertion_id", "evidence_id", "occurrence_id", "producer_id", "path", "line", "producer")


@query(f"""WITH a AS ({_A}), e AS (SELECT p_partkey AS entity_id FROM part WHERE p_partkey % 9 <> 0) SELECT assertion_id, 'source' AS side FROM a WHERE source_id NOT IN (SELECT entity_id FROM e)
 UNION ALL SELECT assertion_id, 'target' FROM a WHERE target_id IS NOT NULL AND target_id NOT IN (SELECT entity_id FROM e)""")
def dangling_endpoints(spark, sf_dir):
    return evidence.dangling(*_sql(spark, sf_dir, _A, "SELECT p_partkey AS entity_id FROM part WHERE p_partkey % 9 <> 0"))


_R = "SELECT concat(p_name, '/', p_type) AS callee_name, l_suppkey AS source_id, CAST(l_linenumber AS BIGINT) AS line, l_orderkey AS assertion_id FROM lineitem JOIN part ON p_partkey = l_partkey"
_T = "SELECT s_suppkey AS entity_id, s_name AS name, s_suppkey % 4 = 0 AS is_test FROM supplier"
_C = "SELECT DISTINCT concat(p_name, '/', p_type) AS name FROM part"


@query(f"SELECT c.name, t.name AS test, min(r.line) AS line FROM ({_C}) c JOIN ({_R}) r ON r.callee_name = c.name JOIN ({_T}) t ON t.entity_id = r.source_id WHERE is_test GROUP BY 1, 2")
def same_name_probe(spark, sf_dir):
    r, t, c = _sql(spark, sf_dir, _R, _T, _C)
    return evidence.same_name_tests(r, t, c)


@query(with_sql("symbols", "refs") + """, n AS (SELECT name, list_distinct(list(kind)) AS k, count(*) FILTER (kind <> 'variable') AS c, count(*) FILTER (kind IN ('class', 'module')) AS h FROM symbols GROUP BY 1),
 r AS (SELECT callee_name AS name, CASE WHEN relation = 'call' THEN coalesce(c, 0) ELSE coalesce(h, 0) END AS cands FROM refs LEFT JOIN n ON n.name = callee_name)
 SELECT s.name, count(*) FILTER (r.cands = 0) AS unresolved, count(*) FILTER (r.cands > 1) AS ambiguous, count(*) FILTER (r.cands = 0 OR r.cands > 1) = 0 AS complete FROM (SELECT DISTINCT name FROM symbols) s LEFT JOIN r USING (name) GROUP BY 1""")
def impact_boundaries(spark, sf_dir):
    s = projected(spark, sf_dir, "symbols")
    return evidence.boundaries(s, resolve.resolved(projected(spark, sf_dir, "refs"), s))


_PIECES = """q AS (SELECT source, left(h, 4) AS q, sha256(string_agg(h, '' ORDER BY h)) AS d FROM (SELECT source, sha256(text) AS h FROM documents) GROUP BY 1, 2),
 p AS (SELECT source, left(q, 2) AS p, sha256(string_agg(q || d, '' ORDER BY q || d)) AS d FROM q GROUP BY 1, 2)"""


@query(f"WITH {_PIECES} SELECT source, sha256(string_agg(p || d, '' ORDER BY p || d)) AS digest FROM p GROUP BY 1")
def content_digest(spark, sf_dir):
    return evidence.digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("text"), ["source"])


_STATE = "CASE doc_id % 9 WHEN 0 THEN 'failed' WHEN 1 THEN 'unsupported' WHEN 2 THEN CASE WHEN lang = 'en' THEN 'disabled' ELSE 'indexed' END ELSE 'indexed' END"


@query(f"SELECT lang, count(*) FILTER (s = 'indexed') AS indexed, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'unsupported') AS unsupported, count(*) FILTER (s = 'disabled') AS disabled, count(*) FILTER (s = 'failed') = 0 AS complete FROM (SELECT lang, {_STATE} AS s FROM documents) GROUP BY 1")
def status(spark, sf_dir):
    return evidence.status(*_sql(spark, sf_dir, f"SELECT lang, {_STATE} AS state FROM documents"))


@query(f"SELECT CASE s WHEN 'indexed' THEN 'active' ELSE 'historical' END AS projection, count(*) AS facts, min(doc_id) AS first FROM (SELECT doc_id, {_STATE} AS s FROM documents) WHERE s IN ('indexed', 'failed') GROUP BY 1")
def historical_projection(spark, sf_dir):
    facts, files = _sql(spark, sf_dir, "SELECT doc_id AS path, doc_id FROM documents", f"SELECT doc_id AS path, {_STATE} AS state FROM documents")
    a, h = evidence.projected_facts(facts, files)
    return a.withColumn("projection", F.lit("active")).unionByName(h.withColumn("projection", F.lit("historical"))).groupBy("projection").agg(F.count(F.lit(1)).alias("facts"), F.min("doc_id").alias("first"))


_NEW = "SELECT doc_id, sha256(text) AS sha256, source AS path, lang, 2 AS version FROM documents" 
_OLD = "SELECT sha256(text) AS sha256, source AS path, lang, CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 2 END AS version FROM documents WHERE doc_id % 4 <> 1"


@query(f"SELECT n.doc_id FROM ({_NEW}) n WHERE NOT EXISTS (SELECT 1 FROM ({_OLD}) o WHERE o.sha256 = n.sha256 AND o.path = n.path AND o.lang = n.lang AND o.version = n.version)")
def extraction_cache(spark, sf_dir):
    new, old = _sql(spark, sf_dir, _NEW.replace("sha256(text)", "sha2(text, 256)"), _OLD.replace("sha256(text)", "sha2(text, 256)"))
    return evidence.cache_misses(new, old).select("doc_id")


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW') ORDER BY id LIMIT 100")
def superseded_ids(spark, sf_dir):
    return evidence.superseded(*_sql(spark, sf_dir, "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'P'", "SELECT o_custkey AS id FROM orders WHERE o_orderpriority = '5-LOW'"), cap=100)


@query("SELECT DISTINCT sha256(text) AS sha256, length(text) AS n FROM documents")
def excerpt_store(spark, sf_dir):
    return evidence.excerpts(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("sha256", F.length("content").alias("n"))


@query("SELECT DISTINCT l_suppkey AS id, l_partkey AS other, l_returnflag AS kind FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)")
def cross_repo_impact(spark, sf_dir):
    changed, links = _sql(spark, sf_dir, "SELECT s_suppkey AS id FROM supplier WHERE s_nationkey = 3", "SELECT l_suppkey AS consumer, l_partkey AS provider, l_returnflag AS kind FROM lineitem")
    return evidence.cross_repo_impact(changed, links)


_STRUCT = "SELECT l_partkey AS span_id, concat('t', CAST(l_suppkey % 20 AS STRING)) AS test, CAST(l_linenumber AS BIGINT) AS distance FROM lineitem"
_SAME = "SELECT DISTINCT l_partkey AS span_id, concat('t', CAST(l_suppkey % 20 AS STRING)) AS test FROM lineitem"
_EV = f"""ev AS (SELECT span_id, test, CASE WHEN body THEN 0 ELSE 2 END AS basis, 1 AS spans, lines AS body_lines, 0 AS distance FROM cov UNION ALL SELECT span_id, test, 3, 0, 0, distance FROM ({_STRUCT}) UNION ALL SELECT span_id, test, 4, 0, 0, 0 FROM ({_SAME})),
 b AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY span_id, test ORDER BY basis, spans DESC, body_lines DESC, distance) = 1)"""


def _plan(spark, sf_dir):
    spans, s, n = _sql(spark, sf_dir, _PART_SPANS, _STRUCT, _SAME)
    ex = projected(spark, sf_dir, "executions")
    return evidence.validation_plan(spans, ex, s, n, ex.filter("path != 'Brand#3'"), spark.createDataFrame([("Brand#3",)], "path string"))


@query(with_sql("executions") + f", {_COVER}, {_EV} SELECT span_id, test, basis, row_number() OVER (PARTITION BY span_id ORDER BY basis, spans DESC, body_lines DESC, distance, test) AS rank FROM b")
def validation_plan(spark, sf_dir):
    return _plan(spark, sf_dir)[0]


@query(with_sql("executions") + f""", {_COVER}, {_EV}, c AS (SELECT path, span_id, bool_or(body) AS body FROM cov GROUP BY ALL), m AS (SELECT span_id, min(basis) AS basis FROM b GROUP BY 1)
 SELECT s.span_id, s.path, CASE WHEN c.body THEN 'executed' WHEN c.path IS NOT NULL THEN 'declaration_only' WHEN s.path IN (SELECT path FROM executions WHERE path <> 'Brand#3') THEN 'no_observation_in_span' WHEN s.path = 'Brand#3' THEN 'stale_only' ELSE 'no_coverage_source' END AS reason,
 CASE WHEN m.basis <= 2 THEN 'observed' WHEN m.basis IS NOT NULL THEN 'structural_only' ELSE 'gap' END AS state FROM ps s LEFT JOIN c ON c.path = s.path AND c.span_id = s.span_id LEFT JOIN m ON m.span_id = s.span_id""")
def validation_states(spark, sf_dir):
    return _plan(spark, sf_dir)[1]


@query(f"""SELECT CASE WHEN s <> 'indexed' THEN 'observation_' || s WHEN doc_id % 31 = 0 THEN 'non_utf8' END AS reason, count(*) AS files, CAST(sum(octet_length(encode(text)) + CASE WHEN doc_id % 31 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bytes FROM (SELECT doc_id, text, {_STATE} AS s FROM documents) GROUP BY 1""")
def retrieval_coverage(spark, sf_dir):
    (f,) = _sql(spark, sf_dir, f"SELECT doc_id AS path, {_STATE} AS state, CASE WHEN doc_id % 31 = 0 THEN concat(encode(text, 'UTF-8'), X'FF') ELSE encode(text, 'UTF-8') END AS content FROM documents")
    return evidence.retrieval_coverage(f)


@query("SELECT source AS path FROM documents UNION SELECT 'c' || doc_id FROM labels UNION SELECT 'p' || page_id % 50 FROM pages")
def binding_units(spark, sf_dir):
    return evidence.binding_units(*_sql(spark, sf_dir, "SELECT source AS path FROM documents", "SELECT concat('c', CAST(doc_id AS STRING)) AS path FROM labels", "SELECT concat('p', CAST(page_id % 50 AS STRING)) AS path FROM pages"))


@query(r"""WITH d AS (SELECT doc_id AS path, regexp_extract_all(text, '(?s)(.*?)(\r\n|\r|\n|$)') AS x, text FROM documents WHERE length(text) > 0),
 s AS (SELECT path, unnest(x) AS piece, generate_subscripts(x, 1) AS line FROM d), o AS (SELECT path, line, octet_length(encode(piece)) AS n, octet_length(encode(regexp_replace(piece, '[\r\n]+$', ''))) AS m FROM s)
 SELECT path, line, CAST(start AS BIGINT) AS start_byte, CAST(start + m AS BIGINT) AS end_byte FROM (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY line) - n AS start FROM o) WHERE n > 0""")
def line_spans(spark, sf_dir):
    return spans.line_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), "text"))


@query(r"""SELECT doc_id, len(list_filter(regexp_extract_all(left(hex(encode(text)), 2 * CAST(doc_id % 900 AS INTEGER)), '..'), lambda x: x = '0A')) + 1 AS line FROM documents WHERE text IS NOT NULL""")
def span_lines(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null")
    return d.select("doc_id", spans.line_at(F.col("text"), F.col("doc_id") % 900).alias("line"))


#: Columns in every line of every text, in three encodings; a wide character stands in the line.
_COLUMN = """SELECT doc_id, pos, CASE (doc_id + pos) % 3 WHEN 0 THEN 'utf8' WHEN 1 THEN 'utf16' ELSE 'utf32' END AS encoding, (doc_id + pos * 7) % 60 AS col,
 concat(substring(content, 1, 20), CASE (doc_id + pos) % 4 WHEN 0 THEN '😀é' ELSE 'ü' END, substring(content, 21)) AS line FROM pieces"""


@query(f"""WITH pieces AS (SELECT doc_id, unnest(x) AS content, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)), d AS ({_COLUMN}),
 c AS (SELECT doc_id, pos, encoding, col, unnest(range(1, length(line) + 1)) AS i, octet_length(encode(unnest(string_split(line, '')))) AS b FROM d),
 u AS (SELECT *, sum(b) OVER w AS bytes, sum(CASE WHEN encoding = 'utf8' THEN b WHEN encoding = 'utf16' AND b = 4 THEN 2 ELSE 1 END) OVER w AS units FROM c WINDOW w AS (PARTITION BY doc_id, pos ORDER BY i)),
 k AS (SELECT doc_id, pos, any_value(col) AS col, min(units) FILTER (units >= col) AS units, min(bytes) FILTER (units >= col) AS bytes FROM u GROUP BY 1, 2)
 SELECT doc_id, pos, CASE WHEN col = 0 THEN 0 WHEN units = col THEN CAST(bytes AS BIGINT) END AS byte, CASE WHEN col = 0 THEN NULL WHEN units IS NULL THEN 'position_out_of_line' WHEN units > col THEN 'position_not_on_boundary' END AS reason FROM k""")
def column_bytes(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null")
    d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content")).createOrReplaceTempView("pieces")
    return spark.sql(_COLUMN).select("doc_id", "pos", spans.column_to_byte(F.col("line"), F.col("col"), F.col("encoding")).alias("x")).select("doc_id", "pos", "x.byte", "x.reason")


@query(f"""WITH {BM25_SQL}, a AS (SELECT query_id, doc_id AS atom_id, rank, source AS path, lang AS owner, doc_id = query_id * 7 AS exact FROM r JOIN documents USING (doc_id) WHERE rank <= 128), {DIVERSITY},
 spent_ AS (SELECT query_id, doc_id, place, CAST(sum(octet_length(encode(text))) OVER (PARTITION BY query_id ORDER BY place) AS BIGINT) AS spent FROM ordered JOIN documents ON doc_id = atom_id) SELECT * FROM spent_ WHERE spent <= 16000""")
def context_pack(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.col("source").alias("path"), F.col("lang").alias("owner"))
    q = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), (F.col("item_id") * 7).alias("anchor"))
    return evidence.context_pack(d, q, 16_000)


@query()
def community_quality(spark, sf_dir):
    """Modularity of the order-dependent communities; the tests check it on a published graph."""
    return evidence.community_quality(assertion_links(spark, sf_dir).filter("confidence in ('EXTRACTED', 'INFERRED')"))


_RAW = "SELECT o_orderkey AS commit_id, 1 AS parents, concat(':100644 100644 a b M', chr(0), 'src/', CAST(o_custkey AS STRING), '.py', chr(0), ':100644 000000 a b D', chr(0), '../x', chr(0), ':100644 100644 a b R100', chr(0), 'old/', CAST(o_orderkey AS STRING), chr(0), 'new/', CAST(o_orderkey AS STRING), chr(0)) AS raw FROM orders"


@query("""SELECT o_orderkey AS commit_id, 1 AS parents, 'src/' || o_custkey || '.py' AS path, '100644' AS mode, 'M' AS status FROM orders UNION ALL SELECT o_orderkey, 1, unnest(['old/' || o_orderkey, 'new/' || o_orderkey]), '100644', 'R' FROM orders""")
def history_records(spark, sf_dir):
    return evidence.raw_changes(*_sql(spark, sf_dir, _RAW))


@query("""SELECT DISTINCT 'run' || doc_id // 50 AS run, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 't' || doc_id % 11 END AS test, source AS path, doc_id % 40 AS line, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'run' ELSE 'setup' END AS phase FROM documents""")
def coverage_import(spark, sf_dir):
    """Reports of fifty documents each are composed from the table and read back through the importer."""
    from loomgraph.sources.readers import coverage_json

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.floor(F.col("doc_id") / 50).alias("r"), "source", (F.col("doc_id") % 40).alias("line"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit("t"), F.col("doc_id") % 11, F.lit("|"), F.when(F.col("doc_id") % 2 == 0, "run").otherwise("setup"))).alias("c"))
    lines = d.groupBy("r", "source", "line").agg(F.sort_array(F.collect_set("c")).alias("cs")).groupBy("r", "source").agg(F.map_from_entries(F.collect_list(F.struct(F.col("line").cast("string"), "cs"))).alias("contexts"))
    runs = lines.groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("source", F.struct("contexts")))).alias("files"))
    files = runs.select(F.concat(F.lit("run"), "r").alias("path"), F.to_json(F.struct(F.struct(F.lit(3).alias("format")).alias("meta"), "files")).alias("text"))
    return coverage_json(files)


@query("SELECT CAST(user_id AS STRING) AS artifact, CAST(user_id AS STRING) AS trace_id, CAST(event_id AS STRING) AS span_id, event_type AS name, CAST(event_id AS STRING) AS start_text, props AS attribute FROM events")
def otlp_import(spark, sf_dir):
    """Traces are composed from the table and read back through the importer."""
    from loomgraph.sources.readers import otlp_json

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    span = F.struct(F.col("user_id").cast("string").alias("traceId"), F.col("event_id").cast("string").alias("spanId"), F.lit("").alias("parentSpanId"), F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("startTimeUnixNano"), F.lit("1").alias("endTimeUnixNano"), F.array(F.struct(F.lit("props").alias("key"), F.struct(F.col("props").alias("stringValue")).alias("value"))).alias("attributes"))
    body = F.struct(F.array(F.struct(F.array(F.struct(F.collect_list(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    files = e.groupBy("user_id").agg(F.to_json(body).alias("text")).select(F.col("user_id").cast("string").alias("path"), "text")
    o = otlp_json(files)
    return o.select("artifact", "trace_id", "span_id", "name", F.col("start_nano").cast("string").alias("start_text"), F.col("attributes")["props"].alias("attribute"))


@query("SELECT 'r' || doc_id // 50 AS path, 'a.C' AS classname, 'n' || doc_id AS name, CASE toxic WHEN 0 THEN 'passed' ELSE 'failed' END AS outcome, NULL::VARCHAR AS reason FROM labels")
def junit_import(spark, sf_dir):
    """Reports of fifty documents each are composed from the labels and read back through the importer."""
    from loomgraph.sources.readers import junit_xml

    case = F.concat(F.lit("<testcase classname='a.C' name='n"), F.col("doc_id"), F.when(F.col("toxic") == 0, "'/>").otherwise("'><failure/></testcase>"))
    d = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.concat(F.lit("r"), F.floor(F.col("doc_id") / 50)).alias("path"), case.alias("c"))
    return junit_xml(d.groupBy("path").agg(F.concat(F.lit("<s>"), F.array_join(F.collect_list("c"), ""), F.lit("</s>")).alias("text")))


_ENTITIES = """SELECT concat('s', CAST(s_suppkey AS STRING)) AS entity_id, concat('f', CAST(s_suppkey AS STRING)) AS path, CAST(s_nationkey AS STRING) AS owner, s_suppkey % 50 AS start_byte, s_suppkey % 50 + 100 AS end_byte FROM supplier
 UNION ALL SELECT concat('p', CAST(p_partkey AS STRING)), concat('f', CAST(p_partkey AS STRING)), p_brand, p_partkey % 50, p_partkey % 50 + 100 FROM part"""
_PROOFS = "SELECT assertion_id, source, target, relation, confidence, concat('f', CAST(assertion_id % 997 AS STRING)) AS path, assertion_id % 40 AS start_byte, assertion_id % 40 + 60 AS end_byte FROM assertions"
_NAMED = "SELECT item_id AS query_id, 1 AS place, 3 AS tier, 'entity' AS kind, concat('s', CAST(item_id + 1 AS STRING)) AS id FROM benchmark UNION ALL SELECT item_id, 2, 3, 'entity', concat('p', CAST(item_id * 3 + 1 AS STRING)) FROM benchmark"
_AIMS = "SELECT item_id AS query_id, (SELECT min(a.target) FROM assertions a WHERE a.source = concat('s', CAST(item_id + 1 AS STRING)) AND a.relation = 'call' AND a.confidence <> 'AMBIGUOUS' AND item_id % 5 = 0) AS target FROM benchmark"


@query(with_sql("assertions") + f""", {BM25_SQL}, ent AS ({_ENTITIES}), proof AS ({_PROOFS}), files AS (SELECT 'f' || doc_id AS path, octet_length(encode(text)) AS size FROM documents WHERE text IS NOT NULL), aims AS ({_AIMS}),
 cand AS ({_NAMED} UNION ALL SELECT query_id, 2 + rank, 4, 'file', 'f' || doc_id FROM r WHERE rank <= 5),
 one AS (SELECT query_id, 'definition' AS kind, id AS atom_id, tier, place AS seed_rank, 0 AS distance, path, owner, [{{'path': path, 'a': start_byte, 'b': end_byte}}] AS src FROM cand JOIN ent ON entity_id = id AND kind = 'entity'
  UNION ALL SELECT query_id, 'lexical_file', id, tier, place, 0, path, NULL, [{{'path': path, 'a': 0, 'b': size}}] FROM cand JOIN files ON path = id AND kind = 'file'),
 sized AS (SELECT *, 64 + strlen(atom_id) + coalesce(strlen(path), 0) + coalesce(strlen(owner), 0) + coalesce(list_sum(list_transform(src, lambda s: 32 + strlen(s.path))), 0) AS size FROM one),
 fit AS (SELECT query_id, bool_and(n <= 40 AND spent <= 9000) AS whole FROM (SELECT query_id, row_number() OVER w AS n, sum(size) OVER w AS spent FROM sized WINDOW w AS (PARTITION BY query_id ORDER BY seed_rank)) GROUP BY 1),
 seed AS (SELECT query_id, seed_rank, tier, atom_id AS seed, target FROM one JOIN fit USING (query_id) JOIN aims USING (query_id) WHERE whole AND kind = 'definition'),
 step AS (SELECT source, target, relation, assertion_id, path, start_byte, end_byte FROM proof WHERE relation = 'call' AND confidence <> 'AMBIGUOUS' AND target IS NOT NULL),
 rel AS (SELECT s.query_id, 'relationship' AS kind, CAST(a.assertion_id AS STRING) AS atom_id, s.tier, s.seed_rank, 1 AS distance, a.path, e.owner, [{{'path': a.path, 'a': a.start_byte, 'b': a.end_byte}}] AS src, a.relation, a.assertion_id FROM seed s JOIN step a ON a.source = s.seed LEFT JOIN ent e ON e.entity_id = a.source WHERE s.target IS NULL),
 hop AS (SELECT s.query_id, s.seed_rank, min((a.relation, a.assertion_id)) AS h FROM seed s JOIN step a ON a.source = s.seed AND a.target = s.target WHERE s.seed <> s.target GROUP BY ALL),
 way AS (SELECT s.query_id, 'path' AS kind, s.seed || ' ' || a.assertion_id AS atom_id, s.tier, s.seed_rank, 1 AS distance, e.path, e.owner, [{{'path': a.path, 'a': a.start_byte, 'b': a.end_byte}}] AS src FROM seed s JOIN hop USING (query_id, seed_rank) JOIN step a ON a.assertion_id = h[2] JOIN ent e ON e.entity_id = s.seed
  UNION ALL SELECT s.query_id, 'path', s.seed || ' ', s.tier, s.seed_rank, 0, e.path, e.owner, [] FROM seed s JOIN ent e ON e.entity_id = s.seed WHERE s.seed = s.target),
 front AS (SELECT s.*, s.target IS NOT NULL AND (s.seed = s.target OR h IS NOT NULL) AS got, EXISTS (SELECT 1 FROM step a WHERE a.source = s.seed AND a.target <> s.seed) AS deep FROM seed s LEFT JOIN hop USING (query_id, seed_rank)),
 mark AS (SELECT query_id, 'frontier' AS kind, seed AS atom_id, 0 AS tier, seed_rank, 0 AS distance, CASE WHEN target IS NULL THEN CASE WHEN deep THEN 'partial' ELSE 'complete' END WHEN got THEN 'complete' WHEN deep THEN 'partial' ELSE 'no_path' END AS path, CASE WHEN NOT got AND deep THEN 'depth_limit' END AS owner, [] AS src FROM front),
 every AS (SELECT 0 AS phase, 1 AS atom, NULL AS relation, NULL AS aid, * FROM one UNION ALL SELECT 1, 0, NULL, NULL, * FROM mark UNION ALL SELECT 1, 1, relation, assertion_id, * EXCLUDE (relation, assertion_id) FROM rel UNION ALL SELECT 1, 1, NULL, NULL, * FROM way),
 run AS (SELECT *, sum(atom) OVER w AS n, sum(64 + strlen(atom_id) + coalesce(strlen(path), 0) + coalesce(strlen(owner), 0) + coalesce(list_sum(list_transform(src, lambda s: 32 + strlen(s.path))), 0)) OVER w AS spent FROM every
  WINDOW w AS (PARTITION BY query_id ORDER BY phase, seed_rank, atom, relation, aid, kind, atom_id ROWS UNBOUNDED PRECEDING)),
 taken AS (SELECT *, len(src) > 0 AND EXISTS (SELECT 1 FROM files f WHERE f.path = src[1].path AND src[1].b <= f.size) AS there FROM run WHERE n <= 40 AND spent <= 9000 AND atom = 1 QUALIFY row_number() OVER (PARTITION BY query_id, kind, atom_id ORDER BY tier, seed_rank, distance) = 1),
 x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, seed_rank, distance, NOT there, list_position(['definition', 'lexical_file', 'relationship', 'path'], kind), kind, atom_id) AS rank, kind = 'definition' AND tier < 4 AS exact FROM taken),
 a AS (SELECT query_id, (kind, atom_id) AS atom_id, rank, path, owner, exact FROM x), {DIVERSITY}
 SELECT o.query_id, place, x.kind, x.atom_id, x.distance, x.src[1].path AS source_path, x.src[1].a AS start_byte, x.src[1].b AS end_byte, CASE WHEN x.there THEN true WHEN len(src) > 0 THEN false END AS available
 FROM ordered o JOIN x ON x.query_id = o.query_id AND x.kind = o.atom_id[1] AND x.atom_id = o.atom_id[2]""")
def task_context(spark, sf_dir):
    """Definitions, files, relationships and paths for each benchmark item; the SQL has one step of depth."""
    from loomgraph.operators import context
    from loomgraph.operators.text import bm25

    projected(spark, sf_dir, "assertions").createOrReplaceTempView("assertions")
    entities, proofs, named, aims = _sql(spark, sf_dir, _ENTITIES, _PROOFS, _NAMED, _AIMS)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    q = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = bm25(docs, q, top=5).select("query_id", (F.col("rank") + 2).alias("place"), F.lit(4).alias("tier"), F.lit("file").alias("kind"), F.concat(F.lit("f"), "doc_id").alias("id"))
    files = docs.filter("text is not null").select(F.concat(F.lit("f"), "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    limits = context.Limits(depth=1, atoms=40, bytes=9000, inline=2000, nodes=5000, edges=5000)
    got = context.assembled(named.unionByName(hits), entities, files, proofs, aims, limits)
    s = got.sources.filter("source_no = 0").select("query_id", "place", F.col("path").alias("source_path"), "start_byte", "end_byte", F.coalesce(F.col("reason") != "source_unavailable", F.lit(True)).alias("available"))
    return got.atoms.join(s, ["query_id", "place"], "left").select("query_id", "place", "kind", "atom_id", "distance", "source_path", "start_byte", "end_byte", "available")
