"""Queries on source text and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import scalars
from loomgraph.operators import text
from loomgraph.plans.projection import projected, views, with_sql
from loomgraph.registry import query

_EXT = ", ".join(f"('{k}', '{v}')" for k, v in scalars.LANGUAGES.items())
_SKIP = ", ".join(f"'{s}'" for s in scalars.SKIPPED)
_FILES = with_sql("source_files")
_LINES = "ln AS (SELECT path, generate_subscripts(s, 1) AS line, unnest(s) AS content FROM (SELECT path, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS s FROM source_files WHERE length(text) > 0))"


@query(_FILES + f" SELECT path, e.l AS lang FROM source_files JOIN (VALUES {_EXT}) e(x, l) ON lower(regexp_extract(path, '[^/]+(\\.[^./]+)$', 1)) = e.x WHERE NOT list_has_any(string_split(path, '/'), [{_SKIP}])")
def source_enumeration(spark, sf_dir):
    return text.enumerated(projected(spark, sf_dir, "source_files").select("path"))


@query(_FILES + f""", {_LINES}, w AS (SELECT *, sum(strlen(content) + 1) OVER (PARTITION BY path ORDER BY line) AS spent, count(*) OVER (PARTITION BY path) AS total FROM ln),
 x AS (SELECT path, line, content, total, sum(strlen(content) + 1) OVER (PARTITION BY path ORDER BY line) AS spent FROM w WHERE line BETWEEN 2 AND 5), y AS (SELECT *, max(line) OVER (PARTITION BY path) AS last FROM x WHERE spent <= 600)
 SELECT path, line, content, CASE WHEN last < total THEN last + 1 END AS next_cursor FROM y""")
def view_file(spark, sf_dir):
    return text.line_window(projected(spark, sf_dir, "source_files"), 2, 5, budget=600)


@query(_FILES + " SELECT DISTINCT split_part(substr(path, 6), '/', 1) AS name, contains(substr(path, 6), '/') AS is_dir FROM source_files WHERE starts_with(path, 'src1/') ORDER BY is_dir DESC, lower(name), name LIMIT 200")
def list_dir(spark, sf_dir):
    return text.listed(projected(spark, sf_dir, "source_files"), "src1")


@query(_FILES + f""", {_LINES}, p AS (SELECT path, line, content, string_split(lower(content), 'tion the') AS s FROM ln)
 SELECT path, line, CAST(list_sum(list_transform(s[1:k], lambda x: length(x))) + (k - 1) * 8 + 1 AS INTEGER) AS col, left(content, 120) AS preview FROM (SELECT *, unnest(range(1, len(s))) AS k FROM p WHERE len(s) > 1)""")
def search_text(spark, sf_dir):
    return text.searched(projected(spark, sf_dir, "source_files"), "tion the")


@query(_FILES + f""", {_LINES}, m AS (SELECT path, line, content, unnest(regexp_extract_all(content, 'The [a-z]+ing')) AS hit FROM ln) SELECT path, line, count(*) AS n FROM m GROUP BY ALL""")
def search_text_regex(spark, sf_dir):
    return text.searched(projected(spark, sf_dir, "source_files"), "The [a-z]+ing", regex=True).groupBy("path", "line").agg(F.count(F.lit(1)).alias("n"))


_COMMENTS = """SELECT doc_id AS path, doc_id % 40 AS line, CASE doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'ruby' WHEN 2 THEN 'typescript' ELSE 'go' END AS lang,
 CASE doc_id % 7 WHEN 0 THEN concat('#  plain', chr(10), '# NOTE: ', w) WHEN 1 THEN concat('// WHY: ', w, ' see rfc 0', CAST(doc_id % 900 AS STRING)) WHEN 2 THEN concat('/**', chr(10), ' * ', w, ' ADR-', CAST(doc_id % 300 AS STRING), chr(10), ' */')
  WHEN 3 THEN concat('#HACK: ', w) WHEN 4 THEN concat('/* a', chr(10), '  * FIXME: ', w, chr(10), ' adr 5 */') WHEN 5 THEN concat('// ', w) ELSE concat('# TODO: ', w) END AS text
 FROM (SELECT doc_id, {0} AS w FROM documents)"""


@query(f"""WITH c AS ({_COMMENTS.format("regexp_replace(coalesce(text, ''), '[^a-z]+', ' ', 'g')")}), l AS (SELECT *, string_split(text, chr(10)) AS s, regexp_extract(text, '(?i)\\b(ADR|RFC)[- ]?(\\d{{1,5}})\\b', ['k', 'd']) AS m FROM c),
 x AS (SELECT path, line, lang, unnest(s) AS t, generate_subscripts(s, 1) - 1 AS i, CASE WHEN m.k <> '' THEN CASE upper(m.k) WHEN 'ADR' THEN 'ADR-' || lpad(CAST(try_cast(m.d AS INT) AS STRING), 4, '0') ELSE 'RFC-' || try_cast(m.d AS INT) END END AS label FROM l),
 y AS (SELECT path, line, lang, i, trim(t) AS text, label, CASE WHEN lang IN ('python', 'ruby') AND regexp_matches(trim(t), '^# (NOTE|IMPORTANT|HACK|WHY|RATIONALE|TODO|FIXME):') THEN 0
   WHEN lang = 'typescript' AND regexp_matches(trim(t), '^(//|\\*) (NOTE|IMPORTANT|HACK|WHY|RATIONALE|TODO|FIXME):') THEN 0 WHEN lang = 'typescript' AND regexp_matches(t, '(?i)\\b(ADR|RFC)[- ]?\\d{{1,5}}\\b') THEN 1 END AS how FROM x)
 SELECT path, line + i AS line, text, CASE WHEN lang = 'typescript' THEN label END AS label FROM y WHERE how IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY how, i) = 1""")
def rationale(spark, sf_dir):
    """Comments are composed from the documents' words, as the texts hold none."""
    views(spark, sf_dir)
    return text.rationale_comments(spark.sql(_COMMENTS.format("regexp_replace(coalesce(text, ''), '[^a-z]+', ' ')")))


_TOK = "list_filter(regexp_split_to_array(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda t: t <> '')"
BM25_SQL = f"""q AS (SELECT item_id AS query_id, unnest(list_distinct({_TOK.format("text")})) AS term FROM benchmark),
 d AS (SELECT doc_id, {_TOK.format("text")} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS avg FROM d),
 tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 s AS (SELECT q.query_id, tf.doc_id, -sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))) AS score FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), doc_id) AS rank FROM s)"""


def _bm25(spark, sf_dir):
    q = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d, q, text.bm25(d, q, top=20)


@query(f"WITH {BM25_SQL} SELECT query_id, doc_id, rank, round(score, 5) AS score FROM r WHERE rank <= 20")
def bm25(spark, sf_dir):
    return _bm25(spark, sf_dir)[2].withColumn("score", F.round("score", 5))


#: What a document and a query show to the four exact tiers, in their order: id, qualified label, path, name.
_DOC_KEYS = ("CAST(doc_id AS STRING)", "concat(source, '.', lang, '.', CAST(doc_id % 40 AS STRING))", "source", "concat(lang, '/', CAST(doc_id % 500 AS STRING))")
_ASK_KEYS = ("CAST(query_id * 3 AS STRING)", "concat('src', CAST(query_id % 20 AS STRING), '.en.', CAST(query_id % 40 AS STRING))", "concat('src', CAST(query_id + 1 AS STRING))", "concat('en/', CAST(query_id % 500 AS STRING))")
_EXACT = " UNION ALL ".join(f"SELECT query_id, doc_id, {i} AS tier, 0.0 AS score FROM (SELECT DISTINCT query_id FROM q) JOIN documents ON {d} = {a}" for i, (d, a) in enumerate(zip(_DOC_KEYS, _ASK_KEYS, strict=True)))


@query(f"""WITH {BM25_SQL}, e AS ({_EXACT} UNION ALL SELECT query_id, doc_id, 4, score FROM r WHERE rank <= 20),
 b AS (SELECT query_id, doc_id, min(tier) AS tier, arg_min(score, tier) AS score FROM e GROUP BY 1, 2)
 SELECT query_id, doc_id, tier, row_number() OVER (PARTITION BY query_id ORDER BY tier, round(score, 9), doc_id) AS place FROM b QUALIFY place <= 50""")
def retrieval_tiers(spark, sf_dir):
    d, q, ranked = _bm25(spark, sf_dir)
    q = q.select("query_id", *[F.expr(x).alias(f"want_{i}") for i, x in enumerate(_ASK_KEYS)])
    d = d.select("doc_id", *[F.expr(x).alias(f"key_{i}") for i, x in enumerate(_DOC_KEYS)])
    return text.tiered(d, q, [(f"key_{i}", f"want_{i}") for i in range(4)], ranked, 50)


@query(f"WITH d AS (SELECT doc_id, ' ' || array_to_string({_TOK.format('text')}, '  ') || ' ' AS t FROM documents) SELECT doc_id, CAST((length(t) - length(replace(t, ' of  the ', ''))) / 9 AS BIGINT) AS n FROM d WHERE contains(t, ' of  the ')")
def phrase_search(spark, sf_dir):
    return text.phrase(spark.read.parquet(f"{sf_dir}/documents.parquet"), "Of the")


#: Places of atoms ``a`` (query_id, atom_id, rank, path, owner, exact): ordered.
DIVERSITY = """n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, atom_id) AS n FROM a QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, atom_id) <= 128),
 f AS (SELECT *, coalesce(n = min(n) FILTER (exact) OVER (PARTITION BY query_id), false) AS first FROM n),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id, first, path, owner ORDER BY n) AS k, min(n) OVER (PARTITION BY query_id, first, path, owner) AS o FROM f),
 t AS (SELECT *, row_number() OVER (PARTITION BY query_id, first, path ORDER BY k, o) AS turn, min(n) OVER (PARTITION BY query_id, first, path ORDER BY k, o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below FROM k),
 ordered AS (SELECT query_id, atom_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first DESC, turn, below) AS INTEGER) AS place FROM t)"""


@query(f"WITH {BM25_SQL}, a AS (SELECT query_id, doc_id AS atom_id, rank, source AS path, lang AS owner, doc_id % 5 = 0 AS exact FROM r JOIN documents USING (doc_id) WHERE rank <= 20), {DIVERSITY} SELECT * FROM ordered")
def context_order(spark, sf_dir):
    ranked = _bm25(spark, sf_dir)[2]
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang")
    atoms = ranked.join(d, "doc_id").select("query_id", F.col("doc_id").alias("atom_id"), "rank", F.col("source").alias("path"), F.col("lang").alias("owner"), (F.col("doc_id") % 5 == 0).alias("exact"))
    return text.diversified(atoms)


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)
SELECT page_id, regexp_extract(path, '[^/]*$') AS base, regexp_replace(path, '/?[^/]*$', '') AS parent, regexp_matches(path, '\\.html$') AS is_html, starts_with(path, 'www.') AS www,
 contains(path, '/en/') AND NOT contains(substr(path, strpos(path, '/') + 4), '/') AS child,
 upper(left(split_part(split_part(path, '/', 1), '.', 1), 1)) || substr(split_part(split_part(path, '/', 1), '.', 1), 2) AS camel FROM p""")
def path_functions(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    c = F.col("path")
    host = F.split(c, "/")[0]
    inner = F.expr("substring(path, instr(path, '/') + 4)")
    return p.select("page_id", scalars.basename(c).alias("base"), scalars.parent(c).alias("parent"), c.endswith(".html").alias("is_html"), c.startswith("www.").alias("www"), (c.contains("/en/") & ~inner.contains("/")).alias("child"), scalars.camelize(F.split(host, r"\.")[0]).alias("camel"))


@query("""SELECT p_partkey, starts_with(path, 'a/b/') AS subtree, starts_with(path, 'a/b/') AND NOT contains(substr(path, 5), '/') AND length(path) > 4 AS children, path = 'a/b/c0' AS literal, path = 'a/b' OR starts_with(path, 'a/b/') AS below,
 NOT (path = '' OR starts_with(path, '/') OR len(list_intersect(string_split(path, '/'), ['', '.', '..'])) > 0) AS relative
 FROM (SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'a/b/c' || p_size % 3 WHEN 1 THEN 'a/b/c/d' || p_size WHEN 2 THEN 'a/bc/d' WHEN 3 THEN 'a/b' WHEN 4 THEN '/abs' WHEN 5 THEN 'x/../y' ELSE 'a//b' END AS path FROM part)""")
def path_selectors(spark, sf_dir):
    size = F.col("p_size")
    m = size % 7
    path = F.when(m == 0, F.concat(F.lit("a/b/c"), size % 3)).when(m == 1, F.concat(F.lit("a/b/c/d"), size)).when(m == 2, "a/bc/d").when(m == 3, "a/b").when(m == 4, "/abs").when(m == 5, "x/../y").otherwise("a//b")
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", path.alias("path"))
    c = F.col("path")
    return p.select("p_partkey", scalars.selected(c, "a/b/**").alias("subtree"), scalars.selected(c, "a/b/*").alias("children"), scalars.selected(c, "a/b/c0").alias("literal"), scalars.under(c, "a/b").alias("below"), scalars.relative_path(c).alias("relative"))


@query("""SELECT label, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ADR-' || lpad(CAST(doc_id % 1000 AS STRING), 4, '0') WHEN doc_id % 3 = 1 THEN 'RFC-' || doc_id % 1000 END AS label FROM documents) WHERE label IS NOT NULL GROUP BY label""")
def decision_labels(spark, sf_dir):
    n = (F.col("doc_id") % 1000).cast("string")
    note = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("see adr "), n, F.lit(" and RFC 9"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("(rfc-"), n, F.lit(")"))).otherwise("none")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", scalars.decision_label(note).alias("label")).filter("label is not null")
    return d.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query("""WITH t AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'x/test_' WHEN 1 THEN 'x/a_' ELSE 'x/' END || p_type || CASE p_size % 5 WHEN 0 THEN '_test.py' ELSE '.py' END AS path, CASE p_partkey % 2 WHEN 0 THEN 'test_' ELSE 'run_' END || p_type AS name,
 CASE p_partkey % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'method' ELSE 'class' END AS kind, CASE p_partkey % 5 WHEN 0 THEN 'TestX' WHEN 1 THEN 'Other' END AS owner FROM part)
 SELECT p_partkey, path || '::' || CASE WHEN owner IS NULL THEN '' ELSE owner || '::' END || name AS selector FROM t WHERE (regexp_matches(path, '/test_[^/]*\\.py$') OR regexp_matches(path, '_test\\.py$')) AND kind IN ('function', 'method') AND starts_with(name, 'test') AND (owner IS NULL OR starts_with(owner, 'Test'))""")
def test_selectors(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    s, k = F.col("p_size"), F.col("p_partkey")
    path = F.concat(F.when(s % 4 == 0, "x/test_").when(s % 4 == 1, "x/a_").otherwise("x/"), F.col("p_type"), F.when(s % 5 == 0, "_test.py").otherwise(".py"))
    t = p.select("p_partkey", path.alias("path"), F.concat(F.when(k % 2 == 0, "test_").otherwise("run_"), "p_type").alias("name"), F.when(k % 3 == 0, "function").when(k % 3 == 1, "method").otherwise("class").alias("kind"), F.when(k % 5 == 0, "TestX").when(k % 5 == 1, "Other").alias("owner"))
    t = t.filter(scalars.is_test(F.col("path"), F.col("name"), F.col("kind"), F.col("owner")))
    return t.select("p_partkey", F.concat_ws("::", "path", "owner", "name").alias("selector"))
