"""Fact tables projected from the driver's star-schema tables.

Each projection is one SELECT that both Spark SQL and DuckDB read, so a query
and its SQL check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.tables import bounded, kept

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_NAME = "concat(p_name, '/', p_type, '/', CAST(p_size AS STRING))"

PROJECTIONS = {
    "symbols": f"""SELECT p_partkey AS id, 'python' AS lang, {_NAME} AS name,
        CASE p_size % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'module' WHEN 2 THEN 'function' WHEN 3 THEN 'method' ELSE 'variable' END AS kind,
        p_brand AS path, p_partkey AS line_start, p_partkey + p_size AS line_end FROM part""",
    "refs": """SELECT DISTINCT 'python' AS lang, concat(p_name, '/', p_type, '/', CAST(p_size + l_linenumber % 2 AS STRING)) AS callee_name,
        CASE l_linenumber % 4 WHEN 2 THEN 'construct' WHEN 3 THEN 'superclass' ELSE 'call' END AS relation, l_returnflag = 'R' AS qualified,
        concat('Brand#', CAST(1 + l_suppkey % 25 AS STRING)) AS path, l_partkey AS line, l_linenumber AS col
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    # the same in files of ten parts each
    "file_symbols": f"""SELECT p_partkey AS id, 'python' AS lang, {_NAME} AS name,
        CASE p_size % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'module' WHEN 2 THEN 'function' WHEN 3 THEN 'method' ELSE 'variable' END AS kind,
        concat(p_brand, '/', CAST(CAST(floor(p_partkey / 10) AS BIGINT) AS STRING), '.py') AS path, p_partkey AS line_start, p_partkey + p_size AS line_end FROM part""",
    "file_refs": """SELECT DISTINCT 'python' AS lang, concat(p_name, '/', p_type, '/', CAST(p_size + l_linenumber % 2 AS STRING)) AS callee_name,
        CASE l_linenumber % 4 WHEN 2 THEN 'construct' WHEN 3 THEN 'superclass' ELSE 'call' END AS relation, l_returnflag = 'R' AS qualified,
        concat('Brand#', CAST(1 + l_suppkey % 25 AS STRING), '/', CAST(CAST(floor(l_partkey / 10) AS BIGINT) AS STRING), '.py') AS path, l_partkey AS line, l_linenumber AS col
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    # supplier -> part -> supplier chains: odd lines lead to the part, even lines back
    "assertions": """SELECT min(l_orderkey * 10 + l_linenumber) AS assertion_id, CASE WHEN l_linenumber % 2 = 1 THEN concat('s', CAST(l_suppkey AS STRING)) ELSE concat('p', CAST(l_partkey AS STRING)) END AS source,
        CASE WHEN l_linenumber % 2 = 1 THEN concat('p', CAST(l_partkey AS STRING)) ELSE concat('s', CAST(l_suppkey AS STRING)) END AS target,
        CASE l_linenumber % 3 WHEN 0 THEN 'import' ELSE 'call' END AS relation,
        CASE l_linenumber % 5 WHEN 0 THEN 'AMBIGUOUS' WHEN 1 THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence
        FROM lineitem GROUP BY ALL""",
    "source_files": """SELECT concat(CASE WHEN doc_id % 11 = 0 THEN 'node_modules/' WHEN doc_id % 13 = 0 THEN '.git/' ELSE '' END, source, '/', lang, '/f', CAST(doc_id AS STRING),
        CASE doc_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.rb' WHEN 2 THEN '.ts' WHEN 3 THEN '.md' WHEN 4 THEN '.bin' WHEN 5 THEN '.go' ELSE '' END) AS path, text FROM documents""",
    "commit_paths": """SELECT o_orderkey AS commit_id, CASE WHEN o_orderpriority = '5-LOW' THEN 2 ELSE 1 END AS parents,
        concat(CASE WHEN l_partkey % 17 = 0 THEN 'gen/' ELSE 'src/' END, CAST(l_partkey AS STRING), '.py') AS path,
        CASE WHEN l_partkey % 29 = 0 THEN '160000' ELSE '100644' END AS mode FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
    "before": """SELECT doc_id AS entity_id, source AS path, lang AS language, CASE doc_id % 3 WHEN 0 THEN 'class' ELSE 'function' END AS kind,
        CAST(doc_id AS STRING) AS name, substring(text, 1, 20) AS signature, substring(text, 21) AS body, doc_id % 50 AS line
        FROM documents WHERE doc_id % 10 <> 0""",
    "after": """SELECT CASE WHEN doc_id % 23 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS entity_id, source AS path, lang AS language,
        CASE doc_id % 3 WHEN 0 THEN 'class' ELSE 'function' END AS kind, CASE WHEN doc_id % 23 = 0 THEN concat('n', CAST(doc_id AS STRING)) ELSE CAST(doc_id AS STRING) END AS name,
        concat(CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END, substring(text, 1, 20)) AS signature,
        concat(substring(text, 21), CASE WHEN doc_id % 5 = 0 THEN ' x' ELSE '' END) AS body, doc_id % 50 + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS line
        FROM documents WHERE doc_id % 10 <> 1""",
    "spans": """SELECT user_id AS trace_id, event_id AS span_id, ts, event_type AS name,
        lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_ts FROM events""",
    "executions": """SELECT event_id, concat('Brand#', CAST(1 + user_id % 25 AS STRING)) AS path, CAST(floor(value * 4) AS BIGINT) AS line_from,
        CAST(floor(value * 4) AS BIGINT) + user_id % 3 AS line_to, event_type AS test FROM events""",
}


def views(spark: SparkSession, sf_dir: str) -> None:
    """Name the parquet tables for SQL."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def reference_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct (path, line) of ``refs``: only the numbers that a place is made of are told apart."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("line"), (F.col("l_suppkey") % 25).alias("__s"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("line"))
    places = lines.repartition("line").distinct().join(parts.hint("merge"), "line", "left_semi")
    return places.select(F.concat(F.lit("Brand#"), (1 + F.col("__s")).cast("string")).alias("path"), "line")


def _references(spark: SparkSession, sf_dir: str, files: bool, called: str | None = None) -> DataFrame:
    """``refs`` or ``file_refs``: the same rows as their SQL. Lines become distinct by their numbers, before they get names, and meet
        their parts where they are: parts are small as a file but not as rows, so they are not copied to every task. With ``called``
    only the parts that may give this name are looked up."""
    key, supplier, place = F.col("l_partkey"), F.col("l_suppkey") % 25, F.col("l_linenumber")
    # distinct rows have distinct names, but for missing ones
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter(key.isNotNull()).select(key.alias("line"), place.alias("col"), F.col("l_returnflag").eqNullSafe("R").alias("__r"), F.col("l_returnflag").isNull().alias("__none"), supplier.alias("__s"))
    stem = F.concat("p_name", F.lit("/"), "p_type", F.lit("/"))
    whole = stem.isNotNull() & F.col("p_size").isNotNull()
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("line"), F.when(whole, stem).alias("__stem"), F.when(whole, F.col("p_size")).alias("__size")).distinct()
    if called is None:
        lines = lines.repartition("line").distinct()
    else:
        may = [F.concat("__stem", (F.col("__size") + k).cast("string")) == called for k in (0, 1)]
        parts = kept(parts.filter(may[0] | may[1]))
        lines = lines.join(bounded(parts.select("line").distinct()), "line", "left_semi").distinct()
    path = F.concat(F.lit("Brand#"), (1 + F.col("__s")).cast("string"))
    if files:
        path = F.concat(path, F.lit("/"), F.floor(F.col("line") / 10).cast("bigint").cast("string"), F.lit(".py"))
    relation = F.when(F.col("col") % 4 == 2, "construct").when(F.col("col") % 4 == 3, "superclass").otherwise("call")
    name = F.concat("__stem", (F.col("__size") + F.col("col") % 2).cast("string"))
    out = lines.join(parts.hint("merge"), "line").select(F.lit("python").alias("lang"), name.alias("callee_name"), relation.alias("relation"), F.when(~F.col("__none"), F.col("__r")).alias("qualified"), path.alias("path"), "line", "col")
    return out if called is None else out.filter(F.col("callee_name") == called)


def references_of(spark: SparkSession, sf_dir: str, called: str) -> DataFrame:
    """The rows of ``refs`` with this name."""
    return _references(spark, sf_dir, False, called)


def assertion_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, relation, confidence) of every line: ``assertions`` without ids and with repeated rows, for what needs only its sets."""
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    sql = PROJECTIONS["assertions"]
    return spark.sql("SELECT " + sql[sql.index("CASE") :].removesuffix(" GROUP BY ALL"))


def projected(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in ("refs", "file_refs"):
        return _references(spark, sf_dir, name == "file_refs")
    sql = PROJECTIONS[name]
    for t in TABLES:
        if t in sql.replace("\n", " ").replace(",", " ").split():
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def with_sql(*names: str) -> str:
    """WITH clause of these projections, for DuckDB."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({PROJECTIONS[n]})" for n in names)
