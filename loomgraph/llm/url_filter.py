"""Operator 5, URL filters: block decisions spread over redirect equivalence. DataFrame functions only.

Pages, and the targets of their redirects and canonical links, are nodes; nodes
are joined by distributed connected components. A page with a rule of its own
follows it. Any other page follows its component: an explicit allow on any
member comes first, then a block on any member, then allow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import components, written

#: (verdict, host, path prefix)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: So many rules become one expression; more are joined.
INLINE = 64

_ATTR = r"""\s*=\s*["']?([^"'\s>]+)"""


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _lower(text: Column) -> Column:
    """A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; of equally long ones allow comes first, then the text's order."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    best = sorted(set(rules), key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]))
    whens = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in best
    ]
    return F.coalesce(*whens, found) if whens else found


def ruled(urls: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with ``__r``: the struct (rule, verdict) of each row, or null.

    A table of rules (verdict, host, path), or more than ``INLINE`` of them, is met by equality only: each suffix of a
    host finds the lengths of its rules' paths, and the path cut to such a length finds the rule.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= INLINE:
            return urls.withColumn("__r", rule_of(F.col("host"), F.col("path"), rules))
        rules = urls.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    rules = rules.groupBy(F.col("host").alias("__h"), F.col("path").alias("__p")).agg(F.min("verdict").alias("__v"))  # "allow" < "block"
    sizes = rules.groupBy("__h").agg(F.collect_set(F.length("__p")).alias("__sizes"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    found = urls.select("host", "path").distinct().withColumn("__h", F.explode(suffixes)).join(sizes, "__h")
    found = found.withColumn("__n", F.explode("__sizes")).withColumn("__p", F.substring(F.col("path"), F.lit(1), F.col("__n"))).filter(F.length("__p") == F.col("__n")).join(rules, ["__h", "__p"])
    text = F.concat("__h", "__p")
    best = found.groupBy("host", "path").agg(F.min(F.struct((-F.length(text)).alias("n"), F.col("__v").alias("verdict"), text.alias("rule"))).alias("__b"))
    best = best.select(F.col("host").alias("__bh"), F.col("path").alias("__bp"), F.struct("__b.rule", "__b.verdict").alias("__r"))
    return urls.join(best, (F.col("host") == F.col("__bh")) & (F.col("path") == F.col("__bp")), "left").drop("__bh", "__bp")


def parsed(urls: DataFrame) -> DataFrame:
    """``urls`` (url, ...) with host, path and node: what identifies a resource (host, path and query, without scheme and fragment; null without a host)."""
    u = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rest = F.regexp_extract(_after_scheme(F.col("url")), r"^[^/?#]*([^#]*)", 1)
    return u.withColumn("node", F.when(F.col("host") != "", F.concat("host", rest)))


def link_targets(html: Column) -> Column:
    """Array of canonical-link and meta-refresh targets, as written in the page."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    canonical = F.transform(F.filter(tags, lambda t: t.rlike(r"""(?is)^<link\b.*\brel\s*=\s*["']?canonical\b""")), lambda t: F.regexp_extract(t, "(?i)\\bhref" + _ATTR, 1))
    refresh = F.transform(F.filter(tags, lambda t: t.rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b""")), lambda t: F.regexp_extract(t, r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    all_ = F.array_distinct(F.concat(canonical, refresh))
    # most pages have neither word: no tag is searched for there
    return F.when(html.rlike("(?i)canonical|http-equiv"), F.filter(all_, lambda t: t != "")).otherwise(F.array().cast("array<string>"))


def resolved(base: Column, target: Column) -> Column:
    """Absolute form of a link target; a target without host or leading slash is taken from the base's folder."""
    scheme = F.regexp_extract(base, r"^([^:/?#]*):", 1)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(_after_scheme(base), r"^([^/?#]*)", 1))
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, component) of every page.

    ``rules`` are (verdict, host, path) triples or a table of them, of any number. ``redirects`` may add (from_url, to_url)
    pairs from a crawl log. Null or odd URLs have empty host and path, no rule and no aliases, and are allowed. Null html has
    no links. Repeated rows are each judged; an empty table gives an empty result. Other columns, whatever their names, are
    ignored. With no links at all no component is computed and the query is a single narrow scan; ``component`` is then null.
    """
    d = pages.select("page_id", "url", "html")
    # few rows; written, so that what follows is not computed inside the tag search
    raw = written(d.select(F.col("url").alias("from_url"), F.explode(link_targets(F.col("html"))).alias("to")), "targets", narrow=True)
    links = raw.select("from_url", resolved(F.col("from_url"), F.col("to")).alias("to_url"))
    if redirects is not None:
        links = links.unionByName(redirects.select("from_url", "to_url"))
    links = written(links.filter("from_url is not null and to_url is not null"), "links", narrow=True)
    plain = parsed(d.select("page_id", "url"))
    own = [F.col("page_id"), F.col("host"), F.col("path"), F.col("__r.rule").alias("rule")]
    if links.isEmpty():
        return ruled(plain, rules).select(*own, F.coalesce(F.col("__r.verdict"), F.lit("allow")).alias("verdict"), F.lit(None).cast("long").alias("component"))
    urls = written(parsed(links.select(F.col("from_url").alias("url")).union(links.select("to_url")).distinct()).filter("node is not null"), "aliases", narrow=True)
    # nodes are named by a 64-bit hash for the component search only where it is unique
    ids = written(urls.select("node").distinct().withColumn("id", F.xxhash64("node")), "nodes", narrow=True)
    if ids.count() != ids.select("id").distinct().count():
        twice = F.row_number().over(Window.partitionBy("id").orderBy("node"))
        ids = written(ids.withColumn("id", F.when(twice == 1, F.col("id")).otherwise(F.xxhash64("node", twice))), "nodes", narrow=True)
    named = written(urls.join(ids, "node").select("url", "id"), "named", narrow=True)
    end = lambda u, i: named.select(F.col("url").alias(u), F.col("id").alias(i))
    edges = links.join(end("from_url", "i"), "from_url").join(end("to_url", "j"), "to_url").select("i", "j")
    comp = written(components(edges).join(ids, "id").select("node", "component"), "aliased", narrow=True)
    known = ruled(urls.select("node", "host", "path").distinct(), rules).select("node", F.col("__r.verdict").alias("v")).filter("v is not null")
    decided = comp.join(known, "node").groupBy("component").agg(F.min("v").alias("__v"))  # "allow" < "block"
    by_node = comp.join(decided, "component", "left").select("node", "component", "__v")
    return ruled(plain, rules).join(by_node, "node", "left").select(*own, F.coalesce(F.col("__r.verdict"), F.col("__v"), F.lit("allow")).alias("verdict"), "component")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("component")
