"""Source text: enumeration, line windows, listing, search, rationale comments, retrieval, context order."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars


def enumerated(files: DataFrame) -> DataFrame:
    """Files of a known language outside skipped directories, with their language."""
    return files.filter(~scalars.skipped(F.col("path"))).withColumn("lang", scalars.language(F.col("path"))).filter(F.col("lang").isNotNull())


def lines(files: DataFrame) -> DataFrame:
    """(path, line, content) with lines from 1; a newline at the end does not begin another line."""
    text = F.regexp_replace("text", r"\n\z", "")
    return files.filter(F.coalesce(F.length("text"), F.lit(0)) > 0).select("path", F.posexplode(F.split(text, "\n")).alias("__i", "content")).select("path", (F.col("__i") + 1).alias("line"), "content")


def line_window(files: DataFrame, start: int, end: int, most: int = 100, budget: int = 8192) -> DataFrame:
    """Lines start..end of each file, ``most`` at most and within ``budget`` bytes; ``next_cursor`` is where reading goes on, or null."""
    if start < 1 or end < start:
        raise ValueError("a window needs 1 <= start <= end")
    end = min(end, start + most - 1)
    w = Window.partitionBy("path").orderBy("line")
    text = F.regexp_replace("text", r"\n\z", "")
    cut = files.filter(F.coalesce(F.length("text"), F.lit(0)) > 0).withColumn("__all", F.split(text, "\n"))
    cut = cut.select("path", F.size("__all").alias("__total"), F.posexplode(F.slice("__all", start, end - start + 1)).alias("__i", "content"))
    d = cut.select("path", "__total", (F.col("__i") + start).alias("line"), "content").withColumn("__spent", F.sum(F.octet_length("content") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.filter(F.col("__spent") <= budget).withColumn("__last", F.max("line").over(Window.partitionBy("path")))
    return d.select("path", "line", "content", F.when(F.col("__last") < F.col("__total"), F.col("__last") + 1).alias("next_cursor"))


def _glob(pattern: str) -> str:
    """The regular expression of a name pattern with ``*``, ``?`` and ``[...]``, as shells read it."""
    import fnmatch

    return "^" + fnmatch.translate(pattern)


def listed(files: DataFrame, folder: str, cap: int = 200, pattern: str | None = None) -> DataFrame:
    """Entries of a folder: directories first, then by case-folded name; with ``pattern``, entries whose name it matches."""
    head = folder.rstrip("/") + "/" if folder else ""
    rest = F.substring(F.col("path"), len(head) + 1, 1 << 30)
    name = F.split(rest, "/")[0]
    d = files.filter(F.col("path").startswith(head)).select(name.alias("name"), rest.contains("/").alias("is_dir")).distinct()
    d = d if pattern is None else d.filter(F.col("name").rlike(_glob(pattern)))
    return d.orderBy(F.desc("is_dir"), F.lower("name"), "name").limit(cap)


def searched(files: DataFrame, pattern: str, regex: bool = False, limit: int | None = None) -> DataFrame:
    """(path, line, col, preview): a row per match; case matters only if the pattern has an upper-case letter.

    One matcher, the JVM's with Unicode case folding and classes, finds lines, matches and columns: a line is split at its
    matches, and a match starts after the pieces and matches before it. Patterns that match nothing at all are refused.
    """
    import re

    if regex and re.search(r"\(\?<?[=!]|\\[1-9]", pattern):
        raise ValueError("look-around and back references are not supported")
    if regex and any(m.start() == m.end() for text in ("", "a b") for m in re.finditer(pattern, text)) or not pattern:
        raise ValueError("a pattern must not match the empty string")
    body = pattern if regex else "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    letters = re.sub(r"\\.", "", pattern) if regex else pattern
    rx = ("(?U)" if any(c.isupper() for c in letters) else "(?iU)") + "(" + body + ")"
    hit = lines(files).filter(F.col("content").rlike(rx))
    hit = hit.withColumn("__p", F.split("content", rx, -1)).withColumn("__m", F.regexp_extract_all("content", F.lit(rx), F.lit(0)))
    size = lambda a, k: F.aggregate(F.slice(a, 1, k), F.lit(0), lambda n, x: n + F.length(x))
    starts = F.transform(F.sequence(F.lit(1), F.size("__m")), lambda k: size("__p", k) + size("__m", k - 1) + 1)
    d = hit.filter(F.size("__m") > 0).select("path", "line", F.explode(starts).alias("col"), F.substring("content", 1, 120).alias("preview"))
    return d.orderBy("path", "line", "col").limit(limit) if limit else d


def rationale_comments(comments: DataFrame) -> DataFrame:
    """(path, line, text, label) of the comments that give reasons. ``comments`` (path, line, lang, text): whole comments as written."""
    hit = comments.select("path", "line", scalars.rationale_match(F.col("text"), F.col("lang")).alias("__r")).filter("__r is not null")
    return hit.select("path", (F.col("line") + F.col("__r.offset")).alias("line"), F.col("__r.text").alias("text"), F.col("__r.label").alias("label"))


def rationale(files: DataFrame) -> DataFrame:
    """Rationale comments of files (path, lang, text): each line that is a comment, or inside a block, counts as one."""
    d = lines(files.select("path", "text")).join(files.select("path", "lang").distinct(), "path")
    return rationale_comments(d.filter(F.trim("content").rlike(r"^(#|//|/?\*)")).select("path", "line", "lang", F.col("content").alias("text")))


def _folding() -> tuple[str, str]:
    """Characters and what they become: letters with a canonical decomposition into a letter and marks become that letter in lower case; the marks that are left go."""
    plain, marks = {}, []
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Mn":
            marks.append(c)
        elif kind[0] == "L" and (d := unicodedata.normalize("NFD", c)) != c and all(unicodedata.category(x) == "Mn" for x in d[1:]):
            plain[c] = d[0].lower()
    return "".join(plain) + "".join(marks), "".join(plain.values())


_FOLDED = _folding()


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and private-use characters; letters with diacritics count as plain ones, combining marks are left out."""
    plain = F.translate(F.lower(text), *_FOLDED)
    return F.filter(F.split(plain, r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, top: int = 100) -> DataFrame:
    """(query_id, doc_id, rank, score) of the best documents of each query (query_id, query): lower is better, as a negated BM25; ties by doc_id.

    The queries' terms are indexed and searched, see :mod:`loomgraph.operators.index`.
    """
    from loomgraph.operators import index

    asked = queries.select(F.explode(tokens(F.col("query"))).alias("term")).distinct()
    return index.search(index.build(docs, asked, k1=k1, b=b), queries, top)


def phrase(docs: DataFrame, query: str) -> DataFrame:
    """(doc_id, n): documents that hold the query's tokens one after another, and how often; from an index of these tokens' positions."""
    from loomgraph.operators import index

    words = docs.sparkSession.range(1).select(tokens(F.lit(query))).first()[0]
    if not words:
        return docs.select("doc_id", F.lit(0).cast("long").alias("n")).limit(0)
    return index.phrase(index.build(docs, sorted(set(words)), positions=True), words)


def tiered(docs: DataFrame, queries: DataFrame, exact: list[tuple[str, str]], ranked: DataFrame, top: int = 100) -> DataFrame:
    """Retrieval order: exact tiers first (each ordered by doc_id, without what an earlier tier has), then BM25.

    ``exact`` lists (document column, query column); ``ranked`` is the result of :func:`bm25`.
    """
    found = None
    for t, (dc, qc) in enumerate(exact):
        hit = queries.join(docs, F.col(dc) == F.col(qc)).select("query_id", "doc_id", F.lit(t).alias("tier"), F.lit(0.0).alias("score"))
        found = hit if found is None else found.unionByName(hit)
    last = ranked.select("query_id", "doc_id", F.lit(len(exact)).alias("tier"), "score")
    best = (found.unionByName(last) if found is not None else last).groupBy("query_id", "doc_id").agg(F.min(F.struct("tier", "score")).alias("b"))
    w = Window.partitionBy("query_id").orderBy("b.tier", F.round("b.score", 9), "doc_id")
    return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).select("query_id", "doc_id", F.col("b.tier").alias("tier"), "place")


def diversified(atoms: DataFrame, most: int = 128) -> DataFrame:
    """(query_id, atom_id, place): the best exact definition first, then round-robin over paths, inside a path over owners.

    ``atoms`` (query_id, atom_id, rank, path, owner, exact); ids are a query's own, and rank and id order it. Every round takes
    one atom from each path that has some left, paths by the best of these. A path's owners take turns in the order of their
    best atoms. At most ``most`` atoms of a query take part, the best by rank.
    """
    best = Window.partitionBy("query_id").orderBy("rank", "atom_id")
    d = atoms.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= most)
    anchor = F.min(F.when(F.col("exact"), F.col("__n"))).over(Window.partitionBy("query_id"))
    d = d.withColumn("__first", F.coalesce(F.col("__n") == anchor, F.lit(False)))
    # the anchor is no part of the rounds
    own, path = ["query_id", "__first", "path", "owner"], ["query_id", "__first", "path"]
    d = d.withColumn("__k", F.row_number().over(Window.partitionBy(*own).orderBy("__n"))).withColumn("__o", F.min("__n").over(Window.partitionBy(*own)))
    turns = Window.partitionBy(*path).orderBy("__k", "__o")
    d = d.withColumn("__turn", F.row_number().over(turns)).withColumn("__left", F.min("__n").over(turns.rowsBetween(0, Window.unboundedFollowing)))
    order = Window.partitionBy("query_id").orderBy(F.desc("__first"), "__turn", "__left")
    return d.select("query_id", "atom_id", F.row_number().over(order).alias("place"))
