"""The query language: ``verb:argument`` strings over a set of fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import evidence, graph, lookup, resolve, text
from loomgraph.plans.paging import Pages, paged

VERBS = ("callers_of", "definitions_of", "subclasses_of", "god_nodes", "communities", "rationale")


class QueryError(ValueError):
    """A refused query; ``code`` and ``retry_hint`` say why and what may help."""

    def __init__(self, code: str, message: str, retry_hint: str = "none"):
        super().__init__(message)
        self.code, self.retry_hint = code, retry_hint


def parse(text: str) -> tuple[str, str]:
    """(verb, argument)."""
    verb, colon, argument = text.partition(":")
    if not colon:
        raise QueryError("INVALID_QUERY", "a query is verb:argument")
    if verb not in VERBS:
        raise QueryError("UNKNOWN_VERB", f"unknown verb {verb!r}", "different_tool")
    return verb, argument.strip()


class Engine:
    """Lazy queries over symbols, refs and, if there are any, rationale and assertions."""

    def __init__(self, symbols: DataFrame, refs: DataFrame, rationale: DataFrame | None = None, assertions: DataFrame | None = None):
        self.symbols, self.refs, self.rationale, self.assertions = symbols, refs, rationale, assertions
        self._edges: DataFrame | None = None

    @property
    def edges(self) -> DataFrame:
        if self._edges is None:
            self._edges = resolve.edges(self.refs, self.symbols)
        return self._edges

    def edges_to(self, name: str) -> DataFrame:
        """Edges of the references to one name; other references take no part in the binding."""
        return resolve.edges_for(self.refs.filter(F.col("callee_name") == name), self.symbols)

    def query(self, asked: str) -> DataFrame:
        verb, arg = parse(asked)
        if verb == "callers_of":
            return lookup.callers_of(self.edges_to(arg.rpartition("#")[2]), arg)
        if verb == "subclasses_of":
            return lookup.subclasses_of(self.edges_to(arg), arg)
        if verb == "definitions_of":
            s = lookup.search_symbol(self.symbols, arg).select(F.lit("symbol").alias("fact"), "path", F.col("line_start").cast("long").alias("line"), "name", "kind")
            r = lookup.references_to(self.refs, arg).select(F.lit("ref").alias("fact"), "path", F.col("line").cast("long").alias("line"), F.col("callee_name").alias("name"), F.col("relation").alias("kind"))
            return s.unionByName(r).orderBy("fact", "path", "line", "name", "kind")
        if verb == "god_nodes":
            return graph.degrees(self.edges, self.symbols)
        if verb == "communities":
            e = lookup.confident(self.edges).filter("target_path is not null and source_name is not null")
            key = lambda p, n: F.concat_ws("\0", p, n)
            links = e.select(key("source_path", "source_name").alias("a"), key("target_path", "target_name").alias("b"))
            return graph.communities(links.select(F.col("a").alias("node")).union(links.select("b")).distinct(), links)
        if self.rationale is None:
            raise QueryError("INVALID_QUERY", "no rationale facts were given")
        d = self.rationale if not arg else self.rationale.filter((F.col("label") == arg) | (F.col("path") == arg))
        return d.orderBy("path", "line", "text")

    def operation(self, op: str, **how) -> DataFrame:
        """Structured operations: status, retrieve, context, neighborhood, edges, outcome, path, impact.

        ``status`` counts the states of ``files`` (lang, state); ``retrieve`` and ``context`` rank ``documents`` for ``queries``;
        ``neighborhood``, ``edges`` and ``outcome`` are the three results of one bounded traversal.
        """
        if op == "status":
            return evidence.status(how["files"])
        if op == "retrieve":
            return text.tiered(how["documents"], how["queries"], how.get("exact", []), text.bm25(how["documents"], how["queries"]), how.get("top", 100))
        if op == "context":
            return evidence.context_pack(how["documents"], how["queries"], how.get("budget", 16_000))
        if self.assertions is None:
            raise QueryError("INVALID_QUERY", "no assertions were given")
        if op in ("neighborhood", "edges", "outcome"):
            return graph.traverse(self.assertions, **how)[("neighborhood", "edges", "outcome").index(op)]
        if op == "path":
            return graph.shortest_paths(self.assertions, **how)
        if op == "impact":
            return graph.impact(self.assertions, **how)
        raise QueryError("UNKNOWN_OPERATION", f"unknown operation {op!r}", "different_tool")

    @staticmethod
    def pages(df: DataFrame, order: list, size: int) -> Pages:
        """A result written once, in a total order, for reading page by page."""
        return paged(df, order, size)
