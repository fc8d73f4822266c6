"""Readers of external evidence. Formats that Spark parses stay in the JVM; the others run one Python parser per file.

Every reader takes a DataFrame of (path, content or text) rows, so files come from any store that Spark reads. A document that
does not parse gives a row with ``reason`` and nothing else; it never stops the job.
"""

from __future__ import annotations

import ast
import hashlib
import io
import json
import re
import tomllib
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars


def _per_file(files: DataFrame, column: str, schema: str, parse: Callable[[str, object], list[tuple]]) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for path, value in zip(b["path"], b[column], strict=True):
                rows += parse(path, value)
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", column).mapInPandas(run, schema)


# JSON formats, parsed by Spark

_COVERAGE = "struct<meta: struct<format: int>, files: map<string, struct<contexts: map<string, array<string>>>>>"


def coverage_json(files: DataFrame) -> DataFrame:
    """(run, test, path, line, phase) of coverage.py JSON reports with contexts ``nodeid|phase``; an empty context is unattributed (null test)."""
    d = files.select(F.col("path").alias("run"), F.from_json("text", _COVERAGE).alias("r"))
    d = d.select("run", F.explode("r.files").alias("path", "f")).select("run", "path", F.explode("f.contexts").alias("line", "ctx"))
    d = d.select("run", "path", F.col("line").cast("long").alias("line"), F.explode("ctx").alias("c"))
    test = F.substring_index("c", "|", 1)
    return d.select("run", F.when(test != "", test).alias("test"), "path", "line", F.when(F.col("c").contains("|"), F.substring_index("c", "|", -1)).alias("phase"))


_OTLP = "struct<resourceSpans: array<struct<scopeSpans: array<struct<spans: array<struct<traceId: string, spanId: string, parentSpanId: string, name: string, startTimeUnixNano: string, endTimeUnixNano: string, attributes: array<struct<key: string, value: struct<stringValue: string, intValue: string>>>>>>>>>>"


def otlp_json(files: DataFrame) -> DataFrame:
    """(artifact, trace_id, span_id, parent_id, name, start_nano, end_nano, attributes) of OTLP JSON; nanoseconds are DECIMAL(20,0)."""
    d = files.select(F.col("path").alias("artifact"), F.from_json("text", _OTLP).alias("r"))
    d = d.select("artifact", F.explode("r.resourceSpans").alias("a")).select("artifact", F.explode("a.scopeSpans").alias("b")).select("artifact", F.explode("b.spans").alias("s"))
    attrs = F.map_from_entries(F.transform("s.attributes", lambda x: F.struct(x["key"], F.coalesce(x["value"]["stringValue"], x["value"]["intValue"]))))
    parent = F.col("s.parentSpanId")
    return d.select("artifact", F.col("s.traceId").alias("trace_id"), F.col("s.spanId").alias("span_id"), F.when(parent != "", parent).alias("parent_id"), F.col("s.name").alias("name"), F.col("s.startTimeUnixNano").cast("decimal(20,0)").alias("start_nano"), F.col("s.endTimeUnixNano").cast("decimal(20,0)").alias("end_nano"), attrs.alias("attributes"))


_RULES = "struct<format: int, rules: array<struct<id: string, description: string, relation: string, `from`: array<string>, `to`: array<string>>>>"


def rule_documents(files: DataFrame) -> DataFrame:
    """(path, rule_id, relation, sources, targets, reason) of architecture rules; a closed set of reasons for refusal."""
    d = files.select("path", F.from_json("text", _RULES).alias("r"), "text")
    d = d.select("path", "r", F.posexplode_outer("r.rules").alias("pos", "rule"))
    selector = lambda s: ~s.rlike(r"^(\*\*|[^*]+/\*\*?|[^*]+)$") | s.startswith("/") | s.rlike(r"(^|/)\.\.?(/|$)|//")
    reason = (
        F.when(F.col("r").isNull() | F.col("r.rules").isNull(), "not_a_rule_document")
        .when(F.coalesce("r.format", F.lit(-1)) != 1, "unsupported_format")
        .when(F.coalesce("rule.id", F.lit("")) == "", "missing_id")
        .when(F.coalesce("rule.relation", F.lit("")) != "import", "unsupported_relation")
        .when((F.coalesce(F.size("rule.from"), F.lit(0)) <= 0) | (F.coalesce(F.size("rule.to"), F.lit(0)) <= 0), "empty_selector")
        .when(F.exists("rule.from", selector) | F.exists("rule.to", selector), "invalid_selector")
    )
    return d.select("path", F.col("rule.id").alias("rule_id"), F.col("rule.relation").alias("relation"), F.col("rule.from").alias("sources"), F.col("rule.to").alias("targets"), reason.alias("reason"))


_SHA = r"^[0-9a-f]{64}$"
_DECISIONS = "struct<format: int, mappings: array<struct<mapping_id: string, decision_id: string, document: struct<path: string, sha256: string>, span: struct<start_byte: bigint, end_byte: bigint, sha256: string>, target: struct<entity_id: string, path: string, kind: string, name: string>>>>"


def decision_mappings(files: DataFrame) -> DataFrame:
    """(file, mapping_id, decision_id, path, sha, start, stop, span_sha, entity_id, target_path, target_kind, target_name, reason) of
    documents that tie spans of decision records to declarations.

    Reasons: not_a_mapping_document, unsupported_format, missing_id, duplicate_mapping (an id that the document holds twice),
    unsafe_path, invalid_span, malformed_digest, missing_target.
    """
    d = files.select(F.col("path").alias("file"), F.from_json("text", _DECISIONS).alias("r")).select("file", "r", F.posexplode_outer("r.mappings").alias("pos", "m"))
    twice = F.count(F.lit(1)).over(Window.partitionBy("file", "m.mapping_id")) > 1  # a document's own entries
    text = lambda c: F.coalesce(c, F.lit("")) != ""
    reason = (
        F.when(F.col("r").isNull() | F.col("r.mappings").isNull(), "not_a_mapping_document")
        .when(F.coalesce("r.format", F.lit(-1)) != 1, "unsupported_format")
        .when(~text(F.col("m.mapping_id")) | ~text(F.col("m.decision_id")), "missing_id")
        .when(twice, "duplicate_mapping")
        .when(~F.coalesce(scalars.relative_path(F.col("m.document.path")) & scalars.relative_path(F.col("m.target.path")), F.lit(False)), "unsafe_path")
        .when(~F.coalesce((F.col("m.span.start_byte") >= 0) & (F.col("m.span.start_byte") < F.col("m.span.end_byte")), F.lit(False)), "invalid_span")
        .when(~F.coalesce(F.col("m.document.sha256").rlike(_SHA) & F.col("m.span.sha256").rlike(_SHA), F.lit(False)), "malformed_digest")
        .when(~text(F.col("m.target.kind")) | ~text(F.col("m.target.name")), "missing_target")
    )
    names = {"mapping_id": "m.mapping_id", "decision_id": "m.decision_id", "path": "m.document.path", "sha": "m.document.sha256", "start": "m.span.start_byte", "stop": "m.span.end_byte", "span_sha": "m.span.sha256",
             "entity_id": "m.target.entity_id", "target_path": "m.target.path", "target_kind": "m.target.kind", "target_name": "m.target.name"}
    return d.withColumn("reason", reason).select("file", *[F.col(c).alias(n) for n, c in names.items()], "reason")


_PACKAGES = "struct<format: int, repositories: array<string>, consumer: struct<lock_sha256: string, environment: string>, packages: array<struct<coordinate: string, package_snapshot_sha256: string, source_prefix: string>>>"


def package_mappings(files: DataFrame) -> DataFrame:
    """(file, lock_sha256, environment, coordinate, package_sha256, source_prefix, reason) of documents that tie a consumer's locked
    packages to provider snapshots.

    Reasons: not_a_mapping_document, unsupported_format, missing_consumer, missing_coordinate, duplicate_coordinate,
    malformed_digest, unsafe_prefix (empty, or a relative folder that ends in a slash, is safe).
    """
    d = files.select(F.col("path").alias("file"), F.from_json("text", _PACKAGES).alias("r")).select("file", "r", F.explode_outer("r.packages").alias("p"))
    twice = F.count(F.lit(1)).over(Window.partitionBy("file", "p.coordinate")) > 1
    prefix = F.col("p.source_prefix")
    reason = (
        F.when(F.col("r").isNull() | F.col("r.packages").isNull(), "not_a_mapping_document")
        .when(F.coalesce("r.format", F.lit(-1)) != 1, "unsupported_format")
        .when(~F.coalesce(F.col("r.consumer.lock_sha256").rlike(_SHA), F.lit(False)) | F.col("r.consumer.environment").isNull(), "missing_consumer")
        .when(F.coalesce("p.coordinate", F.lit("")) == "", "missing_coordinate")
        .when(twice, "duplicate_coordinate")
        .when(~F.coalesce(F.col("p.package_snapshot_sha256").rlike(_SHA), F.lit(False)), "malformed_digest")
        .when(~F.coalesce((prefix == "") | (prefix.endswith("/") & scalars.relative_path(F.regexp_replace(prefix, "/$", ""))), F.lit(False)), "unsafe_prefix")
    )
    return d.select("file", F.col("r.consumer.lock_sha256").alias("lock_sha256"), F.col("r.consumer.environment").alias("environment"), F.col("p.coordinate").alias("coordinate"), F.col("p.package_snapshot_sha256").alias("package_sha256"), prefix.alias("source_prefix"), reason.alias("reason"))


# Python parsers, one file at a time


#: Bounds of a table map.
_MAP_FORMAT, _MAP_BYTES, _MAP_ENTRIES, _TABLE_BYTES = "rails-table-map.v1", 1 << 20, 10_000, 64


def rails_table_map(files: DataFrame) -> DataFrame:
    """(path, sha256, model, table, reason) of operator documents ``{"format", "models": {"Class::Name": "table"}}``.

    A document is taken whole or refused whole: too_large, invalid_json (which duplicate keys and a byte order mark are too),
    unsupported_format, schema, too_many_entries, malformed_model or malformed_table.
    """

    def once(pairs: list[tuple]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a key occurs twice")
        return dict(pairs)

    def reason_of(raw: bytes) -> tuple[str | None, dict]:
        if len(raw) > _MAP_BYTES:
            return "too_large", {}
        try:
            doc = json.loads(raw.decode("utf-8"), object_pairs_hook=once)
        except (ValueError, RecursionError):
            return "invalid_json", {}
        if isinstance(doc, dict) and doc.get("format", _MAP_FORMAT) != _MAP_FORMAT:
            return "unsupported_format", {}
        if not isinstance(doc, dict) or set(doc) != {"format", "models"} or not isinstance(doc["models"], dict):
            return "schema", {}
        models = doc["models"]
        if len(models) > _MAP_ENTRIES:
            return "too_many_entries", {}
        for name, table in sorted(models.items()):
            if not re.fullmatch(r"[A-Z][A-Za-z0-9_]*(::[A-Z][A-Za-z0-9_]*)*", name):
                return "malformed_model", {}
            if not isinstance(table, str) or len(table) > _TABLE_BYTES or not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", table):
                return "malformed_table", {}
        return None, models

    def parse(path: str, text: str) -> list[tuple]:
        raw = (text or "").encode()
        reason, models = reason_of(raw)
        return [(path, hashlib.sha256(raw).hexdigest(), *kv, None) for kv in models.items()] if reason is None else [(path, None, None, None, reason)]

    return _per_file(files, "text", "path string, sha256 string, model string, table string, reason string", parse)


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces, non-ASCII kept; NaN is refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def junit_xml(files: DataFrame) -> DataFrame:
    """(path, classname, name, outcome, reason): passed without children, failed with one failure alone; all else, and every repeated
    case, is not objective."""

    def parse(path: str, text: str) -> list[tuple]:
        if re.search(r"<!(DOCTYPE|ENTITY)", text or ""):
            return [(path, None, None, None, "document_type_refused")]
        try:
            root = ET.fromstring(text or "")
        except ET.ParseError:
            return [(path, None, None, None, "not_xml")]
        out, seen = [], {}
        for case in root.iter("testcase"):
            kids = [k.tag for k in case if k.tag not in ("system-out", "system-err", "properties")]
            outcome = "passed" if not kids else "failed" if kids == ["failure"] else None
            key = (case.get("classname", ""), case.get("name", ""))
            seen[key] = seen.get(key, 0) + 1
            out.append((path, *key, outcome, None if outcome else "outcome_not_objective"))
        return [(p, c, n, None, "outcome_not_objective") if seen[c, n] > 1 else (p, c, n, o, r) for p, c, n, o, r in out]

    return _per_file(files, "text", "path string, classname string, name string, outcome string, reason string", parse)


def node_id(selector: str) -> tuple[str, str]:
    """(classname, name) under which a JUnit report lists ``a/b.py::C::m[p]``."""
    path, *rest = selector.split("::")
    return ".".join([path.removesuffix(".py").replace("/", "."), *rest[:-1]]), rest[-1] if rest else ""


def unified_diff(text: str) -> list[dict]:
    """Files of a unified diff: {old, new, hunks: [(start, lines)]}; lines keep their sign. ValueError if it is not one."""
    out: list[dict] = []
    lines = text.split("\n")
    i = 0
    while i < len(lines):
        if lines[i].startswith("--- ") and i + 1 < len(lines) and lines[i + 1].startswith("+++ "):
            name = lambda s: None if s == "/dev/null" else re.sub(r"^[ab]/", "", s.split("\t")[0])
            old, new = name(lines[i][4:]), name(lines[i + 1][4:])
            for n in (old, new):
                if n and (n.startswith("/") or ".." in n.split("/")):
                    raise ValueError("unsafe_path")
            out.append({"old": old, "new": new, "hunks": []})
            i += 2
        elif m := re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", lines[i]):
            if not out:
                raise ValueError("hunk_without_file")
            left, right = int(m[2] or 1), int(m[4] or 1)
            body: list[str] = []
            i += 1
            while left > 0 or right > 0:
                if i >= len(lines) or lines[i][:1] not in (" ", "-", "+", "\\"):
                    raise ValueError("truncated_hunk")
                sign = lines[i][:1]
                if sign != "\\":
                    body.append(lines[i])
                    left -= sign in " -"
                    right -= sign in " +"
                i += 1
            out[-1]["hunks"].append((int(m[1]), body))
        elif lines[i].startswith(("Binary files", "GIT binary patch")):
            raise ValueError("binary_patch")
        else:
            i += 1
    return out


def patched(text: str, hunks: list[tuple[int, list[str]]]) -> str:
    """The text after exact application of the hunks; ValueError if a context or removed line differs."""
    lines, out, at = text.split("\n"), [], 0
    for start, body in hunks:
        begin = max(start - 1, 0)
        if begin < at:
            raise ValueError("overlapping_hunks")
        out += lines[at:begin]
        at = begin
        for line in body:
            if line[0] in " -":
                if at >= len(lines) or lines[at] != line[1:]:
                    raise ValueError("context_mismatch")
                at += 1
            if line[0] in " +":
                out.append(line[1:])
    return "\n".join(out + lines[at:])


def counterfactual(files: DataFrame, diff: str) -> DataFrame:
    """(path, text) after a patch: files that it does not name pass through; removed ones go, new ones come."""
    changes = unified_diff(diff)
    spark = files.sparkSession
    named = spark.createDataFrame([(c["old"], c["new"], json.dumps(c["hunks"])) for c in changes], "old string, new string, hunks string")
    new = named.filter("old is null").select(F.col("new").alias("path"), F.lit("").alias("text"), "hunks")
    old = files.select("path", "text").join(named.filter("old is not null").withColumnRenamed("old", "path"), "path").filter("new is not null").select(F.col("new").alias("path"), "text", "hunks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [patched(t, json.loads(h)) for t, h in zip(b["text"], b["hunks"], strict=True)]})

    return files.select("path", "text").join(named.select(F.col("old").alias("path")), "path", "left_anti").unionByName(old.unionByName(new).mapInPandas(run, "path string, text string"))


def normal_name(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name.lower())


def version_key(version: str) -> tuple:
    return tuple(int(x) if x.isdigit() else x for x in re.findall(r"\d+|[a-z]+", version.lower()))


def marker(text: str, environment: dict[str, str]) -> bool:
    """Truth of a PEP 508 marker with and, or, parentheses, comparisons and in."""
    tokens = re.findall(r"\(|\)|'[^']*'|\"[^\"]*\"|<=|>=|==|!=|~=|<|>|not\s+in|[A-Za-z_]\w*", text)
    at = 0

    def value() -> str:
        nonlocal at
        t = tokens[at]
        at += 1
        return t[1:-1] if t[0] in "'\"" else environment[t]

    def compare() -> bool:
        nonlocal at
        if tokens[at] == "(":
            at += 1
            out = either()
            at += 1
            return out
        version = "version" in tokens[at] or at + 2 < len(tokens) and "version" in tokens[at + 2]
        a = value()
        op = re.sub(r"\s+", " ", tokens[at])
        at += 1
        b = value()
        if op in ("in", "not in"):
            return (a in b) == (op == "in")
        x, y = (version_key(a), version_key(b)) if version else (a, b)
        if op == "~=":
            return x >= y and x[: len(y) - 1] == y[:-1]
        return {"==": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]

    def both() -> bool:
        nonlocal at
        out = compare()
        while at < len(tokens) and tokens[at] == "and":
            at += 1
            out = compare() and out
        return out

    def either() -> bool:
        nonlocal at
        out = both()
        while at < len(tokens) and tokens[at] == "or":
            at += 1
            out = both() or out
        return out

    return either()


def lock_packages(files: DataFrame) -> DataFrame:
    """(path, name, version, source, markers, wheels, reason) of lock files in TOML."""

    def parse(path: str, text: str) -> list[tuple]:
        try:
            doc = tomllib.loads(text or "")
        except tomllib.TOMLDecodeError:
            return [(path, None, None, None, None, None, "not_toml")]
        return [(path, normal_name(p["name"]), p.get("version"), next(iter(p.get("source", {})), None), p.get("resolution-markers"), [w.get("url", w.get("filename", "")) for w in p.get("wheels", [])], None) for p in doc.get("package", []) if "name" in p]

    return _per_file(files, "text", "path string, name string, version string, source string, markers array<string>, wheels array<string>, reason string", parse)


def select_package(rows: list[tuple], name: str, environment: dict[str, str]) -> tuple[tuple | None, str | None]:
    """(package row, reason) from rows of :func:`lock_packages` (without path): by normalised name; of several, the one whose marker holds."""
    found = [r for r in rows if r[0] == normal_name(name)]
    if not found:
        return None, "no_package"
    if len(found) > 1:
        if any(not r[3] for r in found):
            return None, "unmarked_variant"
        found = [r for r in found if any(marker(m, environment) for m in r[3])]
        if len(found) != 1:
            return None, "no_matching_variant" if not found else "multiple_matching_variants"
    row = found[0]
    if row[2] != "registry":
        return None, "not_from_a_registry"
    if not any(w.endswith("-none-any.whl") for w in row[4]):
        return None, "no_pure_wheel"
    return row, None


# declarations of Python sources


def declarations(source: str) -> tuple[list[tuple], list[tuple], list[tuple], str | None]:
    """(symbols, references, imports, failure): by the standard library's parser.

    symbols: (name, kind, owner, line_start, line_end); references: (callee, relation, qualifier, line, col, scopes innermost
    first); imports: (local name, level, module, name, line).
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as e:
        return [], [], [], f"parse_error:{getattr(e, 'lineno', None) or 0}"
    symbols, refs, imports = [], [], []

    def visit(node: ast.AST, owner: tuple[str, ...], inside: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                cls = isinstance(child, ast.ClassDef)
                kind = "class" if cls else "method" if inside == "class" else "function"
                symbols.append((child.name, kind, ".".join(owner), child.lineno, child.end_lineno))
                if cls:
                    for base in child.bases:
                        add(base, "superclass", owner)
                visit(child, (*owner, child.name), "class" if cls else "function")
                continue
            if isinstance(child, ast.Call):
                add(child.func, "call", owner)
            elif isinstance(child, ast.ImportFrom):
                imports.extend((a.asname or a.name, child.level, child.module or "", a.name, child.lineno) for a in child.names)
            elif isinstance(child, ast.Import):
                imports.extend(((a.asname or a.name.split(".")[0]), 0, a.name, None, child.lineno) for a in child.names)
            visit(child, owner, inside)

    def add(node: ast.AST, relation: str, owner: tuple[str, ...]) -> None:
        scopes = [".".join(owner[:k]) for k in range(len(owner), -1, -1)]
        if isinstance(node, ast.Name):
            refs.append((node.id, relation, None, node.lineno, node.col_offset, scopes))
        elif isinstance(node, ast.Attribute):
            refs.append((node.attr, relation, node.value.id if isinstance(node.value, ast.Name) else "?", node.lineno, node.col_offset, scopes))

    visit(tree, (), "module")
    return symbols, refs, imports, None


_FACTS = "path string, fact string, name string, kind string, owner string, line_start int, line_end int, qualifier string, col int, level int, module string, scopes array<string>, reason string"


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of Python files, one row each (fact: symbol, ref, import or failed). A file that does not parse gives its failure alone."""

    def parse(path: str, text: str) -> list[tuple]:
        s, r, i, failure = declarations(text or "")
        if failure:
            return [(path, "failed", None, None, None, None, None, None, None, None, None, None, failure)]
        out = [(path, "symbol", n, k, o, a, b, None, None, None, None, None, None) for n, k, o, a, b in s]
        out += [(path, "ref", n, k, None, a, None, q, c, None, None, sc, None) for n, k, q, a, c, sc in r]
        return out + [(path, "import", local, None, None, line, None, name, None, level, module, None, None) for local, level, module, name, line in i]

    return _per_file(files, "text", _FACTS, parse)


def fingerprints(source: str) -> list[tuple[str, str, str]]:
    """(owner.name, signature, body) of each declaration with formatting and comments gone."""
    out = []

    def visit(node: ast.AST, owner: tuple[str, ...]) -> None:
        for c in ast.iter_child_nodes(node):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                body = "\n".join(ast.unparse(x) if not isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else f"<decl {type(x).__name__} {x.name}>" for x in c.body)
                head = type(c)(**{f: getattr(c, f, None) for f in c._fields} | {"name": "_", "body": [ast.Pass()]})
                out.append((".".join((*owner, c.name)), ast.unparse(ast.fix_missing_locations(ast.copy_location(head, c))), body))
                visit(c, (*owner, c.name))

    visit(ast.parse(source), ())
    return out


def wheel_declarations(files: DataFrame) -> DataFrame:
    """(path, module, name, kind, exported, reason): top-level declarations of the Python members of wheels; ``exported`` by a literal __all__."""

    def parse(path: str, raw: bytes) -> list[tuple]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(raw))
        except zipfile.BadZipFile:
            return [(path, None, None, None, None, "not_a_zip")]
        out: list[tuple] = []
        for member in sorted(archive.namelist()):
            if not member.endswith(".py") or member.startswith("/") or ".." in member.split("/"):
                continue
            module = re.sub(r"(^|\.)__init__$", "", member[:-3].replace("/", "."))
            try:
                tree = ast.parse(archive.read(member))
            except (SyntaxError, ValueError):
                out.append((path, module, None, None, None, "parse_error"))
                continue
            listed = None
            for n in tree.body:
                if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets):
                    try:
                        listed = set(ast.literal_eval(n.value))
                    except (ValueError, TypeError):
                        listed = None
            for n in tree.body:
                if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    out.append((path, module, n.name, "class" if isinstance(n, ast.ClassDef) else "function", None if listed is None else n.name in listed, None))
        return out

    return _per_file(files, "content", "path string, module string, name string, kind string, exported boolean, reason string", parse)


# OpenAPI


def openapi_operations(text: str) -> list[tuple]:
    """(path, method, required parameter keys, digest, complete) of an OpenAPI 3.1 document; references are followed, cycles included."""
    doc = json.loads(text)
    if not str(doc.get("openapi", "")).startswith("3.1"):
        raise ValueError("unsupported_version")

    def pointer(ref: str):
        node = doc
        for part in ref.removeprefix("#/").split("/"):
            node = node[part.replace("~1", "/").replace("~0", "~")]
        return node

    def closed(node, seen: frozenset, lost: list):
        if isinstance(node, dict):
            ref = node.get("$ref")
            if isinstance(ref, str):
                if ref in seen:
                    return {"$cycle": ref}
                try:
                    return closed(pointer(ref) if ref.startswith("#/") else {}[ref], seen | {ref}, lost)
                except (KeyError, TypeError, IndexError):
                    lost.append(ref)
                    return {"$lost": ref}
            return {k: closed(v, seen, lost) for k, v in node.items() if k not in ("description", "summary", "example", "examples")}
        return [closed(x, seen, lost) for x in node] if isinstance(node, list) else node

    import hashlib

    out = []
    for path, item in doc.get("paths", {}).items():
        names = re.findall(r"\{([^}]+)\}", path)
        shared = item.get("parameters", [])
        for method in ("get", "put", "post", "delete", "options", "head", "patch", "trace"):
            if method not in item:
                continue
            lost: list = []
            op = closed(item[method], frozenset(), lost)
            required = set()
            for p in closed(shared, frozenset(), lost) + op.get("parameters", []):
                where, name = p.get("in"), p.get("name", "")
                if where == "header" and name.lower() in ("accept", "content-type", "authorization"):
                    continue
                if p.get("required"):
                    required.add(f"path:{names.index(name)}" if where == "path" and name in names else f"{where}:{name.lower() if where == 'header' else name}")
            out.append((re.sub(r"\{[^}]+\}", "{}", path), method.upper(), sorted(required), hashlib.sha256(canonical(op).encode()).hexdigest(), not lost))
    return out


def openapi_json(files: DataFrame) -> DataFrame:
    """(file, path, method, required, digest, complete, reason) of OpenAPI documents."""

    def parse(path: str, text: str) -> list[tuple]:
        try:
            return [(path, *op, None) for op in openapi_operations(text)]
        except (ValueError, AttributeError, TypeError) as e:
            return [(path, None, None, None, None, None, str(e) if str(e) == "unsupported_version" else "not_openapi")]

    schema = "file string, path string, method string, required array<string>, digest string, complete boolean, reason string"
    return _per_file(files, "text", schema, parse)


# SCIP (protocol buffers)


def wire(raw: bytes) -> Iterator[tuple[int, int, object]]:
    """(field, wire type, value) of a protocol-buffer message; ValueError if it is cut short."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            if at >= len(raw) or shift > 63:
                raise ValueError("malformed_varint")
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, 0, varint()
        elif kind in (1, 5, 2):
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            if at + n > len(raw):
                raise ValueError("truncated_field")
            yield tag >> 3, kind, raw[at : at + n]
            at += n
        else:
            raise ValueError("unsupported_wire_type")


def _packed(value: object) -> list[int]:
    if isinstance(value, int):
        return [value]
    out, cur, shift = [], 0, 0
    for b in value:
        cur |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(cur)
            cur = shift = 0
    return out


def scip_occurrences(files: DataFrame) -> DataFrame:
    """(index, document, symbol, line, col, is_definition, end_line, end_col, encoding, reason) of SCIP indexes; local symbols are
    keyed by their document. Lines count from 1, columns from 0 in units of the document's encoding (utf8, utf16, utf32, or null
    where the index does not say)."""

    def parse(path: str, raw: bytes) -> list[tuple]:
        try:
            out = []
            for field, _, doc in wire(raw):
                if field != 2:
                    continue
                parts = list(wire(doc))
                name = next(bytes(v).decode() for f, _, v in parts if f == 1)
                encoding = {1: "utf8", 2: "utf16", 3: "utf32"}.get(next((v for f, _, v in parts if f == 6), 0))
                for f, _, occ in parts:
                    if f != 2:
                        continue
                    where: list[int] = []
                    symbol, roles = "", 0
                    for g, _, v in wire(occ):
                        if g == 1:
                            where += _packed(v)
                        elif g == 2:
                            symbol = bytes(v).decode()
                        elif g == 3:
                            roles = v
                    if symbol.startswith("local "):
                        symbol = f"{name}:{symbol}"
                    end = where[2:] if len(where) > 3 else [where[0], where[2]] if len(where) == 3 else where[:2]
                    out.append((path, name, symbol, where[0] + 1, where[1], bool(roles & 1), end[0] + 1, end[1], encoding, None))
            return out
        except (ValueError, UnicodeDecodeError, StopIteration, IndexError) as e:
            return [(path, None, None, None, None, None, None, None, None, str(e) or "malformed_index")]

    return _per_file(files, "content", "index string, document string, symbol string, line int, col int, is_definition boolean, end_line int, end_col int, encoding string, reason string", parse)


#: What ends a line for the producers of SCIP indexes.
_SCIP_LINES = re.compile("\r\n|[\n\r\u2028\u2029]")


def scip_byte_ranges(occurrences: DataFrame, files: DataFrame, digests: DataFrame, encoding: str | None = None) -> DataFrame:
    """(document, symbol, is_definition, line, start_byte, end_byte, reason): occurrences as byte ranges of the sources.

    ``files`` (path, text); ``digests`` (path, sha256): the bytes that the index was made of. ``encoding`` stands in where a
    document names none. Reasons: document_missing, digest_mismatch, unsupported_encoding, position_out_of_line and
    position_not_on_boundary. A file and its occurrences meet in one task; files are read once.
    """

    def column(segment: str, at: int, code: str) -> int | str:
        if code == "utf32":
            return len(segment[:at].encode()) if at <= len(segment) else "position_out_of_line"
        raw = segment.encode("utf-8" if code == "utf8" else "utf-16-le")
        cut = at if code == "utf8" else 2 * at
        if cut > len(raw):
            return "position_out_of_line"
        try:
            return len(raw[:cut].decode("utf-8" if code == "utf8" else "utf-16-le").encode())
        except UnicodeDecodeError:
            return "position_not_on_boundary"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        text = None if right.empty else right["text"].iloc[0] or ""
        agreed = not right.empty and right["sha256"].iloc[0] == hashlib.sha256(text.encode()).hexdigest()
        starts, ends, offset = [0], [], []
        body, mark = (text[1:], 3) if text and text[0] == "\ufeff" else (text or "", 0)
        for m in _SCIP_LINES.finditer(body):
            ends.append(m.start())
            starts.append(m.end())
        ends.append(len(body))
        for a, b in zip(starts, [*starts[1:], len(body)], strict=True):
            offset.append(mark)
            mark += len(body[a:b].encode())

        def byte(line: int, at: int, code: str) -> int | str:
            if line > len(starts):
                return "position_out_of_line"
            found = column(body[starts[line - 1] : ends[line - 1]], at, code)
            return found if isinstance(found, str) else offset[line - 1] + found

        rows = []
        for r in left.itertuples():
            code = r.encoding or encoding
            why = "document_missing" if text is None else "digest_mismatch" if not agreed else "unsupported_encoding" if code not in ("utf8", "utf16", "utf32") else None
            ends_ = (None, None) if why else (byte(int(r.line), int(r.col), code), byte(int(r.end_line), int(r.end_col), code))
            why = why or next((x for x in ends_ if isinstance(x, str)), None)
            rows.append((r.document, r.symbol, r.is_definition, r.line, *((None, None) if why else ends_), why))
        out = pd.DataFrame(rows, columns=["document", "symbol", "is_definition", "line", "start_byte", "end_byte", "reason"])
        return out.astype({"start_byte": "Int64", "end_byte": "Int64"})

    ok = occurrences.filter("reason is null").select("document", "symbol", "is_definition", "line", "col", "end_line", "end_col", "encoding")
    named = files.join(digests.select("path", "sha256"), "path", "left").select(F.col("path").alias("document"), "text", "sha256").join(ok.select("document").distinct(), "document", "left_semi")
    return ok.groupBy("document").cogroup(named.groupBy("document")).applyInPandas(run, "document string, symbol string, is_definition boolean, line int, start_byte long, end_byte long, reason string")


def scip_references(occurrences: DataFrame) -> DataFrame:
    """References with the definitions of their symbol: none UNRESOLVED, one EXTRACTED, several AMBIGUOUS."""
    ok = occurrences.filter("reason is null")
    d = ok.filter("is_definition").groupBy("symbol").agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct("document", "line")).alias("__d"))
    r = ok.filter("not is_definition").join(d, "symbol", "left")
    tier = F.when(F.col("__n").isNull(), "UNRESOLVED").when(F.col("__n") == 1, "EXTRACTED").otherwise("AMBIGUOUS")
    return r.select("document", "line", "col", "symbol", tier.alias("confidence"), F.when(F.col("__n") == 1, F.col("__d.document")).alias("target_path"), F.when(F.col("__n") == 1, F.col("__d.line")).alias("target_line"))
