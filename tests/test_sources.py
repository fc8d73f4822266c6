"""Readers, the canonical export and streaming ingestion."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import overlays
from loomgraph.sources import jsonl, readers
from loomgraph.streaming import ingest
from loomgraph.streaming.retention import retained


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


def test_coverage_json(spark):
    doc = {"meta": {"format": 3}, "files": {"a.py": {"contexts": {"3": ["t.py::x|run", "t.py::x|setup", ""], "4": ["t.py::y|run"]}}}}
    d = readers.coverage_json(texts(spark, ("r", json.dumps(doc)), ("bad", "{")))
    assert {(r.test, r.line, r.phase) for r in d.collect()} == {("t.py::x", 3, "run"), ("t.py::x", 3, "setup"), (None, 3, None), ("t.py::y", 4, "run")}
    o = {(r.test, r.line): r.phases for r in overlays.observations(d).collect()}
    assert o["t.py::x", 3] == ["run", "setup"]


def test_otlp_json(spark):
    span = {"traceId": "t", "spanId": "b", "parentSpanId": "a", "name": "n", "startTimeUnixNano": "18446744073709551615", "endTimeUnixNano": "1", "attributes": [{"key": "code.filepath", "value": {"stringValue": "/app/x.py"}}, {"key": "code.lineno", "value": {"intValue": "7"}}]}
    r = readers.otlp_json(texts(spark, ("f", json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span]}]}]})))).first()
    assert (r.parent_id, int(r.start_nano), r.attributes["code.lineno"]) == ("a", 2**64 - 1, "7")


def test_rule_documents(spark):
    ok = {"format": 1, "rules": [{"id": "r", "relation": "import", "from": ["a/**"], "to": ["b"]}, {"id": "", "relation": "import", "from": ["a"], "to": ["b"]}, {"id": "x", "relation": "call", "from": ["a"], "to": ["b"]}, {"id": "y", "relation": "import", "from": [], "to": ["b"]}, {"id": "z", "relation": "import", "from": ["../a"], "to": ["b"]}]}
    d = readers.rule_documents(texts(spark, ("1", json.dumps(ok)), ("2", json.dumps({"format": 9, "rules": ok["rules"][:1]})), ("3", "{")))
    assert [r.reason for r in d.orderBy("path", "rule_id").collect() if r.path == "1"] == ["missing_id", None, "unsupported_relation", "empty_selector", "invalid_selector"]
    assert {r.path: r.reason for r in d.collect() if r.path != "1"} == {"2": "unsupported_format", "3": "not_a_rule_document"}


def test_rails_table_map(spark):
    doc = lambda **models: json.dumps({"format": "rails-table-map.v1", "models": models})
    rows = [("ok", json.dumps({"format": "rails-table-map.v1", "models": {"A::B": "a_bs", "C": "cs"}})), ("json", "{"), ("twice", '{"format": "rails-table-map.v1", "models": {"A": "x", "A": "y"}}'), ("bom", "\ufeff" + doc()),
            ("format", json.dumps({"format": "v9", "models": {}})), ("schema", json.dumps({"models": {}})), ("list", "[]"), ("model", doc(a="x")), ("table", doc(A="x y")), ("long", doc(A="x" * 65)), ("big", " " * (1 << 20) + doc()), ("null", None)]
    got = readers.rails_table_map(texts(spark, *rows)).collect()
    assert {(r.model, r.table) for r in got if r.reason is None} == {("A::B", "a_bs"), ("C", "cs")}
    assert {r.path: r.reason for r in got if r.reason} == {
        "json": "invalid_json", "twice": "invalid_json", "bom": "invalid_json", "format": "unsupported_format", "schema": "schema", "list": "schema", "model": "malformed_model", "table": "malformed_table", "long": "malformed_table",
        "big": "too_large", "null": "invalid_json",
    }


def test_junit(spark):
    xml = "<r><testcase classname='a.C' name='ok'/><testcase classname='a.C' name='no'><failure/></testcase><testcase classname='a.C' name='s'><skipped/></testcase><testcase classname='a.C' name='d'/><testcase classname='a.C' name='d'/></r>"
    d = readers.junit_xml(texts(spark, ("j", xml), ("bad", "<r"), ("dtd", "<!DOCTYPE x><r/>")))
    assert {(r.name, r.outcome, r.reason) for r in d.collect()} == {("ok", "passed", None), ("no", "failed", None), ("s", None, "outcome_not_objective"), ("d", None, "outcome_not_objective"), (None, None, "not_xml"), (None, None, "document_type_refused")}
    assert readers.node_id("a/b.py::C::m[p]") == ("a.b.C", "m[p]")


DIFF = "--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,3 @@\n a\n-b\n+B\n c\n--- /dev/null\n+++ b/new.py\n@@ -0,0 +1,1 @@\n+hi\n--- a/old.py\n+++ /dev/null\n@@ -1,1 +0,0 @@\n-z\n"


def test_counterfactual_patch(spark):
    got = dict(map(tuple, readers.counterfactual(texts(spark, ("x.py", "a\nb\nc\nd"), ("old.py", "z"), ("keep.py", "k")), DIFF).collect()))
    assert got == {"x.py": "a\nB\nc\nd", "new.py": "hi\n", "keep.py": "k"}
    for bad, why in (("--- a/../x\n+++ b/x\n", "unsafe_path"), ("@@ -1 +1 @@\n", "hunk_without_file"), ("--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n a\n", "truncated_hunk")):
        with pytest.raises(ValueError, match=why):
            readers.unified_diff(bad)
    with pytest.raises(ValueError, match="context_mismatch"):
        readers.patched("q", readers.unified_diff(DIFF)[0]["hunks"])


def test_lock_and_markers(spark):
    lock = '[[package]]\nname="My_Pkg"\nversion="1"\nsource={registry="u"}\nwheels=[{url="my-1-py3-none-any.whl"}]\n[[package]]\nname="two"\nversion="1"\nsource={registry="u"}\nresolution-markers=["python_version < \'3.9\'"]\nwheels=[{url="t-none-any.whl"}]\n[[package]]\nname="two"\nversion="2"\nsource={registry="u"}\nresolution-markers=["python_version >= \'3.9\'"]\nwheels=[{url="t-none-any.whl"}]\n'
    rows = [tuple(r)[1:6] for r in readers.lock_packages(texts(spark, ("uv.lock", lock))).collect()]
    env = {"python_version": "3.13", "sys_platform": "linux"}
    assert readers.select_package(rows, "my.pkg", env)[0][1] == "1"
    assert readers.select_package(rows, "two", env)[0][1] == "2"
    assert readers.select_package(rows, "none", env)[1] == "no_package"
    assert readers.marker("(sys_platform == 'linux' or sys_platform == 'x') and python_version != '3.8'", env)
    assert not readers.marker("python_version < '3.10'", env)


def test_python_facts_and_quarantine(spark):
    src = "from .b import f as g\nclass A(B):\n    def m(self):\n        return g(self.x())\n"
    d = readers.python_facts(texts(spark, ("a.py", src), ("bad.py", "def (")))
    rows = d.collect()
    assert {(r.name, r.kind, r.owner) for r in rows if r.fact == "symbol"} == {("A", "class", ""), ("m", "method", "A")}
    assert {(r.name, r.kind, r.qualifier) for r in rows if r.fact == "ref"} == {("B", "superclass", None), ("g", "call", None), ("x", "call", "self")}
    assert [(r.name, r.level, r.module, r.qualifier) for r in rows if r.fact == "import"] == [("g", 1, "b", "f")]
    assert [r.reason for r in rows if r.path == "bad.py"] == ["parse_error:1"]


def test_fingerprints_ignore_layout():
    a, b, c = (readers.fingerprints(s)[0] for s in ("def f(x):\n    return x+1\n", "def f( x ):  # c\n\n    return (x + 1)\n", "def f(x, y):\n    return x+1\n"))
    assert a == b and a[1] != c[1] and a[2] == c[2]


def test_wheel(spark):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("p/__init__.py", "__all__ = ['f']\ndef f(): pass\nclass G: pass\n")
        z.writestr("p/bad.py", "def (")
    d = readers.wheel_declarations(spark.createDataFrame([("w.whl", bytearray(buf.getvalue())), ("x", bytearray(b"no"))], "path string, content binary"))
    assert {(r.module, r.name, r.exported, r.reason) for r in d.collect()} == {("p", "f", True, None), ("p", "G", False, None), ("p.bad", None, None, "parse_error"), (None, None, None, "not_a_zip")}


def test_openapi(spark):
    def doc(required):
        return json.dumps({"openapi": "3.1.0", "components": {"schemas": {"N": {"properties": {"next": {"$ref": "#/components/schemas/N"}}}}}, "paths": {"/a/{id}": {"get": {"parameters": [{"in": "path", "name": "id", "required": True}, {"in": "query", "name": "q", "required": required}], "responses": {"200": {"schema": {"$ref": "#/components/schemas/N"}}}}}}})

    b, a = (readers.openapi_json(texts(spark, ("f", doc(x)))).filter("reason is null") for x in (False, True))
    assert a.first().required == ["path:0", "query:q"] and a.first().complete
    assert [tuple(r) for r in overlays.contract_changes(b, a).collect()] == [("/a/{}", "GET", "newly_required_parameter")]
    assert overlays.contract_changes(b, b).count() == 0
    assert readers.openapi_json(texts(spark, ("f", '{"openapi": "2.0"}'))).first().reason == "unsupported_version"


def message(*fields):
    out = b""
    for n, v in fields:
        if isinstance(v, int):
            out += bytes([n << 3, v])
        else:
            out += bytes([n << 3 | 2, len(v)]) + v
    return out


def test_scip(spark):
    occ = lambda line, symbol, roles: message((1, bytes([line, 2, 4])), (2, symbol), (3, roles))
    raw = message((2, message((1, b"a.py"), (2, occ(4, b"pkg/f().", 1)), (2, occ(9, b"pkg/f().", 0)), (2, occ(9, b"ext", 0)), (2, occ(1, b"local 1", 1)), (2, occ(2, b"local 1", 0)))))
    d = readers.scip_occurrences(spark.createDataFrame([("i", bytearray(raw)), ("bad", bytearray(b"\x12\x7f"))], "path string, content binary"))
    got = {(r.symbol, r.confidence, r.target_line) for r in readers.scip_references(d).collect()}
    assert got == {("pkg/f().", "EXTRACTED", 5), ("ext", "UNRESOLVED", None), ("a.py:local 1", "EXTRACTED", 2)}
    assert d.filter("reason is not null").first().reason == "truncated_field"


def test_export_and_import(spark, tmp_path):
    rec = spark.createDataFrame([("entity", '{"b": 1, "a": "é"}'), ("entity", '{"a":"x"}'), ("edge", "[1, 2]"), ("edge", "[1,2]")], "type string, payload string")
    jsonl.export(rec, str(tmp_path / "x"))
    back = jsonl.load(spark, str(tmp_path / "x"))
    assert sorted((r.type, r.payload) for r in back.collect()) == [("edge", "[1,2]"), ("entity", '{"a":"x"}'), ("entity", '{"a":"é","b":1}')]
    first, second = jsonl.header(jsonl.record_lines(rec.repartition(1))).first(), jsonl.header(jsonl.record_lines(rec.repartition(5))).first()
    assert first == second
    part = next(p for p in (tmp_path / "x/lines").glob("part*") if "x" in p.read_text())
    part.write_text(part.read_text().replace('"x"', '"y"'))
    for crc in (tmp_path / "x/lines").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="identity_mismatch"):
        jsonl.load(spark, str(tmp_path / "x"))


def test_streaming_ingest(spark, tmp_path):
    """Newer versions, late and repeated ones, removals and what comes after them, each in a run of its own that restarts the query."""
    schema = "path string, version int, deleted boolean, name string"
    src, table, ck = (str(tmp_path / x) for x in ("src", "table", "ck"))
    seen = []
    runs = [
        [("a", 1, False, "x"), ("a", 1, False, "x2"), ("b", 1, None, "y"), ("c", 5, False, "c5")],
        [("a", 2, False, "z"), ("c", 4, False, "late")],
        [("b", 2, True, None)],
        [("b", 1, False, "again"), ("a", 2, False, "repeated"), ("c", 5, False, "repeated")],
        [("b", 3, False, "back"), ("a", 3, False, "three"), ("a", 4, False, "four"), ("d", 1, True, None)],
        [("d", 0, False, "late"), ("c", 6, True, None)],
    ]
    want = [
        {("a", 1, "x"), ("a", 1, "x2"), ("b", 1, "y"), ("c", 5, "c5")},
        {("a", 2, "z"), ("b", 1, "y"), ("c", 5, "c5")},
        {("a", 2, "z"), ("c", 5, "c5")},
        {("a", 2, "z"), ("c", 5, "c5")},
        {("a", 4, "four"), ("b", 3, "back"), ("c", 5, "c5")},
        {("a", 4, "four"), ("b", 3, "back")},
    ]
    rows = lambda: {tuple(r) for r in ingest.table(spark, table, schema).select("path", "version", "name").collect()}
    assert rows() == set()
    for batch, there in zip(runs, want, strict=True):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        ingest.ingest(spark, src, schema, table, ck, lambda b: seen.append(b.count()), buckets=3).awaitTermination()
        assert rows() == there
    assert seen == [4, 1, 1, 3, 1]
    assert ingest.vacuum(spark, table, 1) and rows() == want[-1]


def test_a_batch_that_is_tried_again_changes_nothing(spark, tmp_path):
    schema = "path string, version int, deleted boolean, name string"
    src, table, ck = (str(tmp_path / x) for x in ("src", "table", "ck"))
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    put([("a", 1, False, "x"), ("b", 1, False, "y")])
    ingest.ingest(spark, src, schema, table, ck).awaitTermination()
    put([("a", 2, False, "z"), ("b", 2, True, None)])

    def fails(batch):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        ingest.ingest(spark, src, schema, table, ck, fails).awaitTermination()
    ingest.ingest(spark, src, schema, table, ck).awaitTermination()
    assert [tuple(r) for r in ingest.table(spark, table, schema).select("path", "version", "name").collect()] == [("a", 2, "z")]


def test_sessions(spark):
    e = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:04:00"), ("u", "2024-01-01 01:00:00")], "user string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in ingest.sessions(e, "user", "ts", "5 minutes", "1 hour").collect()) == [1, 2]


def test_retention(spark):
    g = spark.createDataFrame([("r", i, i, i, i == 1, 10) for i in range(1, 7)], "repo string, generation int, seq int, created int, root boolean, bytes int")
    kept = {r.generation for r in retained(g, 4, F.lit(4), most_bytes=30).filter("kept").collect()}
    assert kept == {1, 5, 6}


def test_import_refuses_other_orders_and_unsafe_paths(spark, tmp_path):
    rec = spark.createDataFrame([("entity", json.dumps({"path": f"src/{i}.py", "n": i})) for i in range(30)], "type string, payload string")
    jsonl.export(rec, str(tmp_path / "x"))
    assert jsonl.load(spark, str(tmp_path / "x")).count() == 30
    part = max((tmp_path / "x" / "lines").glob("part-*"), key=lambda f: f.stat().st_size)
    kept = part.read_text().splitlines()
    part.write_text("\n".join(reversed(kept)) + "\n")
    (tmp_path / "x" / "lines" / f".{part.name}.crc").unlink(missing_ok=True)
    if len(kept) > 1:
        with pytest.raises(ValueError, match="order_mismatch"):
            jsonl.load(spark, str(tmp_path / "x"))
    for i, bad in enumerate(("/abs.py", "a/../b.py", "a//b.py")):
        jsonl.export(spark.createDataFrame([("entity", json.dumps({"path": bad}))], "type string, payload string"), str(tmp_path / str(i)))
        with pytest.raises(ValueError, match="unsafe_path"):
            jsonl.load(spark, str(tmp_path / str(i)))


def test_scip_byte_ranges(spark):
    import hashlib

    text = {"a.py": "x = 1\r\né\U0001f600name = x\n\u2028last", "b.py": "\ufeffab\n", "c.py": "changed", "d.py": "q"}
    rows = [
        ("a.py", "s", 1, 0, 1, 1, "utf8"), ("a.py", "n8", 2, 6, 2, 10, "utf8"), ("a.py", "n16", 2, 3, 2, 7, "utf16"), ("a.py", "n32", 2, 2, 2, 6, "utf32"), ("a.py", "half", 2, 2, 2, 7, "utf16"), ("a.py", "mid", 2, 1, 2, 6, "utf8"),
        ("a.py", "far", 1, 0, 1, 6, "utf8"), ("a.py", "down", 9, 0, 9, 1, "utf8"), ("a.py", "after", 4, 0, 4, 4, "utf32"), ("a.py", "both", 1, 4, 2, 2, "utf32"), ("b.py", "bom", 1, 0, 1, 2, None), ("c.py", "sha", 1, 0, 1, 1, "utf8"), ("gone.py", "no", 1, 0, 1, 1, "utf8"), ("d.py", "odd", 1, 0, 1, 1, "ebcdic"),
    ]
    o = spark.createDataFrame([(d, s, True, a, b, c, e, code, None) for d, s, a, b, c, e, code in rows], "document string, symbol string, is_definition boolean, line int, col int, end_line int, end_col int, encoding string, reason string")
    f = spark.createDataFrame(list(text.items()), "path string, text string")
    sha = spark.createDataFrame([(p, hashlib.sha256(("old" if p == "c.py" else x).encode()).hexdigest()) for p, x in text.items()], "path string, sha256 string")
    got = {r.symbol: (r.start_byte, r.end_byte, r.reason) for r in readers.scip_byte_ranges(o, f, sha, "utf16").collect()}
    raw = text["a.py"].encode()
    assert {s: raw[got[s][0] : got[s][1]].decode() for s in ("s", "n8", "n16", "n32", "after", "both")} == {"s": "x", "n8": "name", "n16": "name", "n32": "name", "after": "last", "both": "1\r\né\U0001f600"}
    assert got["bom"] == (3, 5, None)
    assert {s: w for s, (_, _, w) in got.items() if w} == {"half": "position_not_on_boundary", "mid": "position_not_on_boundary", "far": "position_out_of_line", "down": "position_out_of_line", "sha": "digest_mismatch", "no": "document_missing", "odd": "unsupported_encoding"}


def test_decision_mappings(spark):
    sha = "0" * 64
    entry = lambda i, **other: {"mapping_id": i, "decision_id": "ADR-1", "document": {"path": "docs/a.md", "sha256": sha}, "span": {"start_byte": 0, "end_byte": 9, "sha256": sha}, "target": {"entity_id": "e", "path": "a.py", "kind": "class", "name": "A"}} | other
    ok = [entry("ok"), entry(""), entry("two"), entry("two"), entry("up", document={"path": "../a.md", "sha256": sha}), entry("span", span={"start_byte": 4, "end_byte": 4, "sha256": sha}), entry("sha", document={"path": "a.md", "sha256": "x"}), entry("target", target={"path": "a.py"})]
    rows = [("m", json.dumps({"format": 1, "mappings": ok})), ("f", json.dumps({"format": 2, "mappings": ok[:1]})), ("bad", "{"), ("other", "{}")]
    got = [(r.file, r.mapping_id, r.reason) for r in readers.decision_mappings(texts(spark, *rows)).collect()]
    assert {(i, w) for f, i, w in got if f == "m"} == {("ok", None), ("", "missing_id"), ("two", "duplicate_mapping"), ("up", "unsafe_path"), ("span", "invalid_span"), ("sha", "malformed_digest"), ("target", "missing_target")}
    assert {(f, w) for f, _, w in got if f != "m"} == {("f", "unsupported_format"), ("bad", "not_a_mapping_document"), ("other", "not_a_mapping_document")}


def test_package_mappings(spark):
    sha = "a" * 64
    entry = lambda c, digest=sha, prefix="src/": {"coordinate": c, "package_snapshot_sha256": digest, "source_prefix": prefix}
    doc = {"format": 1, "repositories": ["r"], "consumer": {"lock_sha256": sha, "environment": "e"}, "packages": [entry("a"), entry("b", prefix=""), entry(""), entry("c"), entry("c"), entry("d", "x"), entry("e", prefix="src"), entry("f", prefix="/src/")]}
    rows = [("m", json.dumps(doc)), ("none", json.dumps(doc | {"consumer": {}, "packages": [entry("z")]})), ("bad", "[]")]
    got = {(r.file, r.coordinate, r.reason) for r in readers.package_mappings(texts(spark, *rows)).collect()}
    assert {(c, w) for f, c, w in got if f == "m"} == {("a", None), ("b", None), ("", "missing_coordinate"), ("c", "duplicate_coordinate"), ("d", "malformed_digest"), ("e", "unsafe_prefix"), ("f", "unsafe_prefix")}
    assert {(f, w) for f, _, w in got if f != "m"} == {("none", "missing_consumer"), ("bad", "not_a_mapping_document")}
