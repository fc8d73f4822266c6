"""Source text, retrieval order and scalar functions."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalars
from loomgraph.operators import text


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_search_counts_each_match_and_folds_case(spark):
    f = files(spark, [("a", "Foo foo\nbar"), ("b", "x.foo\\Ey"), ("c", None), ("d", "")])
    assert [(r.path, r.line, r["col"]) for r in text.searched(f, "foo").collect()] == [("a", 1, 1), ("a", 1, 5), ("b", 1, 3)]
    assert [(r.path, r["col"]) for r in text.searched(f, "Foo").collect()] == [("a", 1)]
    assert [(r.path, r.line, r["col"]) for r in text.searched(f, "fo+|ba.", regex=True).collect()] == [("a", 1, 1), ("a", 1, 5), ("a", 2, 1), ("b", 1, 3)]


def test_line_window(spark):
    f = files(spark, [("a", "1\n2\n3\n4\n"), ("b", "one")])
    got = [(r.path, r.line, r.content, r.next_cursor) for r in text.line_window(f, 2, 3).collect()]
    assert got == [("a", 2, "2", 4), ("a", 3, "3", 4)]


def test_search_uses_one_matcher(spark):
    f = files(spark, [("a", "École école"), ("b", "x école\nİx école")])
    assert [(r.path, r.line, r["col"]) for r in text.searched(f, "école").collect()] == [("a", 1, 1), ("a", 1, 7), ("b", 1, 3), ("b", 2, 4)]
    assert [(r.path, r.line, r["col"]) for r in text.searched(f, r"\wcole", regex=True).collect()] == [("a", 1, 1), ("a", 1, 7), ("b", 1, 3), ("b", 2, 4)]
    assert [(r.path, r.line, r["col"]) for r in text.searched(f, r"É\w+|x", regex=True).collect()] == [("a", 1, 1), ("b", 1, 1), ("b", 2, 2)]
    for pattern in ("x*", "", "a|", r"\b"):
        with pytest.raises(ValueError):
            text.searched(f, pattern, regex=True)


def test_listing_with_a_pattern(spark):
    f = files(spark, [(p, "x") for p in ("a/b.py", "a/C.py", "a/d.txt", "a/e.py/x", "a/[z].py", "b.py")])
    got = lambda p: [r.name for r in text.listed(f, "a", pattern=p).collect()]
    assert got("*.py") == ["e.py", "[z].py", "b.py", "C.py"] and got("?.py") == ["e.py", "b.py", "C.py"] and got("[b-c].*") == ["b.py"] and got("[[]*") == ["[z].py"] and got("*.rb") == []


def test_rationale_comments(spark):
    rows = [
        ("a.py", 1, "python", "# NOTE: why"), ("a.py", 3, "python", "# see ADR 7"), ("a.py", 4, "python", "#HACK:x"), ("a.rb", 5, "ruby", "#  x\n  # TODO: ADR-1"),
        ("b.ts", 1, "typescript", "// WHY: z"), ("b.ts", 2, "typescript", "/**\n * FIXME: y\n * adr 12\n */"), ("b.ts", 9, "javascript", "/**\n * see\n * RFC-0012 */"), ("b.ts", 20, "tsx", "# NOTE: no"), ("c.go", 1, "go", "// NOTE: no"),
    ]
    got = [tuple(r) for r in text.rationale_comments(spark.createDataFrame(rows, "path string, line int, lang string, text string")).orderBy("path", "line").collect()]
    assert got == [("a.py", 1, "# NOTE: why", None), ("a.rb", 6, "# TODO: ADR-1", None), ("b.ts", 1, "// WHY: z", None), ("b.ts", 3, "* FIXME: y", "ADR-0012"), ("b.ts", 11, "* RFC-0012 */", "RFC-12")]
    f = spark.createDataFrame([("a.py", "# NOTE: why\nx = 1  # TODO: no", "python"), ("b.ts", "// WHY: z\n * FIXME: y\n/* RFC-0012 */", "typescript")], "path string, text string, lang string")
    assert [(r.path, r.line, r.label) for r in text.rationale(f).orderBy("path", "line").collect()] == [("a.py", 1, None), ("b.ts", 1, None), ("b.ts", 2, None), ("b.ts", 3, "RFC-12")]


def test_languages_and_skipped_folders(spark):
    paths = {"a/b.go": "go", "B.Java": "java", "i.htm": "html", "r.markdown": "markdown", "s.css": "scss", "x.mjs": None, "y.json": None, "z.toml": None, "target/a.py": "python", "vendor/a.py": "python", "venv/a.py": "python",
             "tmp/a.py": None, "a/log/b.py": None, "coverage/x.rb": None, "storage/x.rb": None, "_site/i.html": None, "node_modules/x.js": None, "vendor/bundle/x.rb": "ruby", "tmpx/a.sh": "bash"}
    got = {r.path: r.lang for r in text.enumerated(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {p: x for p, x in paths.items() if x}


def test_phrase_counts_adjacent_words(spark):
    d = spark.createDataFrame([(1, "The a_b, a b. Äb a"), (2, "a x b")], "doc_id int, text string")
    assert [(r.doc_id, r.n) for r in text.phrase(d, "A B").collect()] == [(1, 2)]


def order_plain(atoms):
    """Queues for each path and owner; a path's owners take turns in the order of their first atoms."""
    left, out = sorted(atoms, key=lambda a: a[:2]), []
    anchor = next((a for a in left if a[4]), None)
    if anchor:
        out.append(anchor[1])
        left.remove(anchor)
    queues = {}
    for a in left:
        queues.setdefault(a[2], {}).setdefault(a[3], []).append(a)
    owners, at = {p: list(g) for p, g in queues.items()}, dict.fromkeys(queues, 0)
    while queues:
        for p in sorted(queues, key=lambda p: min(q[0][:2] for q in queues[p].values())):
            for step in range(len(owners[p])):
                i = (at[p] + step) % len(owners[p])
                if owners[p][i] in queues[p]:
                    break
            owner = owners[p][i]
            out.append(queues[p][owner].pop(0)[1])
            at[p] = (i + 1) % len(owners[p])
            if not queues[p][owner]:
                del queues[p][owner]
            if not queues[p]:
                del queues[p]
    return out


def test_context_order_against_a_plain_loop(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for q in range(100):
        atoms = [(rng.randrange(30), i, rng.choice("pqr"), rng.choice(["x", "y", "z", None]), rng.random() < 0.1) for i in range(rng.randrange(1, 25))]
        rows += [(q, *a) for a in atoms]
        want[q] = order_plain(atoms)
    d = spark.createDataFrame(rows, "query_id int, rank int, atom_id int, path string, owner string, exact boolean").repartition(3)
    got = {}
    for r in sorted(text.diversified(d).collect(), key=lambda r: r.place):
        got.setdefault(r.query_id, []).append(r.atom_id)
    assert got == want
    few = text.diversified(d, 3).groupBy("query_id").count().collect()
    assert max(r["count"] for r in few) == 3


def test_scalars(spark):
    d = spark.createDataFrame([("a/b_c", "pkg/Name.PY", "My..Pkg_x", "a%2Fb+c", "x~1y~0z", "t.py::C::m[1]")], "c string, p string, n string, u string, j string, s string")
    r = d.select(scalars.camelize(F.col("c")).alias("c"), scalars.language(F.col("p")).alias("l"), scalars.package_name(F.col("n")).alias("n"), scalars.percent_decoded(F.col("u")).alias("u"), scalars.pointer_token(F.col("j")).alias("j"), scalars.without_params(F.col("s")).alias("s")).first()
    assert tuple(r) == ("A::BC", "python", "my-pkg-x", "a/b+c", "x/y~z", "t.py::C::m")


def test_line_spans_and_columns(spark):
    from loomgraph.functions import spans

    texts = ["a\nbc\r\n\rd", "", None, "\n", "é\u2028x\n\n", "x\r", "\r\n\r\n", "no end"]
    f = spark.createDataFrame(list(enumerate(texts)), "path int, text string")
    got = {}
    for r in spans.line_spans(f).orderBy("path", "line").collect():
        got.setdefault(r.path, []).append((r.start_byte, r.end_byte))
    assert got == {0: [(0, 1), (2, 4), (6, 6), (7, 8)], 3: [(0, 0)], 4: [(0, 6), (7, 7)], 5: [(0, 1)], 6: [(0, 0), (2, 2)], 7: [(0, 6)]}
    rows = [("aé\U0001f600b", n, e) for e in ("utf8", "utf16", "utf32") for n in range(10)]
    d = spark.createDataFrame(rows, "line string, col int, encoding string")
    got = {(r.encoding, r.col): (r.x.byte, r.x.reason) for r in d.select("encoding", "col", spans.column_to_byte(F.col("line"), F.col("col"), F.col("encoding")).alias("x")).collect()}
    code = {"utf8": lambda s: len(s.encode()), "utf16": lambda s: len(s.encode("utf-16-le")) // 2, "utf32": len}
    for line, n, e in rows:
        at = {code[e](line[:k]): len(line[:k].encode()) for k in range(len(line) + 1)}
        assert got[e, n] == ((at[n], None) if n in at else (None, "position_out_of_line" if n > max(at) else "position_not_on_boundary"))
    d = spark.createDataFrame([("é\nb\n\nc", i) for i in range(8)], "t string, b int")
    assert [r.n for r in d.select("b", spans.line_at(F.col("t"), F.col("b")).alias("n")).orderBy("b").collect()] == [1, 1, 1, 2, 2, 3, 4, 4]


def test_guards(spark):
    import time

    from loomgraph.operators.guards import WorkStopped, deadline, within

    assert within(spark.range(5), 5, "row_limit").count() == 5
    with pytest.raises(WorkStopped, match="row_limit"):
        within(spark.range(6), 5, "row_limit")
    with deadline(spark, 60):
        assert spark.range(10).count() == 10
    began = time.time()
    with pytest.raises(WorkStopped, match="deadline"), deadline(spark, 1):
        spark.range(1 << 40).selectExpr("sum(hash(id))").collect()
    assert time.time() - began < 30 and spark.range(3).count() == 3


def test_retrieval_coverage_and_units(spark):
    from loomgraph.operators import evidence

    f = spark.createDataFrame([("a", "indexed", bytearray(b"x")), ("b", "failed", bytearray(b"yy")), ("c", "indexed", bytearray(b"\xff")), ("d", "indexed", bytearray(b"zz"))], "path string, state string, content binary")
    assert {r.reason: (r.files, r.bytes) for r in evidence.retrieval_coverage(f).collect()} == {None: (2, 3), "observation_failed": (1, 2), "non_utf8": (1, 1)}
    assert sorted(r.path for r in evidence.binding_units(f, spark.createDataFrame([("a",), ("q",), (None,)], "path string")).collect()) == ["a", "b", "c", "d", "q"]
