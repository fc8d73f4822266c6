"""Findings of the third round: odd tables against the queries' SQL, and the shape of the work."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomgraph import registry
from tests.test_queries import rows


def against_sql(spark, folder, name, **tables):
    """The query and its SQL over these small tables."""
    import duckdb

    con = duckdb.connect()
    for t, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = registry.queries()[name](spark, str(folder))
    want = con.sql(registry.oracle_sql()[name]).to_arrow_table()
    columns = sorted(want.column_names)
    assert sorted(df.columns) == columns
    got = rows(df.toArrow(), columns)
    assert got == rows(want, columns)
    return got


def test_decision_mapping_short_wide_and_repeated(spark, tmp_path):
    """Spans are judged by bytes of the text as it is, and a repeated document counts once a row."""
    texts = ["\u00e9" * 5, "\u4e2d" * 4, "\U0001f600" * 3, "ab\n\u00e9\u00e9\u00e9\u00e9", "", None, "plain text of more bytes", "\u00e9" * 4]
    ids = [x for i in range(len(texts)) for x in (i + 21, i + 35)] + [22, 22, 33, -1]
    found = [t for t in texts for _ in range(2)] + ["again", "\u00e9" * 5, "eleven", "minus"]
    against_sql(spark, tmp_path, "decision_mapping", documents={"doc_id": pa.array(ids, pa.int64()), "text": found}, labels={"doc_id": pa.array([*range(20, 60), None], pa.int64())})


def steps(df):
    """Rows out of every step of a collected result's plan, by the step's name."""
    found = []

    def walk(p):
        name = p.getClass().getSimpleName()
        rows_ = p.metrics().get("numOutputRows")
        if rows_.isDefined():
            found.append((name, rows_.get().value()))
        inner = p.executedPlan() if name == "AdaptiveSparkPlanExec" else p.plan() if name.endswith("QueryStageExec") else None
        if inner is not None:
            walk(inner)
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def text(found):
    from pyspark.sql import functions as F

    return F.array_join(F.transform(found, lambda c: F.concat_ws(":", c["path"], c["line"])), ",")


def test_namespace_lists_are_made_once_and_dealt(spark, monkeypatch):
    """Long lists stand in several places; every reference has its whole list, as text made for the name."""
    from loomgraph.operators import resolve

    monkeypatch.setattr(resolve, "LONG_LIST", 3)
    refs = spark.createDataFrame([(i, ("A::B", "A", "", None, "C")[i % 5], "X" if i % 3 else "Y") for i in range(60)], "ref_id long, namespace string, callee_name string")
    d = spark.createDataFrame([("A::X", f"f{i}", i) for i in range(9)] + [("X", "g", i) for i in range(4)] + [("A::B::Y", "h", 1)], "full_name string, path string, line_start long")
    got = {r.ref_id: (r.full_name, r.candidates) for r in resolve.namespaced(refs, d, text).collect()}
    lists = {"A::X": ",".join(f"f{i}:{i}" for i in range(9)), "X": ",".join(f"g:{i}" for i in range(4)), "A::B::Y": "h:1"}
    for r in refs.collect():
        tried = {"A::B": ["A::B::", "A::", ""], "A": ["A::", ""], "C": ["C::", ""]}.get(r.namespace, [""])
        want = next((n for n in (t + r.callee_name for t in tried) if n in lists), None)
        assert got[r.ref_id] == (want, lists.get(want))
    assert len(got) == 60


def test_members_are_gathered_once_for_a_name(spark):
    """References to one member list do not multiply with its members."""
    from loomgraph.operators import resolve

    refs = spark.createDataFrame([(i, "p", "T" if i % 7 else "Z", "m", ("instance", None, "unknown")[i % 3]) for i in range(300)], "ref_id long, path string, receiver string, callee_name string, category string")
    types = spark.createDataFrame([("T", "p", "o1"), ("T", "p", "o2"), ("U", "p", "o1")], "name string, path string, identity string")
    d = spark.createDataFrame([(("o1", "o2")[i % 2], "m", ("instance", "class", "unknown")[i % 3], "p", i // 2) for i in range(300)], "owner string, name string, category string, path string, line_start long")
    df = resolve.members(refs, types, d)
    for r in df.collect():
        lines = sorted({i // 2 for i in range(300) if i % 3 != 2 and (r.category is None or r.category == ("instance", "class")[i % 3])})
        want = ("unknown_receiver", None) if r.receiver == "Z" else ("owner_has_no_member", None) if r.category == "unknown" else (None, lines)
        assert (r.reason, r.candidates and [c.line for c in r.candidates]) == want
    assert max(n for _, n in steps(df)) <= 1200


def test_edges_show_lists_once_for_a_name(spark):
    from loomgraph.operators import resolve

    symbols = spark.createDataFrame([(i, "python", "n", "function", "p", i, i + 1) for i in range(5)], "id long, lang string, name string, kind string, path string, line_start long, line_end long")
    refs = spark.createDataFrame([("python", "n", "call", False, "p", i, 0) for i in range(8)], "lang string, callee_name string, relation string, qualified boolean, path string, line long, col int")
    e = resolve.edges(refs, symbols, show=text)
    assert {r.candidates for r in e.collect()} == {",".join(f"p:{i}" for i in range(5))}


def test_equal_executions_meet_spans_once(spark):
    from loomgraph.operators import overlays

    ex = spark.range(2000).selectExpr("'p' as path", "id % 4 as line_from", "id % 4 + 2 as line_to", "'t' as test")
    spans_ = spark.range(50).selectExpr("'p' as path", "id as span_id", "0L as start", "9L as stop", "1L as header_end")
    df = overlays.covered_spans(ex, spans_)
    assert {(r.lines, r.body) for r in df.collect()} == {(4000, True)} and df.count() == 50
    assert max(n for _, n in steps(df)) <= 2000


def test_points_probe_only_levels_in_use(spark):
    from loomgraph.operators import intervals

    points = spark.range(1000).selectExpr("'p' as path", "id as line")
    s = spark.range(10).selectExpr("'p' as path", "id * 100 as lo", "id * 100 + 5 as hi")
    df = intervals.containing(points, s, "path", "line", "lo", "hi")
    assert len(df.collect()) == 60
    assert max(n for _, n in steps(df)) <= 1000


@pytest.mark.parametrize("name", ["refs", "file_refs"])
def test_references_copy_no_table_to_every_task(spark, name):
    from loomgraph.plans.projection import projected

    assert "Broadcast" not in projected(spark, "/root/testdata/sf0.001", name)._jdf.queryExecution().executedPlan().toString()


def test_references_with_odd_lines_and_parts(spark, tmp_path):
    """Repeated and missing numbers give the rows that the distinct SQL gives."""
    part = {"p_partkey": pa.array([1, 1, 2, 3, 3, None], pa.int64()), "p_name": ["a b", "a b", "c d", None, None, "x"], "p_type": ["T"] * 6, "p_brand": ["Brand#1"] * 6, "p_size": pa.array([5, 6, None, 7, 8, 9], pa.int32())}
    line = [(k, s, n, f) for k in (1, 2, 3, 4, None) for s in (1, 26) for n in (1, 2, 3) for f in ("R", "A")] * 2
    lineitem = {"l_partkey": pa.array([x[0] for x in line], pa.int64()), "l_suppkey": pa.array([x[1] for x in line], pa.int64()), "l_linenumber": pa.array([x[2] for x in line], pa.int32()), "l_returnflag": [x[3] for x in line]}
    from loomgraph.plans import projection

    for t, columns in (("part", part), ("lineitem", lineitem)):
        pq.write_table(pa.table(columns), f"{tmp_path}/{t}.parquet")
        spark.read.parquet(f"{tmp_path}/{t}.parquet").createOrReplaceTempView(t)
    got, want = projection.projected(spark, str(tmp_path), "refs"), spark.sql(projection.PROJECTIONS["refs"])
    key = lambda d: sorted(map(tuple, d.select(*want.columns).collect()), key=repr)
    assert key(got) == key(want)
    assert got.dtypes == want.dtypes
    places = projection.reference_places(spark, str(tmp_path))
    assert key(want)[0] and sorted(map(tuple, places.collect())) == sorted(map(tuple, want.select("path", "line").distinct().collect()))


def test_pairs_of_a_commit_need_no_second_look_at_its_rows(spark):
    from loomgraph.operators import overlays

    c = spark.createDataFrame([(k, 1, f"f{(k * i) % 7}", "100644") for k in range(20) for i in range(5)] + [(99, 1, f"f{i}", "100644") for i in range(30)], "commit_id long, parents int, path string, mode string")
    df = overlays.co_change(c, 5)
    per = {}
    for k in range(20):
        names = sorted({f"f{(k * i) % 7}" for i in range(5)})
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                per.setdefault((a, b), []).append(k)
    assert {(r.a, r.b): (r.support, list(r.commits)) for r in df.collect()} == {p: (len(k), k) for p, k in per.items()}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_commits_are_dealt_to_small_pieces(spark):
    from loomgraph.operators import overlays

    c = spark.range(4000).selectExpr("id % 1000 as commit_id", "1 as parents", "concat('f', id) as path", "'100644' as mode")
    rows_, classes = overlays.commit_classes(c, 5)
    pieces = overlays.PIECES * 4
    assert rows_.rdd.getNumPartitions() == classes.rdd.getNumPartitions() == pieces
    assert {(r.n, r["class"]) for r in classes.collect()} == {(4, "pair")}


def test_rules_search_many_seeds_in_halves(spark, monkeypatch):
    """Seeds that make more rows than there are files are searched in halves; hits and reasons are those of all together."""
    from loomgraph.operators import rules

    monkeypatch.setattr(rules, "ROWS", 0)
    searched = []
    whole = rules.reach
    monkeypatch.setattr(rules, "reach", lambda step, seeds, depth, most=None: searched.append(whole(step, seeds, depth, most)) or searched[-1])
    sources = [f"s{i:03}" for i in range(600)]
    edges = [(s, "hub") for s in sources] + [("hub", "t1"), ("t1", "t2")]
    files = [*sources, "hub", "t1", "t2"]
    table = lambda d, columns: spark.createDataFrame(d, ", ".join(f"{c} string" for c in columns.split()))
    got = rules.rule_check(table(edges, "source target"), table([(f,) for f in files], "path"), table([("r", "s", "t"), ("q", "s5", "t2")], "rule_id from_prefix to_prefix"), table([("hub",)], "path"), 2).collect()
    assert {r.rule_id: (r.violations, r.first_source, r.first_target, set(r.reasons)) for r in got} == {"r": (600, "s000", "t1", {"depth_limit", "import_boundary"}), "q": (0, None, None, {"depth_limit", "import_boundary"})}
    assert [r is None for r in searched] == [True, False, False]


def test_a_component_of_many_links_is_one_group_and_quality_reads_links_once(spark, monkeypatch):
    """A component of 25,000 links goes without waves, labels are those of the loop, and quality computes the links once."""
    import random

    from loomgraph.operators import graph

    monkeypatch.setattr(graph, "waves", None)
    rng, n = random.Random(3), 2000
    pairs = sorted({(min(x), max(x)) for x in ((rng.randrange(n), rng.randrange(n)) for _ in range(25_200)) if x[0] != x[1]} | {(i, i + 1) for i in range(n - 1)})
    around = [[] for _ in range(n)]
    for a, b in pairs:
        around[a].append(b)
        around[b].append(a)
    label, first = graph.propagate(around), {}
    for i, x in enumerate(label):
        first.setdefault(x, i)
    number = {x: k for k, x in enumerate(sorted(first, key=first.get))}
    table = pa.table({"a": [f"n{a:04}" for a, _ in pairs], "b": [f"n{b:04}" for _, b in pairs]})
    nodes = spark.createDataFrame([(f"n{i:04}",) for i in range(n)] + [("alone",)], "node string")
    got = {r.node: r.community for r in graph.communities(nodes, spark.createDataFrame(table)).collect()}
    assert got == {"alone": 0} | {f"n{i:04}": number[x] + 1 for i, x in enumerate(label)}

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    members = spark.createDataFrame(list(got.items()), "node string, community long")
    q = graph.quality(members, spark.createDataFrame(table).mapInArrow(seen, "a string, b string")).first()
    inner = sum(label[a] == label[b] for a, b in pairs)
    assert q.coverage == round(inner / len(pairs), 6) and q.communities == len(number) + 1 and read.value == len(pairs)


def test_lists_are_dealt_by_what_they_show(spark, monkeypatch):
    """Many references to a short list are dealt over its copies; a long list that is shown seldom has one; no task is left out."""
    from loomgraph.operators import resolve

    monkeypatch.setattr(resolve, "LONG_LIST", 3)
    monkeypatch.setattr(resolve, "SHOWN", 20)
    n = {"hot": 2, "long": 40, "mid": 3}
    asked = ["hot"] * 300 + ["long"] + ["mid"] * 15 + ["none"] * 200 + [None] * 200
    refs = spark.createDataFrame([(i, k, n.get(k)) for i, k in enumerate(asked)], "ref_id long, k string, __n long")
    lists = spark.createDataFrame([(k, c, f"{k}!") for k, c in n.items()], "k string, __n long, candidates string")
    out = resolve._listed(refs, lists, ["k"], refs["ref_id"])
    got = {r.ref_id: (r.k, r.candidates) for r in out.collect()}
    assert got == {i: (k, f"{k}!" if k in n else None) for i, k in enumerate(asked)}
    spread = lambda d: d.selectExpr("spark_partition_id() as p", "k").distinct().count()
    assert spread(out.filter("k = 'hot'")) > 1 and spread(out.filter("k is null")) > 1 and spread(out.filter("k = 'long'")) == 1
    assert out.rdd.getNumPartitions() == 4


def test_incremental_edges_carry_no_lists_until_the_end(spark, tmp_path, monkeypatch):
    """tables of edges that are written on the way name their candidates by a digest, however many there are."""
    from loomgraph.operators import tables

    n, lines = 60, 240
    part = {"p_partkey": pa.array(range(n), pa.int64()), "p_name": [f"n{i % 3}" for i in range(n)], "p_type": ["t"] * n, "p_size": pa.array([i % 2 for i in range(n)], pa.int32()), "p_brand": [f"Brand#{1 + i % 4}" for i in range(n)]}
    lineitem = {"l_partkey": pa.array([i * 7 % n for i in range(lines)], pa.int64()), "l_suppkey": pa.array([i % 4 for i in range(lines)], pa.int64()), "l_linenumber": pa.array([1 + i % 7 for i in range(lines)], pa.int32()), "l_returnflag": ["RAN"[i % 3] for i in range(lines)]}
    written, keep = [], tables.kept
    monkeypatch.setattr(tables, "kept", lambda df, *a: written.append(keep(df, *a)) or written[-1])
    got = against_sql(spark, tmp_path, "incremental_edges", part=part, lineitem=lineitem)
    assert max(len(str(r)) for r in got) > 200
    edges = [d for d in written if "candidates" in d.columns]
    assert edges and all(dict(d.dtypes)["candidates"] == "string" and d.filter("length(candidates) <> 64").isEmpty() for d in edges)
