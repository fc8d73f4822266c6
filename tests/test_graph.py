"""Graph operators against plain loops, on fixtures and seeded random graphs."""

import random

import pytest

from loomgraph.operators import graph, intervals, lookup, resolve
from loomgraph.plans.dsl import Engine, QueryError, parse


def links(spark, pairs):
    return spark.createDataFrame(pairs or [(-1, -1)], "a long, b long").filter("a >= 0")


def test_communities_of_the_task_graph(spark):
    nodes = spark.createDataFrame([(i,) for i in range(7)], "node long")
    e = links(spark, [(0, 1), (2, 3), (2, 4), (5, 6)])
    got = {r.node: r.community for r in graph.communities(nodes, e).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2}
    q = graph.quality(graph.communities(nodes, e), e).first()
    assert (round(q.modularity, 6), q.coverage, q.communities) == (0.625, 1.0, 3)


@pytest.mark.parametrize("most", [0, 1000])
def test_communities_equal_one_loop_over_the_graph(spark, most):
    """Twenty random graphs side by side, some of one giant component; every component in waves, or every one in a task."""
    n, pairs = 40, []
    for seed in range(20):
        rng, base = random.Random(seed), 100 * seed
        pairs += [(base + rng.randrange(n), base + rng.randrange(n)) for _ in range((35, 60, 120)[seed % 3])]
        if seed % 4 == 0:
            pairs += [(base + i, base + rng.randrange(i)) for i in range(1, n)]
    nodes = [100 * seed + i for seed in range(20) for i in range(n)]
    index = {x: i for i, x in enumerate(nodes)}
    around = [set() for _ in nodes]
    for a, b in pairs:
        if a != b:
            around[index[a]].add(index[b])
            around[index[b]].add(index[a])
    label = graph.propagate([sorted(x) for x in around])
    first = {}
    for i, x in enumerate(label):
        first.setdefault(x, i)
    number = {x: k for k, x in enumerate(sorted(first, key=first.get))}
    got = graph.communities(spark.createDataFrame([(i,) for i in nodes], "node long"), links(spark, pairs).repartition(3), most=most)
    assert {r.node: r.community for r in got.collect()} == {nodes[i]: number[x] for i, x in enumerate(label)}


def test_waves_stop_at_the_last_pass(spark):
    """A path turns labels over for many passes; a limit cuts both ways alike."""
    pairs = [(i, i + 1) for i in range(9)] + [(0, 5)]
    around = [sorted({b if a == i else a for a, b in pairs if i in (a, b)}) for i in range(10)]
    for passes in (1, 2):
        got = {r.node: r.label for r in graph.waves(links(spark, pairs), passes).collect()}
        assert got == dict(enumerate(graph.propagate(around, passes)))


def test_shortest_paths_on_random_graphs(spark):
    rng = random.Random(7)
    rows = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}", "call", "EXTRACTED") for _ in range(60)]
    a = spark.createDataFrame(rows, "source string, target string, relation string, confidence string")
    step = {}
    for s, t, *_ in rows:
        step.setdefault(s, set()).add(t)
    pairs = [(f"n{i}", f"n{j}") for i in range(0, 25, 6) for j in range(0, 25, 5)]
    got = {(r.seed, r.target): r for r in graph.shortest_paths(a, spark.createDataFrame(pairs, "seed string, target string")).collect()}
    for s, t in pairs:
        level, seen, k = {s}, {s}, 0
        while level and t not in level and k < 8:
            level = {y for x in level for y in step.get(x, ())} - seen
            seen |= level
            k += 1
        r = got[s, t]
        if t in level:
            assert r.outcome == "complete" and r.distance == k and r.nodes[0] == s and r.nodes[-1] == t and len(r.nodes) == k + 1
            assert all(y in step.get(x, ()) for x, y in zip(r.nodes, r.nodes[1:]))
        else:
            assert r.outcome == ("partial" if level else "no_path") and r.stop_reason == ("depth_limit" if level else None) and r.nodes is None


def walked(rows, seed, depth, max_nodes=None, max_edges=None):
    """One queue over the assertions (source, target, relation, confidence, id): what a bounded search returns."""
    out = {}
    for s, t, rel, conf, i in rows:
        if rel in ("call", "import"):
            out.setdefault(s, []).append((rel, i, t, conf))
    nodes, edges, examined, queue = {seed: 0}, [], 0, [seed]
    while queue:
        if nodes[queue[0]] >= depth:
            return nodes, edges, "depth_limit"
        for rel, i, t, conf in sorted(out.get(queue[0], [])):
            if examined == max_edges:
                return nodes, edges, "examined_edge_limit"
            examined += 1
            if conf == "AMBIGUOUS" or t is None:
                continue
            if t not in nodes:
                if len(nodes) == max_nodes:
                    return nodes, edges, "visited_node_limit"
                nodes[t] = nodes[queue[0]] + 1
                queue.append(t)
            edges.append(i)
        queue.pop(0)
    return nodes, edges, None


@pytest.mark.parametrize("max_nodes, max_edges", [(None, None), (5, None), (None, 9), (6, 12), (40, 14)])
def test_traversal_against_one_queue(spark, max_nodes, max_edges):
    rng = random.Random(11)
    rows = [(f"n{rng.randrange(20)}", rng.choice([None] + [f"n{j}" for j in range(20)]), rng.choice(["call", "import", "include"]), rng.choice(["EXTRACTED", "INFERRED", "AMBIGUOUS"]), i) for i in range(90)]
    a = spark.createDataFrame(rows, "source string, target string, relation string, confidence string, assertion_id long").repartition(3)
    seeds = [f"n{i}" for i in range(0, 20, 3)] + ["absent"]
    for depth in (2, 30):
        got = [x.collect() for x in graph.traverse(a, spark.createDataFrame([(s,) for s in seeds], "seed string"), depth, ("call", "import"), max_nodes=max_nodes, max_edges=max_edges)]
        for s in seeds:
            nodes, edges, reason = walked(rows, s, depth, max_nodes, max_edges)
            assert {r.node: r.distance for r in got[0] if r.seed == s} == nodes
            assert sorted(r.assertion_id for r in got[1] if r.seed == s) == sorted(edges)
            assert [(r.outcome, r.stop_reason) for r in got[2] if r.seed == s] == [("partial" if reason else "complete", reason)]


def test_path_outcomes(spark):
    chain = [(f"c{i}", f"c{i + 1}", "call", "EXTRACTED", i) for i in range(12)] + [("x", "y", "call", "INFERRED", 50)]
    a = spark.createDataFrame(chain, "source string, target string, relation string, confidence string, assertion_id long")
    pairs = spark.createDataFrame([("c0", "c8"), ("c0", "c10"), ("c0", "y"), ("x", "c0"), ("x", "gone"), ("x", "y"), ("y", "y")], "seed string, target string")
    entities = spark.createDataFrame([(f"c{i}",) for i in range(13)] + [("x",), ("y",)], "entity_id string")
    got = {(r.seed, r.target): (r.outcome, r.stop_reason, r.distance, r.hops) for r in graph.shortest_paths(a, pairs, 8, entities).collect()}
    assert got == {
        ("c0", "c8"): ("complete", None, 8, list(range(8))), ("c0", "c10"): ("partial", "depth_limit", None, None), ("c0", "y"): ("partial", "depth_limit", None, None), ("x", "c0"): ("no_path", None, None, None),
        ("x", "gone"): ("no_evidence", None, None, None), ("x", "y"): ("complete", None, 1, [50]), ("y", "y"): ("complete", None, 0, []),
    }


def test_propagation_passes_over_settled_nodes_only():
    """The short cut against the loop that visits every node in every pass."""
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randrange(1, 60)
        around = [set() for _ in range(n)]
        for _ in range(rng.randrange(0, 3 * n)):
            a, b = rng.randrange(n), rng.randrange(n)
            if a != b:
                around[a].add(b)
                around[b].add(a)
        label = list(range(n))
        for _ in range(100):
            before = list(label)
            for i, x in enumerate(around):
                if x:
                    seen = [label[j] for j in x]
                    label[i] = min(seen, key=lambda y: (-seen.count(y), y))
            if label == before:
                break
        assert graph.propagate([sorted(x) for x in around]) == label


def test_range_joins_against_all_pairs(spark):
    rng = random.Random(3)
    point = [(i, f"p{rng.randrange(3)}", rng.randrange(5000)) for i in range(200)]
    span = [(i, f"p{rng.randrange(3)}", lo := rng.randrange(5000), lo + rng.choice([0, 3, 60, 900, 4000])) for i in range(150)]
    p = spark.createDataFrame(point, "pid int, path string, line long")
    s = spark.createDataFrame(span, "sid int, path string, lo long, hi long")
    got = {(r.pid, r.sid) for r in intervals.containing(p, s, "path", "line", "lo", "hi").collect()}
    assert got == {(a, b) for a, x, n in point for b, y, lo, hi in span if x == y and lo <= n <= hi}
    wide = [(900, "p0", 0, 1 << 40), (901, "p0", -5, 1 << 23)]
    span, s = span + wide, s.union(spark.createDataFrame(wide, s.schema))
    half = s.withColumnRenamed("sid", "rid").withColumnRenamed("lo", "from").withColumnRenamed("hi", "to")
    got = [(r.sid, r.rid) for r in intervals.overlapping(s, half, "path", ("lo", "hi"), ("from", "to")).collect()]
    want = {(a, b) for a, x, lo, hi in span for b, y, f, t in span if x == y and lo < t and max(hi, lo + 1) > f}
    assert len(got) == len(set(got)) and set(got) == want


SYMBOLS = "id long, lang string, name string, kind string, path string, line_start long, line_end long"
REFS = "lang string, callee_name string, relation string, qualified boolean, path string, line long, col long"


def fixture(spark):
    s = spark.createDataFrame([(1, "ruby", "ApplicationRepository", "class", "app.rb", 1, 20), (2, "ruby", "VoteRepository", "class", "vote.rb", 1, 9), (3, "ruby", "BallotRepository", "class", "ballot.rb", 1, 9), (4, "ruby", "run", "method", "vote.rb", 3, 5), (5, "ruby", "run", "method", "ballot.rb", 3, 5), (6, "ruby", "only", "method", "app.rb", 2, 4)], SYMBOLS)
    r = spark.createDataFrame([("ruby", "ApplicationRepository", "superclass", False, "vote.rb", 1, 0), ("ruby", "ApplicationRepository", "superclass", False, "ballot.rb", 1, 0), ("ruby", "run", "call", False, "app.rb", 3, 4), ("ruby", "only", "call", False, "vote.rb", 4, 2), ("ruby", "only", "call", True, "vote.rb", 5, 2), ("ruby", "nothing", "call", False, "vote.rb", 5, 9), ("ruby", "VoteRepository", "call", False, "app.rb", 9, 1)], REFS)
    return s, r


def test_confidence_tiers_and_verbs(spark):
    s, r = fixture(spark)
    e = Engine(s, r)
    sub = e.query("subclasses_of:ApplicationRepository").collect()
    assert [(x.source_name, x.confidence) for x in sub] == [("BallotRepository", "EXTRACTED"), ("VoteRepository", "EXTRACTED")]
    assert [(x.confidence, len(x.candidates)) for x in e.query("callers_of:A#run").collect()] == [("AMBIGUOUS", 2)]
    assert [x.confidence for x in e.query("callers_of:only").collect()] == ["INFERRED", "EXTRACTED"]
    made = e.query("callers_of:VoteRepository").collect()
    assert [(x.relation, x.confidence) for x in made] == [("construct", "EXTRACTED")]
    assert [x.callee_name for x in resolve.unresolved(r, e.edges).collect()] == ["nothing"]
    assert {x.fact for x in e.query("definitions_of:run").collect()} == {"symbol", "ref"}
    top = e.query("god_nodes:").first()
    assert top["name"] == "ApplicationRepository" and top["in_degree"] == 2
    assert e.query("communities:").count() > 0
    states = spark.createDataFrame([("python", "indexed"), ("python", "failed"), ("ruby", "indexed")], "lang string, state string")
    assert {(x.lang, x.indexed, x.failed, x.complete) for x in e.operation("status", files=states).collect()} == {("python", 1, 1, False), ("ruby", 1, 0, True)}
    docs = spark.createDataFrame([(1, "zebra crossing", "a", "x"), (2, "plain", "b", "y")], "doc_id long, text string, path string, owner string")
    ask = spark.createDataFrame([(7, "zebra", 1)], "query_id long, query string, anchor long")
    assert [x.doc_id for x in e.operation("retrieve", documents=docs, queries=ask).collect()] == [1]
    assert e.operation("context", documents=docs, queries=ask).count() >= 1
    shaped = lookup.shaped(e.edges).collect()
    assert all((x.target is None) == (x.confidence == "AMBIGUOUS") and (x.candidates is None) == (x.confidence != "AMBIGUOUS") for x in shaped)


def test_results_do_not_depend_on_partitions(spark):
    s, r = fixture(spark)
    one, many = (sorted(map(str, resolve.edges(r.repartition(n), s.repartition(n)).collect())) for n in (1, 8))
    assert one == many


def test_refused_queries(spark):
    for text, code in (("callers_of", "INVALID_QUERY"), ("who:x", "UNKNOWN_VERB")):
        with pytest.raises(QueryError) as e:
            parse(text)
        assert e.value.code == code


def test_shadowed_name_has_no_candidate(spark):
    refs = spark.createDataFrame([(1, "hub.py", "Config", ["f", ""]), (2, "hub.py", "load", ["f", ""]), (3, "hub.py", "gone", [""])], "ref_id int, path string, callee_name string, scopes array<string>")
    d = spark.createDataFrame([("hub.py", "", "load", "function", 3)], "path string, scope string, name string, kind string, line_start int")
    b = spark.createDataFrame([("hub.py", "", "Config", "assignment")], "path string, scope string, name string, binding_kind string")
    got = {r.ref_id: (r.candidates and len(r.candidates), r.reason) for r in resolve.visible(refs, d, b).collect()}
    assert got == {1: (None, "shadowed_noncallable"), 2: (1, None), 3: (None, "no_visible_target")}


def test_relative_imports(spark):
    i = spark.createDataFrame([(1, "pkg/a.py", 1, ["b"], "f"), (2, "pkg/a.py", 3, ["b"], "f"), (3, "flat/a.py", 1, ["b"], "f"), (4, "pkg/a.py", 1, ["zz"], "f"), (5, "pkg/a.py", 1, ["b"], "zz"), (6, "pkg/a.py", 1, ["b"], "hidden"), (7, "pkg/a.py", 1, ["b"], "maybe"), (8, "pkg/a.py", 1, ["b"], "twice")], "import_id int, path string, level int, module array<string>, name string")
    m = spark.createDataFrame([("pkg/__init__.py",), ("pkg/a.py",), ("pkg/b.py",), ("flat/b.py",)], "path string")
    e = spark.createDataFrame([("pkg/b.py", "f", 4, False, False), ("pkg/b.py", "hidden", 5, True, False), ("pkg/b.py", "maybe", 6, False, True), ("pkg/b.py", "twice", 7, False, False), ("pkg/b.py", "twice", 8, False, False)], "path string, name string, line_start int, blocked boolean, conditional boolean")
    got = {r.import_id: (r.target_line, r.reason) for r in resolve.relative_imports(i, m, e).collect()}
    assert got == {1: (4, None), 2: (None, "outside_package"), 3: (None, "no_package"), 4: (None, "missing_module"), 5: (None, "missing_target"), 6: (None, "blocked_export"), 7: (None, "conditional_export"), 8: (None, "ambiguous_target")}


def test_budget_stops_at_the_first_that_does_not_fit(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(1, 5), (2, 6), (3, 1)], "k int, cost int")
    assert [r.k for r in lookup.within_budget(d, ["k"], F.col("cost"), 10).collect()] == [1]
    many = spark.range(500).withColumn("cost", F.col("id") % 7).repartition(5)
    want, spent = [], 0
    for i in range(500):
        spent += i % 7
        want += [(i, spent)] * (spent <= 900)
    assert sorted((r.id, r.spent) for r in lookup.within_budget(many, ["id"], F.col("cost"), 900).collect()) == want


def test_span_paths_are_whole_and_cycles_end(spark):
    deep = [(1, i, i - 1 if i else None) for i in range(700)]
    rng = random.Random(5)
    tree = [(2, i, rng.randrange(i) if i else None) for i in range(60)] + [(2, 99, 77)]
    cycle = [(3, 1, 2), (3, 2, 1), (3, 3, 2), (3, 4, None)]
    got = sorted((r.trace_id, list(r.path)) for r in graph.span_paths(spark.createDataFrame(deep + tree + cycle, "trace_id long, span_id long, parent_id long").repartition(3)).collect())
    above = {(t, s): p for t, s, p in tree}
    want = [(1, list(range(700))), (2, [99]), (3, [4])]
    for leaf in set(range(60)) - set(above.values()):
        path = [leaf]
        while above[2, path[0]] is not None:
            path.insert(0, above[2, path[0]])
        want.append((2, path))
    assert got == sorted(want)


def test_adjusted_rand(spark):
    from itertools import combinations

    rng = random.Random(4)
    for groups in (1, 3, 12):
        a, b = ({i: rng.randrange(groups) for i in range(40)} for _ in range(2))
        pairs = list(combinations(range(40), 2))
        both = sum(a[i] == a[j] and b[i] == b[j] for i, j in pairs)
        in_a, in_b = (sum(x[i] == x[j] for i, j in pairs) for x in (a, b))
        expected, most = in_a * in_b / len(pairs), (in_a + in_b) / 2
        want = 1.0 if most == expected else (both - expected) / (most - expected)
        got = graph.adjusted_rand(*[spark.createDataFrame(list(x.items()), "node long, community long") for x in (a, b)]).first().ari
        assert got == pytest.approx(want, abs=1e-6)


def test_rule_delta_of_searches_that_are_not_whole(spark):
    kind = "rule_id string, source string, target string"
    before = spark.createDataFrame([("r", "a", "b"), ("r", "c", "d"), ("q", "a", "b")], kind)
    after = spark.createDataFrame([("r", "a", "b"), ("r", "e", "f"), ("p", "x", "y")], kind)
    whole = spark.createDataFrame([("r", True, False), ("q", False, True)], "rule_id string, before boolean, after boolean")
    got = lambda d: {(r.rule_id, r.source): r.delta for r in d.collect()}
    assert got(graph.rule_delta(before, after)) == {("r", "a"): "persisting", ("r", "c"): "resolved", ("r", "e"): "introduced", ("q", "a"): "resolved", ("p", "x"): "introduced"}
    assert got(graph.rule_delta(before, after, whole)) == {("r", "a"): "persisting", ("r", "c"): None, ("r", "e"): "introduced", ("q", "a"): "resolved", ("p", "x"): None}


def test_changes_that_say_too_little(spark):
    from loomgraph.operators import diff

    kind = "entity_id long, path string, language string, kind string, name string, signature string, body string, line int"
    row = lambda i, path, body, sig="f(x)": (i, path, "python", "function", f"n{i}", sig, body, 1)
    before = spark.createDataFrame([row(1, "a", "return a + b * c"), row(2, "a", "pass"), row(3, "a", "", "def g(x, y):"), row(4, "a", "x = y = z = w"), row(5, "a", "x = y = z = w")], kind)
    after = spark.createDataFrame([row(11, "a", "return  a + b * c"), row(12, "b", "pass"), row(13, "b", "", "def g(x, y):"), row(14, "b", "x = y = z = w")], kind)
    got = diff.rename_candidates(diff.aligned(diff.fingerprinted(before), diff.fingerprinted(after))).collect()
    assert {(r.before_id, r.after_id, r.relation) for r in got} == {(1, 11, "rename"), (3, 13, "rename_and_move")}


def test_classes_of_commits_links_and_drift(spark):
    from loomgraph.operators import overlays

    rows = [(1, 2, "a", "100644", 5), (2, 1, "a", "100644", 50), (3, 1, "a", "100644", 5), (3, 1, "b", "100644", 5), (4, 1, "gen/x", "100644", 5), (5, 1, "a", "100644", 5)] + [(6, 1, f"p{i}", "100644", 9) for i in range(4)]
    c = spark.createDataFrame(rows, "commit_id int, parents int, path string, mode string, diff_bytes long")
    got = {r.commit_id: r["class"] for r in overlays.commit_classes(c, 3, ("gen/",), most_bytes=10)[1].collect()}
    assert got == {1: "merge", 2: "oversized", 3: "pair", 4: "empty", 5: "single", 6: "bulk"}
    n = {r.linkage: r.spans for r in overlays.linkage_counts(spark.createDataFrame([("linked_file",), ("missing",), ("missing",)], "linkage string")).collect()}
    assert n == {x: {"linked_file": 1, "missing": 2}.get(x, 0) for x in overlays.LINKAGES}
    m = spark.createDataFrame([(i, i, "d") for i in range(4)], "mapping_id int, entity_id int, path string")
    ch = spark.createDataFrame([(0, "body", False, False, True), (1, "body", False, True, True), (2, "removed", False, False, True), (3, "body", False, False, None)], "entity_id int, category string, failed boolean, path_partial boolean, ordinal_shift boolean")
    got = {r.mapping_id: (r.outcome, r.reason) for r in overlays.drift(m, ch, spark.createDataFrame([("d", False)], "path string, changed boolean")).collect()}
    assert got == {0: ("unknown_history", "ordinal_shift"), 1: ("unknown_history", "path_partial"), 2: ("unknown_history", "ordinal_shift"), 3: ("review_needed", "source_changed")}


def test_relative_imports_need_an_initialiser_at_each_level(spark):
    i = spark.createDataFrame([(1, "a/b/c/m.py", 3, ["x"], "f"), (2, "a/b/c/m.py", 2, ["y"], "f"), (3, "p/q/m.py", 2, ["x"], "f")], "import_id int, path string, level int, module array<string>, name string")
    m = spark.createDataFrame([(p,) for p in ("a/__init__.py", "a/b/c/__init__.py", "a/x.py", "a/b/y.py", "p/__init__.py", "p/q/__init__.py", "p/x.py")], "path string")
    e = spark.createDataFrame([("a/x.py", "f", 1, False, False), ("a/b/y.py", "f", 2, False, False), ("p/x.py", "f", 3, False, False)], "path string, name string, line_start int, blocked boolean, conditional boolean")
    assert {r.import_id: (r.target_line, r.reason) for r in resolve.relative_imports(i, m, e).collect()} == {1: (None, "no_package"), 2: (None, "no_package"), 3: (3, None)}


def test_failed_and_unchanged_files(spark):
    from loomgraph.operators import diff

    kind = "entity_id long, path string, language string, kind string, name string, signature string, body string, line int"
    row = lambda i, path, body: (i, path, "python", "function", "n", "f(x)", body, 1)
    b, a = (diff.fingerprinted(spark.createDataFrame(x, kind)) for x in ([row(1, "a", "x"), row(2, "b", "x"), row(3, "c", "x")], [row(1, "a", "y"), row(4, "b", "x"), row(3, "c", "x")]))
    one = lambda p: spark.createDataFrame([(p,)], "path string")
    got = diff.aligned(b, a, failed=one("b"), same=one("c")).collect()
    assert {(r.entity_id, r.category) for r in got} == {(1, "body"), (2, "unknown"), (4, "unknown")}


def test_coverage_states_and_gap_reasons(spark):
    from pyspark.sql import functions as F

    from loomgraph.operators import overlays

    spans = spark.createDataFrame([("a", 1, True, True, False), ("a", 2, False, True, False), ("a", 3, True, False, False), ("a", 4, True, True, True), ("a", 5, True, True, False), ("a", 6, True, True, False), ("b", 7, True, True, False), ("c", 8, True, True, False), ("d", 9, True, True, False)], "path string, span_id int, applicable boolean, supported boolean, limited boolean")
    covered = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 4, True), ("a", 5, False)], "path string, span_id int, body boolean")
    files = lambda *x: spark.createDataFrame([(p,) for p in x], "path string")
    got = {r.span_id: r.state for r in overlays.coverage_state(spans, covered, files("a"), files("c"), files("a", "b")).collect()}
    assert got == {1: "executed", 2: "not_applicable", 3: "unsupported_language", 4: "observation_limit", 5: "declaration_only", 6: "no_observation_in_span", 7: "no_observation_in_file", 8: "stale_only", 9: "no_coverage_source"}
    d = spark.createDataFrame([("stale_only", "none"), ("executed", "found"), ("unsupported_language", "unsupported_language"), ("declaration_only", "incomplete")], "c string, s string")
    assert [r.g for r in d.select(overlays.gap_reasons(F.col("c"), F.col("s")).alias("g")).collect()] == [["no_structural_test", "stale_coverage_only"], [], ["unsupported_language"], ["declaration_only_execution", "structural_discovery_incomplete"]]


def test_incomplete_history_gives_no_records(spark):
    from loomgraph.operators import overlays

    c = spark.createDataFrame([(i, 1, p, "100644") for i in (1, 2, 3) for p in ("a", "b")], "commit_id int, parents int, path string, mode string")
    whole = spark.createDataFrame([(3, 2), (2, 1), (1, 0)], "commit_id int, parent_id int")
    records, reasons = overlays.co_change_overlay(c, whole, 1, 50)
    assert [(r.a, r.b, r.support) for r in records.collect()] == [("a", "b", 2)] and reasons == []
    records, reasons = overlays.co_change_overlay(c, spark.createDataFrame([(3, 2), (2, 9)], "commit_id int, parent_id int"), 1, 50)
    assert records.collect() == [] and reasons == ["object_missing"]
    assert overlays.co_change_overlay(c, whole, 1, 50, truncated=True)[1] == ["commit_budget_exhausted"]


def test_bounded_paths(spark):
    rows = [("t", 1, None), ("t", 2, 1), ("t", 3, 2), ("t", 4, 2), ("t", 5, 1), ("u", 7, 99), ("u", 8, 7), ("v", 9, None)]
    s = spark.createDataFrame(rows, "trace_id string, span_id long, parent_id long")

    def run(**limits):
        paths, totals = graph.bounded_paths(s, **limits)
        return [(r.trace_id, r.path, r.origin, r.truncated) for r in sorted(paths.collect(), key=lambda r: r.place)], tuple(totals.first())

    everything = [("t", [1, 2, 3], "trace_root", False), ("t", [1, 2, 4], "trace_root", False), ("t", [1, 5], "trace_root", False), ("u", [7, 8], "parent_not_in_artifact", False), ("v", [9], "trace_root", False)]
    assert run() == (everything, (5, False))
    assert run(max_paths=2) == (everything[:2], (5, True)) and run(max_paths=5) == (everything, (5, False))
    assert run(max_path_length=2) == ([("t", [1, 2], "trace_root", True), *everything[2:]], (5, True))
    assert run(max_path_length=1)[0] == [("t", [1], "trace_root", True), ("u", [7], "parent_not_in_artifact", True), ("v", [9], "trace_root", False)]
    none = graph.bounded_paths(s.limit(0))
    assert none[0].count() == 0 and tuple(none[1].first()) == (0, False)
    with pytest.raises(ValueError):
        graph.bounded_paths(s, max_paths=0)
