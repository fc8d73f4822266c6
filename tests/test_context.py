"""Task context on a small project: all kinds of atoms, admission, order, inline text."""

import base64

from loomgraph.operators import context

FILES = {"a.py": b"def a():\n  b()\n", "b.py": "# ü\ndef b(): pass\n".encode(), "bin": b"\xff\xfe\x00abc"}


def world(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content binary")
    entities = spark.createDataFrame([("A", "a.py", "m", 0, 14), ("B", "b.py", "m", 5, 18), ("C", "gone.py", "n", 0, 5), ("D", "bin", "n", 0, 3), ("E", "a.py", None, None, None)], "entity_id string, path string, owner string, start_byte long, end_byte long")
    rows = [(1, "A", "B", "call", "EXTRACTED", "a.py", 11, 12), (2, "B", "C", "call", "INFERRED", "b.py", 0, 4), (3, "A", "D", "call", "AMBIGUOUS", "a.py", 0, 1), (4, "A", "E", "import", "EXTRACTED", "a.py", 0, 1), (5, "C", "D", "call", "EXTRACTED", "gone.py", 1, 2)]
    assertions = spark.createDataFrame(rows, "assertion_id long, source string, target string, relation string, confidence string, path string, start_byte long, end_byte long")
    return entities, files, assertions


def candidates(spark, rows):
    return spark.createDataFrame(rows, "query_id long, place int, tier int, kind string, id string")


def atoms(c):
    return {(r.query_id, r.place): (r.kind, r.atom_id, r.distance) for r in c.atoms.collect()}


def test_all_kinds_of_atoms(spark):
    entities, files, assertions = world(spark)
    c = candidates(spark, [(1, 1, 3, "entity", "A"), (1, 2, 4, "file", "bin"), (1, 3, 4, "entity", "C"), (1, 4, 4, "entity", "none"), (2, 1, 4, "entity", "A"), (2, 2, 4, "file", "b.py"), (3, 1, 0, "entity", "E")])
    q = spark.createDataFrame([(1, None), (2, "C"), (3, None), (4, None)], "query_id long, target string")
    got = context.assembled(c, entities, files, assertions, q, context.Limits(depth=2))
    assert atoms(got) == {
        # the anchor; then one atom of each file a round, files by their best atom
        (1, 1): ("definition", "A", 0), (1, 2): ("relationship", "1", 1), (1, 3): ("relationship", "2", 2), (1, 4): ("lexical_file", "bin", 0), (1, 5): ("definition", "C", 0), (1, 6): ("relationship", "5", 1),
        (2, 1): ("definition", "A", 0), (2, 2): ("lexical_file", "b.py", 0), (2, 3): ("path", "A 1 2", 2),
        (3, 1): ("definition", "E", 0),
    }
    text = {(r.query_id, r.place, r.source_no): (r.inline if r.encoding != "base64" else base64.b64decode(r.inline), r.reason) for r in got.sources.collect()}
    assert text == {
        (1, 1, 0): ("def a():\n  b()", None), (1, 2, 0): ("b", None), (1, 3, 0): ("# ü", None), (1, 4, 0): (FILES["bin"], None), (1, 5, 0): (None, "source_unavailable"), (1, 6, 0): (None, "source_unavailable"),
        (2, 1, 0): ("def a():\n  b()", None), (2, 2, 0): (FILES["b.py"].decode(), None), (2, 3, 0): ("b", None), (2, 3, 1): ("# ü", None),
        (3, 1, 0): (None, "source_unavailable"),
    }
    ends = {(r.query_id, r.seed): (r.outcome, r.stop_reason) for r in got.frontiers.collect()}
    assert ends == {(1, "A"): ("partial", "depth_limit"), (1, "C"): ("complete", None), (2, "A"): ("complete", None), (3, "E"): ("complete", None)}
    assert {r.query_id: r.stop_reason for r in got.outcomes.collect()} == {1: None, 2: None, 3: None, 4: None}


def test_collection_stops_at_the_first_that_does_not_fit(spark):
    entities, files, assertions = world(spark)
    c = candidates(spark, [(1, 1, 3, "entity", "A"), (1, 2, 4, "file", "bin")])
    q = spark.createDataFrame([(1, None)], "query_id long, target string")
    run = lambda **k: context.assembled(c, entities, files, assertions, q, context.Limits(**k))
    got = run(atoms=1)
    assert [v[1] for v in atoms(got).values()] == ["A"] and got.outcomes.first().stop_reason == "bundle_limit" and got.frontiers.count() == 0
    got = run(atoms=2)
    assert sorted(v[1] for v in atoms(got).values()) == ["A", "bin"] and got.outcomes.first().stop_reason == "bundle_limit" and got.frontiers.count() == 1
    # 106 and 105 bytes of candidates; the frontier of A takes 64 + 1 + 7 + 11
    got = run(bytes=106)
    assert sorted(v[1] for v in atoms(got).values()) == ["A"] and got.outcomes.first().stop_reason == "collection_limit"
    assert len(atoms(run(bytes=211))) == 2 and len(atoms(run(bytes=211 + 83 + 106))) == 3 and len(atoms(run(bytes=211 + 83 + 105))) == 2
    small = {r.place: (r.inline, r.reason) for r in run(inline=8).sources.collect()}
    assert small[1] == (None, "inline_budget") and {x for x in small.values()} >= {("b", None), ("# ü", None)}
