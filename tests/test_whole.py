"""Queries take all rows of their tables."""

import os

import pytest
from pyspark.sql import functions as F

from loomgraph import registry
from loomgraph.plans.projection import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture
def run(spark, tmp_path):
    """Result rows of a query over the smallest tables, some of them replaced."""

    def go(name, **tables):
        for t in TABLES:
            if t in tables:
                tables[t].write.parquet(f"{tmp_path}/{t}.parquet")
            else:
                os.symlink(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
        return registry.queries()[name](spark, str(tmp_path)).collect()

    return go


def lines(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_linenumber").distinct().collect()


def ends(r):
    e = (f"s{r.l_suppkey}", f"p{r.l_partkey}")
    return e if r.l_linenumber % 2 else e[::-1]


def test_every_line_is_an_assertion(spark, run):
    kind = {r: ("call" if r.l_linenumber % 3 else "import", {0: "AMBIGUOUS", 1: "EXTRACTED"}.get(r.l_linenumber % 5, "INFERRED")) for r in lines(spark)}
    b = {(kind[r][0], *ends(r)) for r in kind if kind[r][1] != "EXTRACTED"}
    a = {(kind[r][0], *ends(r)) for r in kind if kind[r][1] != "INFERRED"}
    want = {x: "introduced" if x not in b else "resolved" if x not in a else "persisting" for x in a | b}
    assert {(r.rule_id, r.source, r.target): r.delta for r in run("rule_delta")} == want


def test_neighborhood_over_all_lines(spark, run):
    step = {}
    for r in lines(spark):
        if r.l_linenumber % 3 and r.l_linenumber % 5:
            s, t = ends(r)
            step.setdefault(s, set()).add(t)
    want = {}
    for seed in ("s1", "s7", "s42"):
        level = {seed}
        for k in range(4):
            want |= {(seed, x): k for x in level}
            level = {y for x in level for y in step.get(x, ())} - {x for s, x in want if s == seed}
    assert {(r.seed, r.node): r.distance for r in run("neighborhood")} == want


def test_communities_hold_every_end(spark, run):
    assert {r.node for r in run("communities")} == {x for r in lines(spark) if r.l_linenumber % 5 for x in ends(r)}


def test_every_item_is_asked_with_its_whole_text(spark, run):
    far = "x " * 60 + "zanzibar"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = docs.limit(1).withColumns({"doc_id": F.lit(7777).cast("long"), "text": F.lit("zanzibar")})
    items = spark.createDataFrame([(3, "nothing"), (41, far)], "item_id long, text string")
    assert [(r.query_id, r.doc_id) for r in run("bm25", documents=docs.unionByName(one), benchmark=items) if r.doc_id == 7777] == [(41, 7777)]


def test_context_pack_of_every_item(spark, run):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    one = docs.limit(1).withColumns({"doc_id": F.lit(7777).cast("long"), "text": F.lit("zanzibar")})
    items = spark.createDataFrame([(41, "x " * 60 + "zanzibar")], "item_id long, text string")
    assert (41, 7777) in {(r.query_id, r.doc_id) for r in run("context_pack", documents=docs.unionByName(one), benchmark=items)}


def test_exact_tiers_of_late_documents(spark, run):
    """By id, label, path and name, each before the next; what one tier has the later ones leave out."""
    rows = [(500, "one", "src4", "xx"), (501, "two", "src5", "xx"), (9, "three", "src9", "xx"), (43, "four", "src3", "en"), (503, "five", "src7", "en"), (1003, "six", "src4", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    items = spark.createDataFrame([(3, "absent")], "item_id long, text string")
    assert [(r.doc_id, r.tier) for r in sorted(run("retrieval_tiers", documents=docs, benchmark=items), key=lambda r: r.place)] == [(9, 0), (43, 1), (500, 2), (1003, 2), (503, 3)]


def test_bodies_are_compared_to_their_end(spark, run):
    doc = lambda i, end: (i, "h" * 20 + "x " * 50_000 + end, "en", "src1", 100_020 + len(end))
    docs = spark.createDataFrame([doc(46, "one"), doc(92, "two")], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.before_id, r.after_id) for r in run("rename_candidates", documents=docs)) == [(46, 1_000_000_046), (92, 1_000_000_092)]


def plain_lines(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber").collect()


def test_endpoints_of_all_lines(spark, run):
    parts = {r.p_partkey for r in spark.read.parquet(f"{SF}/part.parquet").collect() if r.p_partkey % 9}
    want = sorted((r.l_orderkey * 10 + r.l_linenumber, side) for r in plain_lines(spark) for side, x in (("source", r.l_suppkey), ("target", r.l_partkey if r.l_linenumber > 1 else None)) if x is not None and x not in parts)
    assert sorted((r.assertion_id, r.side) for r in run("dangling_endpoints")) == want


def test_proofs_of_all_lines(spark, run):
    part = spark.read.parquet(f"{SF}/part.parquet").withColumn("p_size", (F.col("p_partkey") % 50 + 1).cast("int"))
    supplier = {r.s_suppkey for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}
    want = sorted(r.l_orderkey * 10 + r.l_linenumber for r in plain_lines(spark) if r.l_partkey in supplier and (r.l_partkey + 1) % 7 < 6)
    assert sorted(r.assertion_id for r in run("proof_hydration", part=part)) == want != []


def test_evidence_of_all_lines(spark, run):
    tests = {(r.l_partkey, f"t{r.l_suppkey % 20}") for r in plain_lines(spark)}
    got = {(r.span_id, r.test): r.basis for r in run("validation_plan")}
    assert tests <= set(got) and all(got[x] <= 3 for x in tests)


def test_no_gap_where_a_line_is(spark, run):
    state = {r.span_id: r.state for r in run("validation_states")}
    assert {state[r.l_partkey] for r in plain_lines(spark)} <= {"observed", "structural_only"}


def test_all_events_are_merged(spark, run):
    want = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").collect():
        want.setdefault((r.user_id, r.event_type), set()).add(r.event_id % 3)
    assert {(r.user_id, r.event_type): (r.verdict, r.conflict) for r in run("merged_events")} == {k: (min(v), len(v) > 1) for k, v in want.items()}


def test_feedback_of_late_users(spark, run):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("user_id", F.col("user_id") + 1_000_001)
    states = {r.state for r in run("feedback_states", events=e)}
    assert {"active", "path_not_indexed"} <= states


def test_late_customers_are_ranked(spark, run):
    c = spark.read.parquet(f"{SF}/customer.parquet").withColumn("c_custkey", F.col("c_custkey") + 300)
    assert {r["item"] for r in run("feedback_ranking", customer=c)} == set(range(300, 450))


def test_all_declarations_resolve(spark, run):
    assert all(r.full_name for r in run("ruby_namespace"))


def test_all_routes_have_their_action(spark, run):
    assert {r.outcome for r in run("rails_routes")} <= {"INFERRED", "AMBIGUOUS"}


def test_late_models_and_jobs(spark, run):
    p = spark.read.parquet(f"{SF}/part.parquet").limit(1).withColumns({"p_size": F.lit(1), "p_type": F.lit("X13")})
    s = spark.read.parquet(f"{SF}/supplier.parquet").limit(1).withColumn("s_suppkey", F.lit(13).cast("long"))
    assert [(r.outcome, r.model) for r in run("rails_associations", part=p, supplier=s)] == [("INFERRED", "A::X13")]


def test_jobs_of_late_suppliers(spark, run):
    # 49 counts as 28, so Job28 has two performs; Job31 has one of 1 to 2 arguments
    s = spark.read.parquet(f"{SF}/supplier.parquet").limit(3).withColumn("s_suppkey", F.element_at(F.array(*map(F.lit, (28, 49, 31))), (F.col("s_suppkey") + 1).cast("int")).cast("long"))
    e = spark.read.parquet(f"{SF}/events.parquet").filter("event_id in (0, 5, 10)").withColumns({"user_id": F.element_at(F.array(*map(F.lit, (28, 31, 32))), (F.col("event_id") / 5 + 1).cast("int")).cast("long"), "value": F.lit(1.5)})
    assert {r.call_id: r.outcome for r in run("rails_jobs", supplier=s, events=e)} == {0: "AMBIGUOUS", 5: "INFERRED", 10: "job_not_found"}


def test_names_of_all_symbols(spark, run):
    p = spark.read.parquet(f"{SF}/part.parquet").withColumn("p_partkey", F.col("p_partkey") + 300)
    li = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_partkey", F.col("l_partkey") + 300)
    assert {r.name for r in run("impact_boundaries", part=p, lineitem=li)} == {f"{r.p_name}/{r.p_type}/{r.p_size}" for r in p.collect()}


def test_probe_of_all_names(spark, run):
    name = {r.p_partkey: f"{r.p_name}/{r.p_type}" for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    want = {(name[r.l_partkey], r.l_suppkey) for r in plain_lines(spark) if r.l_suppkey % 4 == 0}
    assert len(run("same_name_probe")) == len(want)
