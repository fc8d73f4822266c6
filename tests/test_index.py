"""Ranked retrieval and phrases from the written index, against plain scoring of every document."""

import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import index, text
from loomgraph.operators.tables import released


def plain_tokens(t):
    t = "".join(x for c in t.lower() for x in (unicodedata.normalize("NFD", c) if unicodedata.category(c)[0] == "L" and all(unicodedata.category(m) == "Mn" for m in unicodedata.normalize("NFD", c)[1:]) else c))
    t = "".join(c for c in t if unicodedata.category(c) != "Mn").lower()
    return [w for w in re.split("|".join(sorted({re.escape(c) for c in t if unicodedata.category(c)[0] not in "LN" and unicodedata.category(c) != "Co"})) or " ", t) if w]


def plain_scores(docs, queries, top, k1=1.2, b=0.75):
    d = {i: plain_tokens(t or "") for i, t in docs}
    known = [len(d[i]) for i, t in docs if t is not None]
    avg = sum(known) / max(1, len(known))
    df = Counter(w for x in d.values() for w in set(x))
    out = {}
    for q, t in queries:
        scores = {}
        for i, x in d.items():
            c = Counter(x)
            hit = set(plain_tokens(t or "")) & set(c)
            if hit:
                scores[i] = -sum(math.log((len(d) - df[w] + 0.5) / (df[w] + 0.5) + 1) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * len(x) / avg)) for w in hit)
        for r, (s, i) in enumerate(sorted((round(s, 9), i) for i, s in scores.items())[:top]):
            out[q, r + 1] = (i, s)
    return out


def zipf(rng, n, vocabulary=400):
    return " ".join(f"w{min(vocabulary, int(rng.paretovariate(0.6)))}" for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_scoring_everything(spark, seed):
    rng = random.Random(seed)
    docs = [(i, zipf(rng, rng.randrange(1, 80))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "w1 " * 500)]
    docs += [(2000 + i, "w7 w9 w333 same text") for i in range(30)]
    # short queries with a rare and a common word are pruned, long ones are not; one repeats a word, one has none
    queries = [(i, zipf(rng, rng.randrange(1, 5))) for i in range(25)] + [(100, zipf(rng, 60)), (101, "w1 w1 W1"), (102, "nothing here"), (103, None), (104, "w1 w2 w3 w333"), (105, "w333 w1")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "query_id long, query string")
    want = plain_scores(docs, queries, 5)
    made = index.build(d, block=50)
    got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in index.search(made, q, 5).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-8) for k in want)
    plan = index._planned(made, q, 5)
    assert plan.filter("not needed").count() > 0 and plan.filter("rest = 0").count() > 0
    released(plan)
    made.drop()
    assert {(r.query_id, r.rank): r.doc_id for r in text.bm25(d, q, top=5).collect()} == {k: v[0] for k, v in want.items()}


def test_terms_that_cannot_reach_the_bound_find_no_documents(spark):
    """The common word's postings are looked up only for documents with the rare one."""
    docs = [(i, "common " + ("rare " * 3 if i < 20 else "") + f"x{i}") for i in range(3000)]
    made = index.build(spark.createDataFrame(docs, "doc_id long, text string"))
    q = spark.createDataFrame([(1, "rare common")], "query_id long, query string")
    plan = {r.term: r.needed for r in index._planned(made, q, 5).collect()}
    assert plan == {"rare": True, "common": False}
    want = plain_scores(docs, [(1, "rare common")], 5)
    assert {(1, r["rank"]): r.doc_id for r in index.search(made, q, 5).collect()} == {k: v[0] for k, v in want.items()}


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b")], "query_id long, query string")
    assert index.search(index.build(none), q).count() == 0
    one = spark.createDataFrame([(1, "a b a")], "doc_id long, text string")
    assert index.search(index.build(one), q.limit(0)).count() == 0
    assert [tuple(r) for r in index.search(index.build(one), q).select("query_id", "doc_id", "rank").collect()] == [(1, 1, 1)]


def test_phrases_by_position(spark):
    rows = [(1, "a b a b"), (2, "a-B"), (3, "b a"), (4, None), (5, "aa b"), (6, "a a a a a"), (7, "Á b"), (8, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = lambda p: {r.doc_id: r.n for r in text.phrase(d, p).collect()}
    assert got("a b") == {1: 2, 2: 1, 7: 1}
    assert got("a a") == {6: 2} and got("b") == {1: 2, 2: 1, 3: 1, 5: 1, 7: 1} and got("a b a") == {1: 1} and got("-") == {}
    whole = index.build(d, positions=True)
    assert {r.doc_id: r.n for r in index.phrase(whole, ["a", "b"]).collect()} == {1: 2, 2: 1, 7: 1}


def test_folding_of_all_characters(spark):
    # the JVM may know an older Unicode than Python does
    known = spark.sparkContext._jvm.java.lang.Character
    codes = [c for c in range(1, 0x3000) if known.isDefined(c)] + [0xE000, 0xE123, 0x1D15E, 0x110AB, 0xFB1D]
    rows = [(c, f"x{chr(c)}y") for c in codes]
    got = {r.c: r.t for r in spark.createDataFrame(rows, "c int, t string").select("c", text.tokens(F.col("t")).alias("t")).collect()}
    odd = [hex(c) for c, t in rows if got[c] != plain_tokens(t)]
    assert not odd
    got = spark.createDataFrame([("Őr šal Ǖx ﬁ ø i̇",)], "t string").select(text.tokens(F.col("t")).alias("t")).first().t
    assert got == ["or", "sal", "ux", "ﬁ", "ø", "i"]
