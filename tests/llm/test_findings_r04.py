"""Findings of round 4: near duplicates gather only groups that are apart, in waves of words."""

import random

from loomgraph.llm import jaccard_join
from loomgraph.llm.jaccard_join import jaccard_components


def _near_copies(spark, n, seed=1):
    """Copies of one text of 200 words with one word of their own each, so all link with the first."""
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(n):
        words = list(base)
        words[i % 200] = f"own{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"x{r.randrange(5000)}" for _ in range(50))) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def _spied(monkeypatch):
    made = []
    real = jaccard_join.written

    def written(df, label, narrow=False):
        out = real(df, label, narrow)
        made.append((label, out.count()))
        return out

    monkeypatch.setattr(jaccard_join, "written", written)
    return made


def test_f1_connected_groups_are_not_gathered_again(spark, monkeypatch):
    made = _spied(monkeypatch)
    got = {r.doc_id: r.component_id for r in jaccard_components(_near_copies(spark, 40), 5, 8, 10).collect()}
    assert all(got[i] == 0 for i in range(40)) and all(got[1000 + i] == 1000 + i for i in range(20))
    assert not any(label == "members" and n for label, n in made)


def test_f1_waves_give_what_one_pass_gives(spark, monkeypatch):
    docs = _near_copies(spark, 60, 2).union(_near_copies(spark, 30, 3).selectExpr("doc_id + 5000", "text"))
    one = sorted(map(tuple, jaccard_components(docs, 5, 8, 10).collect()))
    monkeypatch.setattr(jaccard_join, "WAVE", 10)
    made = _spied(monkeypatch)
    assert sorted(map(tuple, jaccard_components(docs, 5, 8, 10).collect())) == one
    assert sum(label == "met" for label, _ in made) == jaccard_join.WAVES
