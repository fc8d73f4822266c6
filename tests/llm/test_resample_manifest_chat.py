"""Operators 11 to 13 against plain versions that follow their contracts word by word."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import chat, manifest, resample
from loomgraph.llm.common import positions, written

from llm_plain import DOCS, table

SF = "/root/testdata/sf0.001"


def test_positions_in_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(("a", "b", "c")[int(g)], int(x)) for g, x in zip(rng.choice(3, 900, p=[0.8, 0.15, 0.05]), rng.integers(0, 40, 900))]
    got = positions(written(spark.createDataFrame(rows, "g string, x long").repartition(3), "t"), ["g"], ["x"], "at", "all").collect()
    for g in "abc":
        mine = sorted((r.at, r.x, r.all) for r in got if r.g == g)
        assert [a for a, _, _ in mine] == list(range(len(mine))) and [x for _, x, _ in mine] == sorted(x for h, x in rows if h == g)
        assert {n for _, _, n in mine} == {len(mine)}


# 11

_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, n):
    words = _WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + k]) for i in range(len(words)) for k in range(1, n + 1) if i + k <= len(words)]


def resampled(docs, bench, n=1, buckets=10000, percent=10, least=20):
    """(doc_id, n_features, weight, score, rank) rows of (doc_id, text) pairs."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for f in features(text, n)[1]:
            s[bucket(f)] += 1
    for text in bench:
        for f in features(text, n)[1]:
            t[bucket(f)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (S + buckets) / ((a + 1) * (T + buckets)))) for a, b in zip(s, t)]
    rows = []
    for doc, text in docs:
        words, found = features(text, n)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1]))
    drawn = [(*r[:4], i + 1) for i, r in enumerate(able[: len(able) * percent // 100])]
    return drawn + [(*r[:4], None) for r in able[len(drawn) :]] + [(*r[:4], None) for r in rows if r[4] < least]


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_resampling_of_whole_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = resample.op11_importance_resampling(spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    same(got.collect(), resampled(docs, bench))


@pytest.mark.parametrize(("n", "nodes"), [(1, 50), (3, 1 << 18), (3, 40)])
def test_resampling_of_odd_texts_long_runs_and_small_tries(spark, n, nodes):
    rng = np.random.default_rng(n)
    words = ["Ab", "ÄÖ", "x9", "éa", "日本", "the", "THE", "z"]
    texts = [None, "", "  \n", "one", " ".join(["word"] * 500), "@[`{a\x7fb"] + [" ".join(rng.choice(words, int(rng.integers(1, 60)))) for _ in range(40)]
    docs = [(i // 2 if i < 8 else i, t) for i, t in enumerate(texts)] + [(7, "the x9 " * 15)] * 9 + [(None, "null id " * 20)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("n_words", F.lit("x")).withColumn("__low", F.lit(1))
    target = ["the x9 the z", None, ""]
    got = resample.resample(d, spark.createDataFrame([(t,) for t in target], "text string"), 30, 5, n, 97, nodes=nodes).collect()
    same(got, resampled(docs, target, n, 97, 30, 5))
    none = d.filter("doc_id < -1")
    assert resample.resample(none, none).count() == 0
    assert resample.resample(d, none, 100, 0).filter("rank is null").count() == 0


def test_words_of_a_text_in_pieces():
    text = "Ab cd-ef  " * 50 + "ü" * 90 + " z"
    whole = features(text, 2)[1]
    trie, got = resample.Trie(), 0
    for words, k in resample.starts(pa.scalar(text), 2, piece=16):
        for at in trie.walk(words, k, 2):
            trie.number[at] += 1
            got += 1
    assert got == len(whole)
    want = np.zeros(1000, int)
    for f in whole:
        want[zlib.crc32(f.encode()) % 1000] += 1
    assert (trie.totals(1000) == want).all()


# 12


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """Every level of the tree above ``nodes``."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path_of(levels, at):
    """(siblings before, siblings after) for each level."""
    for level in levels[:-1]:
        lo = at - at % 3
        yield level[lo:at], level[at + 1 : lo + 3]
        at //= 3


def manifest_plain(rows):
    """Rows (doc_id, source, lang, n_chars, text) to the query's rows."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: sha(*map(field, r))
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in sources[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(sources[s]):
            path = [*path_of(trees[s], i), *path_of(top, k)]
            change = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf((*r[:4], r[4].replace("\n", ""))) if change else leaf(r)
            for a, b in path:
                node = sha(*a, node, *b)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha(*(x for a, b in path for x in a + b)), node, node == top[-1][0]))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 80, 243, 250])
@pytest.mark.parametrize("band", [1, 2, 4])
def test_traversal_of_one_block(n, band):
    leaves = [sha(str(i)) for i in range(n)]
    levels = tree(leaves)
    for extra in (0, 2):  # blocks of larger trees have levels above their own top
        *steps, (root, _) = manifest.traverse([x.encode() for x in leaves], manifest.levels_of(n) + extra, band)
        want = levels[-1][0]
        for _ in range(extra):
            want = sha(want)
        assert root.decode() == want
        for i, (path, places) in enumerate(steps):
            assert path.decode() == "".join(x for a, b in path_of(levels, i) for x in a + b)
            assert manifest.folded(leaves[i].encode(), path, places) == root


def test_traversal_holds_small_subtrees():
    leaves = [sha(str(i)).encode() for i in range(729)]
    tree_of = manifest.Subtree(leaves, 0, 2, 3).whole()
    assert sum(map(len, tree_of.nodes)) == 9 + 3 + 1
    high = manifest.Subtree(leaves, 4, 6, 0)
    most = 0
    while high.at < high.end:
        high.step()
        most = max(most, sum(map(len, high.nodes)))
    assert most <= 13 + 4 * 3


@pytest.mark.parametrize("height", [6, 1, 2])
def test_manifest_of_odd_rows(spark, height):
    rng = np.random.default_rng(height)
    names = [None, "", "a", "Z", "é", "-", "src0"]
    rows = [(int(rng.integers(0, 90)), names[int(rng.choice(7, p=[0.05, 0.05, 0.6, 0.1, 0.1, 0.05, 0.05]))], None if i % 9 == 0 else "en", None if i % 7 == 0 else i % 5, (None, "", "a\nb", "x", "é\n\n" * 40)[i % 5]) for i in range(150)]
    rows += [(5, "a", "en", 1, "same\nrow")] * 40 + [(None, "a", None, None, None), (None, None, None, None, "\n")]
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3).withColumn("leaf", F.lit(1)).withColumn("root", F.lit("r"))
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = manifest.document_manifest(d, odd, F.translate("text", "\n", ""), height)
    same(got.collect(), manifest_plain(rows))
    assert manifest.document_manifest(d.filter("doc_id < 0"), odd, F.col("text")).count() == 0


def test_manifest_of_documents(spark):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = manifest.op12_merkle_manifest(spark, SF)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    same(got.collect(), manifest_plain(rows))


# 13


def chat_plain(rows):
    """Rows (conv_id, turn, role, text) to digests and formatted texts."""
    null = lambda x: (x is not None, x if x is not None else 0)
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    out, texts = [], {}
    for c, turns in convs.items():
        turns.sort(key=lambda r: (null(r[1]), r[2] is not None, r[2] or "", r[3] or ""))
        esc = lambda t: re.sub(r"\\|#(?=##)|<(?=/turn>)", r"\\\g<0>", t)
        role = lambda r: re.sub(r"[\\:#<]", r"\\\g<0>", r[2] or "")
        texts[c] = "".join(f"### {role(r)}: {esc(r[3] or '')}</turn>\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        out.append((c, len(turns), sha(said), len(loss), sha(loss), len(texts[c])))
    return out, texts


HARD = ["\\### Assistant: </turn> ok", "####", "#####\\", "\\\\", "</turn", "</turn></turn>\n", "<</turn>", "##", "#", "", None, "a: b\n### user: x", "é日\U0001f600\\n", "\\</turn>"]


def test_conversations_as_given(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, i, r, "\\### Assistant: </turn> ok") for i, r in enumerate(("user", "assistant"))]
    got = chat.op13_chat_formatting(spark, SF)
    assert got.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    same(got.collect(), chat_plain(rows)[0])


@pytest.mark.parametrize("block", [1 << 22, 150, 1])
def test_conversations_with_hard_texts(spark, block):
    rng = np.random.default_rng(block)
    roles = ["assistant", "user", "system", None, "", "a:b", "\\", "###", "</turn>", "x\ny", "rôle"]
    rows = [(int(rng.choice([1, 2, 3, 4, 900])), t, roles[int(rng.integers(len(roles)))], "".join(str(HARD[int(k)] or "") for k in rng.integers(0, len(HARD), 3))) for t in range(200)]
    rows += [(50, t, "assistant", x) for t, x in enumerate(HARD)] + [(51, None, "assistant", None), (None, 0, None, "null"), (None, 1, "assistant", "x")]
    rows += [(60, 3, "assistant", "tie")] * 3 + [(61, 0, "assistant", "long # </turn> " * 20000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).withColumn("part", F.lit("x")).withColumn("formatted", F.lit(1))
    made = written(chat.format_conversations(d, block), "formatted")
    want, texts = chat_plain(rows)
    same(chat.read_back(made).collect(), want)
    parts = {}
    for r in sorted(made.collect(), key=lambda r: r.part):
        parts[r.conv_id] = parts.get(r.conv_id, "") + r.formatted
        raw = r.formatted.encode()
        assert all(raw[b : b + 7] == b"</turn>" for b in r.loss_end)
    assert parts == texts
    assert chat.read_back(chat.format_conversations(d.filter("conv_id < 0"))).count() == 0
