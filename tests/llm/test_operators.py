"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import bisect
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import common, embedding_dedup, jaccard_join, language, packing, pieces, quality, sharding, suffix_dedup, topk
from loomgraph.llm.common import components, written

from llm_plain import DOCS, jaccard_plain, joined, near_copies, removed_plain, repeated_texts, table

SF = "/root/testdata/sf0.001"


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = joined({x for p in pairs for x in p}, pairs)
    alone = {a for a, b in pairs if a == b}
    assert got == {i: c for i, c in want.items() if i in got} and all(i in got or i in alone for i in want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_links_need_no_rounds(spark, monkeypatch):
    rng = np.random.default_rng(2)
    nodes = rng.permutation(2000).tolist()
    pairs = [*zip(nodes[:1000], nodes[1:1000]), *[(int(a), int(b)) for a, b in rng.choice(nodes[1000:], (600, 2))]]
    want = joined({x for p in pairs for x in p}, pairs)
    tables = []
    monkeypatch.setattr(common, "written", lambda df, label, narrow=False: tables.append(label) or written(df, label, narrow))
    for few, most in ((common.FEW_LINKS, 2), (0, 100)):
        monkeypatch.setattr(common, "FEW_LINKS", few)
        tables.clear()
        got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert got == {i: c for i, c in want.items() if i in got} and len(got) >= 1000 and len(tables) <= most


# 1


def test_quality_follows_gold_labels_without_seeing_them(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality.classify(d).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    bad, good = got[got.quality == 0], got[got.quality == 1]
    assert (~bad.good).mean() > 0.85 and good.good.mean() > 0.98
    assert got.quality_score.between(0, 1).all()


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.8
    hit = np.array([0.98, 0.97, 0.99, 0.95])
    miss = np.array([0.5, 0.6, 0.4, 0.7])
    v = np.where(y[:, None], rng.random((20000, 4)) < hit, rng.random((20000, 4)) > miss).astype(int)
    v[rng.random(v.shape) < 0.2] = -1
    p, n = np.unique(v, axis=0, return_counts=True)
    _, acc, share = quality.em(p, n)
    assert np.abs(acc[:, 0] - hit).max() < 0.05 and np.abs(acc[:, 1] - miss).max() < 0.15 and abs(share - 0.8) < 0.1


# 2


def best_path(p, word):
    """Highest score of all cuts of a marked word, by trying each."""
    best = [0.0] + [-np.inf] * len(word)
    for i in range(1, len(word) + 1):
        for j in range(i):
            s = p.score[word[j:i]][0] if word[j:i] in p.score else p.unknown if i - j == 1 else -np.inf
            best[i] = max(best[i], best[j] + s)
    return best[-1]


def test_pieces_find_the_best_path_and_round_trip(spark):
    import pyarrow as pa

    p = pieces.loaded(pieces.default_model())
    texts = ["", "  a  b ", "\n\nx\n", "a\x1fb  c", "日本語 \U0001f600 x", " ", "\t", None, "The thingeawh of  the\nworld"] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    at, ids = p.encode(pa.array(texts, pa.string()))
    back_at, back = p.decode(at, ids)
    for i, t in enumerate(texts):
        assert back[back_at[i] : back_at[i + 1]].tobytes().decode() == (t or "")
    names = {i: (s, q) for q, (s, i) in p.score.items()}
    word_at, words = p.split(pa.array(["thing eawh ofthe", "xylophone über 7"]))
    for w in sorted(set(words.to_pylist())):
        if w:
            (raw,) = p.paths([w])
            got = np.frombuffer(raw, np.int32).tolist()
            assert sum(names[i][0] if i in names else p.unknown / len(w[0].encode()) for i in got) == pytest.approx(best_path(p, w)) or any(i not in names for i in got)
    # one word at a time gives what shared prefixes give
    many = sorted({w for w in words.to_pylist() if w} | {"▁the", "▁then", "▁there", "▁a", "▁an", "▁and"})
    assert p.paths(many) == [p.paths([w])[0] for w in many]
    d = pieces.digest(table(spark, texts)).collect()
    assert all(r.round_trip for r in d)
    again = pieces.decode(pieces.encode(table(spark, texts), ["doc_id"]), ["doc_id"])
    assert {r.doc_id: r.text for r in again.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_pieces_equal_the_library(spark, tmp_path):
    """The default file's pieces read as unigrams by the library itself. The file holds scores of -1e9, between which the
    library's single precision cannot tell paths apart, so scores are scaled to where it can; nothing is trained."""
    import pyarrow as pa
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(pieces.default_model(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for x in model.pieces:
        if x.type == 1:
            x.score = max(x.score, -32768.0) / 4096
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    library, p = sentencepiece.SentencePieceProcessor(model_file=path), pieces.loaded(path)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) > 0").collect()]
    lines = [x for t in texts for x in t.split("\n") if x and len(x) < 2000] + ["日本 \U0001f600x", "a  b   c", "é" * 40, "hest entebest"]
    at, ids = p.encode(pa.array(lines))
    assert len(lines) > 1500
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library.encode(x) for x in lines]


# 3


def test_topk_with_ties_odd_vectors_and_waves(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (450, 8)) / 4
    x[7], x[200] = x[100], x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (600, [1.0, float("nan")] * 4), (700, [1.0, None] * 4)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.quantised("embedding").alias("w"), F.lit(1).alias("score"))
    q = np.floor(1024 * x).astype(int)
    want = set()
    for i in range(0, 450, 100):
        order = sorted((-int(q[i] @ q[j]), j) for j in range(450) if j != i)[:10]
        want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(order)}
    for wave in (50_000, 2):
        assert {tuple(r) for r in topk.top_k(e.repartition(3), e.filter("vec_id % 100 = 0"), 10, wave).collect()} == want
    few = topk.top_k(e.filter("vec_id < 3"), e.filter("vec_id = 0"))
    assert few.count() == 2 and topk.top_k(e.filter("vec_id < 0"), e.filter("vec_id < 0")).count() == 0


def test_topk_of_repeated_rows(spark):
    """Every row but the query's own is a candidate, and every query row has its ranks."""
    rows = [(0, [1.0]), (0, [1.0]), (0, [0.25]), (1, [0.5]), (1, [0.5]), (100, [2.0]), (200, None), (None, [1.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", topk.quantised("embedding").alias("w"), F.lit("x").alias("rank"))
    some = [(i, int(1024 * v[0])) for i, v in rows if i is not None and v]
    for k in (10, 2, 1):
        want = []
        for x, (i, v) in enumerate(some):
            if i % 100 == 0:
                best = sorted((-v * w, j) for y, (j, w) in enumerate(some) if y != x)[:k]
                want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
        for wave in (50_000, 1):
            assert sorted(tuple(r) for r in topk.top_k(e.repartition(2), e.filter("vec_id % 100 = 0"), k, wave).collect()) == sorted(want)


# 4


def test_language_on_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(d).join(d.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_learns_nothing_from_held_out_or_other_columns(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    other = d.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    one, two = (sorted(map(tuple, language.identify(x).collect())) for x in (d, other))
    assert one == two


# 6


def jump_plain(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark):
    texts = [None, "", "é", "a" * 70] + [f"t{i % 40}" for i in range(2000)]
    got = sharding.shard_documents(table(spark, texts)).toPandas().sort_values("doc_id")
    assert got["shard"].tolist() == [jump_plain(i, 8) for i in range(len(texts))] and got["grown_shard"].tolist() == [jump_plain(i, 9) for i in range(len(texts))]
    assert got["size"].tolist() == [len((t or "").encode()) + 1 for t in texts] and got["text_crc32"].tolist() == [zlib.crc32((t or "").encode()) for t in texts]
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    moved = got[got["shard"] != got["grown_shard"]]
    assert (moved["grown_shard"] == 8).all() and 0.07 < len(moved) / len(got) < 0.16
    assert sharding.jump(np.array([5, 6], np.uint64), 1).tolist() == [0, 0]


def test_write_shards(spark, tmp_path):
    d = table(spark, ["x", "y", "z"]).drop("lang")
    sharding.write_shards(d, "doc_id", 4, str(tmp_path / "s"))
    assert {r.doc_id: r.shard for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {i: jump_plain(i, 4) for i in range(3)}


# 7

@pytest.mark.parametrize("k, num, den", [(4, 85, 100), (5, 8, 10)])
def test_jaccard_components_against_all_pairs(spark, k, num, den):
    texts = near_copies(k)
    got = {tuple(r) for r in jaccard_join.jaccard_components(table(spark, texts), k, num, den).collect()}
    assert got == jaccard_plain(texts, k, num, den)


def test_jaccard_chain_of_many_near_copies(spark):
    """A large group in which most pairs are too far apart, but every next one is near."""
    rng = np.random.default_rng(5)
    w, texts = [f"w{x}" for x in rng.integers(0, 9999, 150)], []
    for i in range(300):
        w[int(rng.integers(0, 150))] = f"n{i}"
        texts.append(" ".join(w))
    got = {tuple(r) for r in jaccard_join.jaccard_components(table(spark, texts), 4, 85, 100).collect()}
    assert got == jaccard_plain(texts, 4, 85, 100)


def test_jaccard_group_of_texts_that_share_most_words(spark, monkeypatch):
    """One passage makes up most of every text, so all share words, but few link; the group is compared in many parts."""
    monkeypatch.setattr(jaccard_join, "SIDE", 60_000)
    monkeypatch.setattr(jaccard_join, "ROWS", 40)
    rng = np.random.default_rng(12)
    passage = [f"p{x}" for x in range(170)]
    texts = []
    for i in range(300):
        if i % 10 == 7:
            w = texts[int(rng.integers(0, len(texts)))].split()
            w[int(rng.integers(0, len(w)))] = f"e{i}"
        else:
            w = passage + [f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(55, 75)))]
        texts.append(" ".join(w))
    want = jaccard_plain(texts, 5, 8, 10)
    assert 20 < len(texts) - len({c for *_, c in want}) < 40
    assert {tuple(r) for r in jaccard_join.jaccard_components(table(spark, texts), 5, 8, 10).collect()} == want


def test_a_buckets_size_does_not_follow_a_groups(spark):
    """Near copies of one text: what stands in a word's bucket is one member for each task, the others are dealt evenly."""
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    most, spread = [], []
    for n in (1000, 4000):
        texts = []
        for i in range(n):
            w = list(base)
            w[int(rng.integers(300))] = f"own{i}"
            texts.append(" ".join(w))
        docs = table(spark, texts).coalesce(2)
        rows = jaccard_join._emit(docs, 5, jaccard_join.Bands(8, 10), 400).groupBy("bucket").agg(*[F.sum(F.length(c)).alias(c) for c in ("keys", "pairs", "large")]).toPandas()
        most.append(rows["keys"].max())
        spread.append((rows[["pairs", "large"]].max() / rows[["pairs", "large"]].mean()).max())
    # words with an own shingle are keys too and follow the documents; they fall evenly
    assert most[1] < 4.5 * most[0] and spread[1] < 2.5
    docs = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(0, 300, 2)] * 3
    got = jaccard_join.jaccard_components(table(spark, docs), 5, 8, 10)
    assert {tuple(r) for r in got.collect()} == jaccard_plain(docs, 5, 8, 10)


# 8


def test_embedding_links_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    centre = rng.standard_normal((80, 64))
    x = np.concatenate([c + rng.standard_normal((8, 64)) * np.sqrt(rng.choice([0.04, 0.07, 0.08])) for c in centre])
    x[5] = x[4]
    label = rng.integers(0, 3, len(x))
    rows = [(i, v.tolist(), int(lab)) for i, (v, lab) in enumerate(zip(x.astype(np.float32), label))]
    rows += [(9000, None, 1), (9001, [0.0] * 64, 1), (9002, [float("inf")] * 64, 1), (9003, x[0].tolist(), None), (9004, [None] * 64, 1), (9005, [1.0, 0.0], 1), (9006, [1.0, 0.01], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit("clash"))
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(d.repartition(4)).collect()}
    y = x.astype(np.float32).astype(float)
    s = (y @ y.T) / np.outer(np.linalg.norm(y, axis=1), np.linalg.norm(y, axis=1))
    near = (s >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    found = sum(got[i].n_links for i in range(len(x)))
    assert all(got[i].n_links <= near[i].sum() for i in range(len(x))) and found >= 0.99 * near.sum() > 100
    comp = joined(range(len(x)), zip(*np.nonzero(near)))
    assert np.mean([got[i].component_id == comp[i] for i in range(len(x))]) > 0.99
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(9000, 9005))
    assert (got[9006].n_links, got[9006].component_id, got[9006].kept) == (1, 9005, False)


def test_embedding_chunks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 20)
    rng = np.random.default_rng(3)
    x = rng.standard_normal(16) + rng.standard_normal((120, 16)) * 0.02
    d = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_duplicates(d).collect()
    assert {r.n_links for r in got} == {119} and {r.component_id for r in got} == {0}


def test_embedding_copies_are_one_class(spark, monkeypatch):
    """5,000 equal vectors make one class: the join meets one row of it, and links count its rows."""
    seen = []
    plain = embedding_dedup.decoded
    monkeypatch.setattr(embedding_dedup, "decoded", lambda classes, *a: seen.append(classes.count()) or plain(classes, *a))
    rng = np.random.default_rng(3)
    x = rng.standard_normal(16)
    near, far = x + rng.standard_normal(16) * 0.02, rng.standard_normal(16)
    rows = [(i, x.tolist(), 0) for i in range(10, 5010)] + [(5, near.tolist(), 0), (6, far.tolist(), 0), (7, x.tolist(), 1), (10, x.tolist(), 0)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert seen == [4]
    assert (got[5].n_links, got[5].component_id) == (5000, 5) and (got[6].n_links, got[7].n_links) == (0, 0)
    assert {(got[i].n_links, got[i].component_id, got[i].kept) for i in range(10, 5010)} == {(5000, 5, False)}


# 9


def best_fit(lengths, capacity):
    """Sequences of plain best-fit decreasing."""
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        gap = gaps.pop(i) if i < len(gaps) else capacity
        n += i == len(gaps) and gap == capacity
        bisect.insort(gaps, gap - x)
    return n


@pytest.mark.parametrize("seed", range(4))
def test_a_round_gives_each_document_the_successor_gap(spark, seed):
    """Sweeps of ranges and what meets across them against one stack that is really built."""
    rng = np.random.default_rng(seed)
    cap = (12, 40, 300, 300)[seed]
    lengths = rng.integers(1, cap + 1, (150, 200, 90, 4)[seed]).tolist()
    gaps = rng.integers(1, cap + 1, (120, 60, 200, 90)[seed]).tolist()
    stack, want = [], []
    for size, is_doc in sorted([(-g, False) for g in gaps] + [(-n, True) for n in lengths]):
        if is_doc:
            want.append((-size, stack.pop() if stack else None))
        else:
            stack.append(-size)
    names = ["doc_id", "length"]
    docs = spark.createDataFrame([(i, n, None, None) for i, n in enumerate(lengths)], "doc_id long, length long, sequence_id long, gap long")
    rows = docs.union(spark.createDataFrame([(None, None, i, g) for i, g in enumerate(gaps)], docs.schema))
    key = [-F.coalesce("gap", "length"), F.col("sequence_id").isNull(), F.xxhash64("doc_id", "sequence_id")]
    swept = written(packing._swept(rows.repartitionByRange(5, *key).sortWithinPartitions(*key), names, np.ones(cap + 1, np.int64), cap), "swept")
    met = written(packing._met(swept, names, cap), "met")
    got = met.filter("gap is null").drop("gap").unionByName(swept.filter("offset is not null").select(*names, "sequence_id", "offset")).collect()
    taken = {g: n for n, g in ((r.length, r.sequence_id) for r in got if r.sequence_id is not None)}
    open_ = met.filter("gap is not null").select("sequence_id", "gap").unionByName(swept.filter("gap is not null and __at is null").select("sequence_id", "gap")).collect()
    assert sorted((r.sequence_id, r.gap) for r in open_) == [(i, g - taken.get(i, 0)) for i, g in enumerate(gaps)]
    none = lambda p: (p[0], p[1] or 0)
    assert sorted(none((r.length, None if r.sequence_id is None else gaps[r.sequence_id])) for r in got) == sorted(map(none, want))
    used = [r.sequence_id for r in got if r.sequence_id is not None]
    assert len(set(used)) == len(used) and all(r.offset == cap - gaps[r.sequence_id] for r in got if r.sequence_id is not None)
    assert swept.select("__part").distinct().count() > 2


@pytest.mark.parametrize("low, high, rows", [(1, 256, 700), (1, 12, 900), (100, 200, 150), (256, 256, 40), (1, 1, 600)])
def test_packing_is_close_to_plain_best_fit(spark, monkeypatch, low, high, rows):
    rng = np.random.default_rng(rows)
    lengths = [int(x) for x in rng.integers(low, high + 1, rows)]
    d = spark.createDataFrame([(i, 0, 0, n, i % 5) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    monkeypatch.setattr(packing, "ALONE", 0 if rows % 4 else 200_000)
    got = packing.place(d, 256).toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(got.length) == sorted(lengths)
    total = got.groupby("sequence_id").length
    assert (got.offset == total.cumsum() - got.length).all() and total.sum().max() <= 256
    assert len(total) <= 1.02 * best_fit(lengths, 256) + 1


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", "a<|endoftext|>b", "I'll  don't 123\t", "word " * 700, "x y " * 300] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(80).collect()]
    got = packing.pack(table(spark, texts), 256).toPandas()
    for i, text in enumerate(texts):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length)]
        assert (own.length.iloc[1:] == 256).all() and (len(own) == 1) == (len(ids) <= 256)
    g = got.sort_values(["sequence_id", "offset"])
    total = g.groupby("sequence_id").length
    assert (g.offset == total.cumsum() - g.length).all() and total.sum().max() <= 256
    assert got.sequence_id.nunique() <= 1.03 * -(-got.length.sum() // 256) + 1
    seq = {r.sequence_id: r.ids for r in packing.sequences(table(spark, texts), 256).collect()}
    assert {k: len(v) // 4 for k, v in seq.items()} == total.sum().to_dict()


# 10


def test_suffix_dedup_against_all_strings(spark):
    texts = repeated_texts(4)
    want = removed_plain(texts)
    d = table(spark, texts)
    assert {r.doc_id: tuple(r) for r in suffix_dedup.removed(d).collect()} == want
    kept = {r.doc_id: r for r in suffix_dedup.deduplicated(d).collect()}
    for i, t in enumerate(texts):
        assert (kept[i].text is None) == (t is None) and kept[i].n_chars == (None if t is None else len(kept[i].text))
        if t is not None and t.isascii():
            assert len(kept[i].text) == want[i][1] - want[i][2]


def test_suffix_dedup_by_whole_strings(spark, monkeypatch):
    """Parts over their bound, as an anchor in very many contexts makes them, are told apart by strings."""
    monkeypatch.setattr(suffix_dedup, "MOST", 0)
    texts = repeated_texts(6) + [f"{i:05d}" + "the same anchor words stand in many contexts " * 3 + f"{i * 7 % 90:04d}" for i in range(300)]
    assert {r.doc_id: tuple(r) for r in suffix_dedup.removed(table(spark, texts)).collect()} == removed_plain(texts)


def test_suffix_dedup_of_a_long_text_and_of_null_ids(spark):
    rng = np.random.default_rng(8)
    long = "".join(rng.choice(list("abcdefghij"), 1_200_000))
    texts = [long[5000:5300], long + long[700_000:700_200], "x" * 50 + long[1_048_500:1_048_700]]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.removed(table(spark, texts)).collect()}
    assert got == {0: 0, 1: 500, 2: 200}
    one, two = ("".join(rng.choice(list("abcdefghij"), 400)) for _ in range(2))
    rows = [(None, one), (None, one), (None, two + one[:150]), (3, one), (3, two), (None, None), (None, "short")]
    got = suffix_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in got)[:2] == [("3", 400, 400), ("3", 400, 400)]
    assert sorted((r.n_bytes, r.n_removed) for r in got if r.doc_id is None) in ([(0, 0), (5, 0), (400, 0), (400, 0), (550, 150)], [(0, 0), (5, 0), (400, 150), (400, 150), (550, 0)])


# every operator: nulls, empty tables, repeated rows, clashing columns

OPERATORS = {
    "quality": lambda d: quality.classify(d),
    "pieces": lambda d: pieces.digest(d),
    "language": lambda d: language.identify(d),
    "sharding": lambda d: sharding.shard_documents(d),
    "jaccard": lambda d: jaccard_join.jaccard_components(d, 4, 85, 100),
    "packing": lambda d: packing.pack(d),
    "suffix": lambda d: suffix_dedup.removed(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edge_cases(spark, name):
    f = OPERATORS[name]
    empty = spark.createDataFrame([], DOCS)
    assert f(empty).count() == 0
    long = "lorem ipsum dolor " * 20000
    rows = [(1, "one two", "en", None, 7), (1, "one two", "en", None, 7), (2, None, None, None, None), (None, "three", "de", "s", 5), (None, None, None, None, None), (3, "", "en", "s", 0), (4, long, "en", "s", len(long)), (5, "123 !!", None, "s", 6)]
    d = spark.createDataFrame(rows, DOCS)
    clash = d
    for c in ("good", "ids", "shard", "slot", "size", "law", "h", "n", "u", "v", "length", "db", "score", "component_id", "id", "key"):
        clash = clash.withColumn(c, F.lit("x"))
    out = f(clash)
    assert out.columns == f(empty).columns
    got = out.collect()
    assert len([r for r in got if r.doc_id == 1]) == 2 and len([r for r in got if r.doc_id is None]) == 2
    assert sorted(map(str, got)) == sorted(map(str, f(d.repartition(5)).collect())) or name == "packing"


def test_vector_edge_cases(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    d = spark.createDataFrame([(None, [1.0, 0.0], 1), (None, None, None), (1, [], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)], schema)
    got = embedding_dedup.near_duplicates(d).collect()
    assert len(got) == 6 and {r.component_id for r in got if r.vec_id == 2} == {1}
