"""The pipeline stage by stage, each on what the one before it kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm.jaccard_join import jaccard_stage
from loomgraph.llm.language import identify, language_stage
from loomgraph.llm.quality import classify, quality_stage
from loomgraph.llm.suffix_dedup import suffix_stage
from llm_plain import jaccard_plain, near_copies, removed_plain, repeated_texts, table

SF = "/root/testdata/sf0.001"


def test_stages_return_documents_and_keep_clean_ones(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]
    before = docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert out.schema.names == docs.schema.names and out.count() <= before
            assert out.join(docs, "doc_id", "left_anti").count() == 0
            before = out.count()
        docs = out
    assert docs.select("doc_id").distinct().count() == before
    whole = corpus_pipeline.run(spark, SF)
    rows = lambda d: sorted(map(tuple, d.drop("sequence_id", "offset").collect()))
    assert rows(whole) == rows(docs)


def test_a_run_goes_on_where_another_stopped(spark, tmp_path, monkeypatch):
    called = []

    def stage(name, out):
        return name, lambda spark, docs, sf_dir: called.append(name) or out(docs)

    def lost(docs):
        raise RuntimeError("lost")

    one, two = stage("one", lambda d: d.filter("doc_id < 100")), stage("two", lambda d: d.filter("doc_id < 50"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [one, stage("two", lost)])
    with pytest.raises(RuntimeError, match="lost"):
        corpus_pipeline.run(spark, SF, str(tmp_path))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [one, two])
    assert corpus_pipeline.run(spark, SF, str(tmp_path)).count() == 50 and called == ["one", "two", "two"]


def test_run_on_odd_tables(spark, tmp_path):
    rows = [(1, "one two", "en", None, 7), (1, "one two", "en", None, 7), (2, None, None, None, None), (None, "three four", "de", "s", 10), (3, "", "en", "s", 0), (4, "lorem ipsum dolor " * 20000, "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for i, some in enumerate(([], rows)):
        spark.createDataFrame(some, schema).withColumn("good", F.lit("x")).write.parquet(f"{tmp_path}/{i}/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/0").count() == 0
    got = corpus_pipeline.run(spark, f"{tmp_path}/1")
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert {r.doc_id for r in got.collect()} <= {1, 3, 4, None}


def test_quality_stage_keeps_what_the_classifier_calls_good(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = classify(docs).filter("good").select("doc_id")
    kept = quality_stage(spark, docs, SF)
    assert kept.join(good, "doc_id", "left_anti").count() == good.join(kept, "doc_id", "left_anti").count() == 0


def test_language_stage_drops_texts_without_letters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(table(spark, ["123 ...", None, ""], 10**9))
    kept = language_stage(spark, docs, SF)
    assert kept.filter(F.col("doc_id") >= 10**9).count() == 0 and kept.count() == docs.count() - 3
    said = identify(docs).select("doc_id", "lang_pred").join(kept.select("doc_id", "lang"), "doc_id")
    assert said.count() == kept.count() and said.filter("not (lang <=> lang_pred)").count() == 0
    unlabelled = docs.withColumn("lang", F.when(F.col("doc_id") % 5 > 0, F.col("lang")))
    assert language_stage(spark, unlabelled, SF).filter("lang is null").count() == 0


def test_jaccard_stage_keeps_one_of_each_group(spark):
    texts = near_copies(9)
    want = {c for _, n, c in jaccard_plain(texts, 5, 8, 10)}
    d = table(spark, texts)
    assert {r.doc_id for r in jaccard_stage(spark, d, SF).collect()} == want
    twice = d.union(d)
    assert sorted(r.doc_id for r in jaccard_stage(spark, twice, SF).filter(F.length(F.trim("text")) > 3).collect()) == sorted(i for i in want if len((texts[i] or "").strip()) > 3)


def test_suffix_stage_cuts_repeats(spark):
    texts = [t for t in repeated_texts(2) if t is None or t.isascii()]
    want = removed_plain(texts)
    got = {r.doc_id: r.text for r in suffix_stage(spark, table(spark, texts), SF).collect()}
    assert {i: None if t is None else len(t) for i, t in got.items()} == {i: None if texts[i] is None else n - r for i, (_, n, r, _, _) in want.items()}


@pytest.mark.parametrize("stage", [quality_stage, language_stage, jaccard_stage, suffix_stage])
def test_stages_on_an_empty_table_and_with_more_columns(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30).withColumn("good", F.lit(1)).withColumn("db", F.lit("x"))
    assert stage(spark, docs, SF).columns == docs.columns
    assert stage(spark, docs.filter("doc_id < 0"), SF).count() == 0


def test_language_stage_without_labels_drops_only_letterless_texts(spark):
    docs = spark.createDataFrame([(1, "plain words", None), (2, "12 34", None), (3, None, None), (4, "äß", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in language_stage(spark, docs, SF).collect()) == [1, 4]
