"""Copies of rows, and columns and ids that are easily lost, change nothing they shouldn't."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barlake.llm import decontam, langid, quality, sharding, tokenbin, toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(words, 60)) + (" you idiot moron" if i % 5 == 0 else "") + ("!!! ###" * 20 if i % 3 == 0 else "") for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    return docs, labels


def times(df, n):
    return df.withColumn("__n", F.explode(F.sequence(F.lit(1), F.lit(n)))).drop("__n").orderBy(F.rand(n))


@pytest.mark.parametrize("max_labelled", [100, 10_000])
def test_models_of_copies_are_the_same(labelled, max_labelled):
    docs, labels = labelled
    one = toxicity.train(docs, labels, max_labelled=max_labelled), quality.train(docs, labels, max_labelled=max_labelled)
    assert len(one[1].roots) > 0 and one[0].table.any()
    for n in (2, 5):
        toxic, trees = toxicity.train(times(docs, n), times(labels, 3), max_labelled=max_labelled), quality.train(times(docs, n), times(labels, 3), max_labelled=max_labelled)
        assert toxic.table.tobytes() == one[0].table.tobytes() and toxic.bias == one[0].bias
        assert all(np.array_equal(a, b) for a, b in zip(vars(trees).values(), vars(one[1]).values(), strict=True))


def test_an_id_of_two_labels_teaches_nothing(labelled):
    docs, labels = labelled
    torn = labels.unionByName(labels.where("doc_id % 2 = 0").withColumns({"toxic": 1 - F.col("toxic"), "quality": 1 - F.col("quality")}))
    kept = labels.where("doc_id % 2 = 1")
    assert toxicity.train(docs, torn).table.tobytes() == toxicity.train(docs, kept).table.tobytes()
    assert quality.train(docs, torn).value.tobytes() == quality.train(docs, kept).value.tobytes()


def test_the_toxic_sample_is_bounded_in_bytes(spark, labelled):
    docs, labels = labelled
    extra = spark.createDataFrame([(-1, "long " * 300_000), (-2, "long " * 300_000)], "doc_id long, text string")
    more = labels.select("doc_id", "toxic").unionByName(spark.createDataFrame([(-1, 1), (-2, 0)], "doc_id long, toxic int"))
    want = toxicity.train(docs, labels)
    got = toxicity.train(docs.select("doc_id", "text").unionByName(extra), more, max_bytes=2_000_000)  # neither long text fits in half of it
    assert got.table.tobytes() == want.table.tobytes() and got.bias == want.bias
    assert toxicity.train(docs, labels, max_bytes=0).bias == 0


def test_a_language_of_many_copies_is_drawn_whole(spark):
    docs = spark.createDataFrame([(i, f"der satz nummer {i}", "de") for i in range(300)] + [(1000 + i, f"sentence number {i}", "en") for i in range(300)], "doc_id long, text string, lang string")
    many = docs.where("lang = 'en'").unionByName(times(docs.where("lang = 'de'"), 1000))
    want = {tuple(r) for r in langid.sampled(docs, "doc_id", "text", "lang", 200).collect()}
    assert {tuple(r) for r in langid.sampled(many, "doc_id", "text", "lang", 200).collect()} == want and len(want) == 400


def test_an_item_without_an_id_contaminates_in_the_pipeline(spark, tmp_path):
    passage = " ".join(f"word{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "before it " + passage + " after it", "a", 7), (2, "nothing of that in here", "b", 8)], "doc_id long, text string, __tag string, __windows int")
    spark.createDataFrame([(None, passage), (3, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "nothing of that in here", "b", 8)]
    found = decontam.overlaps(docs.withColumn("__x", F.lit(5)), spark.read.parquet(str(tmp_path / "benchmark.parquet")))
    assert found.columns == [*docs.columns, "__x", "n_words", "hit_spans", "hit_items"]
    assert sorted((r["doc_id"], r["__tag"], r["__windows"], r["__x"], len(r["hit_spans"]), r["hit_items"]) for r in found.collect()) == [(1, "a", 7, 5, 1, []), (2, "b", 8, 5, 0, [])]


def test_another_tokenizers_ids_are_its_own(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["Plain English,  with two blanks.\n\nAnd lines", " leading", "", None, "Ünïcode 漢字 it's", "trailing \t"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in tokenbin.token_digest(tokenbin.write_tokens(docs, path, end_id=50256)).collect()}
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 50256]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    with open(path, "rb") as other, open(public_tokenizers.path("word_bpe_49k.json"), "rb") as own:
        assert not tokenbin.by_chunks(other.read()) and tokenbin.by_chunks(own.read())


def test_rows_of_one_text_without_ids_are_dealt_among_tasks(spark):
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    got = sharding.shards_of(rows, 8)
    assert got.where("shard = 0").count() == 100_000 and got.select("slot").distinct().count() == 100_000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tagged = rows.withColumn("tag", F.monotonically_increasing_id())
        sizes = [r["count"] for r in tagged.repartitionByRange(4, "text", "doc_id", "tag").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 60_000
