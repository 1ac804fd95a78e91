"""Thin queries: each applies an operator with production parameters to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import decontam, langid, linedup, mixing, ordermh, pii, quality, repair, sharding, simhash, tokenbin, toxicity, whitening
from barlake.llm.queries_sql import ORACLES
from barlake.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = tokenbin.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return tokenbin.token_digest(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def _fold(folds: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(_fold(5) != 0))
    return langid.identified(docs.select("doc_id", "text"), model).select("doc_id", (_fold(5) == 0).alias("held_out"), "lang_pred", "score")


def op3_private_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key=pii.key_of(spark))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermh.classes(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digest(decontam.overlaps(docs, table(spark, sf_dir, "benchmark"), keep_text=False))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(_fold(3) != 1))
    return toxicity.scored(docs, model).select("doc_id", (_fold(3) == 1).alias("held_out"), "score", "predicted")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linedup.deduplicated(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shards_of(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.judged(docs, trees).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with a fifth of the rows dropped, emptied, cut, repeated or given to the user."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    harm = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    worse = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), harm.alias("harm")).where("harm <> 0")
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("harm") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), worse.alias("text"), times.alias("time")).drop("time")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report = repair.reported(repair.edited(damaged(conversations)))
    every = conversations.select(F.col("conv_id").alias("id")).distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return every.join(report, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    rows = whitening.whitened(vectors, model)
    error = whitening.identity_error(rows)
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues[: whitening.COMPONENTS])).cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_binary, op2_language_id, op3_private_pseudonyms, op4_order_minhash, op5_decontamination, op6_source_mix, op7_toxicity, op8_line_dedup, op9_sharding, op10_quality_rules, op11_conversation_repair, op12_whitening, op13_simhash)}


def oracle_sql() -> dict[str, str]:
    return ORACLES
