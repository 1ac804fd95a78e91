"""Keyed table maintenance on Parquet: merges are DataFrames, writes replace only the partitions they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.operators.exits import valid_ledger_rows
from barlake.sources.shared import fresh_path, remove


def upsert_by_key(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, one a key: the new one counts. Of several new rows of a key the one whose other columns are greatest counts, in
    the order of the columns (nulls least), whatever order they come in; existing rows likewise."""
    order = [F.desc("__new"), *(F.desc(c) for c in existing.columns if c not in keys)]
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n", "__new")


def overwrite_partitions(spark: SparkSession, path: str, rows: DataFrame, partition: list[str]) -> None:
    """Replace the partitions of the table at path that rows hold. The rows are staged first, since a plan can't overwrite what it reads;
    the stage is removed afterwards, and also if the write fails."""
    stage = fresh_path(spark, "stage")
    try:
        rows.write.parquet(stage)
        spark.read.schema(rows.schema).parquet(stage).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)
    finally:
        remove(spark, stage)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: list[str], partition: str) -> DataFrame:
    """Merge new rows into the table at path, which is partitioned by a column of the key. Only partitions that new rows touch
    are read and rewritten."""
    touched = new.select(partition).distinct()
    old = spark.read.parquet(path).join(F.broadcast(touched), partition, "left_semi")  # a row a partition
    overwrite_partitions(spark, path, upsert_by_key(old.select(*new.columns), new, keys), [partition])
    return spark.read.parquet(path)


def replace_slice(existing: DataFrame, new: DataFrame, slice_keys: list[str], *, run_ts: Column, keep_created: bool = True, **stamps: Column) -> DataFrame:
    """existing without the slices that new holds, and new. A replaced slice keeps its first `created_ts` if keep_created."""
    slices = new.select(*slice_keys).distinct()
    kept = existing.join(slices, slice_keys, "left_anti")
    created = run_ts
    if keep_created:
        before = existing.groupBy(*slice_keys).agg(F.min("created_ts").alias("__first"))
        new = new.join(before, slice_keys, "left")
        created = F.coalesce("__first", run_ts)
    stamped = new.withColumns({"created_ts": created, **stamps})
    return kept.unionByName(stamped.select(*kept.columns))


def keep_earliest(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new).groupBy("symbol").agg(F.min("from_date").alias("from_date"))


def record_experiment(spark: SparkSession, ledger_path: str, daily_path: str, row: DataFrame, daily: DataFrame) -> None:
    """Append an experiment: daily rows first, then the ledger row as the commit marker that readers join on. Refuses unfit daily rows."""
    if daily.count() != valid_ledger_rows(daily).count():
        raise ValueError("daily rows with an unknown hit, a non-finite return, or one extreme without the other")
    daily.write.mode("append").parquet(daily_path)
    row.write.mode("append").parquet(ledger_path)


def recorded_experiments(spark: SparkSession, ledger_path: str, daily_path: str) -> tuple[DataFrame, DataFrame]:
    """Ledger and daily rows as readers see them: daily rows without a ledger row were never committed."""
    ledger = spark.read.parquet(ledger_path)
    return ledger, spark.read.parquet(daily_path).join(ledger.select(F.col("id").alias("seq")), "seq", "left_semi")


def record_paper(spark: SparkSession, path: str, trades: DataFrame, strategy: str, recorded_ts: Column) -> DataFrame:
    """Write forward trades as slices of (strategy, rule, target_date): a day recorded again is replaced, others stay."""
    keys = ["strategy", "rule", "target_date"]
    overwrite_partitions(spark, path, trades.withColumns({"strategy": F.lit(strategy), "recorded_ts": recorded_ts}), keys)
    return spark.read.parquet(path)
