"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barlake.session import ship_package
from barlake.sources import shared


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset on a single machine, and an error on a cluster."""
    ship_package(spark)
    return shared.shared_dir(spark)


def fresh_path(spark: SparkSession, name: str) -> str:
    ship_package(spark)
    return shared.fresh_path(spark, name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later steps neither recompute it nor
    depend on what a single executor holds."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more. The caller has written all that stands on them."""
    for table in tables:
        shared.remove(table.sparkSession, table.stored_at)


def row_count_tasks(rows: int, per_task: int, spark: SparkSession) -> int:
    """Tasks for so many rows: at least the session's shuffle partitions, more where a task would get over per_task."""
    return shared.tasks_for(rows, per_task, spark)
