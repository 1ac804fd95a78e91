"""Running totals over a global order, without a window that holds all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.sources.shared import stored, tasks_for

ROWS_PER_TASK = 2_000_000


def running_before(df: DataFrame, order: str, values: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """df, whose `order` column is unique, with `before_<value>`: the sum of the value over all rows of lesser order.

    Rows are dealt by range and written once, so that both readings below see the same parts; sums run within a part and are shifted
    by the totals of the parts before, of which there is one row a task. An empty table gives no rows."""
    df = stored(df, "counted")  # computed once, for the count and for the ranges
    parts = tasks_for(df.count(), rows_per_task, df.sparkSession)
    dealt = stored(df.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id()), "dealt")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    shifts = dealt.groupBy("__part").agg(*(F.sum(v).alias(f"__{v}") for v in values))
    shifts = shifts.select("__part", *(F.coalesce(F.sum(f"__{v}").over(before), F.lit(0)).alias(f"__{v}") for v in values))
    within = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({f"before_{v}": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values})
    return local.join(F.broadcast(shifts), "__part").select(*df.columns, *((F.col(f"before_{v}") + F.col(f"__{v}")).alias(f"before_{v}") for v in values))
