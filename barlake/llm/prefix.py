"""Running totals over a global order, without a window that holds all rows in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.llm.store import materialize, row_count_tasks

ROWS_PER_TASK = 2_000_000


def running_totals(df: DataFrame, order: list[str], values: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """df, written to the shared folder in ascending order of the `order` columns, with `row_index` (rows before) and
    `before_<value>` (sum of the value over rows before).

    Rows are dealt by range, so that a task holds an even share whatever the key counts are; sums run within a task
    and are shifted by the totals of the tasks before, of which there is one row a task. Nulls order first and add
    nothing; tied rows follow one another in any order; an empty table gives an empty table."""
    spark = df.sparkSession
    tasks = row_count_tasks(df.count(), rows_per_task, spark)
    added = [T.StructField(x, T.LongType()) for x in ("part", "row_index", *(f"before_{v}" for v in values))]
    schema = T.StructType([*df.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, sums = TaskContext.get().partitionId(), 0, dict.fromkeys(values, 0)
        for batch in batches:
            n = batch.num_rows
            new = [pa.array(np.full(n, part)), pa.array(np.arange(seen, seen + n))]
            for v in values:
                own = batch.column(batch.schema.get_field_index(v)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.cumsum(own) + sums[v]
                new.append(pa.array(upto - own))
                sums[v] = int(upto[-1]) if n else sums[v]
            seen += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    dealt = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(run, schema)
    local = materialize(dealt, "ordered")
    totals = local.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *(F.sum(v).alias(f"sum_{v}") for v in values))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    shifts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_shift"), *(F.coalesce(F.sum(f"sum_{v}").over(before), F.lit(0)).alias(f"shift_{v}") for v in values))
    return local.join(F.broadcast(shifts), "part").select(*df.columns, (F.col("row_index") + F.col("n_shift")).alias("row_index"), *((F.col(f"before_{v}") + F.col(f"shift_{v}")).alias(f"before_{v}") for v in values))
