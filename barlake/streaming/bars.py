"""Bars from streams of events (Structured Streaming)."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.functions.exprs import THRESHOLD, touch_event
from barlake.sources.shared import fresh_path, tasks_for
from barlake.sources.writers import upsert_table


def event_stream(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The files of a Parquet table as a stream; `ts` becomes a timestamp, which a watermark needs. A stream reads a folder: for a
    table that is a single file it is the folder that holds it, filtered by the file's name."""
    files = events.inputFiles()
    folder = files[0].rpartition("/")[0]
    names = {f.rpartition("/")[2] for f in files}
    pattern = names.pop() if len(names) == 1 else "*.parquet"
    return spark.readStream.schema(events.schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_bars(events: DataFrame, key: str = "event_type", width: str = "60 minutes", late: str = "1 hour") -> DataFrame:
    """OHLCV bars per key and tumbling window, emitted once the watermark passes the window's end; later events are dropped."""
    at = F.struct("ts", "event_id")
    v = F.col("value").cast("double")
    bars = events.where("value IS NOT NULL").withWatermark("ts", late).groupBy(F.window("ts", width), F.col(key).alias("symbol"))
    made = bars.agg(F.min_by(v, at).alias("open"), F.max(v).alias("high"), F.min(v).alias("low"), F.max_by(v, at).alias("close"), (F.count(F.lit(1)) * 100_000).cast("long").alias("volume"))
    return made.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def drain(stream: DataFrame, path: str | None = None, state_tasks: int | None = None) -> DataFrame:
    """Run a stream over what is there now into a Parquet table, and read it. `state_tasks`: over how many tasks its state is dealt; each costs every
    trigger a few files, so a stream of few keys takes few. Without it as many as the session's shuffle partitions."""
    spark = stream.sparkSession
    path = path or fresh_path(spark, "stream")
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}_log").outputMode("append").trigger(availableNow=True)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", state_tasks or tasks)
        query = writer.start()  # takes the session's settings as they are now
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def arriving(ticks: DataFrame, batch: str, path: str, ticks_per_file: int = 250_000) -> DataFrame:
    """ticks as a stream in which those of each value of the column `batch` arrive together, in its order: what a late feed looks like to the jobs below.

    The ticks of a value are written as so many files, after those of lesser values, and as many files make a trigger. The values are few: the driver
    writes them one after another, from a table in which each has a folder, so the ticks themselves are read once. A value's files are the
    same in number for all, so a value must have ticks for each file from one of the tasks that deal them."""
    spark = ticks.sparkSession
    sorted_out, own = f"{path}_values", ticks.drop(batch).schema
    ticks.withColumn("arrives", F.col(batch)).drop(batch).write.partitionBy("arrives").parquet(sorted_out)
    kept = spark.read.schema(own.add("arrives", ticks.schema[batch].dataType)).parquet(sorted_out)
    sizes = {r[0]: r[1] for r in kept.groupBy("arrives").agg(F.count(F.lit(1))).collect()}
    parts = {value: kept.where(F.col("arrives") == value).drop("arrives") for value in sorted(sizes)}
    files = -(-max(sizes.values(), default=1) // ticks_per_file)
    if files > 1:
        files = max(1, min(files, *(sizes[value] // part.rdd.getNumPartitions() for value, part in parts.items())))
    for part in parts.values():
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(path)
    return spark.readStream.schema(own).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def drain_counted(stream: DataFrame, path: str | None = None) -> tuple[DataFrame, int]:
    """`drain`, and how many rows the watermark dropped as too late. Spark counts them where it keeps state, after the partial aggregation of a
    trigger: the late ticks of a task, key and window are one."""
    spark = stream.sparkSession
    path = path or fresh_path(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}_log").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise StreamingQueryException(str(query.exception()))
    dropped = sum(state.numRowsDroppedByWatermark for progress in query.recentProgress for state in progress.stateOperators)
    return spark.read.schema(stream.schema).parquet(path), dropped


def stream_upsert(bars: DataFrame, table: str, keys: list[str], partition: str) -> None:
    """Merge a stream of bars into a keyed table: a bar that is sent again replaces the one before."""
    spark = bars.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            upsert_table(spark, table, batch, keys, partition)

    bars.writeStream.foreachBatch(merge).option("checkpointLocation", f"{table}_log").trigger(availableNow=True).start().awaitTermination()


def stream_movers(ticks: DataFrame, days: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Ticks that reach the day's open plus the threshold, with `days` (symbol, date, open, high_glitch_suspect) as the static side."""
    joined = ticks.join(days, ["symbol", "date"])
    return joined.withColumn("high_return", F.try_divide(F.col("value") - F.col("open"), F.col("open"))).where(touch_event(threshold=threshold - 1e-9))
