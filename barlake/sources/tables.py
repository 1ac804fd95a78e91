"""Reading base tables, and building bars from event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from barlake.functions.exprs import split_artifact, valid_bar


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks_to_bars(ticks: DataFrame, keys: list, order: list[str], value: str = "value", lot: int = 100_000) -> DataFrame:
    """One OHLCV bar per key: first and last value in `order`, extremes, and number of ticks times `lot`.

    One shuffle, pre-aggregated on the map side; ticks without value are left out."""
    at = F.struct(*order)
    v = F.col(value).cast("double")
    return (
        ticks.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.min_by(v, at).alias("open"), F.max(v).alias("high"), F.min(v).alias("low"), F.max_by(v, at).alias("close"), (F.count(F.lit(1)) * lot).cast("long").alias("volume"))
    )


def user_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each user's event values."""
    events = read_table(spark, sf_dir, "events")
    return ticks_to_bars(events, [F.col("user_id").cast("string").alias("symbol"), F.to_date("ts").alias("date")], ["ts", "event_id"])


def user_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("symbol"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("market_cap"), F.to_date(F.lit("2024-01-01")).alias("as_of"), F.col("c_mktsegment").alias("sector"))


def nation_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long history: daily unit-price bars of each supplier nation."""
    lines = read_table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    supplier = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    keys = [F.col("s_nationkey").cast("string").alias("symbol"), F.to_date("l_shipdate").alias("date")]
    return ticks_to_bars(lines.join(supplier, "l_suppkey"), keys, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "price")


def nation_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region, supplier = (read_table(spark, sf_dir, n) for n in ("nation", "region", "supplier"))
    caps = supplier.groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("market_cap"))
    named = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).join(caps, F.col("n_nationkey") == F.col("s_nationkey"))
    return named.select(F.col("n_nationkey").cast("string").alias("symbol"), F.col("n_name").alias("name"), "market_cap", F.to_date(F.lit("2024-01-01")).alias("as_of"), F.col("r_name").alias("sector"))


def session_bars(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    """Intraday bars of each event type; `ts` is the bar's start."""
    events = read_table(spark, sf_dir, "events")
    start = F.window(F.col("ts").cast("timestamp"), f"{minutes} minutes")["start"]
    bars = ticks_to_bars(events.withColumn("bar_ts", start), [F.col("event_type").alias("symbol"), F.col("bar_ts")], ["ts", "event_id"])
    return bars.select("symbol", F.col("bar_ts").alias("ts"), F.to_date("bar_ts").alias("date"), F.lit(f"{minutes}m").alias("interval"), "open", "high", "low", "close", "volume")


def type_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each event type: the days that the sessions of `session_bars` belong to."""
    events = read_table(spark, sf_dir, "events")
    return ticks_to_bars(events, [F.col("event_type").alias("symbol"), F.to_date("ts").alias("date")], ["ts", "event_id"])


def wide_bars(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """One row a date with columns <symbol>_open .. <symbol>_volume: the shape in which providers send a batch of symbols."""
    fields = ("open", "high", "low", "close", "volume")
    return bars.groupBy("date").pivot("symbol", symbols).agg(*(F.first(f).alias(f) for f in fields))


def long_bars(wide: DataFrame, symbols: list[str]) -> DataFrame:
    """(date, <symbol>_open .. <symbol>_volume) columns to one row per symbol and date. A symbol's row is there if any of its fields is."""
    fields = ("open", "high", "low", "close", "volume")
    each = [F.struct(F.lit(s).alias("symbol"), *(F.col(f"{s}_{f}").cast("double").alias(f) for f in fields)) for s in symbols]
    rows = wide.select("date", F.explode(F.array(*each)).alias("bar")).select("bar.symbol", "date", *(f"bar.{f}" for f in fields))
    return rows.where(F.coalesce(*fields).isNotNull())


def bar_reasons(bars: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """bars with `reason`: null (kept), `null_price`, `invalid` or `split_artifact`. seeds: (symbol, seed_date, seed_close), the last stored
    bars, which stand before a symbol's first bar if strictly earlier."""
    priced = bars.withColumn("ok", valid_bar()).withColumn("no_price", F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull())
    w = Window.partitionBy("symbol", "ok").orderBy("date")
    before = priced.withColumn("prev_close", F.lag("close").over(w))
    if seeds is not None:
        before = before.join(seeds, "symbol", "left").withColumn("prev_close", F.coalesce("prev_close", F.when(F.col("seed_date") < F.col("date"), F.col("seed_close")))).drop("seed_date", "seed_close")
    reason = F.when(F.col("no_price"), "null_price").when(~F.col("ok"), "invalid").when(split_artifact(), "split_artifact")
    return before.withColumn("reason", reason).drop("ok", "no_price", "prev_close")


REASONS = ("null_price", "invalid", "split_artifact")


def write_daily_bars(judged: DataFrame, path: str) -> dict[str, int]:
    """Write the kept rows of `bar_reasons` and return how many were kept and how many each cause dropped: all counted while the one job that
    writes them passes over the rows."""
    watch = Observation()
    counts = [F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in REASONS]
    watched = judged.observe(watch, F.count(F.when(F.col("reason").isNull(), 1)).alias("kept"), *counts)
    watched.where("reason IS NULL").drop("reason").write.parquet(path)
    return watch.get


def exchange_local(bars: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Bars of UTC `ts` with the exchange's naive time, the session's date, valid prices only, and 0 for an unknown volume."""
    local = bars.withColumn("ts", F.from_utc_timestamp("ts", zone))
    return local.withColumn("date", F.to_date("ts")).where(valid_bar()).withColumn("volume", F.coalesce("volume", F.lit(0).cast("long")))

