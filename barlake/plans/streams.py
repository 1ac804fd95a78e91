"""Plans of the streaming jobs, run over what is there (availableNow)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.functions.exprs import six
from barlake.plans.inputs import touch_sql
from barlake.plans.registry import query
from barlake.plans.sessions import Sessions
from barlake.sources import tables as S
from barlake.sources.shared import fresh_path
from barlake.streaming import bars as T

CLOSED = "SELECT symbol, ts, open, high, low, close, volume FROM ib WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


#: Five event types with some hours open each: their state is a few hundred rows, however many ticks there are.
STATE_TASKS = 4


def stream(spark, d):
    return T.event_stream(spark, S.read_table(spark, d, "events"))


@query("t01_stream_bars", ["ib"], CLOSED)
def t01(spark, d):
    return T.drain(T.stream_bars(stream(spark, d)), state_tasks=STATE_TASKS)


#: The feed comes in batches of six days. Every 40th tick comes two batches late; odd ticks of a batch's last hour come with the next.
BATCH_SQL = "CASE WHEN event_id % 40 = 7 THEN base + 2 WHEN event_id % 2 = 1 AND hour(ts) = 23 AND day(ts) % 6 = 5 THEN base + 1 ELSE base END"
#: When a batch comes, the watermark is known from the batches up to the one before the last: later windows are open, others' ticks are dropped.
LATE_SQL = f"""WITH fed AS (SELECT *, {BATCH_SQL} AS batch FROM (SELECT *, day(ts) // 6 AS base FROM events)),
  newest AS (SELECT batch, max(ts) AS top FROM fed WHERE value IS NOT NULL GROUP BY batch), marks AS (SELECT b.batch, max(a.top) - INTERVAL 1 HOUR AS mark FROM newest b LEFT JOIN newest a ON a.batch < b.batch - 1 GROUP BY b.batch),
  kept AS (SELECT event_type AS symbol, time_bucket(INTERVAL '60 minutes', ts) AS bar, ts, event_id, value FROM fed JOIN marks USING (batch) WHERE value IS NOT NULL AND (mark IS NULL OR time_bucket(INTERVAL '60 minutes', ts) + INTERVAL 1 HOUR > mark))
  SELECT symbol, bar AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, CAST(count(*) * 100000 AS BIGINT) AS volume FROM kept
  GROUP BY symbol, bar HAVING bar + INTERVAL 1 HOUR <= (SELECT max(top) FROM newest) - INTERVAL 1 HOUR"""


def late_feed(spark, d):
    """The events as a stream of several triggers, some of them late."""
    day, base = F.dayofmonth("ts"), (F.dayofmonth("ts") / 6).cast("int")
    batch = F.when(F.col("event_id") % 40 == 7, base + 2).when((F.col("event_id") % 2 == 1) & (F.hour("ts") == 23) & (day % 6 == 5), base + 1).otherwise(base)
    return T.arriving(S.read_table(spark, d, "events").withColumn("batch", batch), "batch", fresh_path(spark, "feed"))


@query("t01b_stream_late_ticks", [], LATE_SQL)
def t01b(spark, d):
    """Bars over seven triggers: ticks within the watermark count, later ones don't."""
    return T.drain(T.stream_bars(late_feed(spark, d)), state_tasks=STATE_TASKS)


@query("t02_stream_upsert", ["ib"], f"SELECT symbol, ts, date, open, close FROM (SELECT *, CAST(ts AS DATE) AS date FROM ({CLOSED})) UNION ALL SELECT symbol, ts, date, 0.0, 0.0 FROM ib WHERE day(date) <= 3 AND ts NOT IN (SELECT ts FROM ({CLOSED}))")
def t02(spark, d):
    """A table with partial bars of the first days, healed by the stream."""
    path = fresh_path(spark, "bars")
    partial = S.session_bars(spark, d).where(F.dayofmonth("date") <= 3).select("symbol", "ts", "date", F.lit(0.0).alias("open"), F.lit(0.0).alias("close"))
    partial.write.partitionBy("date").parquet(path)
    bars = T.stream_bars(stream(spark, d)).select("symbol", "ts", F.to_date("ts").alias("date"), "open", "close")
    T.stream_upsert(bars, path, ["symbol", "ts"], "date")
    return spark.read.parquet(path).select("symbol", "ts", "date", "open", "close")


@query("t03_stream_movers", ["tr"], f"SELECT event_id, symbol, date, round(high_return, 6) + 0.0 AS high_return FROM (SELECT event_id, event_type AS symbol, CAST(ts AS DATE) AS date, (value - open) / open AS high_return, high_glitch_suspect FROM events JOIN tr ON tr.symbol = event_type AND tr.date = CAST(ts AS DATE)) WHERE {touch_sql()}")
def t03(spark, d):
    ticks = stream(spark, d).select("event_id", F.col("event_type").alias("symbol"), F.to_date("ts").alias("date"), "value")
    days = Sessions(spark, d).returns.select("symbol", "date", "open", "high_glitch_suspect")
    return T.drain(T.stream_movers(ticks, days).select("event_id", "symbol", "date", six(F.col("high_return")).alias("high_return")))
