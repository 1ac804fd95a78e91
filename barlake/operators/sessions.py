"""Intraday sessions: which trigger came first, measured stop fills, trailing exits, and whether the record can be trusted.

A session is the bars of one (symbol, date, interval). All of it is one aggregate per session or a window within one;
no correlated subqueries, and no group larger than a day of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.exprs import LIMIT_FIRST, STOP_FIRST, STOP_TOUCH, TOUCH, finite, six, slot, touch_event

AGREE_WITHIN = 0.001
KEYS = ["symbol", "date"]


def session_agreement(daily: DataFrame, bars: DataFrame) -> DataFrame:
    """Do a session's extremes reproduce its daily bar, within a share of the open."""
    own = bars.groupBy(*KEYS).agg(F.max("high").alias("s_high"), F.min("low").alias("s_low"), F.count(F.lit(1)).alias("n_bars"), F.min_by("open", "ts").alias("s_open"))
    near = F.col("open") * AGREE_WITHIN
    agrees = (F.abs(F.col("s_high") - F.col("high")) <= near) & (F.abs(F.col("s_low") - F.col("low")) <= near)
    return own.join(daily.select(*KEYS, "open", "high", "low"), KEYS).select(*KEYS, "n_bars", "s_open", F.coalesce(agrees, F.lit(False)).alias("agrees"))


def _slots(bars: DataFrame, bar_minutes: int, open_minutes: int) -> DataFrame:
    return bars.withColumn("slot", slot("ts", "date", bar_minutes, open_minutes))


def _first_triggers(days: DataFrame, bars: DataFrame) -> DataFrame:
    """days (symbol, date, d_open) with the first bar that reached the limit and the stop, measured from the daily open."""
    joined = days.join(bars, KEYS, "left")
    up = finite("high") & ((F.col("high") - F.col("d_open")) / F.col("d_open") >= TOUCH)
    down = finite("low") & ((F.col("low") - F.col("d_open")) / F.col("d_open") <= STOP_TOUCH)
    w = Window.partitionBy(*KEYS)
    return joined.withColumns({"limit_ts": F.min(F.when(up, F.col("ts"))).over(w), "stop_ts": F.min(F.when(down, F.col("ts"))).over(w)})


def trigger_order(pairs: DataFrame, returns: DataFrame, bars: DataFrame, *, bar_minutes: int, open_minutes: int) -> DataFrame:
    """For pairs (symbol, date) that touched both triggers: `reason` (resolved, no_intraday, disagreed, same_bar, gappy) and `seq`, 1 if the limit
    came first, 2 if the stop did. A verdict needs every slot from the open to the earlier trigger."""
    both = returns.where(touch_event() & finite("low_return") & (F.col("low_return") <= STOP_TOUCH)).select(*KEYS, F.col("open").alias("d_open"))
    ambiguous = pairs.select(*KEYS).distinct().join(both, KEYS)
    seen = _first_triggers(ambiguous, _slots(bars.drop("open"), bar_minutes, open_minutes))
    first = F.least("limit_ts", "stop_ts")
    before = F.count_distinct(F.when((F.col("slot") >= 0) & (F.col("ts") <= first), F.col("slot")))
    spans = seen.groupBy(*KEYS, "limit_ts", "stop_ts").agg(before.alias("bars_before"), F.max(F.when(F.col("ts") == first, F.col("slot"))).alias("first_slot"))
    agree = session_agreement(returns, bars).select(*KEYS, "agrees")
    reason = (
        F.when(F.col("agrees").isNull(), "no_intraday")
        .when(~F.col("agrees") | F.col("limit_ts").isNull() | F.col("stop_ts").isNull(), "disagreed")
        .when(F.col("limit_ts") == F.col("stop_ts"), "same_bar")
        .when(F.col("first_slot").isNull() | (F.col("first_slot") < 0) | (F.col("bars_before") < F.col("first_slot") + 1), "gappy")
        .otherwise("resolved")
    )
    order = F.when(F.col("limit_ts") < F.col("stop_ts"), LIMIT_FIRST).otherwise(STOP_FIRST)
    return spans.join(agree, KEYS, "left").select(*KEYS, reason.alias("reason"), F.when(reason == "resolved", order).cast("int").alias("seq"))


def best_of(layers: list[DataFrame], usable: Column) -> DataFrame:
    """First usable row of each (symbol, date), finest layer first; else the finest row."""
    whole = None
    for i, layer in enumerate(layers):
        tagged = layer.withColumn("layer", F.lit(i))
        whole = tagged if whole is None else whole.unionByName(tagged)
    w = Window.partitionBy(*KEYS).orderBy(F.when(usable, 0).otherwise(1), "layer")
    return whole.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def stop_fills(pairs: DataFrame, returns: DataFrame, bars: DataFrame, *, bar_minutes: int, open_minutes: int) -> DataFrame:
    """Return from the daily open to the open of the slot after the first stop bar; no row where the record has a hole or disagrees."""
    stopped = returns.where(finite("low_return") & (F.col("low_return") <= STOP_TOUCH)).select(*KEYS, F.col("open").alias("d_open"))
    agree = session_agreement(returns, bars).where("agrees").select(*KEYS)
    days = pairs.select(*KEYS).distinct().join(stopped, KEYS).join(agree, KEYS, "left_semi")
    w = Window.partitionBy(*KEYS).orderBy("ts")
    ahead = _slots(bars, bar_minutes, open_minutes).withColumns({"next_open": F.lead("open").over(w), "next_ts": F.lead("ts").over(w)}).drop("open")
    seen = _first_triggers(days, ahead).where("stop_ts IS NOT NULL")
    at = F.col("ts") == F.col("stop_ts")
    per = seen.groupBy(*KEYS, "d_open").agg(
        F.count_distinct(F.when((F.col("slot") >= 0) & (F.col("ts") <= F.col("stop_ts")), F.col("slot"))).alias("bars_before"),
        F.max(F.when(at, F.col("slot"))).alias("stop_slot"), F.max(F.when(at, F.col("next_open"))).alias("next_open"),
        F.max(F.when(at, F.unix_timestamp("next_ts") - F.unix_timestamp("ts"))).alias("step"),
    )
    good = per.where((F.col("stop_slot") >= 0) & (F.col("bars_before") >= F.col("stop_slot") + 1) & (F.col("step") == bar_minutes * 60) & finite("next_open") & (F.col("next_open") > 0))
    return good.select(*KEYS, ((F.col("next_open") - F.col("d_open")) / F.col("d_open")).alias("fill"))


def trailing_exits(daily: DataFrame, bars: DataFrame, *, bar_minutes: int, open_minutes: int, drop: float = 0.01) -> DataFrame:
    """Exit return of a trailing stop replayed over gapless sessions that agree with their day: at the next bar's open once a low falls `drop` below
    the high so far, never above the trigger; the last close if it never does."""
    agree = session_agreement(daily, bars).where("agrees").select(*KEYS)
    days = daily.where(finite("open") & (F.col("open") > 0)).select(*KEYS, F.col("open").alias("d_open")).join(agree, KEYS, "left_semi")
    rows = days.join(_slots(bars, bar_minutes, open_minutes).where("slot >= 0"), KEYS)
    w = Window.partitionBy(*KEYS).orderBy("ts")
    high = F.greatest(F.max("high").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("d_open"))
    replay = rows.withColumns({"trigger": high * (1 - drop), "after": F.coalesce(F.lead("open").over(w), F.col("close"))}).withColumn("hit", F.col("low") <= F.col("trigger"))
    per = replay.groupBy(*KEYS, "d_open").agg(
        F.min("slot").alias("first"), F.max("slot").alias("last"), F.count_distinct("slot").alias("n"),
        F.min_by(F.when(F.col("hit"), F.least("after", "trigger")), F.when(F.col("hit"), F.col("ts"))).alias("stop_px"), F.max_by("close", "ts").alias("last_close"),
    )
    whole = per.where((F.col("first") == 0) & (F.col("n") == F.col("last") + 1))
    return whole.select(*KEYS, ((F.coalesce("stop_px", "last_close") - F.col("d_open")) / F.col("d_open")).alias("trail"))


def session_coverage(bars: DataFrame, *, bar_minutes: int, close_minutes: int, slack: int = 10, share: float = 0.5, window: int = 5) -> DataFrame:
    """Capture health per (interval, date): ends early (`truncated`) or has few symbols against the sessions before (`thin`)."""
    minute = ((F.unix_timestamp("ts") - F.unix_timestamp(F.col("date").cast("timestamp"))) / 60).cast("long")
    per = bars.groupBy("interval", "date").agg(F.count(F.lit(1)).alias("n_bars"), F.count_distinct("symbol").alias("symbols"), F.max(minute).alias("last_minute"))
    before = Window.partitionBy("interval").orderBy("date").rowsBetween(-window, -1)  # one row a date
    judged = per.withColumn("trailing_median", F.percentile("symbols", F.lit(0.5)).over(before))
    return judged.withColumns({"truncated": F.col("last_minute") < close_minutes - bar_minutes - slack, "thin": F.coalesce(F.col("symbols") < share * F.col("trailing_median"), F.lit(False))})


def coverage_problems(coverage: DataFrame) -> DataFrame:
    return coverage.where("truncated OR thin").orderBy(F.desc("date"), "interval")


def order_validation(coarse: DataFrame, fine: DataFrame) -> DataFrame:
    """Verdicts of a coarse interval against a finer one."""
    a = coarse.select(*KEYS, F.col("seq").alias("seq_a"), F.col("reason").alias("reason_a"))
    b = fine.select(*KEYS, F.col("seq").alias("seq_b"))
    both = a.join(b, KEYS, "full_outer")
    one, two = F.col("seq_a").isNotNull(), F.col("seq_b").isNotNull()
    return both.agg(
        F.count(F.when(one & two, 1)).alias("compared"), F.count(F.when(F.col("seq_a") == F.col("seq_b"), 1)).alias("agreed"), F.count(F.when(F.col("seq_a") != F.col("seq_b"), 1)).alias("disagreed"),
        F.count(F.when(one & ~two, 1)).alias("unchecked"), F.count(F.when(~one & two & (F.col("reason_a") == "same_bar"), 1)).alias("recovered_same_bar"), F.count(F.when(~one & two & (F.col("reason_a") == "gappy"), 1)).alias("recovered_gappy"),
    )


def attach_outcomes(picks: DataFrame, order: DataFrame, fills: DataFrame, trails: DataFrame) -> DataFrame:
    """picks (symbol, target_date, ...) with what the sessions know; one row a pick even if an input repeats a key."""

    def on(frame: DataFrame, column: str) -> DataFrame:
        return frame.where(F.col(column).isNotNull()).select("symbol", F.col("date").alias("target_date"), column).dropDuplicates(["symbol", "target_date"])

    keys = ["symbol", "target_date"]
    return picks.join(on(order, "seq"), keys, "left").join(on(fills, "fill"), keys, "left").join(on(trails, "trail"), keys, "left")


def both_intervals(bars: DataFrame, a: str, b: str) -> DataFrame:
    """Sessions that hold bars of both intervals."""
    per = bars.groupBy(*KEYS).agg(F.max(F.col("interval") == a).alias("a"), F.max(F.col("interval") == b).alias("b"))
    return per.where("a AND b").select(*KEYS)


def attach_coverage(attached: DataFrame) -> DataFrame:
    """How far attached picks (`ol`, `filled`, `seq`, `fill`, `trail`) are known, in one row: picks and their sessions, sessions that touched both triggers and those whose
    order is known, measured stop fills with their first and last day, replayed sessions, and days that a pick without a replay excludes."""
    both = F.col("filled") & (F.col("ol") <= STOP_TOUCH)
    filled_on = F.when(F.col("fill").isNotNull(), F.col("target_date"))
    per = attached.groupBy("target_date", "symbol").agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(c, 1)).alias(name) for name, c in (("both", both), ("seq", F.col("seq").isNotNull()), ("fills", F.col("fill").isNotNull()), ("trails", F.col("trail").isNotNull()))), F.min(filled_on).alias("lo"), F.max(filled_on).alias("hi"))
    days = per.groupBy("target_date").agg(*(F.sum(c).alias(c) for c in ("n", "both", "seq", "fills", "trails")), F.count(F.lit(1)).alias("pairs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return days.agg(
        F.sum("n").alias("picks"), F.sum("pairs").alias("pairs"), F.sum("both").alias("both_touched"), F.sum("seq").alias("ordered"), F.sum("fills").alias("filled"), F.min("lo").alias("first_fill"), F.max("hi").alias("last_fill"),
        F.sum("trails").alias("replayed"), F.count(F.when(F.col("trails") < F.col("n"), 1)).alias("days_not_replayed"),
    )


def pick_days(picks: DataFrame, base: DataFrame) -> DataFrame:
    """One row a target day: `d`, its `base` rate (null where base (target_date, base_rate) has none), whether any pick is `late`, and its picks in rank order (at most
    a basket a day) as structs of rank, oh, ol, oc, hit, seq, fill and trail. Returns have six places and are null where not finite."""

    def number(c: str):
        return F.when(finite(c), six(F.col(c))).alias(c)

    pick = F.struct("rank", number("oh"), number("ol"), number("oc"), F.col("hit").cast("int").alias("hit"), F.col("seq").cast("int").alias("seq"), number("fill"), number("trail"))
    days = picks.groupBy(F.col("target_date").alias("d")).agg(F.max("late").alias("late"), F.array_sort(F.collect_list(pick)).alias("picks"))
    rates = F.broadcast(base.select(F.col("target_date").alias("d"), six(F.col("base_rate")).alias("base")))  # one row a date
    return days.join(rates, "d", "left").select("d", "base", "late", "picks")


def nested_coverage(days: DataFrame) -> DataFrame:
    """Nested days with counts over their picks: whose order, stop fill and replay are known, whose returns are not, and hits."""

    def number(test) -> Column:
        return F.size(F.filter("picks", test)).cast("long")

    counts = {"ordered": lambda p: p["seq"].isNotNull(), "filled": lambda p: p["fill"].isNotNull(), "replayed": lambda p: p["trail"].isNotNull(), "unknown": lambda p: p["ol"].isNull() | p["oc"].isNull()}
    hits = F.aggregate("picks", F.lit(0).cast("long"), lambda total, p: total + p["hit"])
    return days.withColumns({name: number(test) for name, test in counts.items()}).withColumn("hits", hits)
