"""Scoring logged predictions on complete days, and watching how they do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.exprs import EPSILON, EVENT, finite, late, ratio, touch_event
from barlake.operators.bars import next_complete_day

DEGRADATION_WINDOW = 5


def resolved_log(log: DataFrame, complete: DataFrame) -> DataFrame:
    """Touch-era predictions with the target date their signal date resolves to (the next complete day; there are few dates)."""
    touch = log.where(F.col("event") == EVENT)
    return touch.join(F.broadcast(next_complete_day(touch.select("signal_date"), complete)), "signal_date")


def created_by_target(log: DataFrame, complete: DataFrame) -> DataFrame:
    return resolved_log(log, complete).groupBy("target_date").agg(F.max("created_ts").alias("created"))


def late_days(log: DataFrame, complete: DataFrame) -> DataFrame:
    return created_by_target(log, complete).select("target_date", late("created", "target_date").alias("late"))


def rank_outcomes(log: DataFrame, returns: DataFrame, complete: DataFrame, top_n: int = 20) -> DataFrame:
    """One row per pick that traded on its target day."""
    picks = resolved_log(log, complete).where(F.col("rank") <= top_n)
    days = returns.select("symbol", F.col("date").alias("target_date"), "open", "oc_return", "high_return", "low_return", touch_event().cast("int").alias("hit"))
    return picks.join(days, ["symbol", "target_date"]).join(F.broadcast(late_days(log, complete)), "target_date", "left").withColumn("late", F.coalesce("late", F.lit(True)))


def score_days(outcomes: DataFrame, base: DataFrame) -> DataFrame:
    """Per signal and target day: picks, hits, precision, base rate, and lift (null where the base rate is 0)."""
    days = outcomes.groupBy("signal_date", "target_date").agg(F.count(F.lit(1)).alias("n_scored"), F.sum("hit").cast("long").alias("hits"), F.avg(F.col("hit").cast("double")).alias("precision"), F.max("late").alias("late"))
    return days.join(F.broadcast(base.withColumnRenamed("date", "target_date")), "target_date", "left").withColumn("lift", ratio("precision", "base_rate"))


def pending_days(log: DataFrame, complete: DataFrame) -> DataFrame:
    touch = log.where(F.col("event") == EVENT).select("signal_date").distinct()
    return touch.join(next_complete_day(touch, complete), "signal_date", "left_anti")


def pick_performance(outcomes: DataFrame) -> DataFrame:
    """Per target day the best-ranked pick that traded (two signal days may share a target: then the lesser symbol, the earlier
    signal) and the basket."""
    first = F.struct("rank", "symbol", "signal_date")
    return outcomes.groupBy("target_date").agg(
        F.min_by("symbol", first).alias("top1_symbol"), F.min("rank").alias("top1_rank"), F.min_by("oc_return", first).alias("top1_return"), F.min_by("hit", first).alias("top1_hit"),
        F.avg("oc_return").alias("topn_return"), F.sum("hit").cast("long").alias("topn_hits"), F.count(F.lit(1)).alias("n_avail"), F.max("late").alias("late"),
    )


def precision_at_1(performance: DataFrame) -> DataFrame:
    hit = F.col("top1_hit").cast("double")
    return performance.agg(F.avg(F.when(~F.col("late"), hit)).alias("live"), F.avg(hit).alias("every"), F.count(F.when(~F.col("late"), 1)).alias("live_days"), F.count(F.lit(1)).alias("days"))


def _pooled(days: DataFrame) -> DataFrame:
    return days.agg(F.count(F.lit(1)).alias("days"), F.sum("n_scored").alias("picks"), ratio(F.sum("hits"), F.sum("n_scored")).alias("precision"), ratio(F.sum(F.col("base_rate") * F.col("n_scored")), F.sum("n_scored")).alias("base_rate"), F.count(F.when(F.col("lift") < 1 - EPSILON, 1)).alias("days_below_1"))


def in_window(days: DataFrame, window: int = DEGRADATION_WINDOW) -> DataFrame:
    """The newest live days with a lift; there is one row a day."""
    return days.where(~F.col("late") & F.col("lift").isNotNull()).withColumn("n", F.row_number().over(Window.orderBy(F.desc("target_date"), F.desc("signal_date")))).where(F.col("n") <= window)


def degradation_verdict(days: DataFrame, window: int = DEGRADATION_WINDOW) -> DataFrame:
    """Degraded if the pooled precision of the last `window` live days is below their pick-weighted base rate. Armed only with so many live days: before
    that the pooled figures are null, and nothing is degraded. Live days without a lift are `excluded`; `days_below_1` counts days of the window (before
    arming: of all live days) whose lift is under 1."""
    live = days.where(~F.col("late"))
    counts = live.agg(F.count("lift").alias("live_days"), F.count(F.when(F.col("lift").isNull(), 1)).alias("excluded"))
    excess, armed = F.col("precision") - F.col("base_rate"), F.col("live_days") >= window
    both = _pooled(in_window(days, window)).join(counts, F.lit(True))  # one row each
    pooled = {c: F.when(armed, F.col(c)) for c in ("precision", "base_rate")}
    return both.select("live_days", "excluded", F.coalesce("picks", F.lit(0)).alias("picks"), *(c.alias(name) for name, c in pooled.items()), F.when(armed, excess).alias("excess"), "days_below_1", armed.alias("armed"), F.coalesce(armed & (excess < -EPSILON), F.lit(False)).alias("degraded"))


def live_record(days: DataFrame) -> DataFrame:
    live = _pooled(days.where(~F.col("late") & F.col("base_rate").isNotNull()))
    return live.select("days", "picks", "precision", "base_rate", ratio("precision", "base_rate").alias("lift"), (F.col("precision") - F.col("base_rate")).alias("excess"))


def shadow_scores(days: DataFrame, pending: DataFrame, by: str = "challenger") -> DataFrame:
    """Per challenger: live, late and pending days (pending: challenger, signal_date), and means over finite values of live days."""
    live = ~F.col("late")

    def mean(c: str):
        return F.avg(F.when(live & finite(c), F.col(c))).alias(f"mean_{c}")

    scored = days.groupBy(by).agg(F.count(F.when(live, 1)).alias("live_days"), F.count(F.when(~live, 1)).alias("late_days"), mean("precision"), mean("base_rate"), mean("lift"), F.count(F.when(live & finite("lift"), 1)).alias("lift_days"))
    waiting = pending.groupBy(by).agg(F.count_distinct("signal_date").alias("pending_days"))
    whole = scored.join(waiting, by, "full_outer")
    return whole.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("live_days", "late_days", "lift_days", "pending_days")})


def degradation_evidence(days: DataFrame, last: int = 10) -> DataFrame:
    marked = in_window(days).select("signal_date", "target_date", F.lit(True).alias("in_window"))
    newest = days.withColumn("n", F.row_number().over(Window.orderBy(F.desc("target_date"), F.desc("signal_date")))).where(F.col("n") <= last).drop("n")
    return newest.join(marked, ["signal_date", "target_date"], "left").withColumn("in_window", F.coalesce("in_window", F.lit(False)))


def reach_explorer(outcomes: DataFrame, base: DataFrame, baskets=(1, 5, 10, 15, 20), windows=(5, 21, 63, 126, 252)) -> DataFrame:
    """Basket size by trailing window: mean reach and base rate of live days, with the days that were short, substituted or without base."""
    live = outcomes.where(~F.col("late"))
    nth = Window.partitionBy("target_date").orderBy("rank", "symbol")
    recent = Window.orderBy(F.desc("target_date"))
    numbered = live.withColumn("place", F.row_number().over(nth))
    sizes = numbered.withColumn("n", F.explode(F.array(*map(F.lit, baskets)))).where("place <= n")
    days = sizes.groupBy("n", "target_date").agg(F.avg(F.col("hit").cast("double")).alias("reach"), F.count(F.lit(1)).alias("avail"), F.max(F.col("rank") != F.col("place")).alias("subst"))
    order = live.select("target_date").distinct().withColumn("age", F.row_number().over(recent))  # one row a date
    grid = days.join(F.broadcast(order), "target_date").join(F.broadcast(base.withColumnRenamed("date", "target_date")), "target_date", "left").withColumn("w", F.explode(F.array(*map(F.lit, windows)))).where("age <= w")
    return grid.groupBy("n", "w").agg(F.count(F.lit(1)).alias("days"), F.avg("reach").alias("reach"), F.avg("base_rate").alias("base_rate"), F.count(F.when(F.col("avail") < F.col("n"), 1)).alias("short_days"), F.count(F.when(F.col("subst"), 1)).alias("subst_days"), F.count("base_rate").alias("base_days"))
