"""Returns, the touch event, and which days are complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.exprs import COMPLETE_PRIORS, COMPLETE_SHARE, COMPLETE_WINDOW, EPSILON, GLITCH_MULTIPLE, GLITCH_WINDOW, THRESHOLD, TOUCH, finite, split_artifact, touch_event, valid_bar


def by_symbol():
    return Window.partitionBy("symbol").orderBy("date")


def glitch_suspect() -> Column:
    """The high alone decided the touch, stands out over bar and prior close, and volume doesn't bear it out."""
    reference = F.greatest("open", "close", F.coalesce("prev_close", F.lit(0.0)))
    suspect = (F.col("high_return") >= THRESHOLD) & (F.col("oc_return") < THRESHOLD) & (F.col("high") >= GLITCH_MULTIPLE * reference) & finite("trailing_avg_vol") & (F.col("volume") < F.col("trailing_avg_vol"))
    return F.coalesce(suspect, F.lit(False))


def with_glitch(returns: DataFrame) -> DataFrame:
    avg = F.avg("volume").over(by_symbol().rowsBetween(-GLITCH_WINDOW, -1))
    seen = returns.withColumns({"prev_close": F.lag("close").over(by_symbol()), "trailing_avg_vol": avg})
    return seen.withColumn("high_glitch_suspect", glitch_suspect())


def with_returns(bars: DataFrame) -> DataFrame:
    o = F.col("open")
    return bars.withColumns({"oc_return": F.try_divide(F.col("close") - o, o), "high_return": F.try_divide(F.col("high") - o, o), "low_return": F.try_divide(F.col("low") - o, o)})


def daily_returns(bars: DataFrame) -> DataFrame:
    """Valid bars with open-based returns and the glitch flag; one shuffle by symbol."""
    return with_glitch(with_returns(bars.where(valid_bar()))).select("symbol", "date", "open", "high", "low", "close", "volume", "oc_return", "high_return", "low_return", "high_glitch_suspect")


def latest_date(returns: DataFrame) -> DataFrame:
    return returns.agg(F.max("date").alias("date"))


def daily_movers(returns: DataFrame, universe: DataFrame, date=None, threshold: float = THRESHOLD) -> DataFrame:
    """Names that reached the threshold on a date (default: the latest), greatest move first."""
    day = F.broadcast(latest_date(returns)) if date is None else None
    on = returns.join(day, "date") if day is not None else returns.where(F.col("date") == date)
    hit = on.where(touch_event(threshold=threshold - EPSILON))
    return hit.join(universe.select("symbol", "name"), "symbol", "left").select("symbol", "name", "date", "open", "high", "close", "high_return", "oc_return").orderBy(F.desc("high_return"), "symbol")


def with_split_flag(bars: DataFrame) -> DataFrame:
    return bars.withColumn("prev_close", F.lag("close").over(by_symbol())).withColumn("split_artifact", split_artifact())


def touch_share(glitch: str = "high_glitch_suspect"):
    return F.avg(F.when(touch_event("high_return", glitch), 1.0).otherwise(0.0))


def day_counts(bars: DataFrame) -> DataFrame:
    return bars.groupBy("date").agg(F.count(F.lit(1)).alias("raw_count"), F.count(F.when(valid_bar(), 1)).alias("bar_count"))


def coverage_days(bars: DataFrame) -> DataFrame:
    """Each date's valid bars against the median of the up to 20 dates before; the window runs over one row a date."""
    counts = bars.where(valid_bar()).groupBy("date").agg(F.count(F.lit(1)).alias("bar_count"))
    before = Window.orderBy("date").rowsBetween(-COMPLETE_WINDOW, -1)
    judged = counts.withColumns({"prior_days": F.count(F.lit(1)).over(before), "trailing_median": F.percentile("bar_count", F.lit(0.5)).over(before)})
    return judged.withColumn("complete", (F.col("prior_days") < COMPLETE_PRIORS) | (F.col("bar_count") >= COMPLETE_SHARE * F.col("trailing_median") - EPSILON))


def complete_days(bars: DataFrame) -> DataFrame:
    return coverage_days(bars).where("complete").drop("complete")


def base_rates(returns: DataFrame, complete: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Share of all names that touched, on complete (and, if given, requested) dates; other dates are absent."""
    days = complete.select("date") if dates is None else complete.select("date").join(dates.select("date").distinct(), "date", "left_semi")
    return returns.join(F.broadcast(days), "date", "left_semi").groupBy("date").agg(touch_share().alias("base_rate"))


def market_day(returns: DataFrame) -> DataFrame:
    return returns.groupBy("date").agg(F.avg(F.when(F.col("oc_return") > 0, 1.0).otherwise(0.0)).alias("breadth"), F.avg(F.when(F.col("oc_return") >= TOUCH, 1.0).otherwise(0.0)).alias("market_heat"))


def sector_day(returns: DataFrame, universe: DataFrame) -> DataFrame:
    known = universe.where("sector IS NOT NULL AND sector <> ''").select("symbol", "sector")
    return returns.join(known, "symbol").groupBy("date", "sector").agg(F.avg(F.when(F.col("oc_return") > 0, 1.0).otherwise(0.0)).alias("sector_breadth"), F.avg("oc_return").alias("sector_mean_oc"))


def next_complete_day(signal_days: DataFrame, complete: DataFrame) -> DataFrame:
    """Forward as-of join without a theta join: for each signal date the next strictly later complete date. A range frame over
    day numbers skips a complete date equal to the signal date."""
    both = signal_days.select(F.col("signal_date").alias("d"), F.lit(True).alias("signal")).distinct().unionByName(complete.select(F.col("date").alias("d"), F.lit(False).alias("signal")))
    marked = both.withColumns({"day": F.datediff("d", F.lit("1970-01-01")).cast("long"), "c": F.when(~F.col("signal"), F.col("d"))})
    ahead = Window.orderBy("day").rangeBetween(1, Window.unboundedFollowing)  # one row a date
    return marked.withColumn("target_date", F.min("c").over(ahead)).where("signal AND target_date IS NOT NULL").select(F.col("d").alias("signal_date"), "target_date")
