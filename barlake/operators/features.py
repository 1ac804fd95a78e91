"""Feature frame without lookahead, and its labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.exprs import MIN_HISTORY, ratio, touch_event
from barlake.operators.bars import by_symbol, market_day, sector_day

FEATURES = ["oc_return_today", "ret_5d", "vol_20d", "volume_ratio", "close_pos", "cnt_2pct_20d", "breadth", "market_heat", "log_mcap", "sector_breadth", "sector_excess"]


def symbol_windows(returns: DataFrame) -> DataFrame:
    """All per-symbol windows in one shuffle: same partitioning and order."""
    w, w20 = by_symbol(), by_symbol().rowsBetween(-19, 0)
    return returns.withColumns({
        "history_days": F.row_number().over(w).cast("long"),
        "ret_5d": ratio("close", F.lag("close", 5).over(w)) - 1,
        "vol_20d": F.stddev_samp("oc_return").over(w20),
        "volume_ratio": ratio("volume", F.avg("volume").over(w20)),
        "median_vol_20": F.percentile("volume", F.lit(0.5)).over(w20),
        "close_pos": F.when(F.col("high") > F.col("low"), (F.col("close") - F.col("low")) / (F.col("high") - F.col("low"))),
        "cnt_2pct_20d": F.sum(F.when(touch_event(), 1).otherwise(0)).over(w20),
        "target_date": F.lead("date").over(w),
        "next_oc_return": F.lead("oc_return").over(w),
        "next_high_return": F.lead("high_return").over(w),
        "next_glitch": F.lead("high_glitch_suspect").over(w),
        "next_low_return": F.lead("low_return").over(w),
    })


def label() -> Column:
    """1 or 0 for the symbol's own next bar, null where there is none."""
    return F.when(F.col("next_high_return").isNull(), None).when(touch_event("next_high_return", "next_glitch"), 1).otherwise(0).cast("int")


def feature_frame(returns: DataFrame, universe: DataFrame, start=None, end=None, min_history: int = MIN_HISTORY, market: DataFrame | None = None, sector: DataFrame | None = None) -> DataFrame:
    """Features of each (symbol, signal_date) with at least min_history bars; date bounds apply after the windows.

    `returns` is read once for the symbols' windows and, unless `market` and `sector` are given, once each for those: pass a table
    (`stored`), so that bars aren't built from ticks three times."""
    known = universe.select("symbol", "market_cap", "sector")
    market = market_day(returns) if market is None else market
    sector = sector_day(returns, universe) if sector is None else sector
    rows = symbol_windows(returns).join(market, "date").join(known, "symbol", "left").join(sector, ["date", "sector"], "left")
    rows = rows.where(F.col("history_days") >= min_history)
    if start is not None:
        rows = rows.where(F.col("date") >= start)
    if end is not None:
        rows = rows.where(F.col("date") <= end)
    return rows.select(
        "symbol", F.col("date").alias("signal_date"), "target_date", label().alias("did_2pct_next"), "next_oc_return", "next_high_return", "next_low_return",
        F.col("oc_return").alias("oc_return_today"), "ret_5d", "vol_20d", "volume_ratio", "close_pos", F.col("cnt_2pct_20d").cast("long").alias("cnt_2pct_20d"), "breadth", "market_heat",
        F.when(F.col("market_cap") > 0, F.log("market_cap")).alias("log_mcap"), "sector_breadth", (F.col("oc_return") - F.col("sector_mean_oc")).alias("sector_excess"), "median_vol_20",
    )


def feature_null_report(frame: DataFrame) -> DataFrame:
    missing = F.col("sector_breadth").isNull()
    return frame.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(missing, 1)).alias("null_rows"), F.countDistinct(F.when(missing, F.col("symbol"))).alias("null_symbols"), F.coalesce(F.min(missing), F.lit(False)).alias("all_null"))


def formula_score(frame: DataFrame) -> DataFrame:
    """A fixed score from the features, for testing selection and scoring without a fit; rounded so that ties are the same everywhere."""
    raw = F.coalesce("close_pos", F.lit(0.5)) * 0.4 + F.col("cnt_2pct_20d") / 20 * 0.4 + F.coalesce("breadth", F.lit(0.0)) * 0.2
    return frame.withColumn("prob", F.round(raw, 4))


def select_top(scored: DataFrame, n: int = 20, floor: float | None = None) -> DataFrame:
    """The n likeliest names of each day, over the liquidity floor if one is given; ties go to the lesser symbol."""
    pool = scored if floor is None else scored.where(F.col("median_vol_20") >= floor)
    order = Window.partitionBy("signal_date").orderBy(F.desc("prob"), "symbol")
    return pool.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
