"""Data-quality diagnostics; they read raw bars, never filtered views."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.exprs import COMPLETE_PRIORS, COMPLETE_SHARE, COMPLETE_WINDOW, EPSILON, GLITCH_WINDOW, finite, valid_bar
from barlake.operators.bars import by_symbol, day_counts, glitch_suspect, with_glitch, with_returns
from barlake.sources.shared import stored


def day_numbers(counts: DataFrame) -> DataFrame:
    """Counts of a date's bars (date, raw_count, bar_count) as a calendar: `day` is the number of trading dates, those with a valid bar, up to a date; one
    row a date."""
    return counts.select("date", "bar_count", F.count(F.when(F.col("bar_count") > 0, 1)).over(Window.orderBy("date")).alias("day"))


def calendar(bars: DataFrame) -> DataFrame:
    return day_numbers(day_counts(bars))


def gap_counts(bars: DataFrame) -> DataFrame:
    """Trading dates without a valid bar between a symbol's first and last valid one. No range join: consecutive bars whose calendar numbers differ by more
    than one have the dates between them missing."""
    days = calendar(bars).where("bar_count > 0").select("date", "day")
    numbered = bars.where(valid_bar()).select("symbol", "date").distinct().join(F.broadcast(days), "date")
    steps = numbered.withColumns({"next_day": F.lead("day").over(Window.partitionBy("symbol").orderBy("day"))}).where("next_day > day + 1")
    first, last = days.select(F.col("day").alias("f"), F.col("date").alias("first_missing")), days.select(F.col("day").alias("l"), F.col("date").alias("last_missing"))
    spans = steps.groupBy("symbol").agg(F.sum(F.col("next_day") - F.col("day") - 1).cast("long").alias("n_missing"), F.min(F.col("day") + 1).alias("f"), F.max(F.col("next_day") - 1).alias("l"))
    return spans.join(F.broadcast(first), "f").join(F.broadcast(last), "l").select("symbol", "n_missing", "first_missing", "last_missing")


def stale_symbols(bars: DataFrame, more_than: int = 1) -> DataFrame:
    """Symbols after whose last bar, valid or not, more than so many trading dates follow."""
    days = calendar(bars)
    last = bars.groupBy("symbol").agg(F.max("date").alias("date")).join(F.broadcast(days), "date")
    newest = days.agg(F.max("day").alias("top"))  # one row
    return last.join(F.broadcast(newest), F.col("top") - F.col("day") > more_than).select("symbol", F.col("date").alias("last_date"), (F.col("top") - F.col("day")).cast("long").alias("days_behind"))


def invalid_bars(bars: DataFrame) -> DataFrame:
    return bars.where(~valid_bar()).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_invalid"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def glitch_bars(bars: DataFrame) -> DataFrame:
    """The glitch guard over raw bars, worst first: the bar before and the volumes before are those of all bars, whatever is wrong with them; of those that
    then count, the prices must be finite and the open above 0."""
    seen = with_glitch(with_returns(bars)).where(priced() & F.col("high_glitch_suspect"))
    return seen.select("symbol", "date", "high_return", "oc_return", "volume", "trailing_avg_vol", "prev_close").orderBy(F.desc("high_return"), "symbol", "date")


def priced() -> Column:
    return finite("open") & finite("high") & finite("close") & (F.col("open") > 0)


def short_days(counts: DataFrame) -> DataFrame:
    """Of day counts (one row a date) those dates whose raw count is short of the median of the up to 20 dates before; five must stand before."""
    before = Window.orderBy("date").rowsBetween(-COMPLETE_WINDOW, -1)
    judged = counts.withColumns({"trailing_median": F.percentile("raw_count", F.lit(0.5)).over(before), "prior_days": F.count(F.lit(1)).over(before)})
    short = judged.where((F.col("prior_days") >= COMPLETE_PRIORS) & (F.col("raw_count") < COMPLETE_SHARE * F.col("trailing_median") - EPSILON)).drop("prior_days")
    return short.withColumn("ratio", F.try_divide(F.col("raw_count").cast("double"), F.col("trailing_median")))


def incomplete_days(bars: DataFrame) -> DataFrame:
    return short_days(day_counts(bars))


def extreme_bars(bars: DataFrame, beyond: float = 0.5) -> DataFrame:
    """Valid bars that moved by more than `beyond` in a day, greatest move first."""
    moved = with_returns(bars.where(valid_bar()))
    return moved.where(finite("oc_return") & (F.abs("oc_return") > beyond)).select("symbol", "date", "open", "close", "oc_return").orderBy(F.desc(F.abs("oc_return")), "symbol", "date")


def zero_volume_runs(bars: DataFrame, at_least: int = 3) -> DataFrame:
    """Islands of consecutive bars without volume."""
    flagged = bars.withColumn("zero", F.coalesce(F.col("volume"), F.lit(0)) == 0)
    own = Window.partitionBy("symbol", "zero").orderBy("date")
    islands = flagged.withColumn("n", F.row_number().over(by_symbol())).withColumn("grp", F.col("n") - F.row_number().over(own)).where("zero")
    return islands.groupBy("symbol", "grp").agg(F.count(F.lit(1)).alias("n_bars"), F.min("date").alias("first_date"), F.max("date").alias("last_date")).where(F.col("n_bars") >= at_least).drop("grp")


def repair_splits(bars: DataFrame) -> DataFrame:
    """Bars without split artifacts, to a fixpoint: removing a bar gives the next one another close before. Each pass takes out all that
    are flagged. A symbol's history is bounded by its trading days, so one group fits in a task."""

    def clean(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date", ignore_index=True)
        while len(frame):
            before = frame["close"].shift(1)
            jump = frame["open"] / before.where(before > 0)
            flagged = (((frame["close"] - frame["open"]) / frame["open"].where(frame["open"] != 0)).abs() > 0.5 + EPSILON) & ((jump > 2 + EPSILON) | (jump < 0.5 - EPSILON))
            if not flagged.any():
                break
            frame = frame[~flagged].reset_index(drop=True)
        return frame

    return bars.groupBy("symbol").applyInPandas(clean, bars.schema)


#: Checks whose problems make a store unhealthy, in order of the report.
COUNTED = ("gaps", "stale", "extreme", "zero_volume", "invalid", "glitch", "incomplete_days", "unpriced", "no_meta")


def symbol_checks(bars: DataFrame, counts: DataFrame, stale_after: int = 1, beyond: float = 0.5, run: int = 3) -> DataFrame:
    """One row a symbol with what the checks by symbol find: missing and stale days, invalid, glitch and extreme bars, runs without
    volume. One pass over the bars and one shuffle; a run is counted at its bar number `run`. counts are the bars' day counts."""
    days = day_numbers(counts)
    top = days.agg(F.max("day").alias("top"))  # one row
    every, sound = by_symbol(), Window.partitionBy("symbol", "sound").orderBy("date")
    marked = with_returns(bars).withColumns({"sound": valid_bar(), "silent": F.coalesce(F.col("volume"), F.lit(0)) == 0})
    marked = marked.join(F.broadcast(days.select("date", "day")), "date")  # one row a date
    seen = marked.withColumns({
        "place": F.row_number().over(every),
        "next_day": F.lead("day").over(sound),
        "prev_close": F.lag("close").over(every),
        "trailing_avg_vol": F.avg("volume").over(every.rowsBetween(-GLITCH_WINDOW, -1)),
    })
    seen = seen.withColumn("length", F.col("place") - F.coalesce(F.max(F.when(~F.col("silent"), F.col("place"))).over(every.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))

    def number(condition) -> Column:
        return F.count(F.when(condition, 1))

    missing = F.when(F.col("sound"), F.greatest(F.col("next_day") - F.col("day") - 1, F.lit(0)))
    counted = seen.groupBy("symbol").agg(
        F.coalesce(F.sum(missing), F.lit(0)).alias("n_missing"), F.max("day").alias("last_day"), number(~F.col("sound")).alias("n_invalid"),
        number(priced() & glitch_suspect()).alias("n_glitch"), number(F.col("sound") & finite("oc_return") & (F.abs("oc_return") > beyond)).alias("n_extreme"), number(F.col("silent") & (F.col("length") == run)).alias("n_runs"),
    )
    return counted.join(F.broadcast(top), F.lit(True)).withColumn("stale", F.col("top") - F.col("last_day") > stale_after).drop("top", "last_day")


def doctor_report(bars: DataFrame, universe: DataFrame, meta: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """One row a check with its number of problems; `counted` marks those that make a store unhealthy, and every row has the
    `problem_count` of these and whether the store is `ok`.

    meta holds the symbols whose loaded range is known, coverage the session problems, which are reported and not counted. bars
    is read twice, by date and by symbol: pass a table. An empty store has no problems. A row a date and a row a symbol are written."""
    counts = stored(day_counts(bars), "day-counts")
    each = stored(symbol_checks(bars, counts), "symbol-checks")
    own = each.agg(
        F.count(F.when(F.col("n_missing") > 0, 1)).alias("gaps"), F.count(F.when(F.col("stale"), 1)).alias("stale"), F.coalesce(F.sum("n_extreme"), F.lit(0)).alias("extreme"), F.coalesce(F.sum("n_runs"), F.lit(0)).alias("zero_volume"),
        F.count(F.when(F.col("n_invalid") > 0, 1)).alias("invalid"), F.coalesce(F.sum("n_glitch"), F.lit(0)).alias("glitch"),
    )
    known = each.select("symbol")

    def one(frame: DataFrame, name: str) -> DataFrame:
        return frame.agg(F.count(F.lit(1)).alias(name))

    rest = [one(short_days(counts), "incomplete_days"), one(universe.select("symbol").subtract(known), "unpriced"), one(known.subtract(meta.select("symbol")), "no_meta")]
    rest += [] if coverage is None else [one(coverage, "sessions")]
    whole = own
    for part in rest:
        whole = whole.join(part, F.lit(True))  # one row each
    checks = [*COUNTED, *([] if coverage is None else ["sessions"])]
    total = sum((F.col(c) for c in COUNTED), F.lit(0)).cast("long")
    listed = F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("n_problems"), F.lit(c in COUNTED).alias("counted")) for c in checks)))
    return whole.select(listed.alias("x"), total.alias("problem_count")).select("x.*", "problem_count", (F.col("problem_count") == 0).alias("ok"))


def doctor_diff(baseline: DataFrame, now: DataFrame, universe: DataFrame | None = None, recent_days: int = 3) -> DataFrame:
    """What a load brought in: rows (`kind`, symbol, date or null, `severity`).

    New `extreme` bars by key: `fail` if from recent_days before the baseline's newest bar on, else `warn` (a backfill). Symbols with
    `invalid` bars that had none: `fail`. Symbols with runs of `zero_volume` that had none, and symbols of the universe still
    `unpriced`: `warn`. With an empty baseline every extreme bar is recent."""
    newest = baseline.agg(F.max("date").alias("top"))  # one row
    keys = ["symbol", "date"]
    new = extreme_bars(now).select(*keys).join(extreme_bars(baseline).select(*keys), keys, "left_anti").join(F.broadcast(newest), F.lit(True))
    recent = F.coalesce(F.col("date") >= F.date_sub("top", recent_days), F.lit(True))
    rows = new.select(F.lit("extreme").alias("kind"), *keys, F.when(recent, "fail").otherwise("warn").alias("severity"))

    def symbols(frame: DataFrame, kind: str, severity: str) -> DataFrame:
        return frame.select(F.lit(kind).alias("kind"), "symbol", F.lit(None).cast("date").alias("date"), F.lit(severity).alias("severity"))

    for check, kind, severity in ((invalid_bars, "invalid", "fail"), (zero_volume_runs, "zero_volume", "warn")):
        rows = rows.unionByName(symbols(check(now).select("symbol").subtract(check(baseline).select("symbol")), kind, severity))
    return rows if universe is None else rows.unionByName(symbols(universe.select("symbol").subtract(now.select("symbol")), "unpriced", "warn"))


def recheck_verdict(diff: DataFrame) -> DataFrame:
    """One row: `fail` if any row of the diff is, else `warn` if there are rows, else `ok`."""
    return diff.agg(F.count(F.when(F.col("severity") == "fail", 1)).alias("n_fail"), F.count(F.lit(1)).alias("n")).select(F.when(F.col("n_fail") > 0, "fail").when(F.col("n") > 0, "warn").otherwise("ok").alias("verdict"), "n_fail", (F.col("n") - F.col("n_fail")).alias("n_warn"))


def ingest_gate(plan: DataFrame, outcomes: DataFrame, bars: DataFrame, *, today: str, max_failed: float = 0.05, max_age: int = 5) -> DataFrame:
    """Did a load account for every symbol, fail for few, and leave fresh bars."""
    dormant = plan.agg(F.count(F.lit(1)).alias("n_symbols"), F.count(F.when(F.col("action") == "dormant", 1)).alias("n_dormant"))
    done = outcomes.agg(F.count(F.lit(1)).alias("n_accounted"), F.count(F.when(F.col("outcome") == "failed", 1)).alias("n_failed"))
    newest = bars.agg(F.max("date").alias("newest"))
    rows = dormant.join(done, F.lit(True)).join(newest, F.lit(True))  # one row each
    share = F.try_divide(F.col("n_failed").cast("double"), (F.col("n_symbols") - F.col("n_dormant")).cast("double"))
    return rows.select("n_symbols", "n_dormant", "n_failed", (F.col("n_accounted") + F.col("n_dormant") == F.col("n_symbols")).alias("all_accounted"), F.coalesce(share > max_failed, F.lit(False)).alias("too_many_failed"), (F.datediff(F.lit(today).cast("date"), "newest") > max_age).alias("stale_store"))

