"""Returns of exit rules over picks, and the forward ledger's statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.exprs import EPSILON, STOP_TOUCH, exit_rule, finite, ratio

RULES = ("hold_close", "limit_2pct", "limit_stop", "trailing")
COSTS_BPS = (0, 5, 10, 20, 40)


def rule_returns(picks: DataFrame, rules=RULES) -> DataFrame:
    """picks (ol, oc, filled, seq, fill, trail) with one row per rule: `rule`, `worst`, `best`."""
    each = F.array(*(F.struct(F.lit(r).alias("rule"), exit_rule(r).alias("band")) for r in rules))
    exploded = picks.withColumn("one", F.explode(each))
    return exploded.withColumns({"rule": F.col("one.rule"), "worst": F.col("one.band.worst"), "best": F.col("one.band.best")}).drop("one")


def rule_explorer(picks: DataFrame, baskets=(1, 5, 10, 15, 20), windows=(5, 21, 63, 126, 252), rules=RULES) -> DataFrame:
    """Basket by window by rule: compounded growth of equal-weight day returns and share of winning picks, at both ends of the band.

    Days with a pick whose bar is unknown are `missing`; with the trailing rule, days with a session that can't be replayed are `excluded`."""
    nth = Window.partitionBy("target_date").orderBy("rank", "symbol")
    age = picks.select("target_date").distinct().withColumn("age", F.row_number().over(Window.orderBy(F.desc("target_date"))))  # one row a date
    placed = picks.withColumn("place", F.row_number().over(nth))
    cells = rule_returns(placed, rules).withColumn("n", F.explode(F.array(*map(F.lit, baskets)))).where("place <= n")
    stopped = F.col("ol") <= STOP_TOUCH
    both = F.col("filled") & stopped
    days = cells.groupBy("rule", "n", "target_date").agg(
        F.avg("worst").alias("worst"), F.avg("best").alias("best"), F.count(F.lit(1)).alias("picks"), F.count(F.when(F.col("worst") > 0, 1)).alias("wins_w"), F.count(F.when(F.col("best") > 0, 1)).alias("wins_b"),
        F.count(F.when(both, 1)).alias("amb"), F.count(F.when(both & F.col("seq").isNotNull(), 1)).alias("res"), F.count(F.when(stopped, 1)).alias("stopped"), F.count(F.when(stopped & F.col("fill").isNotNull(), 1)).alias("meas"),
        F.max(F.col("ol").isNull() | F.col("oc").isNull()).alias("missing"), F.max(F.col("worst").isNull()).alias("unknown"),
    )
    grid = days.join(F.broadcast(age), "target_date").withColumn("w", F.explode(F.array(*map(F.lit, windows)))).where("age <= w")
    clean = ~F.col("missing") & ~F.col("unknown")

    def total(c: str):
        return F.coalesce(F.sum(F.when(clean, F.col(c))), F.lit(0)).cast("long").alias(c)

    sums = grid.groupBy("rule", "n", "w").agg(
        F.count(F.lit(1)).alias("days"), F.count(F.when(clean, 1)).alias("clean"), F.count(F.when(F.col("missing"), 1)).alias("missing"), F.count(F.when(~F.col("missing") & F.col("unknown"), 1)).alias("excluded"),
        F.product(F.when(clean, 1 + F.col("worst"))).alias("growth_worst"), F.product(F.when(clean, 1 + F.col("best"))).alias("growth_best"), *(total(c) for c in ("picks", "wins_w", "wins_b", "amb", "res", "stopped", "meas")),
    )
    return sums.withColumns({"win_worst": ratio("wins_w", "picks"), "win_best": ratio("wins_b", "picks")}).drop("wins_w", "wins_b")


def paper_record(outcomes: DataFrame, recorded: DataFrame, *, today: str, max_age: int = 5) -> DataFrame:
    """Forward trades to record: live days at most max_age days old that aren't recorded yet, under the limit rule."""
    age = F.datediff(F.lit(today).cast("date"), "target_date")
    new = outcomes.where(~F.col("late") & age.between(0, max_age)).join(recorded.select("target_date").distinct(), "target_date", "left_anti")
    per = Window.partitionBy("target_date")
    filled = F.col("hit") == 1
    return new.select("target_date", "symbol", "rank", F.lit("limit_2pct").alias("rule"), F.when(filled, 0.02).otherwise(F.col("oc_return")).alias("gross_return"), F.when(filled, "limit").otherwise("close").alias("exit_reason"), F.count(F.lit(1)).over(per).alias("n_avail"))


def first_traded(trades: DataFrame, baskets) -> DataFrame:
    """trades once for each `basket` that they belong to: the first so many of a day that traded, by rank, then symbol. A pick that didn't trade
    leaves its place to the next."""
    order = [c for c in ("rank", "symbol") if c in trades.columns]
    place = F.row_number().over(Window.partitionBy("target_date").orderBy(*order))
    return trades.withColumn("place", place).withColumn("basket", F.explode(F.array(*map(F.lit, baskets)))).where("place <= basket").drop("place")


def paper_report(trades: DataFrame, basket: int = 20, costs_bps=COSTS_BPS) -> DataFrame:
    """Growth of a day's first `basket` picks that traded, the share of days that gain, and mean, deviation and t of a day, at each cost level."""
    cost = F.explode(F.array(*map(F.lit, costs_bps)))
    net = first_traded(trades, [basket]).withColumn("cost_bps", cost).withColumn("net", F.col("gross_return") - F.col("cost_bps") / 10_000)
    daily = net.groupBy("cost_bps", "target_date").agg(F.avg("net").alias("day"), F.count(F.lit(1)).alias("n"))
    sums = daily.groupBy("cost_bps").agg(F.product(1 + F.col("day")).alias("growth"), F.count(F.lit(1)).alias("days"), F.sum("n").alias("trades"), ratio(F.count(F.when(F.col("day") > 0, 1)), F.count(F.lit(1))).alias("day_win_rate"), F.avg("day").alias("mean"), F.stddev_samp("day").alias("sd"))
    return sums.withColumn("t", ratio(F.col("mean") * F.sqrt("days"), "sd"))


def paper_breakeven(trades: DataFrame, baskets=(1, 5, 10, 20), steps: int = 60) -> DataFrame:
    """Cost in basis points at which the growth of a day's first `basket` picks that traded is 1, by bisection on [0, 5 %]; 0 if it doesn't grow without cost.

    Growth depends on the daily means alone: one row a basket with an array of a value a day."""
    days = first_traded(trades, baskets).groupBy("basket", "target_date").agg(F.avg("gross_return").alias("day")).groupBy("basket").agg(F.sort_array(F.collect_list("day")).alias("means"))
    growth = "aggregate(means, cast(1 as double), (g, r) -> g * (1 + r - {c}))"
    halve = f"aggregate(sequence(1, {steps}), struct(cast(0 as double) as lo, cast(0.05 as double) as hi), (s, i) -> case when {growth.format(c='(s.lo + s.hi) / 2')} > 1 then struct((s.lo + s.hi) / 2 as lo, s.hi as hi) else struct(s.lo as lo, (s.lo + s.hi) / 2 as hi) end, s -> (s.lo + s.hi) / 2)"
    return days.select("basket", F.size("means").cast("long").alias("days"), F.expr(f"case when {growth.format(c='0')} <= 1 then cast(0 as double) else {halve} * 10000 end").alias("breakeven_bps"))


def halves_by(challengers: DataFrame, champion: DataFrame, least_days: int = 4) -> DataFrame:
    """For each challenger (id, target_date, precision): does it beat the champion (target_date, precision) in both halves of the days that
    they share. The middle day of an odd number belongs to the second half."""
    shared = challengers.select("id", "target_date", F.col("precision").alias("a")).join(champion.select("target_date", F.col("precision").alias("b")), "target_date")
    own = Window.partitionBy("id")  # one row a date
    halved = shared.withColumns({"n": F.row_number().over(own.orderBy("target_date")), "k": F.count(F.lit(1)).over(own)}).withColumn("early", F.col("n") <= F.floor(F.col("k") / 2))
    margin = F.col("a") - F.col("b")
    sums = halved.groupBy("id").agg(F.count(F.lit(1)).alias("days"), F.avg(F.when(F.col("early"), margin)).alias("first_margin"), F.avg(F.when(~F.col("early"), margin)).alias("second_margin"))
    return sums.withColumn("holds", F.coalesce((F.col("days") >= least_days) & (F.col("first_margin") > EPSILON) & (F.col("second_margin") > EPSILON), F.lit(False)))


def halves_hold(challenger: DataFrame, champion: DataFrame, least_days: int = 4) -> DataFrame:
    """The same of one challenger (target_date, precision); no row if they share no day."""
    return halves_by(challenger.withColumn("id", F.lit(0)), champion, least_days).drop("id")


def valid_ledger_rows(rows: DataFrame) -> DataFrame:
    """Rank rows fit to record: finite return, known hit, and both or neither of the extremes."""
    paired = F.col("oh").isNull() == F.col("ol").isNull()
    return rows.where(finite("ret") & F.col("hit").isNotNull() & paired & (F.col("oh").isNull() | (finite("oh") & finite("ol"))))
