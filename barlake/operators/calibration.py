"""How well probabilities mean what they say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions.exprs import EPSILON, ratio
from barlake.operators.prefix import running_before
from barlake.sources.shared import stored

BUCKETS = 10


def day_buckets(rows: DataFrame) -> DataFrame:
    """rows (date, prob, label) summed by day and bucket of prob: all that a calibration report needs, in at most ten rows a day.

    The ten buckets are fixed. Rows without a probability or a label don't count."""
    p, y = F.col("prob").cast("double"), F.col("label").cast("double")
    bucket = F.least(F.lit(BUCKETS - 1), F.greatest(F.lit(0), F.floor(F.col("prob") * BUCKETS + EPSILON))).cast("int")
    return rows.where("prob IS NOT NULL AND label IS NOT NULL").groupBy("date", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("hits"), F.sum(p).alias("sum_p"), F.sum(p * p).alias("sum_pp"), F.sum(p * y).alias("sum_py"))


def reliability_of(sums: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean prediction and reach rate of each bucket; empty buckets are there with nulls (without `by`)."""
    by = by or []
    full = sums.groupBy(*by, "bucket").agg(F.round(F.sum("sum_p") / F.sum("n") + EPSILON, 4).alias("mean_pred"), F.round(F.sum("hits") / F.sum("n") + EPSILON, 4).alias("reach_rate"), F.sum("n").alias("n"))
    if by:
        return full
    every = sums.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    return every.join(full, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def reliability_table(rows: DataFrame) -> DataFrame:
    return reliability_of(day_buckets(rows))


def calibration_slope(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count-weighted least squares slope of reach on prediction over occupied buckets; null for under two or no spread."""
    w, x, y = F.col("n").cast("double"), F.col("mean_pred"), F.col("reach_rate")
    used = table.where("n > 0")
    sums = used.groupBy(*(by or [])).agg(F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"), F.count(F.lit(1)).alias("k"))
    down = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
    return sums.select(*(by or []), F.when((F.col("k") >= 2) & (F.abs(down) > 1e-12), (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / down).alias("slope"))


def _days(sums: DataFrame, by: list[str]) -> DataFrame:
    """A row a day: squared errors of the predictions and of the day's own base rate (hits - hits ** 2 / n)."""
    days = sums.groupBy("date", *by).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), (F.sum("sum_pp") - 2 * F.sum("sum_py") + F.sum("hits")).alias("error"))
    return days.withColumns({"base": F.col("hits") / F.col("n"), "own_error": F.col("hits") - F.col("hits") * F.col("hits") / F.col("n")})


def brier_of(sums: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Brier score against that of each day's own base rate; null skill where the reference is 0."""
    scores = _days(sums, by or []).groupBy(*(by or [])).agg((F.sum("error") / F.sum("n")).alias("brier"), (F.sum("own_error") / F.sum("n")).alias("brier_ref"))
    return scores.withColumn("bss", 1 - ratio("brier", "brier_ref"))


def brier_skill(rows: DataFrame) -> DataFrame:
    return brier_of(day_buckets(rows))


def regimes_of(sums: DataFrame) -> DataFrame:
    """sums with `regime`: low, mid or high by the tertile of its day's base rate; there is one row a day behind the tertiles."""
    days = sums.groupBy("date").agg((F.sum("hits") / F.sum("n")).alias("base"))
    cuts = days.agg(F.percentile("base", F.lit(1 / 3)).alias("lo"), F.percentile("base", F.lit(2 / 3)).alias("hi"))
    named = days.join(F.broadcast(cuts), F.lit(True)).select("date", "base", F.when(F.col("base") <= F.col("lo"), "low").when(F.col("base") > F.col("hi"), "high").otherwise("mid").alias("regime"))
    return sums.join(F.broadcast(named), "date")


def regimes_report(sums: DataFrame) -> DataFrame:
    marked = regimes_of(sums)
    sizes = marked.groupBy("regime").agg(F.sum("n").alias("n"), F.countDistinct("date").alias("days"), F.min("base").alias("base_min"), F.max("base").alias("base_max"))
    slopes = calibration_slope(reliability_of(marked, ["regime"]), ["regime"])
    return sizes.join(brier_of(marked, ["regime"]).select("regime", "bss"), "regime").join(slopes, "regime", "left")


def regime_report(rows: DataFrame) -> DataFrame:
    """Per regime: rows, days, span of base rates, Brier skill and slope. The rows are read once, into a table of days and buckets."""
    return regimes_report(stored(day_buckets(rows), "day-buckets"))


def calibration_report(rows: DataFrame) -> DataFrame:
    """Everything about all names in one row: size, Brier scores, slope, the table of buckets and the regimes as arrays."""
    sums = stored(day_buckets(rows), "day-buckets")
    table = reliability_of(sums)
    buckets = table.agg(F.array_sort(F.collect_list(F.struct("bucket", "mean_pred", "reach_rate", "n"))).alias("reliability"))  # ten rows
    regimes = regimes_report(sums).agg(F.array_sort(F.collect_list(F.struct("regime", "n", "days", "base_min", "base_max", "bss", "slope"))).alias("regimes"))  # three rows
    size = sums.agg(F.lit("all_names_test").alias("population"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_distinct("date").alias("n_days"))
    return size.join(brier_of(sums), F.lit(True)).join(calibration_slope(table), F.lit(True)).join(buckets, F.lit(True)).join(regimes, F.lit(True))


def pick_calibration(picks: DataFrame, top_n: int) -> DataFrame:
    """The same of the picks alone, in one row: size, table and slope. No skill score: after selection it measures the selection."""
    sums = stored(day_buckets(picks), "day-buckets")
    table = reliability_of(sums)
    buckets = table.agg(F.array_sort(F.collect_list(F.struct("bucket", "mean_pred", "reach_rate", "n"))).alias("reliability"))  # ten rows
    size = sums.agg(F.lit("top_n_liquid_picks").alias("population"), F.lit(top_n).alias("top_n"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_distinct("date").alias("n_days"))
    return size.join(calibration_slope(table), F.lit(True)).join(buckets, F.lit(True))


def expected_calibration_error(table: DataFrame) -> DataFrame:
    """Count-weighted gap, its verdict, the fullest bucket, and buckets from .7 up that promise .075 too much."""
    used = table.where("n > 0").withColumn("gap", F.col("mean_pred") - F.col("reach_rate"))
    one = used.agg(ratio(F.sum(F.abs("gap") * F.col("n")), F.sum("n")).alias("ece"), F.max_by("bucket", F.struct("n", "mean_pred")).alias("modal_bucket"), F.count(F.when((F.col("mean_pred") >= 0.7) & (F.col("gap") >= 0.075), 1)).alias("tail_buckets"))
    return one.withColumn("verdict", F.when(F.col("ece") <= 0.05, "good").when(F.col("ece") <= 0.10, "fair").otherwise("poor"))


def auc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve from counts per distinct probability, unrounded; ties count half. Null where a class is missing."""
    counts = rows.where("prob IS NOT NULL AND label IS NOT NULL").groupBy(F.col("prob").alias("p")).agg(F.sum(F.col("label").cast("long")).alias("pos"), F.sum((1 - F.col("label")).cast("long")).alias("neg"))
    ranked = running_before(counts, "p", ["neg"])
    won = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    return ranked.agg(ratio(won, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def benchmark_metrics(rows: DataFrame, picks: DataFrame) -> DataFrame:
    """rows (date, prob, label) scored out of sample, picks (date, rank, label): precision is the mean of daily means."""
    daily = picks.groupBy("date").agg(F.avg(F.col("label").cast("double")).alias("p_n"), F.avg(F.when(F.col("rank") <= 1, F.col("label").cast("double"))).alias("p_1"), F.avg(F.when(F.col("rank") <= 5, F.col("label").cast("double"))).alias("p_5"))
    means = daily.agg(F.avg("p_n").alias("precision_at_n"), F.avg("p_1").alias("precision_at_1"), F.avg("p_5").alias("precision_at_5"), F.count(F.lit(1)).alias("days"))
    pooled = rows.agg(F.avg(F.col("label").cast("double")).alias("base_rate"), F.avg((F.col("prob") - F.col("label")) ** 2).alias("brier"), F.count(F.lit(1)).alias("n_rows"))
    return means.join(pooled, F.lit(True)).withColumn("lift", ratio("precision_at_n", "base_rate"))
