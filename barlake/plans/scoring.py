"""Plans of scoring, calibration and the explorers, on the predictions log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions.exprs import LIQUIDITY
from barlake.operators import bars as B
from barlake.operators import calibration as C
from barlake.operators import features as X
from barlake.operators import scoring as P
from barlake.plans.daily import R, rounded
from barlake.plans.inputs import LATE, Users, nation_features
from barlake.plans.registry import query, subquery
from barlake.sources.shared import stored

subquery("days", ["outcomes", "ubase"], "SELECT signal_date, target_date, n_scored, hits, precision, late, base_rate, precision / nullif(base_rate, 0) AS lift FROM (SELECT signal_date, target_date, count(*) AS n_scored, CAST(sum(hit) AS BIGINT) AS hits, avg(hit) AS precision, bool_or(late) AS late FROM outcomes GROUP BY 1, 2) LEFT JOIN ubase ON date = target_date")
subquery("perf", ["outcomes"], "SELECT target_date, first(symbol ORDER BY rank, symbol, signal_date) AS top1_symbol, min(rank) AS top1_rank, first(oc_return ORDER BY rank, symbol, signal_date) AS top1_return, first(hit ORDER BY rank, symbol, signal_date) AS top1_hit, avg(oc_return) AS topn_return, CAST(sum(hit) AS BIGINT) AS topn_hits, count(*) AS n_avail, bool_or(late) AS late FROM outcomes GROUP BY 1")
subquery("inwin", ["days"], "SELECT * FROM days WHERE NOT late AND lift IS NOT NULL ORDER BY target_date DESC, signal_date DESC LIMIT 5")
subquery("probs", ["nscored"], "SELECT target_date AS date, symbol, prob, did_2pct_next AS label, median_vol_20, signal_date FROM nscored WHERE did_2pct_next IS NOT NULL")
subquery("nbucket", ["probs"], "SELECT CAST(least(9, greatest(0, floor(prob * 10 + 1e-9))) AS INTEGER) AS bucket, round(avg(prob) + 1e-9, 4) AS mean_pred, round(avg(label) + 1e-9, 4) AS reach_rate, count(*) AS n FROM probs GROUP BY 1")
SLOPE = "CASE WHEN count(*) >= 2 AND abs(sum(n) * sum(n * mean_pred * mean_pred) - sum(n * mean_pred) * sum(n * mean_pred)) > 1e-12 THEN (sum(n) * sum(n * mean_pred * reach_rate) - sum(n * mean_pred) * sum(n * reach_rate)) / (sum(n) * sum(n * mean_pred * mean_pred) - sum(n * mean_pred) * sum(n * mean_pred)) END"
BRIER = "avg((prob - label) ** 2) AS brier, avg((own - label) ** 2) AS brier_ref, 1 - avg((prob - label) ** 2) / nullif(avg((own - label) ** 2), 0) AS bss"
subquery("regimed", ["probs"], "SELECT p.*, base, CASE WHEN base <= lo THEN 'low' WHEN base > hi THEN 'high' ELSE 'mid' END AS regime, avg(label) OVER (PARTITION BY date) AS own FROM probs p JOIN (SELECT date, avg(label) AS base FROM probs GROUP BY 1) USING (date), (SELECT quantile_cont(base, 1.0 / 3) AS lo, quantile_cont(base, 2.0 / 3) AS hi FROM (SELECT date, avg(label) AS base FROM probs GROUP BY 1))")


def outcomes(u: Users) -> DataFrame:
    return P.rank_outcomes(u.log, u.returns, u.complete)


def days(u: Users) -> DataFrame:
    return P.score_days(outcomes(u), B.base_rates(u.returns, u.complete))


def probabilities(spark, d) -> DataFrame:
    """Fixed probabilities and labels on the long history."""
    return X.formula_score(nation_features(spark, d)).where("did_2pct_next IS NOT NULL").select(F.col("target_date").alias("date"), "symbol", "prob", F.col("did_2pct_next").alias("label"), "median_vol_20", "signal_date")


@query("a07_score_days", ["days"], f"SELECT signal_date, target_date, n_scored, hits, late, {R.format('precision')}, {R.format('base_rate')}, {R.format('lift')} FROM days")
def a07(spark, d):
    return rounded(days(Users(spark, d)), "precision", "base_rate", "lift")


@query("j05_three_way_join", ["touchlog", "resolved", "ur"], "SELECT symbol, signal_date, target_date, rank, round(close, 6) + 0.0 AS close FROM touchlog JOIN resolved USING (signal_date) JOIN (SELECT symbol, date AS target_date, close FROM ur) USING (symbol, target_date)")
def j05(spark, d):
    """Predictions, the day that they resolve to, and that day's bar."""
    u = Users(spark, d)
    picks = P.resolved_log(u.log, u.complete)
    return rounded(picks.join(u.returns.select("symbol", F.col("date").alias("target_date"), "close"), ["symbol", "target_date"]).select("symbol", "signal_date", "target_date", "rank", "close"), "close")


@query("a07b_pending_days", ["touchlog", "resolved"], "SELECT DISTINCT signal_date FROM touchlog WHERE signal_date NOT IN (SELECT signal_date FROM resolved)")
def a07b(spark, d):
    u = Users(spark, d)
    return P.pending_days(u.log, u.complete)


@query("a08_pick_performance", ["perf"], f"SELECT target_date, top1_symbol, top1_rank, top1_hit, topn_hits, n_avail, late, {R.format('top1_return')}, {R.format('topn_return')} FROM perf")
def a08(spark, d):
    return rounded(P.pick_performance(outcomes(Users(spark, d))), "top1_return", "topn_return")


@query("a09_rank_outcomes", ["outcomes"], f"SELECT target_date, symbol, rank, hit, late, {R.format('oc_return')}, {R.format('high_return')}, {R.format('low_return')} FROM outcomes")
def a09(spark, d):
    return rounded(outcomes(Users(spark, d)).select("target_date", "symbol", "rank", "hit", "late", "oc_return", "high_return", "low_return"), "oc_return", "high_return", "low_return")


@query("a10_created_by_target", ["created"], "SELECT target_date, created FROM created")
def a10(spark, d):
    u = Users(spark, d)
    return P.created_by_target(u.log, u.complete)


@query("a11_late_flag", ["created"], f"SELECT target_date, {LATE} AS late FROM created")
def a11(spark, d):
    u = Users(spark, d)
    return P.late_days(u.log, u.complete)


@query("a12_precision_at_1", ["perf"], "SELECT round(avg(CASE WHEN NOT late THEN top1_hit END), 6) + 0.0 AS live, round(avg(top1_hit), 6) + 0.0 AS every, count(CASE WHEN NOT late THEN 1 END) AS live_days, count(*) AS days FROM perf")
def a12(spark, d):
    return rounded(P.precision_at_1(P.pick_performance(outcomes(Users(spark, d)))), "live", "every")


POOL = "count(*) AS days, CAST(sum(n_scored) AS BIGINT) AS picks, sum(hits) / sum(n_scored) AS precision, sum(base_rate * n_scored) / sum(n_scored) AS base_rate, count(CASE WHEN lift < 1 THEN 1 END) AS days_below_1"


def verdict_sql(days: str) -> str:
    """The verdict of a days table, from its live days numbered from the newest."""
    return f"""SELECT count(*) FILTER (lift IS NOT NULL) AS live_days, count(*) FILTER (lift IS NULL) AS excluded, CAST(coalesce(sum(n_scored) FILTER (k <= 5), 0) AS BIGINT) AS picks, CASE WHEN count(lift) >= 5 THEN sum(hits) FILTER (k <= 5) / sum(n_scored) FILTER (k <= 5) END AS precision,
      CASE WHEN count(lift) >= 5 THEN sum(base_rate * n_scored) FILTER (k <= 5) / sum(n_scored) FILTER (k <= 5) END AS base_rate, count(*) FILTER (k <= 5 AND lift < 1 - 1e-9) AS days_below_1
      FROM (SELECT *, CASE WHEN lift IS NOT NULL THEN row_number() OVER (PARTITION BY lift IS NULL ORDER BY target_date DESC, signal_date DESC) END AS k FROM ({days}) WHERE NOT late)"""


VERDICT = f"SELECT {{}} live_days, excluded, picks, {R.format('precision')}, {R.format('base_rate')}, round(precision - base_rate, 6) + 0.0 AS excess, days_below_1, live_days >= 5 AS armed, coalesce(live_days >= 5 AND precision - base_rate < -1e-9, FALSE) AS degraded FROM ({{}})"


@query("a13_degradation_verdict", ["days"], VERDICT.format("", verdict_sql("SELECT * FROM days")))
def a13(spark, d):
    return rounded(P.degradation_verdict(days(Users(spark, d))), "precision", "base_rate", "excess")


@query("a13b_degradation_unarmed", ["days"], " UNION ALL ".join(VERDICT.format(f"{n} AS upto,", verdict_sql(f"SELECT * REPLACE (CASE WHEN day(target_date) % 3 = 0 THEN NULL ELSE lift END AS lift) FROM days WHERE day(target_date) <= {n}")) for n in (4, 8, 31)))
def a13b(spark, d):
    """The verdict as it stood on some days, with a third of the days without a lift: first not armed, then armed."""
    scored = stored(days(Users(spark, d)), "days").withColumn("lift", F.when(F.dayofmonth("target_date") % 3 != 0, F.col("lift")))
    made = [P.degradation_verdict(scored.where(F.dayofmonth("target_date") <= n)).withColumn("upto", F.lit(n)) for n in (4, 8, 31)]
    return rounded(made[0].unionByName(made[1]).unionByName(made[2]), "precision", "base_rate", "excess")


@query("a14_live_record", ["days"], f"SELECT days, picks, {R.format('precision')}, {R.format('base_rate')}, round(precision / base_rate, 6) + 0.0 AS lift, round(precision - base_rate, 6) + 0.0 AS excess FROM (SELECT {POOL} FROM days WHERE NOT late AND base_rate IS NOT NULL)")
def a14(spark, d):
    return rounded(P.live_record(days(Users(spark, d))), "precision", "base_rate", "lift", "excess")


CHALLENGER = "'c' || CAST(day(signal_date) % 3 AS VARCHAR) AS challenger"


@query("a15_shadow_scores", ["days", "touchlog", "resolved"], f"""SELECT challenger, coalesce(live_days, 0) AS live_days, coalesce(late_days, 0) AS late_days, coalesce(pending_days, 0) AS pending_days, coalesce(lift_days, 0) AS lift_days, {R.format('mean_precision')}, {R.format('mean_base_rate')}, {R.format('mean_lift')} FROM
  (SELECT {CHALLENGER}, count(*) FILTER (NOT late) AS live_days, count(*) FILTER (late) AS late_days, avg(precision) FILTER (NOT late) AS mean_precision, avg(base_rate) FILTER (NOT late) AS mean_base_rate, avg(lift) FILTER (NOT late) AS mean_lift, count(lift) FILTER (NOT late) AS lift_days FROM days GROUP BY 1)
  FULL JOIN (SELECT {CHALLENGER}, count(DISTINCT signal_date) AS pending_days FROM touchlog WHERE signal_date NOT IN (SELECT signal_date FROM resolved) GROUP BY 1) USING (challenger)""")
def a15(spark, d):
    u = Users(spark, d)
    name = F.concat(F.lit("c"), (F.dayofmonth("signal_date") % 3).cast("string"))
    marked, waiting = (x.withColumn("challenger", name) for x in (days(u), P.pending_days(u.log, u.complete)))
    return rounded(P.shadow_scores(marked, waiting), "mean_precision", "mean_base_rate", "mean_lift")


@query("a29_reliability_table", ["nbucket"], "SELECT CAST(k AS INTEGER) AS bucket, mean_pred, reach_rate, coalesce(n, 0) AS n FROM range(10) t(k) LEFT JOIN nbucket ON bucket = k")
def a29(spark, d):
    return C.reliability_table(probabilities(spark, d))


@query("a30_calibration_slope", ["nbucket"], f"SELECT round({SLOPE}, 6) + 0.0 AS slope FROM nbucket")
def a30(spark, d):
    return rounded(C.calibration_slope(C.reliability_table(probabilities(spark, d))), "slope")


@query("a31_brier_skill", ["regimed"], f"SELECT {R.format('brier')}, {R.format('brier_ref')}, {R.format('bss')} FROM (SELECT {BRIER} FROM regimed)")
def a31(spark, d):
    return rounded(C.brier_skill(probabilities(spark, d)), "brier", "brier_ref", "bss")


@query(
    "a32_regime_report",
    ["regimed"],
    f"""SELECT regime, a.n, days, {R.format('base_min')}, {R.format('base_max')}, {R.format('bss')}, {R.format('slope')} FROM (SELECT regime, count(*) AS n, count(DISTINCT date) AS days, min(base) AS base_min, max(base) AS base_max, {BRIER} FROM regimed GROUP BY 1) a
      LEFT JOIN (SELECT regime, {SLOPE} AS slope FROM (SELECT regime, least(9, greatest(0, floor(prob * 10 + 1e-9))) AS bucket, round(avg(prob) + 1e-9, 4) AS mean_pred, round(avg(label) + 1e-9, 4) AS reach_rate, count(*) AS n FROM regimed GROUP BY 1, 2) GROUP BY 1) USING (regime)""",
)
def a32(spark, d):
    return rounded(C.regime_report(probabilities(spark, d)), "base_min", "base_max", "bss", "slope")


@query("a33_calibration_report", ["nbucket", "regimed"], f"SELECT n, n_days, round(slope, 6) + 0.0 AS slope, {R.format('brier')}, {R.format('bss')}, n_buckets, regimes FROM (SELECT {SLOPE} AS slope, count(*) AS n_buckets FROM nbucket), (SELECT count(*) AS n, count(DISTINCT date) AS n_days, {BRIER} FROM regimed), (SELECT string_agg(regime || ':' || CAST(k AS VARCHAR), ',' ORDER BY regime) AS regimes FROM (SELECT regime, count(*) AS k FROM regimed GROUP BY 1))")
def a33(spark, d):
    report = C.calibration_report(probabilities(spark, d))
    filled = F.size(F.filter("reliability", lambda b: b["n"] > 0)).cast("long").alias("n_buckets")
    regimes = F.array_join(F.transform("regimes", lambda r: F.concat(r["regime"], F.lit(":"), r["n"].cast("string"))), ",").alias("regimes")
    return rounded(report.select("n", "n_days", "slope", "brier", "bss", filled, regimes), "slope", "brier", "bss")


@query("a33b_pick_calibration", ["probs"], f"""SELECT n, n_days, round(slope, 6) + 0.0 AS slope FROM (SELECT {SLOPE} AS slope, CAST(sum(n) AS BIGINT) AS n FROM (SELECT least(9, floor(prob * 10 + 1e-9)) AS bucket, round(avg(prob) + 1e-9, 4) AS mean_pred, round(avg(label) + 1e-9, 4) AS reach_rate, count(*) AS n FROM picked GROUP BY 1)), (SELECT count(DISTINCT date) AS n_days FROM picked)""".replace("picked", f"(SELECT * FROM probs WHERE median_vol_20 >= {LIQUIDITY} QUALIFY row_number() OVER (PARTITION BY signal_date ORDER BY prob DESC, symbol) <= 10)"))
def a33b(spark, d):
    picks = X.select_top(probabilities(spark, d), 10, LIQUIDITY)
    return rounded(C.pick_calibration(picks, 10).select("n", "n_days", "slope"), "slope")


@query(
    "a34_expected_calibration_error",
    ["nbucket"],
    "SELECT round(ece, 6) + 0.0 AS ece, modal_bucket, tail_buckets, CASE WHEN ece <= 0.05 THEN 'good' WHEN ece <= 0.10 THEN 'fair' ELSE 'poor' END AS verdict FROM (SELECT sum(abs(mean_pred - reach_rate) * n) / sum(n) AS ece, (SELECT bucket FROM nbucket ORDER BY n DESC, mean_pred DESC LIMIT 1) AS modal_bucket, count(CASE WHEN mean_pred >= 0.7 AND mean_pred - reach_rate >= 0.075 THEN 1 END) AS tail_buckets FROM nbucket)",
)
def a34(spark, d):
    return rounded(C.expected_calibration_error(C.reliability_table(probabilities(spark, d))), "ece")


#: The sum of the positives' mid-ranks, of a score that is hardly ever tied.
RANKS = "SELECT label, rank() OVER (ORDER BY raw) + (count(*) OVER (PARTITION BY raw) - 1) / 2 AS mid FROM (SELECT label, prob + close_pos * 1e-6 AS raw FROM (SELECT p.*, f.close_pos FROM probs p JOIN nfeat f USING (symbol, signal_date)) WHERE close_pos IS NOT NULL)"


@query("a35_auc", ["probs", "nfeat"], f"SELECT round((sum(mid) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) + 0.0 AS auc FROM ({RANKS})")
def a35(spark, d):
    scored = X.formula_score(nation_features(spark, d)).where("did_2pct_next IS NOT NULL AND close_pos IS NOT NULL")
    return rounded(C.auc(scored.select((F.col("prob") + F.col("close_pos") * 1e-6).alias("prob"), F.col("did_2pct_next").alias("label"))), "auc")


@query(
    "a36_benchmark_metrics",
    ["probs"],
    f"""SELECT round(p_n, 6) + 0.0 AS precision_at_n, round(p_1, 6) + 0.0 AS precision_at_1, round(p_5, 6) + 0.0 AS precision_at_5, days, {R.format('base_rate')}, {R.format('brier')}, n_rows, round(p_n / base_rate, 6) + 0.0 AS lift
      FROM (SELECT avg(a) AS p_n, avg(b) AS p_1, avg(c) AS p_5, count(*) AS days FROM (SELECT date, avg(label) AS a, avg(CASE WHEN rank <= 1 THEN label END) AS b, avg(CASE WHEN rank <= 5 THEN label END) AS c
        FROM (SELECT *, row_number() OVER (PARTITION BY signal_date ORDER BY prob DESC, symbol) AS rank FROM probs WHERE median_vol_20 >= {LIQUIDITY} QUALIFY rank <= 10) GROUP BY 1)),
      (SELECT avg(label) AS base_rate, avg((prob - label) ** 2) AS brier, count(*) AS n_rows FROM probs)""",
)
def a36(spark, d):
    rows = probabilities(spark, d)
    return rounded(C.benchmark_metrics(rows, X.select_top(rows, 10, LIQUIDITY)), "precision_at_n", "precision_at_1", "precision_at_5", "base_rate", "brier", "lift")


@query(
    "a41_reach_explorer",
    ["outcomes", "ubase"],
    """SELECT n, w, count(*) AS days, round(avg(reach), 6) + 0.0 AS reach, round(avg(base_rate), 6) + 0.0 AS base_rate, count(CASE WHEN avail < n THEN 1 END) AS short_days, count(CASE WHEN subst THEN 1 END) AS subst_days, count(base_rate) AS base_days FROM
      (SELECT n, target_date, avg(hit) AS reach, count(*) AS avail, bool_or(rank <> place) AS subst FROM (SELECT *, row_number() OVER (PARTITION BY target_date ORDER BY rank, symbol) AS place FROM outcomes WHERE NOT late), (VALUES (1), (5), (10), (15), (20)) b(n) WHERE place <= n GROUP BY 1, 2)
      JOIN (SELECT target_date, row_number() OVER (ORDER BY target_date DESC) AS age FROM (SELECT DISTINCT target_date FROM outcomes WHERE NOT late)) USING (target_date) LEFT JOIN ubase ON date = target_date, (VALUES (5), (21), (63), (126), (252)) v(w) WHERE age <= w GROUP BY 1, 2""",
)
def a41(spark, d):
    u = Users(spark, d)
    return rounded(P.reach_explorer(outcomes(u), B.base_rates(u.returns, u.complete)), "reach", "base_rate")


@query("a43_new_scored_days", ["days"], "SELECT count(*) AS n_new FROM (SELECT DISTINCT target_date FROM days) WHERE target_date NOT IN (SELECT target_date FROM days WHERE day(target_date) % 2 = 0)")
def a43(spark, d):
    now = days(Users(spark, d)).select("target_date").distinct()
    return now.join(now.where(F.dayofmonth("target_date") % 2 == 0), "target_date", "left_anti").agg(F.count(F.lit(1)).alias("n_new"))


@query("a44_degradation_evidence", ["days", "inwin"], f"SELECT target_date, hits, n_scored, late, {R.format('precision')}, {R.format('base_rate')}, {R.format('lift')}, (signal_date, target_date) IN (SELECT (signal_date, target_date) FROM inwin) AS in_window FROM (SELECT * FROM days ORDER BY target_date DESC, signal_date DESC LIMIT 10)")
def a44(spark, d):
    shown = P.degradation_evidence(days(Users(spark, d)))
    return rounded(shown.select("target_date", "hits", "n_scored", "late", "precision", "base_rate", "lift", "in_window"), "precision", "base_rate", "lift")


@query("k02_first_available", ["outcomes"], "SELECT target_date, symbol, CAST(row_number() OVER (PARTITION BY target_date ORDER BY rank, symbol) AS INTEGER) AS place FROM outcomes WHERE CAST(symbol AS BIGINT) % 3 <> 0 QUALIFY place <= 3")
def k02(spark, d):
    from pyspark.sql import Window

    open_names = outcomes(Users(spark, d)).where(F.col("symbol").cast("long") % 3 != 0)
    place = F.row_number().over(Window.partitionBy("target_date").orderBy("rank", "symbol"))
    return open_names.select("target_date", "symbol", place.alias("place")).where("place <= 3")


@query("m09_formula_strategy", ["uscored"], "SELECT symbol, signal_date, prob FROM uscored")
def m09(spark, d):
    return Users(spark, d).scored.select("symbol", "signal_date", "prob")


