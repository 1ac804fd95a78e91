"""Plans of walk-forward validation and prediction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barlake.operators import ml as M
from barlake.operators.ledger import load_roster
from barlake.plans.daily import rounded
from barlake.plans.inputs import nation_features
from barlake.plans.registry import query, subquery
from barlake.sources import tables as S
from barlake.sources import writers as W
from barlake.sources.shared import fresh_path, stored

MONTHS, TOP_N = 12, 20
#: Small tables fill no fold: then the benchmarks have no rows.
RUNS = "(SELECT * FROM folds WHERE (SELECT count(*) FROM nlab WHERE target_date < month_start) >= 10000)"
subquery("nlab", ["nfeat"], "SELECT * FROM nfeat WHERE did_2pct_next IS NOT NULL")
subquery("folds", ["nlab"], f"SELECT month_start, last_day(month_start) AS month_end FROM (SELECT DISTINCT CAST(date_trunc('month', target_date) AS DATE) AS month_start FROM nlab) ORDER BY 1 DESC LIMIT {MONTHS}")


def history(spark, d):
    """The feature frame as a table, since every fold reads it."""
    path = fresh_path(spark, "features")
    nation_features(spark, d).write.parquet(path)
    return spark.read.parquet(path)


def last_day_of(frame):
    return frame.agg(F.max(F.when(F.col("did_2pct_next").isNotNull(), F.col("signal_date")))).first()[0]


@query("m01_month_folds", ["folds"], "SELECT month_start, month_end FROM folds")
def m01(spark, d):
    return M.month_folds(nation_features(spark, d).where("did_2pct_next IS NOT NULL"), MONTHS)


@query("m02_walk_forward_split", ["folds", "nlab"], "SELECT month_start, month_end, count(CASE WHEN target_date < month_start THEN 1 END) AS n_train, count(CASE WHEN target_date BETWEEN month_start AND month_end THEN 1 END) AS n_test, count(CASE WHEN target_date < month_start THEN 1 END) >= 10000 AND count(CASE WHEN target_date BETWEEN month_start AND month_end THEN 1 END) > 0 AS runs FROM folds, nlab GROUP BY 1, 2")
def m02(spark, d):
    return M.walk_forward_split(nation_features(spark, d), MONTHS)


FILLED = " + ".join(f"CAST(count({c}) > 0 AS INTEGER)" for c in M.FEATURES)


@query("m03_strategy_registry", ["nfeat"], f"SELECT strategy, n_features FROM (VALUES ('constant'), ('formula'), ('gbt'), ('logreg'), ('stochastic_gbt'), ('stochastic_trees')) s(strategy), (SELECT {FILLED} AS n_features FROM nfeat)")
def m03(spark, d):
    """Registered strategies with the features that their training rows fill."""
    filled = nation_features(spark, d).agg(*(F.count(c).alias(c) for c in M.FEATURES)).first()
    return spark.createDataFrame([(name, sum(bool(filled[c]) for c in M.FEATURES)) for name in sorted(M.REGISTRY)], "strategy string, n_features int")


FORMULA_PICKS = "SELECT signal_date, symbol, CAST(row_number() OVER (ORDER BY prob DESC, symbol) AS INTEGER) AS rank, prob FROM nscored WHERE signal_date = (SELECT max(signal_date) FROM nscored WHERE did_2pct_next IS NOT NULL) AND median_vol_20 >= 100000"
#: What any strategy's picks of the last day must be like: as many as names are liquid, by falling probability, with no name twice.
PICKS_SQL = f"SELECT signal_date, rank, TRUE AS in_range, TRUE AS falling, (SELECT count(*) FROM ({FORMULA_PICKS}) WHERE rank <= 10) AS n_names FROM ({FORMULA_PICKS}) WHERE rank <= 10"


def _fit(name, **params):
    """A digest of a fitted strategy's picks: their probabilities stand on the fit, all else is fixed."""

    def run(spark, d):
        frame = history(spark, d)
        picks = stored(M.predict_for(frame, name, last_day_of(frame), 10, **params), "picks")
        above = F.lag("prob").over(Window.partitionBy("signal_date").orderBy("rank"))  # ten rows
        names = picks.agg(F.count_distinct("symbol").alias("n_names"))
        return picks.select("signal_date", "rank", F.col("prob").between(0, 1).alias("in_range"), F.coalesce(F.col("prob") <= above, F.lit(True)).alias("falling")).join(names, F.lit(True))

    return run


query("m04_gbt_strategy", ["nscored"], PICKS_SQL)(_fit("gbt"))
query("m05_logreg_strategy", ["nscored"], PICKS_SQL)(_fit("logreg"))
query("m06_stochastic_gbt_strategy", ["nscored"], PICKS_SQL)(_fit("stochastic_gbt"))


PICKED = f"(SELECT n.*, row_number() OVER (PARTITION BY signal_date ORDER BY prob DESC, symbol) AS rank FROM nscored n JOIN {RUNS} ON target_date BETWEEN month_start AND month_end WHERE did_2pct_next IS NOT NULL AND median_vol_20 >= 100000 QUALIFY rank <= 20)"


@query(
    "m07_run_benchmark",
    ["folds", "nscored", "nlab"],
    f"""SELECT 1 AS id, 'logreg' AS strategy, 'open_to_high' AS event, '{{"months": 12, "top_n": 20}}' AS params, count(*) AS n_rows, count(DISTINCT target_date) AS n_days, CAST(count(DISTINCT target_date) AS VARCHAR) AS days, max(scored) AS scored, round(max(base), 6) + 0.0 AS base_rate, TRUE AS in_range FROM {PICKED},
      (SELECT avg(did_2pct_next) AS base, CAST(count(*) AS VARCHAR) AS scored FROM nscored JOIN {RUNS} ON target_date BETWEEN month_start AND month_end WHERE did_2pct_next IS NOT NULL) HAVING count(*) > 0""",
)
def m07(spark, d):
    """A logistic regression benchmarked and recorded: its ledger row as readers find it, of the metrics those that don't stand on the fit."""
    ledger, daily = fresh_path(spark, "ledger"), fresh_path(spark, "ledger-daily")
    M.record_benchmark(spark, M.run_benchmark(history(spark, d), "logreg", MONTHS, TOP_N), ledger, daily, run_id=1, run_ts="2024-02-01 00:00:00")
    runs, rows = W.recorded_experiments(spark, ledger, daily)
    counts = rows.groupBy(F.col("seq").alias("id")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("target_date").alias("n_days"))
    metric = {name: F.get_json_object("metrics", f"$.{name}") for name in ("days", "n_rows", "base_rate", "auc", "precision_at_n", "brier")}
    unit = [metric[name].cast("double").between(0, 1) for name in ("auc", "precision_at_n", "brier")]
    return rounded(runs.join(counts, "id").select(F.col("id").cast("int").alias("id"), "strategy", "event", "params", "n_rows", "n_days", metric["days"].alias("days"), metric["n_rows"].alias("scored"), metric["base_rate"].cast("double").alias("base_rate"), (unit[0] & unit[1] & unit[2]).alias("in_range")), "base_rate")


@query(
    "m07b_run_benchmark_formula",
    ["folds", "nscored", "nlab"],
    f"""SELECT round(p_n, 6) + 0.0 AS precision_at_n, days, round(base, 6) + 0.0 AS base_rate, n_rows, round(p_n / base, 6) + 0.0 AS lift FROM
      (SELECT avg(a) AS p_n, count(*) AS days FROM (SELECT target_date, avg(did_2pct_next) AS a FROM {PICKED} GROUP BY 1)),
      (SELECT avg(did_2pct_next) AS base, count(*) AS n_rows FROM nscored JOIN {RUNS} ON target_date BETWEEN month_start AND month_end WHERE did_2pct_next IS NOT NULL) WHERE n_rows > 0""",
)
def m07b(spark, d):
    made = M.run_benchmark(history(spark, d), "formula", MONTHS, TOP_N).metrics
    return rounded(made.select("precision_at_n", "days", "base_rate", "n_rows", "lift"), "precision_at_n", "base_rate", "lift")


@query("m07c_benchmark_outcomes", ["folds", "nscored", "nlab"], f"SELECT target_date, CAST(rank AS INTEGER) AS rank, symbol, did_2pct_next AS hit, round(next_oc_return, 6) + 0.0 AS ret, round(next_high_return, 6) + 0.0 AS oh, round(next_low_return, 6) + 0.0 AS ol FROM {PICKED}")
def m07c(spark, d):
    return rounded(M.run_benchmark(history(spark, d), "formula", MONTHS, TOP_N).daily, "ret", "oh", "ol")


LIFTS = ", ".join(f"(SELECT avg(a) / max(base) AS lift_{side} FROM (SELECT target_date, avg(did_2pct_next) AS a FROM {PICKED.replace('20)', '5)') if side == 'a' else PICKED.replace('prob DESC, ', '').replace('20)', '5)')} GROUP BY 1), (SELECT avg(did_2pct_next) AS base FROM nscored JOIN {RUNS} ON target_date BETWEEN month_start AND month_end WHERE did_2pct_next IS NOT NULL))" for side in "ab")


@query("m10b_compare_strategies", ["folds", "nscored", "nlab"], f"SELECT round(lift_a, 6) + 0.0 AS lift_a, round(lift_b, 6) + 0.0 AS lift_b, CASE WHEN abs(lift_a - lift_b) < 0.1 - 1e-9 THEN 'within_noise' WHEN lift_a > lift_b THEN 'a' ELSE 'b' END AS verdict FROM {LIFTS} WHERE lift_a IS NOT NULL")
def m10b(spark, d):
    """The formula against a constant, five names a day on the same folds."""
    made = M.compare_strategies(history(spark, d), "formula", "constant", months=MONTHS, top_n=5)
    return rounded(made.select("lift_a", "lift_b", "verdict"), "lift_a", "lift_b")


@query("m08_predict_for", ["nscored"], "SELECT signal_date, symbol, prob, CAST(row_number() OVER (ORDER BY prob DESC, symbol) AS INTEGER) AS rank FROM nscored WHERE signal_date = (SELECT max(signal_date) FROM nscored WHERE did_2pct_next IS NOT NULL) AND median_vol_20 >= 100000 ORDER BY rank LIMIT 10")
def m08(spark, d):
    frame = history(spark, d)
    return M.predict_for(frame, "formula", last_day_of(frame), 10)


#: A roster of the nations: sound entries, unknown names, parameters that a fit can't take, and malformed ones before and among them.
ROSTER_SQL = """SELECT n_nationkey AS place, CASE n_nationkey WHEN 0 THEN 'malformed' WHEN 1 THEN 'ran' WHEN 2 THEN 'failed' WHEN 3 THEN 'malformed' WHEN 4 THEN 'failed' WHEN 5 THEN 'ran' ELSE 'dropped' END AS status,
  CASE WHEN n_nationkey IN (0, 3) THEN NULL ELSE CASE n_nationkey WHEN 1 THEN 'formula {}' WHEN 2 THEN 'nonesuch {}' WHEN 4 THEN 'logreg {"reg": -1}' WHEN 5 THEN 'logreg {"max_iter": 200, "reg": 0.01}' ELSE 'formula {"n": ' || CAST(n_nationkey AS VARCHAR) || '}' END END AS challenger FROM nation"""


def shadowed(spark, d):
    """Challengers' picks in the shadow log, run twice for a day, and what became of the roster's entries."""
    frame, key = history(spark, d), F.col("n_nationkey")
    item = (
        F.when(key == 0, '{"strategy": 7}').when(key == 1, '{"strategy": "formula", "note": "first"}').when(key == 2, '{"strategy": "nonesuch"}').when(key == 3, '"logreg"')
        .when(key == 4, '{"strategy": "logreg", "params": {"reg": -1.0}}').when(key == 5, '{"params": {"reg": 1e-2, "max_iter": 200.0}, "strategy": "logreg"}')
        .otherwise(F.concat(F.lit('{"strategy": "formula", "params": {"n": '), key.cast("string"), F.lit("}}")))
    )
    path = fresh_path(spark, "roster")
    items = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", item.alias("i")))), lambda x: x["i"])  # the nations, one roster
    S.read_table(spark, d, "nation").agg(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).alias("value")).write.text(path)
    roster, day = stored(load_roster(spark, path, 4), "roster"), last_day_of(frame)
    logged = spark.createDataFrame([], "challenger string, strategy string, params string, signal_date date, symbol string, prob double, rank int, created_ts timestamp, universe_as_of date, event string")
    for hour in (9, 10):
        logged, became = M.run_shadow(frame, logged, roster, day, run_ts=F.lit(f"2030-01-01 {hour:02d}:00:00").cast("timestamp"), universe_as_of="2024-01-01", top_n=5)
        logged = stored(logged, "shadow")
    return logged, became




@query("m15_shadow_predict", ["nscored"], f"SELECT challenger, TIMESTAMP '2030-01-01 10:00:00' AS created_ts, count(*) AS n_picks, list(rank ORDER BY rank) AS ranks, CASE WHEN challenger LIKE 'formula%' THEN list(symbol ORDER BY rank) END AS symbols, TRUE AS in_range FROM (SELECT * FROM ({FORMULA_PICKS}) WHERE rank <= 5), (VALUES ('formula {{}}'), ('logreg {{\"max_iter\": 200, \"reg\": 0.01}}')) c(challenger) GROUP BY 1")
def m15(spark, d):
    """A digest of the shadow log: of the formula every pick, of a fitted model the ranks and the range of its probabilities."""
    logged, _ = shadowed(spark, d)
    picks = F.transform(F.array_sort(F.collect_list(F.struct("rank", "symbol"))), lambda x: x["symbol"])
    sums = logged.groupBy("challenger", "created_ts").agg(F.count(F.lit(1)).alias("n_picks"), F.array_sort(F.collect_list("rank")).alias("ranks"), picks.alias("symbols"), F.min(F.col("prob").between(0, 1)).alias("in_range"))
    return sums.withColumn("symbols", F.when(F.col("challenger").startswith("formula"), F.col("symbols")))


@query("m15b_shadow_roster", [], ROSTER_SQL)
def m15b(spark, d):
    return shadowed(spark, d)[1].select("place", "status", "challenger")


@query("m15c_shadow_report", [], f"SELECT count(*) FILTER (status <> 'malformed') AS rostered, count(*) FILTER (status = 'ran') AS ran, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'dropped') AS dropped, count(*) FILTER (status = 'malformed') AS malformed FROM ({ROSTER_SQL})")
def m15c(spark, d):
    return M.shadow_report(shadowed(spark, d)[1])
