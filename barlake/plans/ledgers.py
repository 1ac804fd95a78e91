"""Plans of keyed writes and of the experiments ledger, which derives from the orders by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions.exprs import EVENT, canonical_params, six
from barlake.operators import exits as X
from barlake.operators import ledger as L
from barlake.plans.daily import rounded
from barlake.plans.inputs import Users
from barlake.plans.registry import query, subquery
from barlake.plans.scoring import outcomes
from barlake.sources import tables as S
from barlake.sources import writers as W
from barlake.sources.shared import fresh_path, stored

PARAMS_SQL = """CASE WHEN o_orderkey % 37 = 0 THEN '{broken' ELSE '{"months": ' || CASE WHEN o_orderkey % 3 = 0 THEN '6' ELSE '12' END || ', "top_n": ' || CASE WHEN o_orderkey % 5 = 0 THEN '10' ELSE '20' END
  || CASE WHEN o_orderkey % 2 = 0 THEN ', "strategy_params": {"depth": ' || CAST(o_custkey % 3 AS VARCHAR) || CASE WHEN o_orderkey % 4 = 0 THEN '.0' ELSE '' END || ', "alpha": 1}' ELSE '' END || '}' END"""
subquery("ledger", [], f"SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS run_ts, 's' || CAST(o_custkey % 4 AS VARCHAR) AS strategy, {PARAMS_SQL} AS params, round(o_totalprice / 100000, 4) AS lift, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE '{EVENT}' END AS event FROM orders")
subquery("ledger_daily", [], "SELECT l_orderkey AS seq, CAST(l_shipdate AS DATE) AS target_date, CAST(l_linenumber AS INTEGER) AS rank FROM lineitem")
#: Outcome rows on days that runs share.
subquery("ledger_hits", [], "SELECT l_orderkey AS seq, DATE '2024-01-01' + CAST(l_linenumber AS INTEGER) AS target_date, CAST(l_quantity AS INTEGER) % 3 AS hit FROM lineitem")
STANDARD = f"event = '{EVENT}' AND params NOT LIKE '{{broken%' AND params LIKE '%\"months\": 12,%' AND (params LIKE '%\"top_n\": 20}}%' OR params LIKE '%\"top_n\": 20,%')"
PLAIN = "params NOT LIKE '%strategy_params%'"
CANON = """'{"alpha": 1, "depth": ' || CAST(o_custkey % 3 AS VARCHAR) || '}'"""


def ledger(spark, d) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    own = F.when(key % 2 == 0, F.concat(F.lit(', "strategy_params": {"depth": '), (cust % 3).cast("string"), F.when(key % 4 == 0, ".0").otherwise(""), F.lit(', "alpha": 1}'))).otherwise("")
    params = F.when(key % 37 == 0, "{broken").otherwise(F.concat(F.lit('{"months": '), F.when(key % 3 == 0, "6").otherwise("12"), F.lit(', "top_n": '), F.when(key % 5 == 0, "10").otherwise("20"), own, F.lit("}")))
    return S.read_table(spark, d, "orders").select(key.alias("id"), F.col("o_orderdate").cast("timestamp").alias("run_ts"), F.concat(F.lit("s"), (cust % 4).cast("string")).alias("strategy"), params.alias("params"), F.round(F.col("o_totalprice") / 100_000, 4).alias("lift"), F.when(key % 7 == 0, None).otherwise(F.lit(EVENT)).alias("event"), cust.alias("cust"))


@query("s07_upsert_by_key", ["ub"], "SELECT symbol, date, open, CASE WHEN day(date) >= 15 THEN round(close * 1.01, 6) ELSE close END AS close FROM ub WHERE day(date) <= 20 OR CAST(symbol AS BIGINT) % 2 = 0")
def s07(spark, d):
    """Through a written table: partitions before the 15th aren't touched."""
    bars = S.user_bars(spark, d).select("symbol", "date", "open", "close")
    path = fresh_path(spark, "prices")
    bars.where(F.dayofmonth("date") <= 20).write.partitionBy("date").parquet(path)
    new = bars.where((F.dayofmonth("date") >= 15) & ((F.dayofmonth("date") <= 20) | (F.col("symbol").cast("long") % 2 == 0))).withColumn("close", F.round(F.col("close") * 1.01, 6))
    merged = W.upsert_table(spark, path, new, ["symbol", "date"], "date")
    return merged.select(F.col("symbol").cast("string").alias("symbol"), "date", "open", "close")



@query("s08_replace_slice", ["log", "uu"], f"SELECT signal_date, symbol, rank, CASE WHEN day(signal_date) % 2 = 0 THEN min(created_ts) OVER (PARTITION BY signal_date) ELSE created_ts END AS created_ts, CASE WHEN day(signal_date) % 2 = 0 THEN (SELECT max(as_of) FROM uu) ELSE DATE '2023-12-01' END AS universe_as_of, CASE WHEN day(signal_date) % 2 = 0 THEN '{EVENT}' ELSE event END AS event FROM log WHERE day(signal_date) % 2 = 1 OR rank <= 10")
def s08(spark, d):
    u = Users(spark, d)
    log = u.log.withColumn("universe_as_of", F.lit("2023-12-01").cast("date"))
    new = log.where((F.dayofmonth("signal_date") % 2 == 0) & (F.col("rank") <= 10))
    as_of = u.universe.agg(F.max("as_of")).first()[0]
    made = W.replace_slice(log, new, ["strategy", "signal_date"], run_ts=F.lit("2030-01-01").cast("timestamp"), universe_as_of=F.lit(as_of), event=F.lit(EVENT))
    return made.select("signal_date", "symbol", "rank", "created_ts", "universe_as_of", "event")


@query("s09_replace_shadow_slice", ["log"], "SELECT signal_date, symbol, rank, CASE WHEN day(signal_date) % 2 = 0 THEN TIMESTAMP '2030-01-01' ELSE created_ts END AS created_ts FROM log WHERE day(signal_date) % 2 = 1 OR rank <= 10")
def s09(spark, d):
    log = Users(spark, d).log
    new = log.where((F.dayofmonth("signal_date") % 2 == 0) & (F.col("rank") <= 10))
    return W.replace_slice(log, new, ["strategy", "signal_date"], run_ts=F.lit("2030-01-01").cast("timestamp"), keep_created=False).select("signal_date", "symbol", "rank", "created_ts")


@query("s10_keep_earliest", ["ub"], "SELECT symbol, least(min(date), min(date) FILTER (day(date) % 2 = 0) - 3) AS from_date FROM ub GROUP BY symbol")
def s10(spark, d):
    bars = S.user_bars(spark, d)
    old = bars.select("symbol", F.col("date").alias("from_date"))
    return W.keep_earliest(old, bars.where(F.dayofmonth("date") % 2 == 0).select("symbol", F.date_sub("date", 3).alias("from_date")))


@query("s11_record_experiment", ["outcomes"], "SELECT target_date, symbol, rank, hit, round(oc_return, 6) + 0.0 AS ret FROM outcomes WHERE rank % 4 <> 1 AND rank % 5 <> 2")
def s11(spark, d):
    """Rows that may be recorded (some lack an extreme, some the hit), through the written ledger; rows of a run that was never
    committed aren't read."""
    rows = outcomes(Users(spark, d)).select("target_date", "symbol", "rank", F.when(F.col("rank") % 5 != 2, F.col("hit")).alias("hit"), F.col("oc_return").alias("ret"), F.when(F.col("rank") % 4 != 1, F.col("high_return")).alias("oh"), F.col("low_return").alias("ol"))
    sound = stored(X.valid_ledger_rows(rows), "daily")
    ledger, daily = fresh_path(spark, "ledger"), fresh_path(spark, "ledger-daily")
    row = spark.range(1, 2).select("id", F.lit("formula").alias("strategy"))
    W.record_experiment(spark, ledger, daily, row, sound.withColumn("seq", F.lit(1).cast("long")))
    sound.withColumn("seq", F.lit(2).cast("long")).write.mode("append").parquet(daily)  # a crash before the ledger row
    committed = W.recorded_experiments(spark, ledger, daily)[1]
    return rounded(committed.select("target_date", "symbol", "rank", "hit", "ret"), "ret")


@query("s18_list_experiments", ["ledger"], "SELECT id, run_ts, strategy FROM ledger ORDER BY run_ts DESC, id DESC LIMIT 30")
def s18(spark, d):
    return ledger(spark, d).orderBy(F.desc("run_ts"), F.desc("id")).limit(30).select("id", "run_ts", "strategy")


SHADOW = "'c' || CAST(CAST(symbol AS BIGINT) % 3 AS VARCHAR)"


@query("s19b_shadow_challengers", ["log"], f"SELECT {SHADOW} AS challenger, strategy, '{{}}' AS params, count(DISTINCT CASE WHEN event = '{EVENT}' THEN signal_date END) AS touch_days, min(CASE WHEN event = '{EVENT}' THEN signal_date END) AS first_touch, max(CASE WHEN event = '{EVENT}' THEN signal_date END) AS last_touch FROM log GROUP BY ALL")
def s19b(spark, d):
    return L.shadow_challengers(shadow_log(spark, d))


@query("s19c_shadow_signal_dates", ["log"], f"SELECT DISTINCT {SHADOW} AS challenger, signal_date FROM log WHERE event = '{EVENT}'")
def s19c(spark, d):
    return L.shadow_signal_dates(shadow_log(spark, d))


def shadow_log(spark, d) -> DataFrame:
    """The users' predictions as those of three challengers."""
    return Users(spark, d).log.withColumns({"challenger": F.concat(F.lit("c"), (F.col("symbol").cast("long") % 3).cast("string")), "params": F.lit("{}")})


@query("s19_distinct_logs", ["log"], f"SELECT count(DISTINCT CASE WHEN event = '{EVENT}' THEN signal_date END) AS touch_days, min(CASE WHEN event = '{EVENT}' THEN signal_date END) AS first_touch, count(DISTINCT CASE WHEN event IS DISTINCT FROM '{EVENT}' THEN signal_date END) AS archived_days FROM log")
def s19(spark, d):
    touch = F.col("event").eqNullSafe(F.lit(EVENT))
    return Users(spark, d).log.agg(F.count_distinct(F.when(touch, F.col("signal_date"))).alias("touch_days"), F.min(F.when(touch, F.col("signal_date"))).alias("first_touch"), F.count_distinct(F.when(~touch, F.col("signal_date"))).alias("archived_days"))


@query("s20_picked_symbols", ["log", "outcomes"], "SELECT symbol FROM log WHERE rank <= 5 AND signal_date >= DATE '2024-01-20' UNION SELECT symbol FROM outcomes WHERE rank <= 3 AND target_date >= DATE '2024-01-15'")
def s20(spark, d):
    u = Users(spark, d)
    logged = u.log.where((F.col("rank") <= 5) & (F.col("signal_date") >= "2024-01-20")).select("symbol")
    return logged.union(outcomes(u).where((F.col("rank") <= 3) & (F.col("target_date") >= "2024-01-15")).select("symbol")).distinct()


@query("u03_union_distinct", ["log", "uu"], "SELECT symbol FROM log UNION SELECT symbol FROM uu WHERE market_cap > 5000")
def u03(spark, d):
    u = Users(spark, d)
    return u.log.select("symbol").union(u.universe.where("market_cap > 5000").select("symbol")).distinct()


@query("k04_latest_standard_experiment", ["ledger"], f"SELECT strategy, id, lift FROM ledger WHERE {STANDARD} AND {PLAIN} QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY run_ts DESC, id DESC) = 1")
def k04(spark, d):
    return L.latest_standard_experiment(ledger(spark, d)).select("strategy", "id", "lift")


@query(
    "k05_reference_run",
    ["ledger", "ledger_daily"],
    f"SELECT strategy, id, n_days FROM (SELECT *, max(n_days) OVER (PARTITION BY strategy) AS best FROM ledger JOIN (SELECT seq AS id, count(DISTINCT target_date) AS n_days FROM ledger_daily GROUP BY 1) USING (id) WHERE event = '{EVENT}' AND params NOT LIKE '{{broken%') WHERE {PLAIN} QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY CASE WHEN n_days >= 0.9 * best THEN 0 ELSE 1 END, run_ts DESC, id DESC) = 1",
)
def k05(spark, d):
    daily = S.read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq"), F.to_date("l_shipdate").alias("target_date"))
    sound = ledger(spark, d).where(~F.col("params").startswith("{broken"))
    return L.reference_run(sound, daily)


@query("a38_family_size", ["ledger"], f"SELECT strategy, count(*) AS family_size FROM ledger WHERE {STANDARD} GROUP BY 1")
def a38(spark, d):
    return L.standard(ledger(spark, d)).groupBy("strategy").agg(F.count(F.lit(1)).alias("family_size"))


DONE = f"SELECT DISTINCT strategy, CASE WHEN params LIKE '%strategy_params%' THEN {CANON} ELSE '{{}}' END AS params_key FROM (SELECT l.*, o_custkey FROM ledger l JOIN orders ON o_orderkey = id) WHERE {STANDARD}"


@query("a38b_recorded_configs", ["ledger"], DONE)
def a38b(spark, d):
    return L.recorded_configs(ledger(spark, d))


#: What the lines' parameters mean, written in order; the texts below write it in other ways.
MEANT = """'{"a": {"x": ' || CASE WHEN l_linenumber % 3 = 0 THEN '"' || l_linenumber || '.0"' ELSE CAST(l_linenumber AS VARCHAR) END || ', "y": [' || l_suppkey || ', 0.5, {"k": null, "z": true}]}, "b": ' || l_suppkey || '}'"""


@query("canonical_params", [], f"SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_linenumber = 4 THEN NULL ELSE {MEANT} END AS params_key FROM lineitem")
def canonical(spark, d):
    """Nested parameters with keys out of order, numbers written in three ways, texts that look like numbers, and malformed JSON."""
    line, supplier = F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")
    number = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit('"'), line, F.lit('.0"'))).when(F.col("l_linenumber") % 3 == 1, F.concat(line, F.lit(".0"))).otherwise(F.concat(line, F.lit("0e-1")))
    shown = F.when(F.col("l_linenumber") % 2 == 0, F.concat(supplier, F.lit(".00"))).otherwise(supplier)
    whole = F.concat(F.lit('{"b" : '), shown, F.lit(',"a":{"y":['), supplier, F.lit('e0, 5e-1,{"z":true,"k":null}],  "x":'), number, F.lit("}}"))
    texts = F.when(F.col("l_linenumber") == 4, '{"a": ').otherwise(whole)
    return S.read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), canonical_params(texts).alias("params_key"))


SPACE = {"s1": {"depth": [0, 1, 2, 3], "alpha": [1, 2]}, "s2": {"depth": [1.0, 5.0], "alpha": [1]}}
GRID_SQL = "SELECT 's1' AS strategy, '{\"alpha\": ' || a || ', \"depth\": ' || b || '}' AS params, CAST((a - 1) * 4 + b AS INTEGER) AS place, '{\"alpha\": ' || a || ', \"depth\": ' || b || '}' AS k FROM (VALUES (1), (2)) x(a), (VALUES (0), (1), (2), (3)) y(b) UNION ALL SELECT 's2', '{\"alpha\": 1, \"depth\": ' || b || '.0}', CAST(8 + CASE WHEN b = 5 THEN 1 ELSE 0 END AS INTEGER), '{\"alpha\": 1, \"depth\": ' || b || '}' FROM (VALUES (1), (5)) y(b)"


def known(spark, d) -> DataFrame:
    """The grid against strategies and parameters that the ledger holds."""
    return L.param_grid(spark, SPACE)


@query("m11_param_grid", ["ledger"], f"SELECT g.strategy, params, place, (SELECT count(*) FROM ledger l WHERE l.strategy = g.strategy) AS n_runs FROM ({GRID_SQL}) g")
def m11(spark, d):
    runs = ledger(spark, d).groupBy("strategy").agg(F.count(F.lit(1)).alias("n_runs"))
    return known(spark, d).join(runs, "strategy", "left").withColumn("n_runs", F.coalesce("n_runs", F.lit(0).cast("long")))


#: A queue of what customers ordered: the strategies that the ledger knows, a depth, some of it recorded and some asked for twice.
QUEUED_SQL = """SELECT 's' || CAST(c_custkey % 4 AS VARCHAR) AS strategy, '{"depth": ' || CAST(c_custkey % 5 AS VARCHAR) || CASE WHEN c_custkey % 2 = 0 THEN '.0' ELSE '' END || ', "alpha": 1}' AS params, CAST(c_custkey AS INTEGER) AS place,
  '{"alpha": 1, "depth": ' || CAST(c_custkey % 5 AS VARCHAR) || '}' AS k FROM customer"""
BUDGET = 11


@query(
    "m12_pending_configs",
    ["ledger"],
    f"""SELECT strategy, params, place, origin FROM (SELECT *, 'queue' AS origin FROM ({QUEUED_SQL}) UNION ALL SELECT *, 'grid' FROM ({GRID_SQL})) g WHERE (strategy, k) NOT IN (SELECT (strategy, params_key) FROM ({DONE}))
      QUALIFY row_number() OVER (PARTITION BY strategy, k ORDER BY origin DESC, place) = 1 ORDER BY origin DESC, place LIMIT {BUDGET}""",
)
def m12(spark, d):
    """All customers' orders as a queue, then the grid up to the budget."""
    key = F.col("c_custkey")
    params = F.concat(F.lit('{"depth": '), (key % 5).cast("string"), F.when(key % 2 == 0, ".0").otherwise(""), F.lit(', "alpha": 1}'))
    queue = S.read_table(spark, d, "customer").select(F.concat(F.lit("s"), (key % 4).cast("string")).alias("strategy"), params.alias("params"), key.cast("int").alias("place"))
    return L.pending_configs(queue, known(spark, d), ledger(spark, d), BUDGET)


@query("m12b_queue_entries", [], "SELECT 's' || CAST(o_orderkey % 3 AS VARCHAR) AS strategy, '{\"depth\":' || CAST(o_orderkey AS VARCHAR) || '}' AS params, count(*) OVER () AS n_entries, (SELECT count(*) FROM orders WHERE o_orderkey % 5 >= 3) AS n_malformed FROM orders WHERE o_orderkey % 5 < 3")
def m12b(spark, d):
    """All orders as a queue in several files, a customer's orders in one list; some entries have no strategy, some a list for params."""
    key = F.col("o_orderkey")
    own = F.concat(F.lit('"strategy": "s'), (key % 3).cast("string"), F.lit('", "params": '))
    item = F.when(key % 5 == 3, F.lit('{"strategy": 7, "params": {}}')).when(key % 5 == 4, F.concat(F.lit("{"), own, F.lit("[1]}"))).otherwise(F.concat(F.lit("{"), own, F.lit('{"depth": '), key.cast("string"), F.lit('}, "note": "x"}')))
    path = fresh_path(spark, "queue")
    lists = S.read_table(spark, d, "orders").groupBy((F.col("o_custkey") % QUEUE_FILES).alias("file"), "o_custkey").agg(F.array_join(F.collect_list(item), ",").alias("some"))
    lists.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("some"), ","), F.lit("]")).alias("value")).write.partitionBy("file").text(path)
    entries, malformed = L.load_queue(spark, path)
    return entries.select("strategy", "params", F.lit(entries.count()).cast("long").alias("n_entries"), F.lit(malformed).cast("long").alias("n_malformed"))


QUEUE_FILES = 64

#: The inverse normal distribution's lower tail as a quotient of polynomials (fixed values; good to nine digits), for families of two and more.
TAIL = "sqrt(-2 * ln(0.05 / (2 * n)))"
QUANTILE = (
    "-(((((-7.784894002430293e-03 * q - 3.223964580411365e-01) * q - 2.400758277161838e+00) * q - 2.549732539343734e+00) * q + 4.374664141464968e+00) * q + 2.938163982698783e+00)"
    " / ((((7.784695709041462e-03 * q + 3.224671290700398e-01) * q + 2.445134137142996e+00) * q + 3.754408661907416e+00) * q + 1)"
)


def band_sql(sized: str) -> str:
    return f"SELECT *, greatest(0.27, round(({QUANTILE}) * 0.08, 4)) AS band FROM (SELECT *, {TAIL} AS q FROM ({sized}))"


@query("m13_promotion_band", ["ledger"], f"SELECT strategy, n, CAST(band AS DOUBLE) AS band FROM ({band_sql(f'SELECT strategy, count(*) AS n FROM ledger WHERE {STANDARD} GROUP BY 1')})")
def m13(spark, d):
    """Each strategy's band for exactly the runs that the ledger has of it."""
    return L.with_band(L.standard(ledger(spark, d)).groupBy("strategy").agg(F.count(F.lit(1)).alias("n")))


CORRECTION_SQL = f"SELECT *, round(z / 1.959963984540054, 4) AS correction FROM (SELECT *, CASE WHEN n = 1 THEN 1.959963984540054 ELSE ({QUANTILE}) END AS z FROM (SELECT *, {TAIL} AS q FROM {{}}))"


@query("m13b_forward_margin", ["ledger"], f"SELECT strategy, month, n, correction, round(0.25 * correction, 4) AS forward_margin FROM ({CORRECTION_SQL.format(f'(SELECT strategy, CAST(month(run_ts) AS INTEGER) AS month, count(*) AS n FROM ledger WHERE {STANDARD} GROUP BY 1, 2)')})")
def m13b(spark, d):
    """By how much a margin of 0.25 widens where the best of a strategy's runs of a month is chosen."""
    families = L.standard(ledger(spark, d)).groupBy("strategy", F.month("run_ts").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return L.with_forward_margin(families.withColumn("single", F.lit(0.25)), "single").drop("single")


@query(
    "m14_promotion_candidates",
    ["ledger", "ledger_hits"],
    f"""SELECT batch, id, lift, band, beats, holds, beats AND holds AS promoted FROM (SELECT b.batch, b.id, b.lift, CAST(f.band AS DOUBLE) AS band, b.lift - c.lift > f.band - 1.0000001e-9 AS beats, coalesce(h.holds, FALSE) AS holds FROM
      (SELECT strategy || '-' || CAST(year(run_ts) AS VARCHAR) AS batch, id, lift FROM ledger WHERE {STANDARD} AND strategy <> 's0' QUALIFY row_number() OVER (PARTITION BY batch ORDER BY lift DESC, id) = 1) b,
      (SELECT id, lift FROM ledger WHERE {STANDARD} AND {PLAIN} AND strategy = 's0' ORDER BY run_ts DESC, id DESC LIMIT 1) c,
      ({band_sql(f'SELECT count(*) AS n FROM ledger WHERE {STANDARD}')}) f
      LEFT JOIN (SELECT mine, days >= 4 AND early > 0 AND late > 0 AS holds FROM (SELECT mine, count(*) AS days, avg(gap) FILTER (place <= days_shared // 2) AS early, avg(gap) FILTER (place > days_shared // 2) AS late FROM
        (SELECT x.seq AS mine, x.p - y.p AS gap, row_number() OVER (PARTITION BY x.seq ORDER BY x.target_date) AS place, count(*) OVER (PARTITION BY x.seq) AS days_shared FROM (SELECT seq, target_date, avg(hit) AS p FROM ledger_hits GROUP BY ALL) x
          JOIN (SELECT seq, target_date, avg(hit) AS p FROM ledger_hits GROUP BY ALL) y ON y.target_date = x.target_date AND y.seq = (SELECT id FROM ledger WHERE {STANDARD} AND {PLAIN} AND strategy = 's0' ORDER BY run_ts DESC, id DESC LIMIT 1)) GROUP BY 1)) h ON h.mine = b.id)""",
)
def m14(spark, d):
    """The best run of each strategy and year against the newest default run of one strategy."""
    runs = L.standard(ledger(spark, d))
    champion = L.latest_standard_experiment(runs.where("strategy = 's0'")).select("id", "lift")
    batches = runs.where("strategy <> 's0'").select(F.concat("strategy", F.lit("-"), F.year("run_ts").cast("string")).alias("batch"), "id", "lift")
    daily = S.read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("l_linenumber")).alias("target_date"), (F.col("l_quantity").cast("int") % 3).alias("hit"))
    return L.promotion_verdicts(batches, champion, runs.agg(F.count(F.lit(1)).alias("n")), daily)


@query("m10_compare_verdict", ["ledger"], f"SELECT lift_a, lift_b, CASE WHEN lift_a IS NULL OR lift_b IS NULL THEN 'undecided' WHEN lift_a = lift_b THEN 'tie' WHEN abs(lift_a - lift_b) < 0.1 - 1e-9 THEN 'within_noise' WHEN lift_a > lift_b THEN 'a' ELSE 'b' END AS verdict FROM (SELECT round(avg(lift), 6) + 0.0 AS lift_a FROM ledger WHERE {STANDARD} AND strategy = 's1'), (SELECT round(avg(lift), 6) + 0.0 AS lift_b FROM ledger WHERE {STANDARD} AND strategy = 's2')")
def m10(spark, d):
    runs = L.standard(ledger(spark, d))
    mean = [runs.where(F.col("strategy") == s).agg(six(F.avg("lift")).alias("lift")) for s in ("s1", "s2")]
    return L.compare_verdict(*mean)


