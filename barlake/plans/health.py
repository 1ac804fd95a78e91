"""Plans of the data-quality diagnostics. Bars with planted defects derive from the users' bars by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.functions.exprs import six
from barlake.operators import health as H
from barlake.operators import sessions as I
from barlake.plans.daily import PLAN_SQL, ingest_inputs
from barlake.plans.inputs import VALID
from barlake.plans.registry import query, subquery
from barlake.plans.sessions import COVER, MINUTES, Sessions
from barlake.sources import tables as S
from barlake.sources import universe as V
from barlake.sources.shared import stored

#: One defect a class: missing bars, a tail cut, a high under the open, no volume, a tenfold close, no close and little volume before a spike, a day on which no
#: bar is valid, and thin days among the first five and later.
subquery(
    "db",
    ["ub"],
    """SELECT symbol, date, open, CASE WHEN k % 23 = 3 OR day(date) = 17 THEN open - 1 WHEN k % 6 = 2 THEN 2 * greatest(open, high) ELSE high END AS high, low, CASE WHEN k % 6 = 1 THEN NULL WHEN k % 29 = 4 THEN close * 10 ELSE close END AS close, CASE WHEN s % 9 = 2 AND day(date) BETWEEN 5 AND 9 THEN 0 WHEN k % 6 = 2 THEN 1000 ELSE volume END AS volume
      FROM (SELECT *, CAST(symbol AS BIGINT) AS s, CAST(symbol AS BIGINT) + day(date) AS k FROM ub) WHERE NOT (s % 4 = 1 AND day(date) % 6 = 3) AND NOT (s % 10 = 7 AND day(date) > 20) AND NOT (s % 3 <> 0 AND day(date) IN (3, 22))""",
)
subquery("dcal", ["db"], "SELECT date, row_number() OVER (ORDER BY date) AS day FROM (SELECT DISTINCT date FROM db)")
#: Trading dates: those with a valid bar.
subquery("tcal", ["db"], f"SELECT DISTINCT date FROM db WHERE {VALID}")
GAPS = f"SELECT s.symbol, count(*) AS n_missing, min(c.date) AS first_missing, max(c.date) AS last_missing FROM (SELECT symbol, min(date) AS f, max(date) AS l FROM db WHERE {VALID} GROUP BY 1) s JOIN tcal c ON c.date > s.f AND c.date < s.l LEFT JOIN (SELECT symbol, date FROM db WHERE {VALID}) b ON b.symbol = s.symbol AND b.date = c.date WHERE b.symbol IS NULL GROUP BY 1"
STALE = "SELECT symbol, last_date, count(c.date) AS days_behind FROM (SELECT symbol, max(date) AS last_date FROM db GROUP BY 1) l LEFT JOIN tcal c ON c.date > l.last_date GROUP BY 1, 2 HAVING count(c.date) > 1"
INVALID = f"SELECT symbol, count(*) AS n_invalid, min(date) AS first_date, max(date) AS last_date FROM db WHERE NOT coalesce({VALID}, FALSE) GROUP BY 1"
#: Positions over all bars; the bars before a bar are joined by position, and what is judged is filtered after that.
DBK = "(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM db)"
GLITCH = f"""SELECT b.symbol, b.date, (b.high - b.open) / b.open AS high_return, (b.close - b.open) / b.open AS oc_return, b.volume, q.mean_volume AS trailing_avg_vol, p.close AS prev_close FROM {DBK} b LEFT JOIN {DBK} p ON p.symbol = b.symbol AND p.k = b.k - 1
  JOIN (SELECT y.symbol, y.k, sum(z.volume) / count(z.volume) AS mean_volume FROM {DBK} y JOIN {DBK} z ON z.symbol = y.symbol AND y.k - z.k BETWEEN 1 AND 20 GROUP BY ALL) q ON q.symbol = b.symbol AND q.k = b.k
  WHERE b.open > 0 AND isfinite(b.open) AND isfinite(b.close) AND isfinite(b.high) AND (b.high - b.open) / b.open >= 0.02 AND (b.close - b.open) / b.open < 0.02 AND b.volume < q.mean_volume AND b.high >= 1.15 * b.open AND b.high >= 1.15 * b.close AND (p.close IS NULL OR b.high >= 1.15 * p.close)"""
INCOMPLETE = f"""SELECT d.date, d.raw_count, d.bar_count, CAST(median(e.raw_count) AS DOUBLE) AS trailing_median, d.raw_count / median(e.raw_count) AS ratio FROM (SELECT *, row_number() OVER (ORDER BY date) AS k FROM (SELECT date, count(*) AS raw_count, count(CASE WHEN {VALID} THEN 1 END) AS bar_count FROM db GROUP BY date)) d
  JOIN (SELECT row_number() OVER (ORDER BY date) AS k, raw_count FROM (SELECT date, count(*) AS raw_count FROM db GROUP BY date)) e ON d.k - e.k BETWEEN 1 AND 20 GROUP BY d.date, d.raw_count, d.bar_count HAVING count(e.k) >= 5 AND d.raw_count < 0.9 * median(e.raw_count) - 1e-9"""
EXTREME = f"SELECT symbol, date, open, close, (close - open) / open AS oc_return FROM db WHERE {VALID} AND abs((close - open) / open) > 0.5"
SPLITS = "SELECT symbol, date FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev_close FROM {}) WHERE abs((close - open) / nullif(open, 0)) > 0.5 + 1e-9 AND prev_close > 0 AND (open / prev_close > 2 + 1e-9 OR open / prev_close < 0.5 - 1e-9)"
ZERO = "SELECT symbol, n_bars, first_date, last_date FROM (SELECT symbol, grp, count(*) AS n_bars, min(date) AS first_date, max(date) AS last_date FROM (SELECT *, n - row_number() OVER (PARTITION BY symbol, z ORDER BY date) AS grp FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n, coalesce(volume, 0) = 0 AS z FROM db)) WHERE z GROUP BY 1, 2) WHERE n_bars >= 3"


def defective(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, day = F.col("symbol").cast("long"), F.dayofmonth("date")
    k = s + day
    kept = S.user_bars(spark, sf_dir).where(~((s % 4 == 1) & (day % 6 == 3)) & ~((s % 10 == 7) & (day > 20)) & ~((s % 3 != 0) & day.isin(3, 22)))
    return kept.withColumns({"high": F.when((k % 23 == 3) | (day == 17), F.col("open") - 1).when(k % 6 == 2, 2 * F.greatest("open", "high")).otherwise(F.col("high")), "close": F.when(k % 6 == 1, None).when(k % 29 == 4, F.col("close") * 10).otherwise(F.col("close")), "volume": F.when((s % 9 == 2) & day.between(5, 9), F.lit(0).cast("long")).when(k % 6 == 2, F.lit(1000).cast("long")).otherwise(F.col("volume"))})


@query("a16_gap_counts", ["db", "tcal"], GAPS)
def a16(spark, d):
    return H.gap_counts(defective(spark, d))


@query("j06_range_join_rewritten", ["db", "dcal"], "SELECT b.symbol, b.date, count(c.date) AS days_without FROM (SELECT symbol, date, lead(date) OVER (PARTITION BY symbol ORDER BY date) AS following FROM db) b JOIN dcal c ON c.date > b.date AND c.date < b.following GROUP BY 1, 2")
def j06(spark, d):
    """Calendar days strictly between consecutive bars, by the difference of their numbers."""
    bars = stored(defective(spark, d), "bars")
    days = bars.select("date").distinct().withColumn("day", F.row_number().over(Window.orderBy("date")))  # one row a date
    numbered = bars.join(F.broadcast(days), "date")
    ahead = F.lead("day").over(Window.partitionBy("symbol").orderBy("day"))
    return numbered.select("symbol", "date", (ahead - F.col("day") - 1).cast("long").alias("days_without")).where("days_without > 0")


@query("j08_anti_join", ["db", "dcal"], "SELECT symbol, date FROM (SELECT DISTINCT symbol FROM db) CROSS JOIN dcal WHERE (symbol, date) NOT IN (SELECT (symbol, date) FROM db)")
def j08(spark, d):
    """The days on which a symbol has no bar at all: its days subtracted from the calendar, as an anti join."""
    bars = stored(defective(spark, d), "bars")
    days = bars.select("date").distinct().agg(F.array_sort(F.collect_set("date")).alias("dates"))  # one row: the calendar
    every = bars.select("symbol").distinct().join(F.broadcast(days), F.lit(True)).select("symbol", F.explode("dates").alias("date"))
    return every.join(bars.select("symbol", "date"), ["symbol", "date"], "left_anti")


@query("a17_stale_symbols", ["db", "tcal"], STALE)
def a17(spark, d):
    return H.stale_symbols(defective(spark, d))


@query("j07_dates_after_last_bar", ["db", "dcal"], "SELECT symbol, date FROM dcal JOIN (SELECT symbol, max(date) AS last_date FROM db GROUP BY 1) ON date > last_date")
def j07(spark, d):
    """Every trading day after a symbol's last bar: the calendar's tail from its number on."""
    bars = stored(defective(spark, d), "bars")
    days = bars.select("date").distinct().agg(F.array_sort(F.collect_set("date")).alias("dates"))  # one row: the calendar
    last = bars.groupBy("symbol").agg(F.max("date").alias("last_date")).join(F.broadcast(days), F.lit(True))
    at = F.array_position("dates", F.col("last_date")).cast("int")
    return last.select("symbol", F.explode(F.slice("dates", at + 1, F.size("dates") - at)).alias("date"))


@query("a18_invalid_bars", ["db"], INVALID)
def a18(spark, d):
    return H.invalid_bars(defective(spark, d))


@query("a19_glitch_bars", ["db"], f"SELECT symbol, date, round(high_return, 6) + 0.0 AS high_return, round(oc_return, 6) + 0.0 AS oc_return, volume, round(trailing_avg_vol, 6) + 0.0 AS trailing_avg_vol, prev_close FROM ({GLITCH})")
def a19(spark, d):
    return H.glitch_bars(defective(spark, d)).withColumns({c: six(F.col(c)) for c in ("high_return", "oc_return", "trailing_avg_vol")})


@query("a20_incomplete_days", ["db"], f"SELECT date, raw_count, bar_count, trailing_median, round(ratio, 6) + 0.0 AS ratio FROM ({INCOMPLETE})")
def a20(spark, d):
    return H.incomplete_days(defective(spark, d)).withColumn("ratio", six(F.col("ratio")))


@query("a21_extreme_bars", ["db"], f"SELECT symbol, date, open, close, round(oc_return, 6) + 0.0 AS oc_return FROM ({EXTREME})")
def a21(spark, d):
    return H.extreme_bars(defective(spark, d)).withColumn("oc_return", six(F.col("oc_return")))


@query("a22_zero_volume_runs", ["db"], ZERO)
def a22(spark, d):
    return H.zero_volume_runs(defective(spark, d))


FLAGGED = "coalesce(abs(x.close / nullif(x.open, 0) - 1) > 0.5 + 1e-9 AND l[i - 1].close > 0 AND (x.open / l[i - 1].close > 2 + 1e-9 OR x.open / l[i - 1].close < 0.5 - 1e-9), FALSE)"
REPAIR = f"""SELECT symbol, unnest(l, recursive := true) FROM (SELECT symbol, arg_max(l, pass) AS l FROM (
  WITH RECURSIVE passes AS (SELECT symbol, list(struct_pack(date := date, open := open, high := high, low := low, close := close, volume := volume) ORDER BY date) AS l, 0 AS pass FROM db GROUP BY symbol
    UNION ALL SELECT symbol, kept, pass + 1 FROM (SELECT symbol, l, pass, list_filter(l, lambda x, i: i = 1 OR NOT {FLAGGED}) AS kept FROM passes) WHERE len(kept) < len(l)) SELECT * FROM passes) GROUP BY symbol)"""


@query("a23_repair_splits", ["db"], REPAIR)
def a23(spark, d):
    return H.repair_splits(defective(spark, d))


#: Symbols whose loaded range is known, and a record of sessions with holes, for the report.
META = "SELECT DISTINCT symbol FROM db WHERE CAST(symbol AS BIGINT) % 7 <> 0"
COUNTED = {"gaps": GAPS, "stale": STALE, "extreme": EXTREME, "zero_volume": ZERO, "invalid": INVALID, "glitch": GLITCH, "incomplete_days": INCOMPLETE, "unpriced": "SELECT symbol FROM uu EXCEPT SELECT symbol FROM db", "no_meta": f"SELECT symbol FROM db EXCEPT ({META})"}
CHECKS = " UNION ALL ".join([f"SELECT '{k}' AS check, count(*) AS n_problems, TRUE AS counted FROM ({v})" for k, v in COUNTED.items()] + [f"SELECT 'sessions', count(*), FALSE FROM ({COVER}) WHERE truncated OR thin"])
REPORT = f"SELECT *, CAST(sum(n_problems) FILTER (counted) OVER () AS BIGINT) AS problem_count, sum(n_problems) FILTER (counted) OVER () = 0 AS ok FROM ({CHECKS})"


def report_inputs(spark, d):
    bars = stored(defective(spark, d), "bars")
    meta = bars.where(F.col("symbol").cast("long") % 7 != 0).select("symbol").distinct()
    return bars, S.user_universe(spark, d), meta


@query("a24_doctor_report", ["db", "tcal", "uu", "ibh"], REPORT)
def a24(spark, d):
    sessions = I.coverage_problems(I.session_coverage(Sessions(spark, d).holed, bar_minutes=MINUTES, close_minutes=1440))
    return H.doctor_report(*report_inputs(spark, d), sessions)


@query("u04_concat_checks", ["db"], f"SELECT 'extreme' AS check, symbol, date AS first_date FROM ({EXTREME}) UNION ALL SELECT 'invalid', symbol, first_date FROM ({INVALID}) UNION ALL SELECT 'zero_volume', symbol, first_date FROM ({ZERO})")
def u04(spark, d):
    """Problems of several checks in one table."""
    bars = stored(defective(spark, d), "bars")
    parts = {"extreme": H.extreme_bars(bars).withColumnRenamed("date", "first_date"), "invalid": H.invalid_bars(bars), "zero_volume": H.zero_volume_runs(bars)}
    listed = [frame.select(F.lit(name).alias("check"), "symbol", "first_date") for name, frame in parts.items()]
    return listed[0].unionByName(listed[1]).unionByName(listed[2])


EARLIER = "(SELECT * FROM db WHERE date <= DATE '2024-01-20' AND CAST(symbol AS BIGINT) % 9 <> 4)"
DIFF = " UNION ALL ".join([
    f"SELECT 'extreme' AS kind, symbol, date, CASE WHEN date >= (SELECT max(date) FROM {EARLIER}) - 3 THEN 'fail' ELSE 'warn' END AS severity FROM ({EXTREME}) WHERE (symbol, date) NOT IN (SELECT (symbol, date) FROM ({EXTREME.replace('FROM db', f'FROM {EARLIER} e')}))",
    f"SELECT 'invalid', symbol, NULL, 'fail' FROM (SELECT symbol FROM ({INVALID}) EXCEPT SELECT symbol FROM ({INVALID.replace('FROM db', f'FROM {EARLIER} e')}))",
    f"SELECT 'zero_volume', symbol, NULL, 'warn' FROM (SELECT symbol FROM ({ZERO}) EXCEPT SELECT symbol FROM ({ZERO.replace('FROM db', f'FROM {EARLIER} e')}))",
    "SELECT 'unpriced', symbol, NULL, 'warn' FROM (SELECT symbol FROM uu EXCEPT SELECT symbol FROM db)",
])


def before_and_after(spark, d):
    now = stored(defective(spark, d), "bars")
    return now.where((F.col("date") <= "2024-01-20") & (F.col("symbol").cast("long") % 9 != 4)), now


@query("a25_doctor_diff", ["db", "uu"], DIFF)
def a25(spark, d):
    return H.doctor_diff(*before_and_after(spark, d), S.user_universe(spark, d))


@query("a25b_recheck_verdict", ["db", "uu"], f"SELECT CASE WHEN n_fail > 0 THEN 'fail' WHEN n_warn > 0 THEN 'warn' ELSE 'ok' END AS verdict, n_fail, n_warn FROM (SELECT count(*) FILTER (severity = 'fail') AS n_fail, count(*) FILTER (severity = 'warn') AS n_warn FROM ({DIFF}))")
def a25b(spark, d):
    return H.recheck_verdict(H.doctor_diff(*before_and_after(spark, d), S.user_universe(spark, d)))


@query("u05_key_difference", ["db"], f"SELECT symbol, date FROM db EXCEPT SELECT symbol, date FROM {EARLIER} e")
def u05(spark, d):
    before, now = before_and_after(spark, d)
    return now.select("symbol", "date").join(before.select("symbol", "date"), ["symbol", "date"], "left_anti")


GATE = f""", plan AS ({PLAN_SQL}), lb AS (SELECT symbol, max(date) AS last_date FROM ub WHERE CAST(symbol AS BIGINT) % 5 <> 0 OR date < DATE '2024-01-15' GROUP BY symbol),
  done AS (SELECT p.symbol, CASE WHEN CAST(p.symbol AS BIGINT) % 3 = 0 THEN 'ok' WHEN last_date >= p.from_date THEN 'skipped' ELSE 'failed' END AS outcome FROM plan p LEFT JOIN lb USING (symbol) WHERE action <> 'dormant')
  SELECT n_symbols, n_dormant, n_failed, n_accounted + n_dormant = n_symbols AS all_accounted, coalesce(n_failed / nullif(n_symbols - n_dormant, 0) > 0.05, FALSE) AS too_many_failed, DATE '2024-02-20' - newest > 5 AS stale_store
  FROM (SELECT count(*) AS n_symbols, count(CASE WHEN action = 'dormant' THEN 1 END) AS n_dormant FROM plan), (SELECT count(*) AS n_accounted, count(CASE WHEN outcome = 'failed' THEN 1 END) AS n_failed FROM done), (SELECT max(date) AS newest FROM ub)"""


@query("a26_ingest_gate", ["ub", "uu"], GATE)
def a26(spark, d):
    symbols, last, meta = ingest_inputs(spark, d)
    plan = V.ingest_plan(symbols, last, meta, today="2024-02-20", start="2019-01-01")
    returned = symbols.where(F.col("symbol").cast("long") % 3 == 0)
    came = plan.where("action <> 'dormant'").join(returned, "symbol", "left_semi").select("symbol", F.lit("ok").alias("outcome"))
    return H.ingest_gate(plan, came.unionByName(V.classify_missing(plan, last, returned)), S.user_bars(spark, d), today="2024-02-20")


@query("u01_except_unpriced", ["ub", "uu"], "SELECT symbol FROM uu EXCEPT SELECT symbol FROM ub")
def u01(spark, d):
    return S.user_universe(spark, d).select("symbol").subtract(S.user_bars(spark, d).select("symbol"))


@query("u02_except_unplanned", ["ub"], "SELECT symbol FROM ub EXCEPT SELECT symbol FROM ub WHERE CAST(symbol AS BIGINT) % 7 <> 0")
def u02(spark, d):
    bars = S.user_bars(spark, d).select("symbol")
    return bars.subtract(bars.where(F.col("symbol").cast("long") % 7 != 0))
