"""Plans on daily bars: sources, returns, the event, days, joins, windows, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.exprs import EVENT, LIQUIDITY, finite, normalize_symbol, six, touch_event, valid_bar
from barlake.operators import bars as B
from barlake.operators import features as X
from barlake.plans.inputs import MIN_DAYS, VALID, Users, nation_features, touch_sql
from barlake.plans.registry import query, subquery
from barlake.sources import tables as S
from barlake.sources import universe as V
from barlake.sources.shared import fresh_path, stored

R = "round({0}, 6) + 0.0 AS {0}"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: six(F.col(c)) for c in columns})


@query("s01_scan_tables", [], "SELECT o_orderstatus, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def s01(spark, d):
    return S.read_table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


#: Nations' bars with planted defects: no close, a high under the open, and a threefold open on the 17th.
subquery(
    "nd",
    ["nb"],
    """SELECT symbol, date, CASE WHEN split THEN 3 * open ELSE open END AS open, CASE WHEN split THEN 3 * greatest(open, high) WHEN k % 23 = 3 THEN open - 1 ELSE high END AS high, low, CASE WHEN k % 31 = 4 THEN NULL ELSE close END AS close, volume
      FROM (SELECT *, CAST(symbol AS BIGINT) + day(date) AS k, CAST(symbol AS BIGINT) % 5 = 1 AND day(date) = 17 AS split FROM nb)""",
)
CUT = "1995-01-17"
REASON_SQL = f"""SELECT CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL THEN 'null_price' WHEN NOT ok THEN 'invalid'
  WHEN coalesce(abs(close / open - 1) > 0.5 + 1e-9 AND before > 0 AND (open / before > 2 + 1e-9 OR open / before < 0.5 - 1e-9), FALSE) THEN 'split_artifact' ELSE 'kept' END AS reason
  FROM (SELECT n.*, coalesce(lag(n.close) OVER (PARTITION BY n.symbol, ok ORDER BY n.date), s.close) AS before FROM (SELECT *, coalesce({VALID}, FALSE) AS ok FROM nd WHERE date >= DATE '{CUT}') n
    LEFT JOIN (SELECT symbol, arg_max(close, date) AS close FROM nb WHERE date < DATE '{CUT}' GROUP BY symbol) s ON s.symbol = n.symbol)"""


def judged_batch(spark, d) -> DataFrame:
    """A wide batch of all nations' bars since a day, after the bars stored before it, with what each row is dropped for."""
    bars = stored(S.nation_bars(spark, d), "bars")
    symbols = [str(r[0]) for r in S.read_table(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]  # the batch's symbols
    nation = F.col("symbol").cast("long")
    k, split = nation + F.dayofmonth("date"), (nation % 5 == 1) & (F.dayofmonth("date") == 17)
    high = F.when(split, 3 * F.greatest("open", "high")).when(k % 23 == 3, F.col("open") - 1).otherwise(F.col("high"))
    spoilt = bars.where(F.col("date") >= CUT).withColumns({"high": high, "close": F.when(k % 31 != 4, F.col("close")), "open": F.when(split, 3 * F.col("open")).otherwise(F.col("open"))})
    last = V.last_bars(bars.where(F.col("date") < CUT)).select("symbol", F.col("last_date").alias("seed_date"), F.col("last_close").alias("seed_close"))
    return S.bar_reasons(S.long_bars(S.wide_bars(spoilt, symbols), symbols), last)


@query("s02_daily_bar_rows", ["nd"], f"SELECT reason, count(*) AS n_rows FROM ({REASON_SQL}) GROUP BY 1")
def s02(spark, d):
    """Rows of the batch by what drops them."""
    return judged_batch(spark, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("s02b_daily_bar_write", ["nd"], f"SELECT r.reason, count(x.reason) AS n_observed, CASE WHEN r.reason = 'kept' THEN count(x.reason) ELSE 0 END AS n_written FROM (VALUES ('kept'), ('null_price'), ('invalid'), ('split_artifact')) r(reason) LEFT JOIN ({REASON_SQL}) x ON x.reason = r.reason GROUP BY r.reason")
def s02b(spark, d):
    """What the writing job counted of each cause, and the rows that are there after it."""
    path = fresh_path(spark, "daily")
    seen = S.write_daily_bars(judged_batch(spark, d), path)
    written = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))  # one row
    rows = spark.createDataFrame(sorted(seen.items()), "reason string, n_observed long")
    return rows.join(written, F.lit(True)).select("reason", "n_observed", F.when(F.col("reason") == "kept", F.col("n")).otherwise(0).alias("n_written"))


@query("s03_intraday_bar_rows", ["ib"], f"SELECT symbol, ts, CAST(ts AS DATE) AS date, open, high, low, close, volume FROM (SELECT * REPLACE (CAST(timezone('America/New_York', timezone('UTC', ts)) AS TIMESTAMP) AS ts) FROM ib) WHERE {VALID}")
def s03(spark, d):
    return S.exchange_local(S.session_bars(spark, d)).select("symbol", "ts", "date", "open", "high", "low", "close", "volume")


@query("s04_ticks_to_bars", ["ub"], "SELECT symbol, date, open, high, low, close, volume FROM ub")
def s04(spark, d):
    return S.user_bars(spark, d)


@query("s04b_ticks_to_session_bars", ["ib"], "SELECT symbol, ts, date, interval, open, high, low, close, volume FROM ib")
def s04b(spark, d):
    return S.session_bars(spark, d)


SUFFIXES = [" ETF", " Warrants", " Depositary Shares", " 5.5% Senior 2030", " Acquisition Units, each of one share", " Units", " Unit Corporation", " Preferred Bank", " Preferred Stock", " Notes due 2031", " Note Bancorp", " Rights", " Wright Medical", " Funding", " Income Fund", ""]
NAME_SQL = "p_name || list_extract([" + ", ".join(f"'{x}'" for x in SUFFIXES) + f"], CAST(p_partkey % {len(SUFFIXES)} + 1 AS INTEGER))"
#: Which of the suffixes name listings that aren't common shares, judged by hand.
UNCOMMON = [" ETF", " Warrants", " Depositary Shares", " 5.5% Senior 2030", " Acquisition Units, each of one share", " Units", " Preferred Stock", " Notes due 2031", " Rights", " Income Fund"]


@query(
    "s05_build_universe",
    [],
    f"""SELECT symbol, name, market_cap, sector FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY market_cap DESC, name) AS n FROM (SELECT trim(p_brand) || CASE WHEN p_partkey % 17 = 0 THEN '^' ELSE '' END || CAST(p_partkey % 400 AS VARCHAR) AS symbol, {NAME_SQL} AS name, list_extract([{", ".join(f"{x in UNCOMMON}" for x in SUFFIXES)}], CAST(p_partkey % {len(SUFFIXES)} + 1 AS INTEGER)) AS uncommon,
      CASE WHEN p_partkey % 13 <> 0 THEN CAST(CAST(p_partkey AS VARCHAR) || lpad(CAST(p_size AS VARCHAR), 3, '0') || '.5' AS DOUBLE) END AS market_cap, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS sector FROM part)
      WHERE market_cap > 0 AND NOT contains(symbol, '^') AND NOT uncommon) WHERE n = 1 ORDER BY market_cap DESC, symbol LIMIT 100""",
)
def s05(spark, d):
    key = F.col("p_partkey")
    raw = S.read_table(spark, d, "part").select(
        F.concat(F.lit(" "), F.trim("p_brand"), F.when(key % 17 == 0, "^").otherwise(""), (key % 400).cast("string")).alias("symbol"),
        F.concat("p_name", F.element_at(F.array(*map(F.lit, SUFFIXES)), (key % len(SUFFIXES) + 1).cast("int"))).alias("name"),
        F.when(key % 13 == 0, "").otherwise(F.concat(key.cast("string"), F.lit(","), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(".5"))).alias("market_cap"),
        F.when(key % 3 != 0, F.concat("p_type", F.lit(" "))).alias("sector"),
    )
    return V.build_universe(raw, 100)


@query("s06_normalize_symbol", [], "SELECT DISTINCT p_brand || '/' || p_type || '. ' AS raw, replace(replace(trim(p_brand || '/' || p_type || '. '), '/', '-'), '.', '-') AS symbol FROM part")
def s06(spark, d):
    raw = S.read_table(spark, d, "part").select(F.concat("p_brand", F.lit("/"), "p_type", F.lit(". ")).alias("raw")).distinct()
    return raw.withColumn("symbol", normalize_symbol("raw"))


SNAPSHOTS = "SELECT symbol, name, market_cap * (1 + k / 10) AS market_cap, as_of + CAST(k AS INTEGER) AS as_of, sector FROM uu, range(3) t(k) WHERE (CAST(symbol AS BIGINT) + k) % 4 <> 0"


def snapshots(spark, d):
    k = F.explode(F.sequence(F.lit(0), F.lit(2)))
    grown = S.user_universe(spark, d).withColumn("k", k).where((F.col("symbol").cast("long") + F.col("k")) % 4 != 0)
    return grown.select("symbol", "name", (F.col("market_cap") * (1 + F.col("k") / 10)).alias("market_cap"), F.date_add("as_of", F.col("k")).alias("as_of"), "sector")


@query("s12_latest_snapshot", ["uu"], f"SELECT symbol, name, {R.format('market_cap')}, as_of, sector FROM ({SNAPSHOTS}) QUALIFY as_of = max(as_of) OVER ()")
def s12(spark, d):
    return rounded(V.latest_snapshot(snapshots(spark, d)), "market_cap")


@query("s13_all_universe_symbols", ["uu"], f"SELECT symbol, round(max(market_cap), 6) + 0.0 AS market_cap FROM ({SNAPSHOTS}) GROUP BY symbol")
def s13(spark, d):
    return rounded(V.all_symbols(snapshots(spark, d)), "market_cap")


@query("s14_last_bar", ["ub"], "SELECT symbol, max(date) AS last_date, arg_max(close, date) AS last_close FROM ub GROUP BY symbol")
def s14(spark, d):
    return V.last_bars(S.user_bars(spark, d))


PLAN_SQL = """SELECT symbol, CASE WHEN last_date IS NULL THEN 'backfill' WHEN from_date IS NULL THEN 'backfill' WHEN last_date < DATE '2024-02-20' - 30 THEN 'dormant' ELSE 'tail' END AS action,
  CASE WHEN last_date IS NULL OR from_date IS NULL THEN DATE '2019-01-01' WHEN last_date < DATE '2024-02-20' - 30 THEN NULL ELSE last_date END AS from_date
  FROM uu LEFT JOIN (SELECT symbol, max(date) AS last_date FROM ub WHERE CAST(symbol AS BIGINT) % 5 <> 0 OR date < DATE '2024-01-15' GROUP BY symbol) USING (symbol)
  LEFT JOIN (SELECT DISTINCT symbol, DATE '2019-01-01' AS from_date FROM ub WHERE CAST(symbol AS BIGINT) % 7 <> 0) USING (symbol)"""


def ingest_inputs(spark, d):
    bars, key = S.user_bars(spark, d), F.col("symbol").cast("long")
    last = bars.where((key % 5 != 0) | (F.col("date") < "2024-01-15")).groupBy("symbol").agg(F.max("date").alias("last_date"))
    meta = bars.where(key % 7 != 0).select("symbol", F.lit("2019-01-01").cast("date").alias("from_date")).distinct()
    return S.user_universe(spark, d).select("symbol"), last, meta


@query("s15_ingest_plan", ["ub", "uu"], PLAN_SQL)
def s15(spark, d):
    symbols, last, meta = ingest_inputs(spark, d)
    return V.ingest_plan(symbols, last, meta, today="2024-02-20", start="2019-01-01")


@query("s16_classify_missing", ["ub", "uu"], f"SELECT CASE WHEN last_date >= p.from_date THEN 'skipped' ELSE 'failed' END AS outcome, count(*) AS n_symbols FROM ({PLAN_SQL}) p LEFT JOIN (SELECT symbol, max(date) AS last_date FROM ub WHERE CAST(symbol AS BIGINT) % 5 <> 0 OR date < DATE '2024-01-15' GROUP BY symbol) USING (symbol) WHERE action <> 'dormant' AND CAST(symbol AS BIGINT) % 3 <> 0 GROUP BY 1")
def s16(spark, d):
    symbols, last, meta = ingest_inputs(spark, d)
    plan = V.ingest_plan(symbols, last, meta, today="2024-02-20", start="2019-01-01")
    returned = symbols.where(F.col("symbol").cast("long") % 3 == 0)
    return V.classify_missing(plan, last, returned).groupBy("outcome").agg(F.count(F.lit(1)).alias("n_symbols"))


@query("s17_price_counts", ["ub"], f"SELECT count(*) AS total, count(CASE WHEN date = m THEN 1 END) AS raw_on_latest, count(CASE WHEN date = m AND {VALID} THEN 1 END) AS usable_on_latest, max(date) AS latest FROM ub, (SELECT max(date) AS m FROM ub)")
def s17(spark, d):
    bars = S.user_bars(spark, d)
    day = F.broadcast(B.latest_date(bars).withColumnRenamed("date", "m"))  # one row
    on = F.col("date") == F.col("m")
    return bars.join(day, F.lit(True)).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(on, 1)).alias("raw_on_latest"), F.count(F.when(on & valid_bar(), 1)).alias("usable_on_latest"), F.max("date").alias("latest"))


@query("x01_valid_bars", ["ub"], f"SELECT symbol, date, open, high, low, close, volume FROM ub WHERE {VALID}")
def x01(spark, d):
    return S.user_bars(spark, d).where(valid_bar())


@query("x02_daily_returns", ["ur"], f"SELECT symbol, date, {R.format('oc_return')}, {R.format('high_return')}, {R.format('low_return')} FROM ur")
def x02(spark, d):
    return rounded(Users(spark, d).returns.select("symbol", "date", "oc_return", "high_return", "low_return"), "oc_return", "high_return", "low_return")


@query("x03_glitch_guard", ["ur"], "SELECT symbol, date, high, close, high_glitch_suspect FROM ur WHERE high_glitch_suspect")
def x03(spark, d):
    return Users(spark, d).returns.where("high_glitch_suspect").select("symbol", "date", "high", "close", "high_glitch_suspect")


@query("x04_touch_event", ["ur"], f"SELECT date, count(*) AS n_bars, count(CASE WHEN {touch_sql()} THEN 1 END) AS n_touch FROM ur GROUP BY date")
def x04(spark, d):
    return Users(spark, d).returns.groupBy("date").agg(F.count(F.lit(1)).alias("n_bars"), F.count(F.when(touch_event(), 1)).alias("n_touch"))


@query("x05_daily_movers", ["ur", "uu"], f"SELECT symbol, name, date, open, high, close, {R.format('high_return')}, {R.format('oc_return')} FROM ur LEFT JOIN uu USING (symbol) WHERE date = (SELECT max(date) FROM ur) AND {touch_sql()} ORDER BY high_return DESC")
def x05(spark, d):
    u = Users(spark, d)
    return rounded(B.daily_movers(u.returns, u.universe), "high_return", "oc_return")


@query("x06_split_artifact_flag", ["ub"], f"SELECT symbol, date, open, close, prev_close FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev_close FROM ub) WHERE abs((close - open) / nullif(open, 0)) > 0.5 + 1e-9 AND prev_close > 0 AND (open / prev_close > 2 + 1e-9 OR open / prev_close < 0.5 - 1e-9)")
def x06(spark, d):
    return B.with_split_flag(S.user_bars(spark, d)).where("split_artifact").select("symbol", "date", "open", "close", "prev_close")


@query("x07_era_filter", ["log"], f"SELECT signal_date, count(*) AS n_picks FROM log WHERE event = '{EVENT}' GROUP BY 1")
def x07(spark, d):
    return Users(spark, d).log.where(F.col("event") == EVENT).groupBy("signal_date").agg(F.count(F.lit(1)).alias("n_picks"))


@query("x08_liquidity_floor", ["ufeat"], f"SELECT signal_date, count(*) AS n_pool FROM ufeat WHERE median_vol_20 >= 3 * {LIQUIDITY} GROUP BY 1")
def x08(spark, d):
    return Users(spark, d).features.where(F.col("median_vol_20") >= 3 * LIQUIDITY).groupBy("signal_date").agg(F.count(F.lit(1)).alias("n_pool"))


@query("x09_thin_history_drop", ["ur"], f"SELECT count(CASE WHEN h < {MIN_DAYS} THEN 1 END) AS dropped, count(CASE WHEN h >= {MIN_DAYS} THEN 1 END) AS kept FROM (SELECT row_number() OVER (PARTITION BY symbol ORDER BY date) AS h FROM ur)")
def x09(spark, d):
    aged = Users(spark, d).returns.withColumn("h", F.row_number().over(B.by_symbol()))
    return aged.agg(F.count(F.when(F.col("h") < MIN_DAYS, 1)).alias("dropped"), F.count(F.when(F.col("h") >= MIN_DAYS, 1)).alias("kept"))


@query("x10_signal_day_default", ["ufeat", "ucomplete"], "SELECT coalesce((SELECT max(signal_date) FROM ufeat WHERE signal_date IN (SELECT date FROM ucomplete)), (SELECT max(signal_date) FROM ufeat)) AS signal_date")
def x10(spark, d):
    u = Users(spark, d)
    days = u.features.select("signal_date").distinct().join(u.complete.select(F.col("date").alias("signal_date"), F.lit(True).alias("whole")), "signal_date", "left")
    return days.agg(F.coalesce(F.max(F.when(F.col("whole"), F.col("signal_date"))), F.max("signal_date")).alias("signal_date"))


@query("a01_market_day", ["umarket"], f"SELECT date, {R.format('breadth')}, {R.format('market_heat')} FROM umarket")
def a01(spark, d):
    return rounded(B.market_day(Users(spark, d).returns), "breadth", "market_heat")


@query("a02_sector_day", ["usector"], f"SELECT date, sector, {R.format('sector_breadth')}, {R.format('sector_mean_oc')} FROM usector")
def a02(spark, d):
    u = Users(spark, d)
    return rounded(B.sector_day(u.returns, u.universe), "sector_breadth", "sector_mean_oc")


@query("a03_base_rates", ["ubase"], f"SELECT date, {R.format('base_rate')} FROM ubase WHERE day(date) % 2 = 0")
def a03(spark, d):
    u = Users(spark, d)
    return rounded(B.base_rates(u.returns, u.complete, u.returns.select("date").where(F.dayofmonth("date") % 2 == 0)), "base_rate")


@query("a04_day_counts", ["ub"], f"SELECT date, count(*) AS raw_count, count(CASE WHEN {VALID} THEN 1 END) AS bar_count FROM ub GROUP BY date")
def a04(spark, d):
    return B.day_counts(S.user_bars(spark, d))


@query("a05_complete_days", ["ucomplete"], "SELECT date, bar_count, prior_days, trailing_median FROM ucomplete")
def a05(spark, d):
    return B.complete_days(S.user_bars(spark, d))


@query("a06_coverage_days", ["ucov"], "SELECT date, bar_count, prior_days, trailing_median, complete FROM ucov")
def a06(spark, d):
    return B.coverage_days(S.user_bars(spark, d))


FEATURE_COLUMNS = ["oc_return_today", "ret_5d", "vol_20d", "volume_ratio", "close_pos", "breadth", "market_heat", "log_mcap", "sector_breadth", "sector_excess", "median_vol_20"]
FEATURE_SQL = "SELECT symbol, signal_date, target_date, did_2pct_next, cnt_2pct_20d, " + ", ".join(R.format(c) for c in FEATURE_COLUMNS) + " FROM "


@query("f01_feature_frame", ["ufeat"], FEATURE_SQL + "ufeat")
def f01(spark, d):
    return rounded(Users(spark, d).features.select("symbol", "signal_date", "target_date", "did_2pct_next", "cnt_2pct_20d", *FEATURE_COLUMNS), *FEATURE_COLUMNS)


@query("f01b_feature_frame_long", ["nfeat"], FEATURE_SQL + "nfeat")
def f01b(spark, d):
    return rounded(nation_features(spark, d).select("symbol", "signal_date", "target_date", "did_2pct_next", "cnt_2pct_20d", *FEATURE_COLUMNS), *FEATURE_COLUMNS)


@query("f02_label_next_touch", ["ufeat"], f"SELECT symbol, signal_date, target_date, did_2pct_next, {R.format('next_oc_return')}, {R.format('next_high_return')}, {R.format('next_low_return')} FROM ufeat")
def f02(spark, d):
    return rounded(Users(spark, d).features.select("symbol", "signal_date", "target_date", "did_2pct_next", "next_oc_return", "next_high_return", "next_low_return"), "next_oc_return", "next_high_return", "next_low_return")


@query("f03_feature_null_report", ["ufeat"], "SELECT count(*) AS n_rows, count(*) FILTER (sector_breadth IS NULL) AS null_rows, count(DISTINCT symbol) FILTER (sector_breadth IS NULL) AS null_symbols, bool_and(sector_breadth IS NULL) AS all_null FROM ufeat")
def f03(spark, d):
    return X.feature_null_report(Users(spark, d).features)


@query("j01_market_join", ["ur", "umarket"], "SELECT symbol, date, round(breadth, 6) + 0.0 AS breadth FROM ur JOIN umarket USING (date)")
def j01(spark, d):
    returns = Users(spark, d).table
    return rounded(returns.join(B.market_day(returns), "date").select("symbol", "date", "breadth"), "breadth")


@query("j02_left_universe_join", ["ur", "uu"], "SELECT symbol, date, sector FROM ur LEFT JOIN (SELECT * FROM uu WHERE market_cap > 0) USING (symbol)")
def j02(spark, d):
    u = Users(spark, d)
    return u.returns.join(u.universe.where("market_cap > 0").select("symbol", "sector"), "symbol", "left").select("symbol", "date", "sector")


@query("j03_left_sector_join", ["ur", "uu", "usector"], "SELECT symbol, ur.date, round(oc_return - sector_mean_oc, 6) + 0.0 AS sector_excess FROM ur LEFT JOIN uu USING (symbol) LEFT JOIN usector s ON s.date = ur.date AND s.sector = uu.sector")
def j03(spark, d):
    u = Users(spark, d)
    joined = u.table.join(u.universe.select("symbol", "sector"), "symbol", "left").join(B.sector_day(u.table, u.universe), ["date", "sector"], "left")
    return joined.select("symbol", "date", six(F.col("oc_return") - F.col("sector_mean_oc")).alias("sector_excess"))


@query("j04_next_complete_day", ["resolved"], "SELECT signal_date, target_date FROM resolved")
def j04(spark, d):
    u = Users(spark, d)
    return B.next_complete_day(u.log.where(F.col("event") == EVENT).select("signal_date"), u.complete)


@query("j09_semi_join", ["ub", "ucomplete"], "SELECT symbol, date FROM ub WHERE (symbol, date) IN (SELECT symbol, date FROM ub WHERE close > open) AND date IN (SELECT date FROM ucomplete)")
def j09(spark, d):
    u = Users(spark, d)
    up = u.bars.where("close > open").select("symbol", "date")
    return u.bars.select("symbol", "date").join(up, ["symbol", "date"], "left_semi").join(u.complete.select("date"), "date", "left_semi").select("symbol", "date")


W_SQL = "SELECT symbol, date, {} AS v FROM ur WINDOW w AS (PARTITION BY symbol ORDER BY date), w20 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


def w20():
    return B.by_symbol().rowsBetween(-19, 0)


WINDOWS = {
    "w01_row_number": ("row_number() OVER w", lambda: F.row_number().over(B.by_symbol()).cast("long")),
    "w02_lag": ("round(close / nullif(lag(close, 5) OVER w, 0) - lag(close) OVER w, 6) + 0.0", lambda: six(F.try_divide(F.col("close"), F.lag("close", 5).over(B.by_symbol())) - F.lag("close").over(B.by_symbol()))),
    "w03_lead": ("round(lead(oc_return) OVER w, 6) + 0.0", lambda: six(F.lead("oc_return").over(B.by_symbol()))),
    "w04_stddev": ("round(stddev_samp(oc_return) OVER w20, 6) + 0.0", lambda: six(F.stddev_samp("oc_return").over(w20()))),
    "w05_avg_sum": (f"round(volume / avg(volume) OVER w20 + sum(CASE WHEN {touch_sql()} THEN 1 ELSE 0 END) OVER w20, 6) + 0.0", lambda: six(F.col("volume") / F.avg("volume").over(w20()) + F.sum(F.when(touch_event(), 1).otherwise(0)).over(w20()))),
    "w06_median": ("round(median(volume) OVER w20, 6) + 0.0", lambda: six(F.percentile("volume", F.lit(0.5)).over(w20()))),
    "w07_prior_average": ("round(avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) + 0.0", lambda: six(F.avg("volume").over(B.by_symbol().rowsBetween(-20, -1)))),
    "w10_whole_maximum": ("max(volume) OVER ()", None),
    "w11_own_day_mean": ("round(avg(oc_return) OVER (PARTITION BY date), 6) + 0.0", lambda: six(F.avg("oc_return").over(Window.partitionBy("date")))),
    "w12_seeded_lag": ("coalesce(lag(close) OVER w, 100.0)", lambda: F.coalesce(F.lag("close").over(B.by_symbol()), F.lit(100.0))),
    "w13_shared_window": ("round(avg(close) OVER w20 - min(low) OVER w20, 6) + 0.0", lambda: six(F.avg("close").over(w20()) - F.min("low").over(w20()))),
    "w14_running_maximum": ("max(high) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)", lambda: F.max("high").over(B.by_symbol().rowsBetween(Window.unboundedPreceding, 0))),
}


def _window(column):
    def run(spark, d):
        returns = Users(spark, d).returns
        if column is None:  # a whole-set maximum is a scalar beside the rows, not a window in one task
            top = returns.agg(F.max("volume").alias("v"))
            return returns.select("symbol", "date").join(F.broadcast(top), F.lit(True))
        return returns.select("symbol", "date", column().alias("v"))

    return run


for _name, (_sql, _column) in WINDOWS.items():
    query(_name, ["ur"], W_SQL.format(_sql))(_window(_column))


@query("w08_date_window", ["ucov"], "SELECT date, trailing_median FROM ucov")
def w08(spark, d):
    return B.coverage_days(S.user_bars(spark, d)).select("date", "trailing_median")


@query("k01_top_per_day", ["uscored"], f"SELECT signal_date, symbol, prob, CAST(row_number() OVER (PARTITION BY signal_date ORDER BY prob DESC, symbol) AS INTEGER) AS rank FROM uscored WHERE median_vol_20 >= {LIQUIDITY} QUALIFY rank <= 5")
def k01(spark, d):
    return X.select_top(Users(spark, d).scored, 5, LIQUIDITY).select("signal_date", "symbol", "prob", "rank")


@query("k03_order_limit", ["uu"], "SELECT symbol, market_cap FROM uu ORDER BY market_cap DESC, symbol LIMIT 50")
def k03(spark, d):
    return S.user_universe(spark, d).orderBy(F.desc("market_cap"), "symbol").limit(50).select("symbol", "market_cap")


@query("k06_trailing_days", ["ubase"], "SELECT date, round(base_rate, 6) + 0.0 AS base_rate FROM ubase ORDER BY date DESC LIMIT 5")
def k06(spark, d):
    u = Users(spark, d)
    return rounded(B.base_rates(u.returns, u.complete).orderBy(F.desc("date")).limit(5), "base_rate")


@query("k07_worst_first", ["ur"], "SELECT symbol, date, round(oc_return, 6) + 0.0 AS oc_return FROM ur ORDER BY abs(oc_return) DESC, symbol, date LIMIT 25")
def k07(spark, d):
    return rounded(Users(spark, d).returns.orderBy(F.desc(F.abs("oc_return")), "symbol", "date").limit(25).select("symbol", "date", "oc_return"), "oc_return")


@query("x11_finite", ["ub"], "SELECT count(*) AS n_rows, count(CASE WHEN isfinite(ln(nullif(open - 20, 0) * 0 + 1)) THEN 1 END) AS n_finite FROM ub")
def x11(spark, d):
    value = F.log(F.nullif(F.col("open") - 20, F.lit(0.0)) * 0 + 1)
    return S.user_bars(spark, d).agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(finite(value), 1)).alias("n_finite"))
