"""Inputs that the plans share, as DataFrames and as DuckDB subqueries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.functions.exprs import EVENT, LIQUIDITY
from barlake.operators import bars as B
from barlake.operators import features as X
from barlake.plans.registry import subquery
from barlake.sources import tables as S
from barlake.sources.shared import stored

MIN_DAYS = 10  # the test users have 22 to 30 bars


def bars_sql(keys: str, source: str, value: str, order: str) -> str:
    return f"SELECT {keys}, first({value} ORDER BY {order}) AS open, max({value}) AS high, min({value}) AS low, last({value} ORDER BY {order}) AS close, CAST(count(*) * 100000 AS BIGINT) AS volume FROM {source} WHERE {value} IS NOT NULL GROUP BY 1, 2"


VALID = "isfinite(open) AND isfinite(high) AND isfinite(low) AND isfinite(close) AND open > 0 AND high >= open AND high >= close AND low <= open AND low <= close"


def returns_sql(source: str, usable: str = VALID) -> str:
    """Bars numbered within their symbol (k); the bar before and the volumes before by position, not by a window."""
    numbered = f"(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM {source} WHERE {usable})"
    return f"""SELECT b.symbol, b.k, b.date, b.open, b.high, b.low, b.close, b.volume, p.close AS prev_close, (b.close - b.open) / b.open AS oc_return, (b.high - b.open) / b.open AS high_return, (b.low - b.open) / b.open AS low_return,
      coalesce(b.volume < q.mean_volume AND b.high >= 1.15 * list_max([p.close, b.close, b.open]) AND (b.close - b.open) / b.open < 0.02 AND (b.high - b.open) / b.open >= 0.02, FALSE) AS high_glitch_suspect
      FROM {numbered} b LEFT JOIN {numbered} p ON p.symbol = b.symbol AND p.k = b.k - 1
      LEFT JOIN (SELECT y.symbol, y.k, sum(z.volume) / count(z.volume) AS mean_volume FROM {numbered} y JOIN {numbered} z ON z.symbol = y.symbol AND y.k - z.k BETWEEN 1 AND 20 GROUP BY ALL) q ON q.symbol = b.symbol AND q.k = b.k"""


def touch_sql(high: str = "high_return", glitch: str = "high_glitch_suspect") -> str:
    return f"(NOT {glitch} AND {high} > 0.02 - 1.0000001e-9)"


def coverage_sql(source: str) -> str:
    days = f"(SELECT date, count(*) AS bar_count, row_number() OVER (ORDER BY date) AS k FROM {source} WHERE {VALID} GROUP BY date)"
    return f"""SELECT d.date, d.bar_count, count(e.date) AS prior_days, median(e.bar_count) AS trailing_median, coalesce(count(e.date) < 5 OR d.bar_count + 1e-9 >= 0.9 * median(e.bar_count), FALSE) AS complete
      FROM {days} d LEFT JOIN {days} e ON d.k - e.k BETWEEN 1 AND 20 GROUP BY d.date, d.bar_count"""


def market_sql(returns: str) -> str:
    return f"SELECT date, count(*) FILTER (oc_return > 0) / count(*) AS breadth, count(*) FILTER (oc_return + 1e-9 >= 0.02) / count(*) AS market_heat FROM {returns} GROUP BY ALL"


def sector_sql(returns: str, universe: str) -> str:
    return f"SELECT r.date, u.sector, count(*) FILTER (r.oc_return > 0) / count(*) AS sector_breadth, sum(r.oc_return) / count(*) AS sector_mean_oc FROM {universe} u, {returns} r WHERE r.symbol = u.symbol AND length(u.sector) > 0 GROUP BY ALL"


def features_sql(returns: str, universe: str, market: str, sector: str, min_history: int) -> str:
    """Every look back or ahead is a join on the bar's number."""
    return f"""SELECT now.symbol, now.date AS signal_date, ahead.date AS target_date, CAST({touch_sql('ahead.high_return', 'ahead.high_glitch_suspect')} AS INTEGER) AS did_2pct_next,
      ahead.oc_return AS next_oc_return, ahead.high_return AS next_high_return, ahead.low_return AS next_low_return, now.oc_return AS oc_return_today, now.close / nullif(week.close, 0) - 1 AS ret_5d,
      month.spread AS vol_20d, now.volume / nullif(month.mean_volume, 0) AS volume_ratio, (now.close - now.low) / nullif(now.high - now.low, 0) AS close_pos, month.touches AS cnt_2pct_20d,
      day.breadth, day.market_heat, ln(CASE WHEN own.market_cap > 0 THEN own.market_cap END) AS log_mcap, peers.sector_breadth, now.oc_return - peers.sector_mean_oc AS sector_excess, month.mid_volume AS median_vol_20
      FROM {returns} now
      JOIN (SELECT y.symbol, y.k, stddev_samp(z.oc_return) AS spread, sum(z.volume) / count(z.volume) AS mean_volume, CAST(median(z.volume) AS DOUBLE) AS mid_volume, count(*) FILTER ({touch_sql('z.high_return', 'z.high_glitch_suspect')}) AS touches
        FROM {returns} y JOIN {returns} z ON z.symbol = y.symbol AND y.k - z.k BETWEEN 0 AND 19 GROUP BY ALL) month ON month.symbol = now.symbol AND month.k = now.k
      LEFT JOIN {returns} ahead ON ahead.symbol = now.symbol AND ahead.k = now.k + 1 LEFT JOIN {returns} week ON week.symbol = now.symbol AND week.k = now.k - 5
      LEFT JOIN {market} day ON day.date = now.date LEFT JOIN {universe} own ON own.symbol = now.symbol LEFT JOIN {sector} peers ON peers.sector = own.sector AND peers.date = now.date
      WHERE now.k >= {min_history}"""


subquery("ub", [], bars_sql("CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS date", "events", "value", "ts, event_id"))
subquery("uu", [], "SELECT CAST(c_custkey AS VARCHAR) AS symbol, c_name AS name, c_acctbal AS market_cap, DATE '2024-01-01' AS as_of, c_mktsegment AS sector FROM customer")
subquery("ur", ["ub"], returns_sql("ub"))
subquery("ucov", ["ub"], coverage_sql("ub"))
subquery("ucomplete", ["ucov"], "SELECT date, bar_count, prior_days, trailing_median FROM ucov WHERE complete")
subquery("umarket", ["ur"], market_sql("ur"))
subquery("usector", ["ur", "uu"], sector_sql("ur", "uu"))
subquery("ufeat", ["ur", "uu", "umarket", "usector"], features_sql("ur", "uu", "umarket", "usector", MIN_DAYS))
subquery("uscored", ["ufeat"], "SELECT *, round(coalesce(close_pos, 0.5) * 0.4 + cnt_2pct_20d / 20 * 0.4 + coalesce(breadth, 0.0) * 0.2, 4) AS prob FROM ufeat")
subquery("nlines", [], "SELECT CAST(s_nationkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
subquery("nb", ["nlines"], bars_sql("symbol, date", "nlines", "price", "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"))
subquery("nu", [], "SELECT CAST(n_nationkey AS VARCHAR) AS symbol, n_name AS name, market_cap, DATE '2024-01-01' AS as_of, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (SELECT s_nationkey, sum(s_acctbal) AS market_cap FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
subquery("nr", ["nb"], returns_sql("nb"))
subquery("nmarket", ["nr"], market_sql("nr"))
subquery("nsector", ["nr", "nu"], sector_sql("nr", "nu"))
subquery("nfeat", ["nr", "nu", "nmarket", "nsector"], features_sql("nr", "nu", "nmarket", "nsector", 20))
subquery("nscored", ["nfeat"], "SELECT *, round(coalesce(close_pos, 0.5) * 0.4 + cnt_2pct_20d / 20 * 0.4 + coalesce(breadth, 0.0) * 0.2, 4) AS prob FROM nfeat")
subquery("ib_raw", [], bars_sql("event_type AS symbol, time_bucket(INTERVAL '60 minutes', ts) AS ts", "(SELECT event_type, ts AS ts0, ts, event_id, value FROM events)", "value", "ts0, event_id"))
subquery("ib", ["ib_raw"], "SELECT symbol, ts, CAST(ts AS DATE) AS date, '60m' AS interval, open, high, low, close, volume FROM ib_raw")
subquery("td", [], bars_sql("event_type AS symbol, CAST(ts AS DATE) AS date", "events", "value", "ts, event_id"))
subquery("tr", ["td"], returns_sql("td"))
#: Logged predictions: live unless the day of the month divides by 5, of the old event definition if it divides by 11.
subquery(
    "log",
    ["uscored"],
    f"""SELECT 'formula' AS strategy, signal_date, symbol, prob, rank, CASE WHEN day(signal_date) % 5 = 0 THEN CAST(signal_date AS TIMESTAMP) + INTERVAL 4 DAY ELSE CAST(signal_date AS TIMESTAMP) + INTERVAL 10 HOUR END AS created_ts,
      CASE WHEN day(signal_date) % 11 = 0 THEN NULL ELSE '{EVENT}' END AS event FROM (SELECT *, CAST(row_number() OVER (PARTITION BY signal_date ORDER BY prob DESC, symbol) AS INTEGER) AS rank FROM uscored WHERE median_vol_20 >= {LIQUIDITY}) WHERE rank <= 20""",
)
subquery("touchlog", ["log"], f"SELECT * FROM log WHERE event = '{EVENT}'")
subquery("resolved", ["touchlog", "ucomplete"], "SELECT signal_date, min(date) AS target_date FROM (SELECT DISTINCT signal_date FROM touchlog) JOIN ucomplete ON date > signal_date GROUP BY signal_date")
LATE = "coalesce(created > CAST(target_date AS TIMESTAMP) + INTERVAL 14 HOUR + INTERVAL 30 MINUTE, TRUE)"  # 09:30 in New York in winter
subquery("created", ["touchlog", "resolved"], "SELECT target_date, max(created_ts) AS created FROM touchlog JOIN resolved USING (signal_date) GROUP BY target_date")
subquery(
    "outcomes",
    ["touchlog", "resolved", "ur", "created"],
    f"""SELECT p.signal_date, r.target_date, p.symbol, p.rank, p.prob, d.open, oc_return, high_return, low_return, CASE WHEN {touch_sql()} THEN 1 ELSE 0 END AS hit, {LATE.replace("target_date", "r.target_date")} AS late
      FROM touchlog p JOIN resolved r USING (signal_date) JOIN ur d ON d.symbol = p.symbol AND d.date = r.target_date LEFT JOIN created c ON c.target_date = r.target_date""",
)
subquery("ubase", ["ur", "ucomplete"], f"SELECT date, avg(CASE WHEN {touch_sql()} THEN 1.0 ELSE 0.0 END) AS base_rate FROM ur JOIN ucomplete USING (date) GROUP BY date")


class Users:
    """Daily bars of users and what derives from them. Where only bars and returns are asked for they come straight from the ticks;
    `table` holds the returns as a table, so that features, log and scores read the ticks once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.bars = S.user_bars(spark, sf_dir)
        self.universe = S.user_universe(spark, sf_dir)
        self.returns = B.daily_returns(self.bars)
        self.complete = B.complete_days(self.bars)

    @cached_property
    def table(self) -> DataFrame:
        self.returns = stored(self.returns, "returns")
        self.complete = B.complete_days(self.returns)  # days count valid bars only
        return self.returns

    @property
    def features(self) -> DataFrame:
        return X.feature_frame(self.table, self.universe, min_history=MIN_DAYS)

    @property
    def scored(self) -> DataFrame:
        return X.formula_score(self.features)

    @cached_property
    def log(self) -> DataFrame:
        """The logged predictions as a table of their own: at most 20 a day."""
        day = F.dayofmonth("signal_date")
        at = F.col("signal_date").cast("timestamp")
        picks = X.select_top(self.scored, 20, LIQUIDITY)
        made = picks.select(F.lit("formula").alias("strategy"), "signal_date", "symbol", "prob", "rank", F.when(day % 5 == 0, at + F.expr("INTERVAL 4 DAYS")).otherwise(at + F.expr("INTERVAL 10 HOURS")).alias("created_ts"), F.when(day % 11 == 0, None).otherwise(F.lit(EVENT)).alias("event"))
        return stored(made, "predictions")


def nation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.feature_frame(stored(B.daily_returns(S.nation_bars(spark, sf_dir)), "returns"), S.nation_universe(spark, sf_dir))
