"""Plans on intraday sessions, exit rules and the forward ledger."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.operators import bars as B
from barlake.operators import exits as X
from barlake.operators import sessions as I
from barlake.plans.daily import R, rounded
from barlake.plans.inputs import Users, bars_sql, touch_sql
from barlake.plans.registry import query, subquery
from barlake.plans.scoring import outcomes
from barlake.sources import tables as S
from barlake.sources import writers as W
from barlake.sources.shared import fresh_path, stored

MINUTES, OPEN = 60, 0
SLOT = "CAST(floor(date_diff('second', CAST(date AS TIMESTAMP), ts) / 3600) AS BIGINT)"
subquery("ib30_raw", [], bars_sql("event_type AS symbol, time_bucket(INTERVAL '30 minutes', ts) AS ts", "(SELECT event_type, ts AS ts0, ts, event_id, value FROM events)", "value", "ts0, event_id"))
subquery("ib30", ["ib30_raw"], "SELECT symbol, ts, CAST(ts AS DATE) AS date, '30m' AS interval, open, high, low, close, volume FROM ib30_raw")


def agree_sql(bars: str) -> str:
    return f"SELECT symbol, date, n_bars, s_open, abs(s_high - high) <= 0.001 * open AND abs(s_low - low) <= 0.001 * open AS agrees FROM (SELECT symbol, date, max(high) AS s_high, min(low) AS s_low, count(*) AS n_bars, arg_min(open, ts) AS s_open FROM {bars} GROUP BY 1, 2) JOIN tr USING (symbol, date)"


def order_sql(bars: str, minutes: int) -> str:
    cell = f"CAST(floor(date_diff('second', CAST(b.date AS TIMESTAMP), ts) / {minutes * 60}) AS BIGINT)"
    return f"""SELECT symbol, date, reason, CASE WHEN reason = 'resolved' THEN CASE WHEN limit_ts < stop_ts THEN 1 ELSE 2 END END AS seq FROM (SELECT *, CASE WHEN agrees IS NULL THEN 'no_intraday' WHEN NOT agrees OR limit_ts IS NULL OR stop_ts IS NULL THEN 'disagreed' WHEN limit_ts = stop_ts THEN 'same_bar'
      WHEN bars_before < floor(date_diff('second', CAST(date AS TIMESTAMP), least(limit_ts, stop_ts)) / {minutes * 60}) + 1 THEN 'gappy' ELSE 'resolved' END AS reason FROM
      (SELECT h.*, (SELECT count(DISTINCT {cell}) FROM {bars} b WHERE b.symbol = h.symbol AND b.date = h.date AND b.ts <= least(h.limit_ts, h.stop_ts)) AS bars_before FROM
        (SELECT d.symbol, d.date, g.agrees, min(CASE WHEN (i.high - d.open) / d.open >= 0.02 - 1e-9 THEN i.ts END) AS limit_ts, min(CASE WHEN (i.low - d.open) / d.open <= -0.01 + 1e-9 THEN i.ts END) AS stop_ts
          FROM tr d LEFT JOIN ({agree_sql(bars)}) g ON g.symbol = d.symbol AND g.date = d.date LEFT JOIN {bars} i ON i.symbol = d.symbol AND i.date = d.date WHERE {touch_sql()} AND low_return <= -0.01 + 1e-9 GROUP BY 1, 2, 3) h))"""


subquery("iagree", ["ib", "tr"], agree_sql("ib"))
#: A record with holes and one session that doesn't agree with its day.
subquery("ibh", ["ib"], "SELECT * FROM ib WHERE NOT (day(date) % 4 = 1 AND hour(ts) = 2) AND NOT (day(date) = 7 AND hour(ts) > 12)")
subquery("order60", ["ibh", "tr"], order_sql("ibh", 60))
subquery("order30", ["ib30", "tr"], order_sql("ib30", 30))
subquery("orderbest", ["order30", "order60"], "SELECT symbol, date, reason, seq, layer FROM (SELECT *, 0 AS layer FROM order30 UNION ALL SELECT *, 1 AS layer FROM order60) QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY CASE WHEN seq IS NOT NULL THEN 0 ELSE 1 END, layer) = 1")


def fill_sql(bars: str, minutes: int) -> str:
    return f"""SELECT symbol, date, (next_open - d_open) / d_open AS fill FROM (SELECT t.symbol, t.date, t.d_open, stop_ts, (SELECT count(DISTINCT floor(date_diff('second', CAST(b.date AS TIMESTAMP), b.ts) / {minutes * 60})) FROM {bars} b WHERE b.symbol = t.symbol AND b.date = t.date AND b.ts <= t.stop_ts) AS bars_before,
        n.open AS next_open, n.ts AS next_ts FROM (SELECT d.symbol, d.date, d.open AS d_open, min(CASE WHEN (i.low - d.open) / d.open <= -0.01 + 1e-9 THEN i.ts END) AS stop_ts FROM tr d JOIN ({agree_sql(bars)}) g ON g.symbol = d.symbol AND g.date = d.date AND g.agrees JOIN {bars} i ON i.symbol = d.symbol AND i.date = d.date WHERE low_return <= -0.01 + 1e-9 GROUP BY 1, 2, 3) t
        JOIN {bars} n ON n.symbol = t.symbol AND n.date = t.date AND n.ts = (SELECT min(z.ts) FROM {bars} z WHERE z.symbol = t.symbol AND z.date = t.date AND z.ts > t.stop_ts))
      WHERE bars_before >= floor(date_diff('second', CAST(date AS TIMESTAMP), stop_ts) / {minutes * 60}) + 1 AND date_diff('second', stop_ts, next_ts) = {minutes * 60} AND next_open > 0"""


subquery("fills60", ["ibh", "tr"], fill_sql("ibh", 60))
subquery("fills30", ["ib30", "tr"], fill_sql("ib30", 30))
subquery(
    "trails",
    ["ib", "tr", "iagree"],
    f"""SELECT symbol, date, (coalesce(stop_px, last_close) - d_open) / d_open AS trail FROM (SELECT symbol, date, d_open, min(slot) AS f, max(slot) AS l, count(DISTINCT slot) AS n, arg_min(CASE WHEN low <= trigger THEN least(after, trigger) END, CASE WHEN low <= trigger THEN ts END) AS stop_px, arg_max(close, ts) AS last_close FROM
      (SELECT *, greatest(max(high) OVER (PARTITION BY symbol, date ORDER BY ts ROWS UNBOUNDED PRECEDING), d_open) * (1 - 0.01) AS trigger, coalesce(lead(open) OVER (PARTITION BY symbol, date ORDER BY ts), close) AS after FROM
        (SELECT i.*, d.open AS d_open, {SLOT.replace('date AS', 'i.date AS').replace(', ts)', ', i.ts)')} AS slot FROM ib i JOIN tr d ON d.symbol = i.symbol AND d.date = i.date JOIN iagree g ON g.symbol = i.symbol AND g.date = i.date AND g.agrees)) GROUP BY 1, 2, 3) WHERE f = 0 AND n = l + 1""",
)
#: Event types as picks, those of the day's greatest volume first, with what their sessions know.
subquery(
    "epicks",
    ["tr", "order60", "fills60", "trails"],
    f"""SELECT p.date AS target_date, p.symbol, rank, CAST(hit AS INTEGER) AS hit, low_return AS ol, oc_return AS oc, hit AS filled, seq, fill, trail FROM (SELECT *, {touch_sql()} AS hit, CAST(row_number() OVER (PARTITION BY date ORDER BY volume DESC, symbol) AS INTEGER) AS rank FROM tr) p
      LEFT JOIN order60 o ON o.symbol = p.symbol AND o.date = p.date LEFT JOIN fills60 f ON f.symbol = p.symbol AND f.date = p.date LEFT JOIN trails t ON t.symbol = p.symbol AND t.date = p.date""",
)


class Sessions:
    """Days, hours and half hours of event types, each a table: what is asked of them reads them more than once."""

    def __init__(self, spark, d):
        self.spark, self.d = spark, d

    @cached_property
    def returns(self) -> DataFrame:
        return stored(B.daily_returns(S.type_days(self.spark, self.d)), "type-days")

    @cached_property
    def bars(self) -> DataFrame:
        return stored(S.session_bars(self.spark, self.d), "hours")

    @cached_property
    def half_hours(self) -> DataFrame:
        return stored(S.session_bars(self.spark, self.d, 30), "half-hours")

    @property
    def holed(self) -> DataFrame:
        hour, day = F.hour("ts"), F.dayofmonth("date")
        return self.bars.where(~((day % 4 == 1) & (hour == 2)) & ~((day == 7) & (hour > 12)))

    def order(self, bars: DataFrame, minutes: int) -> DataFrame:
        return I.trigger_order(self.returns, self.returns, bars, bar_minutes=minutes, open_minutes=OPEN)

    def fills(self, bars: DataFrame, minutes: int) -> DataFrame:
        return I.stop_fills(self.returns, self.returns, bars, bar_minutes=minutes, open_minutes=OPEN)


def exit_picks(spark, d) -> DataFrame:
    """Event types as picks, those of the day's greatest volume first, with what their sessions know."""
    s = Sessions(spark, d)
    nth = Window.partitionBy("target_date").orderBy(F.desc("volume"), "symbol")
    hit = B.touch_event()
    named = s.returns.withColumnRenamed("date", "target_date")
    picks = named.select("target_date", "symbol", F.row_number().over(nth).alias("rank"), hit.cast("int").alias("hit"), F.col("low_return").alias("ol"), F.col("oc_return").alias("oc"), hit.alias("filled"))
    trails = I.trailing_exits(s.returns, s.bars, bar_minutes=MINUTES, open_minutes=OPEN)
    return stored(I.attach_outcomes(picks, s.order(s.holed, 60), s.fills(s.holed, 60), trails), "picks")


@query("a27_session_agreement", ["iagree"], "SELECT symbol, date, n_bars, s_open, agrees FROM iagree")
def a27(spark, d):
    s = Sessions(spark, d)
    return I.session_agreement(s.returns, s.bars)


COVER = "SELECT interval, date, n_bars, symbols, last_minute, trailing_median, last_minute < 1440 - 60 - 10 AS truncated, coalesce(symbols < 0.5 * trailing_median, FALSE) AS thin FROM (SELECT *, CAST(median(symbols) OVER (PARTITION BY interval ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS DOUBLE) AS trailing_median FROM (SELECT interval, date, count(*) AS n_bars, count(DISTINCT symbol) AS symbols, max(date_diff('minute', CAST(date AS TIMESTAMP), ts)) AS last_minute FROM ibh GROUP BY 1, 2))"


@query("a28_session_coverage", ["ibh"], COVER)
def a28(spark, d):
    return I.session_coverage(Sessions(spark, d).holed, bar_minutes=MINUTES, close_minutes=1440)


@query("w09_interval_median", ["ibh"], "SELECT interval, date, symbols, (SELECT median(n) FROM (SELECT e.date, count(DISTINCT e.symbol) AS n FROM ibh e WHERE e.interval = c.interval AND e.date < c.date GROUP BY 1 ORDER BY 1 DESC LIMIT 5)) AS trailing_median FROM (SELECT interval, date, count(DISTINCT symbol) AS symbols FROM ibh GROUP BY 1, 2) c")
def w09(spark, d):
    return I.session_coverage(Sessions(spark, d).holed, bar_minutes=MINUTES, close_minutes=1440).select("interval", "date", "symbols", "trailing_median")


@query("a28b_coverage_problems", ["ibh"], f"SELECT * FROM ({COVER}) WHERE truncated OR thin")
def a28b(spark, d):
    return I.coverage_problems(I.session_coverage(Sessions(spark, d).holed, bar_minutes=MINUTES, close_minutes=1440))


@query("e02_trigger_order", ["order60"], "SELECT symbol, date, reason, CAST(seq AS INTEGER) AS seq FROM order60")
def e02(spark, d):
    s = Sessions(spark, d)
    return s.order(s.holed, 60)


@query("j11_decorrelated_counts", ["ibh"], "SELECT symbol, date, ts, (SELECT count(DISTINCT hour(e.ts)) FROM ibh e WHERE e.symbol = b.symbol AND e.date = b.date AND e.ts <= b.ts) AS slots_so_far FROM ibh b")
def j11(spark, d):
    """For every bar the slots of its session up to it: a running count of first occurrences for a correlated subquery."""
    slotted = Sessions(spark, d).holed.withColumn("slot", F.hour("ts"))
    first = F.row_number().over(Window.partitionBy("symbol", "date", "slot").orderBy("ts")) == 1
    so_far = F.sum(F.when(first, 1).otherwise(0)).over(Window.partitionBy("symbol", "date").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0))
    return slotted.select("symbol", "date", "ts", so_far.cast("long").alias("slots_so_far"))


@query("j12_left_joins", ["tr", "ib30"], "SELECT t.symbol, t.date, CASE WHEN g.n IS NULL THEN 'no_intraday' WHEN abs(g.s_high - t.high) <= 0.001 * t.open AND abs(g.s_low - t.low) <= 0.001 * t.open THEN 'agrees' ELSE 'disagrees' END AS state FROM tr t LEFT JOIN (SELECT symbol, date, count(*) AS n, max(high) AS s_high, min(low) AS s_low FROM ib30 WHERE day(date) % 3 <> 0 AND NOT (day(date) = 7 AND hour(ts) > 12) GROUP BY 1, 2) g USING (symbol, date)")
def j12(spark, d):
    """No sessions at all is told from sessions that disagree."""
    s, day = Sessions(spark, d), F.dayofmonth("date")
    agree = I.session_agreement(s.returns, s.half_hours.where((day % 3 != 0) & ~((day == 7) & (F.hour("ts") > 12))))
    state = F.when(F.col("agrees").isNull(), "no_intraday").when(F.col("agrees"), "agrees").otherwise("disagrees")
    return s.returns.select("symbol", "date").join(agree, ["symbol", "date"], "left").select("symbol", "date", state.alias("state"))


@query("e03_trigger_order_best", ["orderbest"], "SELECT symbol, date, reason, CAST(seq AS INTEGER) AS seq, layer FROM orderbest")
def e03(spark, d):
    s = Sessions(spark, d)
    return I.best_of([s.order(s.half_hours, 30), s.order(s.holed, 60)], F.col("seq").isNotNull())


@query("j14_layered_resolve", ["order30", "order60"], "SELECT symbol, date, reason FROM order60 WHERE (symbol, date) NOT IN (SELECT (symbol, date) FROM order30 WHERE seq IS NOT NULL)")
def j14(spark, d):
    """What the finer layer left open, by an anti join on what it resolved."""
    s = Sessions(spark, d)
    done = s.order(s.half_hours, 30).where("seq IS NOT NULL").select("symbol", "date")
    return s.order(s.holed, 60).join(done, ["symbol", "date"], "left_anti").select("symbol", "date", "reason")


@query("e04_stop_fills", ["fills60"], f"SELECT symbol, date, {R.format('fill')} FROM fills60")
def e04(spark, d):
    s = Sessions(spark, d)
    return rounded(s.fills(s.holed, 60), "fill")


@query("e05_stop_fills_best", ["fills30", "fills60"], f"SELECT symbol, date, {R.format('fill')}, layer FROM (SELECT *, 0 AS layer FROM fills30 UNION ALL SELECT *, 1 AS layer FROM fills60) QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY layer) = 1")
def e05(spark, d):
    s = Sessions(spark, d)
    return rounded(I.best_of([s.fills(s.half_hours, 30), s.fills(s.holed, 60)], F.col("fill").isNotNull()), "fill")


@query("e06_trailing_exits", ["trails"], f"SELECT symbol, date, {R.format('trail')} FROM trails")
def e06(spark, d):
    s = Sessions(spark, d)
    return rounded(I.trailing_exits(s.returns, s.bars, bar_minutes=MINUTES, open_minutes=OPEN), "trail")


VALIDATION = "SELECT count(CASE WHEN a.seq IS NOT NULL AND b.seq IS NOT NULL THEN 1 END) AS compared, count(CASE WHEN a.seq = b.seq THEN 1 END) AS agreed, count(CASE WHEN a.seq <> b.seq THEN 1 END) AS disagreed, count(CASE WHEN a.seq IS NOT NULL AND b.seq IS NULL THEN 1 END) AS unchecked, count(CASE WHEN a.seq IS NULL AND b.seq IS NOT NULL AND a.reason = 'same_bar' THEN 1 END) AS recovered_same_bar, count(CASE WHEN a.seq IS NULL AND b.seq IS NOT NULL AND a.reason = 'gappy' THEN 1 END) AS recovered_gappy FROM order60 a FULL JOIN order30 b USING (symbol, date)"


@query("e07_order_validation", ["order60", "order30"], VALIDATION)
def e07(spark, d):
    s = Sessions(spark, d)
    return I.order_validation(s.order(s.holed, 60), s.order(s.half_hours, 30))


@query("j13_full_outer_merge", ["ibh", "ib30"], "SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.date, b.date) AS date, a.n AS hours, b.n AS half_hours FROM (SELECT symbol, date, count(*) AS n FROM ibh WHERE day(date) % 3 <> 0 GROUP BY 1, 2) a FULL JOIN (SELECT symbol, date, count(*) AS n FROM ib30 WHERE day(date) % 4 <> 0 GROUP BY 1, 2) b ON a.symbol = b.symbol AND a.date = b.date")
def j13(spark, d):
    """Sessions of either record, with their bars in both."""
    s, day = Sessions(spark, d), F.dayofmonth("date")
    hours = s.holed.where(day % 3 != 0).groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("hours"))
    halves = s.half_hours.where(day % 4 != 0).groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("half_hours"))
    return hours.join(halves, ["symbol", "date"], "full_outer")


ATTACH = f"SELECT symbol, target_date, hit, CAST(seq AS INTEGER) AS seq, {R.format('fill')}, {R.format('trail')} FROM (SELECT symbol, date AS target_date, CASE WHEN {touch_sql()} THEN 1 ELSE 0 END AS hit FROM tr) p LEFT JOIN (SELECT symbol AS s, date AS d, seq FROM order60) o ON o.s = symbol AND o.d = target_date LEFT JOIN (SELECT symbol AS s, date AS d, fill FROM fills60) f ON f.s = symbol AND f.d = target_date LEFT JOIN (SELECT symbol AS s, date AS d, trail FROM trails) t ON t.s = symbol AND t.d = target_date"


@query("e08_attach_outcomes", ["tr", "order60", "fills60", "trails"], ATTACH)
def e08(spark, d):
    s = Sessions(spark, d)
    picks = s.returns.select("symbol", F.col("date").alias("target_date"), F.when(B.touch_event(), 1).otherwise(0).alias("hit"))
    trails = I.trailing_exits(s.returns, s.bars, bar_minutes=MINUTES, open_minutes=OPEN)
    return rounded(I.attach_outcomes(picks, s.order(s.holed, 60), s.fills(s.holed, 60), trails), "fill", "trail")


@query("j15_outcome_attach", ["tr", "trails"], f"SELECT t.symbol, t.date AS target_date, {R.format('trail')} FROM tr t LEFT JOIN trails x ON x.symbol = t.symbol AND x.date = t.date")
def j15(spark, d):
    """A side that repeats every key adds no row to the picks."""
    s = Sessions(spark, d)
    trails = I.trailing_exits(s.returns, s.bars, bar_minutes=MINUTES, open_minutes=OPEN)
    none = s.returns.select("symbol", "date", F.lit(None).cast("int").alias("seq"), F.lit(None).cast("double").alias("fill"))
    return rounded(I.attach_outcomes(s.returns.select("symbol", F.col("date").alias("target_date")), none, none, trails.unionByName(trails)).select("symbol", "target_date", "trail"), "trail")


@query("j10_both_intervals", ["ib", "ib30"], "SELECT DISTINCT symbol, date FROM ib a WHERE hour(ts) < 20 AND EXISTS (SELECT 1 FROM ib30 b WHERE b.symbol = a.symbol AND b.date = a.date AND hour(b.ts) > 21)")
def j10(spark, d):
    s = Sessions(spark, d)
    return I.both_intervals(s.bars.where(F.hour("ts") < 20).unionByName(s.half_hours.where(F.hour("ts") > 21)), "60m", "30m")


@query(
    "e08b_attach_coverage",
    ["epicks"],
    """SELECT count(*) AS picks, count(DISTINCT (symbol, target_date)) AS pairs, count(*) FILTER (filled AND ol <= -0.01 + 1e-9) AS both_touched, count(seq) AS ordered, count(fill) AS filled, min(target_date) FILTER (fill IS NOT NULL) AS first_fill, max(target_date) FILTER (fill IS NOT NULL) AS last_fill,
      count(trail) AS replayed, (SELECT count(*) FROM (SELECT 1 FROM epicks GROUP BY target_date HAVING bool_or(trail IS NULL))) AS days_not_replayed FROM epicks""",
)
def e08b(spark, d):
    return I.attach_coverage(exit_picks(spark, d))


#: Days with their picks as lists of structs, null where not finite; every third day's base rate is unknown.
NESTED = """SELECT target_date AS d, CASE WHEN day(target_date) % 3 <> 0 THEN round(avg(hit), 6) END AS base, day(target_date) % 5 = 0 AS late,
  list(struct_pack(rank := rank, oh := round(oh, 6) + 0.0, ol := round(ol, 6) + 0.0, oc := round(oc, 6) + 0.0, hit := hit, seq := CAST(seq AS INTEGER), fill := round(fill, 6) + 0.0, trail := round(trail, 6) + 0.0) ORDER BY rank) AS picks
  FROM (SELECT e.*, r.high_return AS oh FROM epicks e JOIN tr r ON r.symbol = e.symbol AND r.date = e.target_date) GROUP BY target_date"""
NUMBERS = ("oh", "ol", "oc", "fill", "trail")


def nested_days(spark, d) -> DataFrame:
    picks = exit_picks(spark, d)
    oh = Sessions(spark, d).returns.select("symbol", F.col("date").alias("target_date"), F.col("high_return").alias("oh"))
    dated = picks.join(oh, ["symbol", "target_date"]).withColumn("late", F.dayofmonth("target_date") % 5 == 0)
    base = picks.where(F.dayofmonth("target_date") % 3 != 0).groupBy("target_date").agg(F.avg("hit").alias("base_rate"))
    return I.pick_days(dated, base)


PICK_TEXT = " || ';' || ".join(f"coalesce(CAST({'p.' + c if c in ('rank', 'hit', 'seq') else f'CAST(round(p.{c} * 1000000) AS BIGINT)'} AS VARCHAR), '-')" for c in ("rank", "oh", "ol", "oc", "hit", "seq", "fill", "trail"))


@query("e09_pick_days_nested", ["epicks", "tr"], f"SELECT d, CAST(round(base * 1000000) AS BIGINT) AS base, late, len(picks) AS n_picks, array_to_string(list_transform(picks, lambda p: {PICK_TEXT}), ',') AS picks FROM ({NESTED})")
def e09(spark, d):
    """Every field of every pick of the nested days, spelled out: returns in millionths, nulls as dashes."""

    def spelled(p):
        fields = [F.round(p[c] * 1_000_000).cast("long") if c in NUMBERS else p[c] for c in ("rank", "oh", "ol", "oc", "hit", "seq", "fill", "trail")]
        return F.concat_ws(";", *(F.coalesce(f.cast("string"), F.lit("-")) for f in fields))

    return nested_days(spark, d).select("d", F.round(F.col("base") * 1_000_000).cast("long").alias("base"), "late", F.size("picks").cast("long").alias("n_picks"), F.array_join(F.transform("picks", spelled), ",").alias("picks"))


@query("e09b_nested_day_coverage", ["epicks", "tr"], f"SELECT d, len(list_filter(picks, lambda p: p.seq IS NOT NULL)) AS ordered, len(list_filter(picks, lambda p: p.fill IS NOT NULL)) AS filled, len(list_filter(picks, lambda p: p.trail IS NOT NULL)) AS replayed, len(list_filter(picks, lambda p: p.ol IS NULL OR p.oc IS NULL)) AS unknown, list_sum(list_transform(picks, lambda p: p.hit)) AS hits FROM ({NESTED})")
def e09b(spark, d):
    """Coverage counted on the nested days alone."""
    return I.nested_coverage(nested_days(spark, d)).select("d", "ordered", "filled", "replayed", "unknown", "hits")


FILL = "least(coalesce(fill, -0.01), -0.01)"
BOTH = "filled AND ol <= -0.01 + 1e-9"
WORST = f"CASE rule WHEN 'hold_close' THEN oc WHEN 'limit_2pct' THEN CASE WHEN filled THEN 0.02 ELSE oc END WHEN 'trailing' THEN trail ELSE CASE WHEN {BOTH} AND seq = 1 THEN 0.02 WHEN ol <= -0.01 + 1e-9 THEN {FILL} WHEN filled THEN 0.02 ELSE oc END END"
TOP = f"CASE rule WHEN 'hold_close' THEN oc WHEN 'limit_2pct' THEN CASE WHEN filled THEN 0.02 ELSE oc END WHEN 'trailing' THEN trail ELSE CASE WHEN {BOTH} AND seq = 2 THEN {FILL} WHEN {BOTH} THEN 0.02 WHEN ol <= -0.01 + 1e-9 THEN {FILL} WHEN filled THEN 0.02 ELSE oc END END"
RULED = f"SELECT *, {WORST} AS worst, {TOP} AS best FROM epicks, (VALUES ('hold_close'), ('limit_2pct'), ('limit_stop'), ('trailing')) r(rule)"


@query("e01_exit_rule_returns", ["epicks"], f"SELECT target_date, symbol, rank, rule, {R.format('worst')}, {R.format('best')} FROM ({RULED})")
def e01(spark, d):
    return rounded(X.rule_returns(exit_picks(spark, d)).select("target_date", "symbol", "rank", "rule", "worst", "best"), "worst", "best")


@query(
    "a42_rule_explorer",
    ["epicks"],
    f"""SELECT rule, n, w, days, clean, missing, excluded, round(ln(CASE WHEN growth_worst > 0 THEN growth_worst END), 6) + 0.0 AS log_growth_worst, round(ln(CASE WHEN growth_best > 0 THEN growth_best END), 6) + 0.0 AS log_growth_best, picks, amb, res, stopped, meas, round(wins_w / nullif(picks, 0), 6) + 0.0 AS win_worst, round(wins_b / nullif(picks, 0), 6) + 0.0 AS win_best FROM
      (SELECT rule, n, w, count(*) AS days, count(CASE WHEN ok THEN 1 END) AS clean, count(CASE WHEN missing THEN 1 END) AS missing, count(CASE WHEN NOT missing AND unknown THEN 1 END) AS excluded, product(CASE WHEN ok THEN 1 + worst END) AS growth_worst, product(CASE WHEN ok THEN 1 + best END) AS growth_best,
        {', '.join(f'CAST(coalesce(sum(CASE WHEN ok THEN {c} END), 0) AS BIGINT) AS {c}' for c in ('picks', 'wins_w', 'wins_b', 'amb', 'res', 'stopped', 'meas'))} FROM
        (SELECT *, NOT missing AND NOT unknown AS ok FROM (SELECT rule, n, target_date, avg(worst) AS worst, avg(best) AS best, count(*) AS picks, count(CASE WHEN worst > 0 THEN 1 END) AS wins_w, count(CASE WHEN best > 0 THEN 1 END) AS wins_b, count(CASE WHEN {BOTH} THEN 1 END) AS amb, count(CASE WHEN {BOTH} AND seq IS NOT NULL THEN 1 END) AS res,
          count(CASE WHEN ol <= -0.01 + 1e-9 THEN 1 END) AS stopped, count(CASE WHEN ol <= -0.01 + 1e-9 AND fill IS NOT NULL THEN 1 END) AS meas, bool_or(ol IS NULL OR oc IS NULL) AS missing, bool_or(worst IS NULL) AS unknown
          FROM (SELECT *, row_number() OVER (PARTITION BY target_date, rule ORDER BY rank, symbol) AS place FROM ({RULED})), (VALUES (1), (5), (10), (15), (20)) b(n) WHERE place <= n GROUP BY 1, 2, 3))
        JOIN (SELECT target_date, row_number() OVER (ORDER BY target_date DESC) AS age FROM (SELECT DISTINCT target_date FROM epicks)) USING (target_date), (VALUES (5), (21), (63), (126), (252)) v(w) WHERE age <= w GROUP BY 1, 2, 3)""",
)
def a42(spark, d):
    """Growth as its logarithm: the test bars move by tens of percent a day."""
    cells = X.rule_explorer(exit_picks(spark, d))
    logs = {f"log_{c}": F.log(F.when(F.col(c) > 0, F.col(c))) for c in ("growth_worst", "growth_best")}
    return rounded(cells.withColumns(logs).drop("growth_worst", "growth_best"), *logs, "win_worst", "win_best")


PAPER = "SELECT target_date, symbol, rank, 'limit_2pct' AS rule, CASE WHEN hit = 1 THEN 0.02 ELSE oc_return END AS gross_return, CASE WHEN hit = 1 THEN 'limit' ELSE 'close' END AS exit_reason, count(*) OVER (PARTITION BY target_date) AS n_avail FROM outcomes WHERE NOT late"


@query("e10_paper_record", ["outcomes"], f"SELECT target_date, symbol, rank, rule, {R.format('gross_return')}, exit_reason, n_avail FROM ({PAPER}) WHERE DATE '2024-01-31' - target_date BETWEEN 0 AND 5 AND target_date NOT IN (SELECT target_date FROM outcomes WHERE day(target_date) = 29)")
def e10(spark, d):
    """Through the written ledger: a day recorded twice is there once."""
    found = outcomes(Users(spark, d))
    recorded = found.where(F.dayofmonth("target_date") == 29).select("target_date")
    new = X.paper_record(found, recorded, today="2024-01-31")
    path = fresh_path(spark, "paper")
    for stamp in ("2024-01-31", "2024-02-01"):
        written = W.record_paper(spark, path, new, "formula", F.lit(stamp).cast("timestamp"))
    columns = ["target_date", "symbol", "rank", "rule", "gross_return", "exit_reason", "n_avail"]
    return rounded(written.where("recorded_ts = '2024-02-01'").select(F.to_date("target_date").alias("target_date"), *columns[1:]), "gross_return")


def trades(spark, d) -> DataFrame:
    return X.paper_record(outcomes(Users(spark, d)), outcomes(Users(spark, d)).limit(0), today="2024-03-01", max_age=400)


#: A trade belongs to a basket if fewer trades than that stand before it on its day: a count, not a window.
BASKETS = f"""SELECT x.*, basket FROM (SELECT x.*, (SELECT count(*) FROM ({PAPER}) y WHERE y.target_date = x.target_date AND (y.rank < x.rank OR (y.rank = x.rank AND y.symbol < x.symbol))) AS ahead FROM ({PAPER}) x) x, (VALUES (1), (5), (10), (20)) b(basket) WHERE ahead < basket"""


@query(
    "a39_paper_report",
    ["outcomes"],
    f"""SELECT CAST(basket AS INTEGER) AS basket, cost_bps, {R.format('growth')}, days, trades, {R.format('day_win_rate')}, {R.format('mean')}, {R.format('sd')}, round(mean * sqrt(days) / nullif(sd, 0), 6) + 0.0 AS t FROM (SELECT basket, cost_bps, product(1 + day) AS growth, count(*) AS days, CAST(sum(n) AS BIGINT) AS trades, avg(CAST(day > 0 AS INTEGER)) AS day_win_rate, avg(day) AS mean, stddev_samp(day) AS sd FROM
      (SELECT basket, cost_bps, target_date, avg(gross_return - cost_bps / 10000) AS day, count(*) AS n FROM ({BASKETS}), (VALUES (0), (5), (10), (20), (40)) c(cost_bps) WHERE basket IN (5, 20) GROUP BY 1, 2, 3) GROUP BY 1, 2)""",
)
def a39(spark, d):
    """A small basket, in which picks that didn't trade leave their places to others, and the whole one."""
    made = stored(trades(spark, d), "trades")
    small, whole = (X.paper_report(made, n).withColumn("basket", F.lit(n)) for n in (5, 20))
    return rounded(small.unionByName(whole), "growth", "day_win_rate", "mean", "sd", "t")


#: The bisection as a recursion of 60 steps over the daily means of each basket.
BREAKEVEN = f"""WITH RECURSIVE means AS (SELECT basket, list(day) AS days FROM (SELECT basket, target_date, avg(gross_return) AS day FROM ({BASKETS}) GROUP BY 1, 2) GROUP BY 1),
  halved AS (SELECT basket, days, 0 AS step, 0.0::DOUBLE AS lo, 0.05::DOUBLE AS hi FROM means UNION ALL
    SELECT basket, days, step + 1, CASE WHEN grows THEN (lo + hi) / 2 ELSE lo END, CASE WHEN grows THEN hi ELSE (lo + hi) / 2 END FROM (SELECT *, list_product(list_transform(days, lambda r: 1 + r - (lo + hi) / 2)) > 1 AS grows FROM halved) WHERE step < 60)
  SELECT basket, CAST(len(days) AS BIGINT) AS days, round(CASE WHEN list_product(list_transform(days, lambda r: 1 + r)) <= 1 THEN 0 ELSE (lo + hi) / 2 * 10000 END, 6) + 0.0 AS breakeven_bps FROM halved WHERE step = 60"""


@query("a40_paper_breakeven", ["outcomes"], f"SELECT * FROM ({BREAKEVEN})")
def a40(spark, d):
    return rounded(X.paper_breakeven(trades(spark, d)), "breakeven_bps")


@query(
    "a37_halves_hold",
    ["outcomes"],
    f"""SELECT days, {R.format('first_margin')}, {R.format('second_margin')}, coalesce(days >= 4 AND first_margin > 1e-9 AND second_margin > 1e-9, FALSE) AS holds FROM (SELECT count(*) AS days, avg(CASE WHEN n <= floor(k / 2) THEN a - b END) AS first_margin, avg(CASE WHEN n > floor(k / 2) THEN a - b END) AS second_margin FROM
      (SELECT a, b, row_number() OVER (ORDER BY target_date) AS n, count(*) OVER () AS k FROM (SELECT target_date, avg(hit) AS a FROM outcomes WHERE rank <= 5 GROUP BY 1) JOIN (SELECT target_date, avg(hit) AS b FROM outcomes GROUP BY 1) USING (target_date)))""",
)
def a37(spark, d):
    found = outcomes(Users(spark, d))
    daily = [x.groupBy("target_date").agg(F.avg(F.col("hit").cast("double")).alias("precision")) for x in (found.where("rank <= 5"), found)]
    return rounded(X.halves_hold(*daily), "first_margin", "second_margin")


