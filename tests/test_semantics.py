"""Boundaries, no lookahead, fixpoints, idempotence and learning, on small made inputs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barlake.functions import exprs as E
from barlake.operators import bars as B
from barlake.operators import calibration as C
from barlake.operators import exits as X
from barlake.operators import features as FE
from barlake.operators import health as H
from barlake.operators import ledger as L
from barlake.operators import ml as M
from barlake.operators import sessions as I
from barlake.sources import shared
from barlake.sources import tables as S
from barlake.sources import universe as V
from barlake.sources import writers as W

BARS = "symbol string, date date, open double, high double, low double, close double, volume long"
DAY = dt.date(2026, 1, 5)


def bar(symbol, k, o, h=None, low=None, c=None, v=1_000_000):
    c = o if c is None else c
    return (symbol, DAY + dt.timedelta(days=k), o, max(o, c) if h is None else h, min(o, c) if low is None else low, c, v)


def history(n=40, symbols=("A", "B", "C")):
    rng = random.Random(1)
    out = []
    for s in symbols:
        for k in range(n):
            c = 100 * (1 + rng.uniform(-0.03, 0.03))
            out.append(bar(s, k, 100.0, max(100.0, c) * 1.005, min(100.0, c) * 0.995, c, 1_000_000 + k * 1000))
    return out


UNIVERSE = "symbol string, name string, market_cap double, as_of date, sector string"


@pytest.fixture(scope="module")
def universe(spark):
    return spark.createDataFrame([(s, s, 1e9, DAY, "x") for s in "ABC"], UNIVERSE)


def test_event_boundaries(spark):
    rows = [bar("EDGE", 0, 100.0, 102.0), bar("ULP", 0, 5.0, 5.1), bar("ULP2", 0, 5.7, 5.7 * 1.02), bar("MEH", 0, 100.0, 101.99), bar("ZERO", 0, 0.0, 1.0), bar("NAN", 0, 100.0, float("nan")), bar("NAN2", 0, float("nan"), 103.0), bar("INF", 0, 100.0, float("inf")), ("NULL", DAY, 100.0, None, 99.0, 100.0, 1)]
    returns = B.daily_returns(spark.createDataFrame(rows, BARS))
    assert {r["symbol"] for r in returns.where(E.touch_event()).collect()} == {"EDGE", "ULP", "ULP2"}
    assert {r["symbol"] for r in returns.collect()} == {"EDGE", "ULP", "ULP2", "MEH"}


def test_glitch_needs_volume_norm_and_isolation(spark):
    calm = [bar("G", k, 100.0) for k in range(20)]
    spike = lambda s, v: [(s, d, o, h, lo, c, vol) for _, d, o, h, lo, c, vol in calm] + [bar(s, 20, 100.0, 130.0, 100.0, 100.5, v)]
    rows = spike("QUIET", 1_000) + spike("LOUD", 9_000_000) + [bar("NEW", 0, 100.0, 130.0, 100.0, 100.5, 1)]
    flagged = B.daily_returns(spark.createDataFrame(rows, BARS)).where("high_glitch_suspect").collect()
    assert [r["symbol"] for r in flagged] == ["QUIET"]


def test_features_dont_look_ahead(spark, universe):
    rows = history()
    at = DAY + dt.timedelta(days=30)
    changed = [r if r[1] <= at else (r[0], r[1], r[2], r[2] * 1.3, r[2] * 0.7, r[2] * 1.2, 5) for r in rows]
    frames = [FE.feature_frame(B.daily_returns(spark.createDataFrame(x, BARS)), universe) for x in (rows, changed)]
    before, after = ([tuple(r) for r in f.where(F.col("signal_date") <= at).select("symbol", "signal_date", *FE.FEATURES).orderBy("symbol", "signal_date").collect()] for f in frames)
    assert before == after and before
    labels = [f.where(F.col("signal_date") == at).select("symbol", "next_high_return").orderBy("symbol").collect() for f in frames]
    assert labels[0] != labels[1]


def test_newest_row_has_no_label(spark, universe):
    last = FE.feature_frame(B.daily_returns(spark.createDataFrame(history(), BARS)), universe).where("target_date IS NULL").collect()
    assert len(last) == 3 and all(r["did_2pct_next"] is None for r in last)


@pytest.mark.parametrize(("present", "complete"), [(27, True), (26, False)])
def test_completeness_boundary(spark, present, complete):
    rows = [bar(f"S{i}", k, 10.0) for k in range(24) for i in range(30)] + [bar(f"S{i}", 24, 10.0) for i in range(present)]
    last = B.coverage_days(spark.createDataFrame(rows, BARS)).orderBy(F.desc("date")).first()
    assert last["complete"] is complete


def test_next_complete_day_is_strictly_later(spark):
    days = [DAY + dt.timedelta(days=k) for k in range(6)]
    signals = spark.createDataFrame([(days[0],), (days[2],), (days[5],)], "signal_date date")
    complete = spark.createDataFrame([(days[2],), (days[4],)], "date date")
    assert sorted(tuple(r) for r in B.next_complete_day(signals, complete).collect()) == [(days[0], days[2]), (days[2], days[4])]


def test_repair_splits_reaches_a_fixpoint(spark):
    rows = [bar("A", 0, 100.0), bar("A", 1, 100.0), bar("A", 2, 10.0, 100.0, 10.0, 100.0), bar("A", 3, 250.0, 250.0, 50.0, 50.0), bar("A", 4, 99.0), bar("A", 5, 100.0, 180.0, 100.0, 180.0)]
    once = H.repair_splits(spark.createDataFrame(rows, BARS))
    twice = H.repair_splits(once)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert once.count() == 4 and B.with_split_flag(once).where("split_artifact").count() == 0


@pytest.mark.parametrize(
    ("rule", "ol", "oc", "filled", "seq", "fill", "want"),
    [
        ("hold_close", -0.05, 0.01, True, None, None, (0.01, 0.01)),
        ("limit_2pct", -0.05, 0.01, True, None, None, (0.02, 0.02)),
        ("limit_2pct", -0.05, 0.01, False, None, None, (0.01, 0.01)),
        ("limit_stop", -0.05, 0.01, True, None, None, (-0.01, 0.02)),
        ("limit_stop", -0.05, 0.01, True, 1, None, (0.02, 0.02)),
        ("limit_stop", -0.05, 0.01, True, 2, -0.015, (-0.015, -0.015)),
        ("limit_stop", -0.05, 0.01, True, 2, 0.005, (-0.01, -0.01)),
        ("limit_stop", (4.95 - 5.0) / 5.0, 0.01, False, None, None, (-0.01, -0.01)),
        ("limit_stop", -0.005, 0.003, False, None, None, (0.003, 0.003)),
    ],
)
def test_exit_rules(spark, rule, ol, oc, filled, seq, fill, want):
    row = spark.createDataFrame([(ol, oc, filled, seq, fill, None)], "ol double, oc double, filled boolean, seq int, fill double, trail double")
    assert tuple(row.select(E.exit_rule(rule).alias("r")).first()["r"]) == want


def session(spark, steps, day=DAY):
    """steps: (minute after 09:30, high, low)"""
    at = dt.datetime.combine(day, dt.time(9, 30))
    rows = [("A", at + dt.timedelta(minutes=m), day, 100.0, h, low, 100.0) for m, h, low in steps]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, date date, open double, high double, low double, close double")


@pytest.mark.parametrize(
    ("steps", "reason", "seq"),
    [
        ([(0, 100.5, 99.9), (5, 103.0, 100.0), (10, 101.0, 98.0)], "resolved", 1),
        ([(0, 100.5, 99.9), (5, 100.5, 98.0), (10, 103.0, 99.0)], "resolved", 2),
        ([(0, 103.0, 98.0), (5, 100.0, 100.0)], "same_bar", None),
        ([(0, 100.5, 99.9), (10, 103.0, 100.0), (15, 101.0, 98.0)], "gappy", None),
        ([(2, 100.5, 99.9), (5, 103.0, 100.0), (10, 101.0, 98.0)], "resolved", 1),
        ([(0, 100.5, 99.9), (5, 102.5, 100.0), (10, 101.0, 98.0)], "disagreed", None),
    ],
)
def test_trigger_order_gates(spark, steps, reason, seq):
    daily = B.daily_returns(spark.createDataFrame([bar("A", 0, 100.0, 103.0, 98.0, 101.0)], BARS))
    got = I.trigger_order(daily, daily, session(spark, steps), bar_minutes=5, open_minutes=570).first()
    assert (got["reason"], got["seq"]) == (reason, seq)


def test_no_session_is_no_intraday(spark):
    daily = B.daily_returns(spark.createDataFrame([bar("A", 0, 100.0, 103.0, 98.0, 101.0)], BARS))
    got = I.trigger_order(daily, daily, session(spark, [(0, 1.0, 1.0)]).limit(0), bar_minutes=5, open_minutes=570).first()
    assert got["reason"] == "no_intraday"


def test_trailing_exit_equals_a_loop(spark):
    rng = random.Random(3)
    days, bars, want = [], [], {}
    for k in range(12):
        day, price, rows = DAY + dt.timedelta(days=k), 100.0, []
        for slot in range(20):
            o = price
            price *= 1 + rng.uniform(-0.006, 0.006)
            rows.append((o, max(o, price) * 1.001, min(o, price) * 0.999, price))
            bars.append(("A", dt.datetime.combine(day, dt.time(9, 30)) + dt.timedelta(minutes=5 * slot), day, *rows[-1]))
        high = max(r[1] for r in rows)
        days.append(("A", day, rows[0][0], high, min(r[2] for r in rows), rows[-1][3], 1))
        top, out = rows[0][0], rows[-1][3]
        for i, (_, h, low, c) in enumerate(rows):
            top = max(top, h)
            if low <= top * 0.99:
                out = min(rows[i + 1][0] if i + 1 < len(rows) else c, top * 0.99)
                break
        want[day] = (out - rows[0][0]) / rows[0][0]
    frame = spark.createDataFrame(bars, "symbol string, ts timestamp, date date, open double, high double, low double, close double")
    got = {r["date"]: r["trail"] for r in I.trailing_exits(spark.createDataFrame(days, BARS), frame, bar_minutes=5, open_minutes=570).collect()}
    assert got == {d: pytest.approx(v) for d, v in want.items()}


def test_breakeven_leaves_growth_one(spark):
    rows = [(DAY + dt.timedelta(days=k), 1, 0.004 if k % 3 else -0.002) for k in range(30)]
    trades = spark.createDataFrame(rows, "target_date date, rank int, gross_return double")
    bps = X.paper_breakeven(trades, baskets=(1,)).first()["breakeven_bps"]
    growth = 1.0
    for _, _, r in rows:
        growth *= 1 + r - bps / 10_000
    assert bps > 0 and growth == pytest.approx(1.0, abs=1e-9)


def test_upsert_is_idempotent_and_leaves_other_partitions(spark):
    path = shared.fresh_path(spark, "t")
    old = spark.createDataFrame([("A", "d1", 1.0), ("B", "d1", 1.0), ("A", "d2", 1.0)], "symbol string, day string, v double")
    old.write.partitionBy("day").parquet(path)
    new = spark.createDataFrame([("A", "d1", 2.0), ("C", "d1", 3.0)], "symbol string, day string, v double")
    for _ in range(2):
        merged = W.upsert_table(spark, path, new, ["symbol", "day"], "day")
    assert sorted((r["symbol"], r["day"], r["v"]) for r in merged.collect()) == [("A", "d1", 2.0), ("A", "d2", 1.0), ("B", "d1", 1.0), ("C", "d1", 3.0)]


def test_record_experiment_refuses_unfit_rows(spark):
    a, b = shared.fresh_path(spark, "ledger"), shared.fresh_path(spark, "daily")
    schema = "seq long, target_date date, rank int, ret double, hit int, oh double, ol double"
    row = spark.createDataFrame([(1, "s")], "id long, strategy string")
    good = spark.createDataFrame([(1, DAY, 1, 0.01, 1, 0.02, -0.01), (1, DAY, 2, 0.0, 0, None, None)], schema)
    W.record_experiment(spark, a, b, row, good)
    for bad in ((1, DAY, 1, float("nan"), 1, 0.1, 0.1), (1, DAY, 1, 0.1, None, 0.1, 0.1), (1, DAY, 1, 0.1, 1, None, 0.1)):
        with pytest.raises(ValueError):
            W.record_experiment(spark, a, b, row, spark.createDataFrame([bad], schema))
    assert spark.read.parquet(a).count() == 1 and spark.read.parquet(b).count() == 2


def test_universe_rules(spark):
    rows = [("AAPL", "Apple Inc. Common Stock", "3,000.5"), ("AAPL", "Apple", "1"), ("X^A", "X", "9"), ("Y~", "Y", "9"), ("W", "W Corp Warrants", "9"), ("E", "Some ETF", "9"), ("N", "Notewell Inc", "7"), ("Z", "Z", ""), ("Q", "Q", "0"), ("B", "B", "oops")]
    got = [tuple(r) for r in V.build_universe(spark.createDataFrame(rows, "symbol string, name string, market_cap string"), 5).collect()]
    assert got == [("AAPL", "Apple Inc. Common Stock", 3000.5, ""), ("N", "Notewell Inc", 7.0, "")]


def test_canonical_params(spark):
    rows = spark.createDataFrame([('{"b": 200, "a": 1.5}',), ('{"a": 1.5, "b": 200.0}',), ("{oops",), ("{}",)], "p string")
    got = [r[0] for r in rows.select(E.canonical_params("p")).collect()]
    assert got[0] == got[1] == '{"a": 1.5, "b": 200}' and got[2] is None and got[3] == "{}"


def test_bands_grow_with_the_family():
    bands = [L.promotion_band(n) for n in (1, 10, 100, 10_000)]
    assert bands == sorted(bands) and bands[0] == 0.27 and L.family_correction(1) == 1.0 and L.family_correction(4) == pytest.approx(1.27, abs=0.01)
    assert L.MAX_FAMILY == 64


def test_registry_refuses_unknowns():
    with pytest.raises(ValueError):
        M.strategy("nonesuch")
    with pytest.raises(ValueError):
        M.strategy("gbt", nonesuch=1)
    with pytest.raises(ValueError):
        M.register("gbt", M.gbt)


@pytest.mark.parametrize("name", ["gbt", "logreg", "stochastic_gbt"])
def test_strategies_learn_a_planted_signal(spark, name):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        x = rng.random()
        rows.append((f"S{i % 30}", DAY + dt.timedelta(days=i // 30), DAY + dt.timedelta(days=i // 30 + 1), int(x + rng.uniform(-0.2, 0.2) > 0.5), 1e6, *(x if c == "close_pos" else (None if c == "sector_breadth" else rng.random()) for c in FE.FEATURES)))
    schema = "symbol string, signal_date date, target_date date, did_2pct_next int, median_vol_20 double, " + ", ".join(f"{c} double" for c in FE.FEATURES)
    frame = spark.createDataFrame(rows, schema)
    params = {"gbt": {"max_iter": 5}, "stochastic_gbt": {"n_estimators": 5}}.get(name, {})
    cut = DAY + dt.timedelta(days=22)
    fitted = M.strategy(name, **params).fit(frame.where(F.col("target_date") < cut))
    assert "sector_breadth" not in fitted.used
    scored = fitted.score(frame.where(F.col("target_date") >= cut))
    good = scored.agg(F.avg(F.when(F.col("prob") > 0.5, F.col("did_2pct_next"))), F.avg(F.when(F.col("prob") <= 0.5, F.col("did_2pct_next")))).first()
    assert good[0] > 0.8 and good[1] < 0.25


def test_folds_train_on_earlier_targets_only(spark):
    rows = [("A", dt.date(2026, m, 10), dt.date(2026, m, 11), 1) for m in (1, 2, 3, 4)]
    frame = spark.createDataFrame(rows, "symbol string, signal_date date, target_date date, did_2pct_next int")
    got = [tuple(r) for r in M.walk_forward_split(frame, 2, 3).orderBy("month_start").collect()]
    assert got == [(dt.date(2026, 3, 1), dt.date(2026, 3, 31), 2, 1, False), (dt.date(2026, 4, 1), dt.date(2026, 4, 30), 3, 1, True)]


def test_listing_rules_keep_companies_and_drop_listings(spark):
    kept = ["Preferred Bank Common Stock", "Unit Corporation", "First Note Bancorp", "Wright Medical Group N.V.", "BrightSphere Investment Group", "MidCap Funding Corp", None]
    dropped = ["Foo Inc Depositary Shares", "Foo 5.5% Senior 2030", "Acme Acquisition Corp Units, each consisting of one share", "Acme Units", "Bar Capital Rights", "Baz Global Fund", "Foo Preferred Stock", "Foo Notes due 2031", "Foo ETFs", "X Warrants"]
    rows = spark.createDataFrame([(f"S{i} ", n, "2,000.5", None) for i, n in enumerate(kept + dropped)] + [("S0", "Copy", "1", "x"), ("A^B", "x", "1", "x"), ("NIL", "x", "n/a", "x")], "symbol string, name string, market_cap string, sector string")
    got = V.build_universe(rows, 100).collect()
    assert {(r["symbol"], r["name"]) for r in got} == {(f"S{i}", n) for i, n in enumerate(kept)}
    assert all(r["market_cap"] == 2000.5 and r["sector"] == "" for r in got)
    assert V.build_universe(rows.limit(0).drop("sector"), 5).count() == 0


def test_auc_of_scores_that_differ_by_little(spark):
    split = spark.createDataFrame([(0.5 + i * 1e-9, int(i >= 1000)) for i in range(2000)], "prob double, label int")
    assert C.auc(split).first()["auc"] == 1.0
    rng = random.Random(8)
    rows = [(rng.choice([0.1, 0.2, 0.2 + 1e-12, 0.7]), rng.randrange(2)) for _ in range(300)]
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(C.auc(spark.createDataFrame([*rows, (None, 1), (0.3, None)], "prob double, label int")).first()["auc"] - want) < 1e-12
    assert C.auc(split.where("label = 1")).first()["auc"] is None and C.auc(split.limit(0)).first()["auc"] is None


def test_report_in_one_pass_counts_what_each_check_finds(spark):
    rng = random.Random(3)
    rows = []
    for s in "ABCDEF":
        for k in range(45):
            if rng.random() < 0.1 or (s == "F" and k > 40):
                continue
            o = 100.0 * rng.choice([1, 1, 1, 1.4])
            c = o * rng.choice([1, 1.01, 0.99, 2.0])
            h = max(o, c) * rng.choice([1, 1.3]) if rng.random() > 0.05 else o * 0.5
            rows.append(bar(s, k, o if rng.random() > 0.04 else float("nan"), h, min(o, c), c, rng.choice([0, 0, 0, None, 1000, 10])))
    bars = spark.createDataFrame(rows, BARS)
    universe = spark.createDataFrame([(s,) for s in "ABXY"], "symbol string")
    meta = spark.createDataFrame([("A",), ("B",)], "symbol string")
    got = {r["check"]: r for r in H.doctor_report(bars, universe, meta, bars.limit(3)).collect()}
    each = {"gaps": H.gap_counts, "stale": H.stale_symbols, "extreme": H.extreme_bars, "zero_volume": H.zero_volume_runs, "invalid": H.invalid_bars, "glitch": H.glitch_bars, "incomplete_days": H.incomplete_days}
    assert {c: got[c]["n_problems"] for c in each} == {c: f(bars).count() for c, f in each.items()}
    assert got["glitch"]["n_problems"] > 0 and got["zero_volume"]["n_problems"] > 0
    assert (got["unpriced"]["n_problems"], got["no_meta"]["n_problems"], got["sessions"]["n_problems"]) == (2, 4, 3)
    assert got["gaps"]["problem_count"] == sum(r["n_problems"] for r in got.values() if r["counted"]) and not got["gaps"]["ok"]
    calm = spark.createDataFrame([bar("A", k, 100.0, 101.0, 99.0, 100.5) for k in range(5)], BARS)
    assert all(r["ok"] for r in H.doctor_report(calm, meta.limit(1), meta).collect())
    assert all(r["ok"] for r in H.doctor_report(calm.limit(0), meta.limit(0), meta).collect())


def test_recheck_fails_on_recent_corruption_only(spark):
    old = [bar("A", k, 100.0) for k in range(20)] + [bar("B", 2, 100.0, c=190.0), bar("Z", 1, 100.0)]
    base = spark.createDataFrame(old, BARS)
    add = lambda *rows: H.recheck_verdict(H.doctor_diff(base, spark.createDataFrame([*old, *rows], BARS))).first()
    assert add()["verdict"] == "ok"
    assert tuple(add(bar("B", 3, 100.0, c=190.0))) == ("warn", 0, 1)
    assert tuple(add(bar("B", 17, 100.0, c=190.0), bar("B", 3, 100.0, c=190.0))) == ("fail", 1, 1)
    assert add(bar("Z", 2, 100.0, 90.0))["verdict"] == "fail"
    assert add(*(bar("Z", k, 100.0, v=0) for k in (5, 6, 7)))["verdict"] == "warn"


def test_wide_batches_become_rows_and_seeds_come_strictly_before(spark):
    rows = [bar("A", 5, 300.0, c=100.0), bar("A", 6, 100.0), bar("B", 5, 300.0, c=100.0), bar("C", 5, 100.0, 50.0)]
    wide = S.wide_bars(spark.createDataFrame(rows, BARS), ["A", "B", "C", "D"])
    back = S.long_bars(wide, ["A", "B", "C", "D"])
    assert sorted(back.collect()) == sorted(spark.createDataFrame(rows, BARS).collect())
    seeds = spark.createDataFrame([("A", DAY + dt.timedelta(days=4), 100.0), ("B", DAY + dt.timedelta(days=5), 100.0)], "symbol string, seed_date date, seed_close double")
    got = {(r["symbol"], (r["date"] - DAY).days): r["reason"] for r in S.bar_reasons(back, seeds).collect()}
    assert got == {("A", 5): "split_artifact", ("A", 6): None, ("B", 5): None, ("C", 5): "invalid"}


def test_queue_file_counts_malformed_entries(spark, tmp_path):
    path = tmp_path / "queue.json"
    path.write_text('[{"strategy": "a", "params": {"x": [1, {"y": null}]}, "note": "n"}, {"strategy": "b"}, {"strategy": ""}, {"strategy": 3}, {"params": {}}, {"strategy": "c", "params": [1]}, "text", 7]')
    entries, malformed = L.load_queue(spark, str(path))
    assert [tuple(r) for r in entries.orderBy("place").collect()] == [("a", '{"x":[1,{"y":null}]}', "n", 0), ("b", "{}", "", 1)] and malformed == 6
    path.write_text('{"strategy": "a"}')
    entries, malformed = L.load_queue(spark, str(path))
    assert entries.count() == 0


def test_upsert_of_repeated_new_keys_is_the_same_in_any_order(spark):
    old = spark.createDataFrame([("A", 1, 1.0)], "symbol string, day int, v double")
    new = [("A", 1, 2.0), ("A", 1, 5.0), ("A", 1, None), ("B", 1, 3.0)]
    for rows in (new, new[::-1]):
        got = W.upsert_by_key(old, spark.createDataFrame(rows, old.schema), ["symbol", "day"]).collect()
        assert sorted(map(tuple, got)) == [("A", 1, 5.0), ("B", 1, 3.0)]


def test_halves_per_challenger(spark):
    days = [(i, DAY + dt.timedelta(days=k), p) for i, ps in {1: [1.0] * 5, 2: [1.0, 1.0, 0.0, 0.0, 0.0], 3: [1.0] * 3}.items() for k, p in enumerate(ps)]
    champion = [(DAY + dt.timedelta(days=k), 0.5) for k in range(5)]
    got = X.halves_by(spark.createDataFrame(days, "id int, target_date date, precision double"), spark.createDataFrame(champion, "target_date date, precision double"))
    assert {r["id"]: r["holds"] for r in got.collect()} == {1: True, 2: False, 3: False}


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("X", (), {"master": "spark://host:7077", "applicationId": "a"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Elsewhere)
