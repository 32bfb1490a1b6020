"""Operators against small cases worked by hand, and against straightforward loops."""

import math
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import distributions as dist
from tessella.functions import scalars as S
from tessella.functions.ordering import Series
from tessella.operators import barriers as T
from tessella.operators import bars as B
from tessella.operators import calendar as C
from tessella.operators import ewm as E
from tessella.operators import garch as G
from tessella.operators import joins as J
from tessella.operators import patterns as N
from tessella.operators import performance as P
from tessella.operators import research as Q
from tessella.operators import risk as K
from tessella.operators import rolling as R

BAR = Series(("symbol",), ("i",))


def bars(spark, high, low, close, open_=None, volume=None):
    n = len(close)
    rows = [("x", i, float((open_ or close)[i]), float(high[i]), float(low[i]), float(close[i]), float((volume or [1] * n)[i])) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, i long, open double, high double, low double, close double, volume double")


def entry(spark, bar=0, side=1.0, price=100.0, stop=95.0):
    return spark.createDataFrame([("x", bar, side, price, stop)], "symbol string, bar long, side double, entry double, stop double")


def walk(b, e, **options):
    return T.walk_explicit(b, e, BAR, cost_bp=0.0, **options).collect()


def test_explicit_walk_reaches_target(spark):
    [t] = walk(bars(spark, [100, 100, 120], [100, 99, 99], [100, 100, 120]), entry(spark), rr=2)
    assert (t.outcome, t.net_R, t.bars_held) == ("target", 2.0, 2)


def test_both_barriers_in_one_bar_is_a_stop(spark):
    [t] = walk(bars(spark, [100, 120], [100, 90], [100, 100]), entry(spark), rr=2)
    assert (t.outcome, t.ambiguous, t.net_R) == ("stop", True, -1.0)


def test_breakeven_arms_at_the_close(spark):
    b = bars(spark, [100, 102, 101], [100, 101, 90], [100, 102, 91])
    [t] = walk(b, entry(spark), rr=5, breakeven_frac=0.01)
    assert (t.outcome, t.net_R, t.be_armed) == ("breakeven", 0.0, True)
    [t] = walk(b, entry(spark), rr=5)
    assert (t.outcome, t.net_R) == ("stop", -1.0)
    [t] = walk(bars(spark, [100, 102, 100], [100, 99.5, 90], [100, 100.2, 91]), entry(spark), rr=5, breakeven_frac=0.01)
    assert (t.outcome, t.be_armed, t.net_R) == ("stop", False, -1.0)


def test_breakeven_costs_winners(spark):
    b = bars(spark, [100, 102, 100.5, 120], [100, 101, 99, 100], [100, 102, 99.5, 120])
    assert walk(b, entry(spark), rr=2, breakeven_frac=0.01)[0].outcome == "breakeven"
    assert walk(b, entry(spark), rr=2)[0].net_R == 2.0


def test_time_exit_and_mirror(spark):
    [t] = walk(bars(spark, [100] * 9, [100] * 9, [100] * 9), entry(spark), rr=2, max_bars=3)
    assert (t.outcome, t.bars_held, t.net_R) == ("time", 3, 0.0)
    [t] = walk(bars(spark, [100, 100, 101], [100, 89, 80], [100, 90, 80]), entry(spark, side=-1.0, stop=105.0), rr=2)
    assert (t.outcome, t.net_R) == ("target", 2.0)


def test_overlapping_entries_are_dropped_and_later_ones_taken(spark):
    up = [100 + k for k in range(12)]
    e = spark.createDataFrame([("x", k, 1.0, float(up[k]), up[k] - 3.0) for k in (0, 1, 2, 6)], "symbol string, bar long, side double, entry double, stop double")
    b = bars(spark, up, up, up)
    assert sorted(t.bar for t in walk(b, e, rr=1)) == [0, 6]
    assert len(walk(b, e, rr=1, allow_overlap=True)) == 4
    assert walk(b, entry(spark, stop=100.0), rr=1) == []


def test_tied_entries_take_one(spark):
    """Of entries that start on one bar one is taken, whatever their sides and ends; the others run into it."""
    rows = [("x", 1, 5, 1.0), ("x", 1, 5, -1.0), ("x", 1, 7, 1.0), ("x", 4, 9, 1.0), ("x", 5, 6, 1.0), ("x", 5, 6, 1.0), ("y", 1, 5, 1.0)]
    d = spark.createDataFrame(rows, "symbol string, bar long, next_free long, side double")
    got = [(r.symbol, r.bar, r.next_free) for r in T.greedy(d, ("symbol",), 6).orderBy("symbol", "bar").collect()]
    assert got == [("x", 1, 5), ("x", 5, 6), ("y", 1, 5)]
    assert T.greedy(d.limit(0), ("symbol",), 6).columns == d.columns


def test_folds_refuse_empty_spans():
    for months in ((0, 6, None), (18, 0, None), (18, 6, 0), (18, -1, 6), (18, 6, -2)):
        with pytest.raises(ValueError, match="at least 1"):
            C.make_folds(date(2021, 1, 1), date(2026, 1, 1), *months)
    assert [f["test_start"] for f in C.make_folds(date(2021, 1, 1), date(2023, 1, 1), 12, 6, 3)] == [date(2022, 1, 1), date(2022, 4, 1), date(2022, 7, 1)]


def test_greedy_keeps_keys_apart(spark):
    rows = [(k, b, b + 3) for k in ("a", "b") for b in range(10)]
    d = spark.createDataFrame(rows, "symbol string, bar long, next_free long")
    got = T.greedy(d, ("symbol",), 6).groupBy("symbol").agg(F.sort_array(F.collect_list("bar")).alias("b")).collect()
    assert {r.symbol: list(r.b) for r in got} == {"a": [0, 3, 6, 9], "b": [0, 3, 6, 9]}


def test_barrier_summary_counts_barrier_wins_alone(spark):
    rows = [("x", o, r, 0.0, False, 1) for o, r in (("target", 1.0), ("stop", -1.0), ("time", 0.01), ("time", 0.01))]
    t = spark.createDataFrame(rows, "symbol string, outcome string, net_R double, cost_R double, ambiguous boolean, bars_held int")
    [s] = T.barrier_summary(t, ("symbol",), 1.0).collect()
    assert (s.win_rate, s.barrier_win_rate, s.time_share) == (0.75, 0.5, 0.5)


def one(spark, c):
    return spark.range(1).select(c.alias("v")).head().v


def test_scalars(spark):
    assert one(spark, S.breakeven_win_rate(0.04, 2.0)) == pytest.approx(1.04 / 3)
    assert one(spark, S.breakeven_win_rate(0.073, 1.0)) == pytest.approx(0.5365)
    assert one(spark, S.touch_probability(F.lit(100.0), F.lit(110.0), F.lit(100 / 1.1))) == pytest.approx(0.5)
    assert one(spark, S.touch_probability(F.lit(1.0), F.exp(F.lit(0.2)), F.exp(F.lit(-0.1)))) == pytest.approx(1 / 3)
    assert one(spark, S.touch_probability(F.lit(1.0), F.lit(1.0), F.lit(0.9))) is None
    assert S.effective_observations(0.94) == pytest.approx(16.67, abs=0.01)
    with pytest.raises(ValueError):
        S.effective_observations(1.0)
    for b, zone, m in ((4, "green", 3.0), (6, "amber", 3.5), (12, "red", 4.0)):
        z, k = S.basel_zone(F.lit(b), F.lit(250), 0.99)
        assert (one(spark, z), one(spark, k)) == (zone, m)
    assert one(spark, S.basel_zone(F.lit(4), F.lit(250), 0.95)[0]) == "n/a"


def test_drift_raises_and_inverts():
    p = [S.touch_probability_value(0.02, 0.02, d, 0.01) for d in (-0.01, 1e-9, 0.01)]
    assert p[0] < p[1] < p[2]
    for d in (-0.002, 0.003):
        assert S.implied_drift(0.02, 0.03, S.touch_probability_value(0.02, 0.03, d, 0.01), 0.01) == pytest.approx(d, abs=1e-6)
    assert math.isnan(S.implied_drift(0.02, 0.03, 1.0, 0.01))


def test_distributions():
    assert dist.norm_ppf(0.01) == pytest.approx(-2.3263478740408408)
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.228138852, abs=1e-6)
    assert dist.t_ppf(0.01, 5) == pytest.approx(-3.364929999, abs=1e-6)
    assert dist.t_two_sided(2.0, 30) == pytest.approx(0.0546, abs=1e-4)
    assert dist.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-6)
    assert dist.chi2_sf(5.991464547, 2) == pytest.approx(0.05, abs=1e-6)


def test_kupiec(spark):
    stat = lambda x: one(spark, K.kupiec(F.lit(1000), F.lit(x), 0.99))
    assert stat(10) == pytest.approx(0, abs=1e-9) and stat(50) > 6.63 and stat(0) == pytest.approx(-2000 * math.log(0.99))
    assert one(spark, K.chi2_sf1(F.lit(3.841458821))) == pytest.approx(0.05, abs=1e-6)


def test_tick_bars(spark):
    start = datetime(2026, 1, 5)
    rows = [("x", start + timedelta(seconds=10 * k), k, 1.10 + 0.01 * k / 599, 1.1001 + 0.01 * k / 599) for k in range(600)]
    t = spark.createDataFrame(rows, "symbol string, ts timestamp, tick_id long, bid double, ask double")
    b = B.ticks_to_bars(B.mid_and_spread(t), "1 minute").collect()
    assert len(b) == 100 and {x.volume for x in b} == {6} and all(x.low <= x.open <= x.close <= x.high for x in b)


def test_sessions_follow_new_york(spark):
    stamps = ["2026-01-05 21:45:00", "2026-01-05 22:15:00", "2026-01-06 04:45:00", "2026-01-06 07:00:00", "2026-01-06 14:30:00", "2026-03-08 20:30:00", "2026-03-08 23:00:00"]
    d = spark.createDataFrame([(s,) for s in stamps], "s string").select(F.to_timestamp("s").alias("ts"))
    got = [str(r.e) for r in d.select(B.session_end_date("ts").alias("e")).collect()]
    assert got == ["2026-01-05", "2026-01-06", "2026-01-06", "2026-01-06", "2026-01-06", "2026-03-08", "2026-03-09"]


def test_vwaps(spark):
    b = bars(spark, [100, 200], [100, 200], [100, 200], volume=[1, 3]).withColumn("session", F.lit(1))
    assert [r.vwap for r in R.session_vwap(b, BAR).orderBy("i").collect()] == [100, 175]
    b = bars(spark, [10, 20], [10, 20], [10, 20], volume=[1, 99])
    assert [r.vwap for r in R.rolling_vwap(b, BAR, 2).orderBy("i").collect()] == [None, pytest.approx(19.9)]
    dead = bars(spark, [10, 20], [10, 20], [10, 20], volume=[0, 0])
    with pytest.raises(ValueError):
        R.require_volume(dead)
    assert [r.kind for r in R.rolling_vwap_or_twap(dead, BAR, 2).collect()] == ["twap", "twap"]


def test_ewm_matches_pandas_over_many_blocks_and_nulls(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=5000)
    x[:3] = np.nan
    x[rng.random(5000) < 0.05] = np.nan
    d = spark.createDataFrame([("x", i, None if math.isnan(v) else float(v)) for i, v in enumerate(x)], "symbol string, i long, v double")
    for alpha in (0.06, 0.5, 0.9999):
        got = np.array([np.nan if r.y is None else r.y for r in E.ewm_mean(d, BAR, "v", alpha, "y").orderBy("i").collect()], dtype=float)
        want = pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()
        np.testing.assert_allclose(got, want, rtol=1e-9)


def test_ewma_variance_holds_on_null(spark):
    rng = np.random.default_rng(2)
    r = rng.normal(0, 0.01, 200)
    r[77] = np.nan
    d = spark.createDataFrame([("x", i, None if math.isnan(v) else float(v)) for i, v in enumerate(r)], "symbol string, i long, ret double")
    got = [x.variance for x in E.ewma_variance(d, BAR, "ret").orderBy("i").collect()]
    s, want = float(np.var(r[:30], ddof=1)), []
    for t in range(200):
        want.append(s if t >= 30 else None)
        if t >= 30 and not math.isnan(r[t]):
            s = 0.94 * s + 0.06 * r[t] ** 2
    assert got[:30] == [None] * 30
    np.testing.assert_allclose(got[30:], want[30:], rtol=1e-10)


def test_causality_of_windows(spark):
    rng = np.random.default_rng(3)
    c = list(100 + np.cumsum(rng.normal(size=120)))
    full = bars(spark, [x + 1 for x in c], [x - 1 for x in c], c)
    short = full.filter("i < 80")
    for op in (lambda b: E.atr(b, BAR), lambda b: N.sweeps(b, BAR, 10), lambda b: N.swings(b, BAR), lambda b: R.prior_extremes(b, BAR, 5)):
        a = {r.i: r for r in op(full).filter("i < 80").collect()}
        for r in op(short).collect():
            for x, y in zip(a[r.i], r, strict=True):
                assert x == y or (isinstance(x, float) and x == pytest.approx(y, rel=1e-9))


def test_swings_gaps_and_sweeps(spark):
    low = [100.0 + 0.01 * (k % 3) for k in range(40)]
    low[20] = 95
    b = bars(spark, [101.0 + 0.01 * (k % 5) for k in range(40)], low, [100.5 + 0.001 * k for k in range(40)])
    s = {r.i: r.swing_low for r in N.swings(b, BAR, 2).collect()}
    assert s[20] != 95 and s[21] != 95 and s[22] == 95
    h, lo, c = [100.0 + 0.2 * (k % 2) for k in range(30)], [99.0 + 0.2 * (k % 2) for k in range(30)], [99.5 + 0.2 * (k % 2) for k in range(30)]
    h[20:], lo[20:], c[20:] = [104.0] * 10, [100.0] * 10, [103.5] * 10
    lo[21:], h[21:], c[21:] = [103.0] * 9, [105.0] * 9, [104.0] * 9
    g = [r for r in N.fair_value_gaps(bars(spark, h, lo, c), BAR).collect() if r.known_bar == 21]
    assert [(r.formed_bar, r.side) for r in g] == [(20, 1.0)]


def test_scan_patterns_match_loops(spark):
    rng = np.random.default_rng(5)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 600)))
    h, lo = c * (1 + np.abs(rng.normal(0, 0.006, 600))), c * (1 - np.abs(rng.normal(0, 0.006, 600)))
    b = bars(spark, list(h), list(lo), list(c))
    ret = pd.Series(np.log(c)).diff()
    sig = np.sqrt(ret.pow(2).ewm(alpha=0.06, adjust=False).mean()).shift(1).to_numpy()
    n, want, i = 600, [], 21
    while i < n - 1:  # the rule as its definition reads, one bar at a time
        if np.isfinite(sig[i]) and sig[i] > 0:
            for side in (1, -1):
                edge = lo if side > 0 else h
                past = side * edge[i - 20 : i]
                level, age = past.min() * side, 20 - int(np.argmin(past))
                if side * edge[i] < side * level and age >= 4:
                    for j in range(i, min(i + 4, n - 1)):
                        if side * c[j] > side * level:
                            want.append((i, j, float(side)))
                            i = j
                            break
        i += 1
    got = [(r.start, r.bar, r.side) for r in N.turtle_soup_entries(b, BAR).orderBy("start", "bar", F.col("side").desc()).collect()]
    assert len(want) > 5 and got == sorted(want, key=lambda x: (x[0], x[1], -x[2]))
    assert N.inducement_entries(b, BAR).count() > 5


def test_breakout_retrace_setup(spark):
    quiet = 25
    h, lo, c = [100.0, 99.9] * 12 + [100.0], [99.9] * quiet, [100.0, 99.9] * 12 + [100.0]
    h, lo, c = h + [103, 103, 103.6, 103.6], lo + [99.9, 101, 101.2, 103], c + [103, 101.2, 103.5, 103.4]
    b = bars(spark, h, lo, c).withColumn("session", F.lit(1))
    [s] = N.breakout_retrace(b, BAR).filter("side > 0").collect()
    assert (s.entry, s.breakout_bar, s.bar) == (103.5, 25, 27)
    lo[26] = 98.5
    assert N.breakout_retrace(bars(spark, h, lo, c).withColumn("session", F.lit(1)), BAR).filter("side > 0").count() == 0


def test_asof_is_backward_and_known_at_close(spark):
    day = datetime(2026, 1, 5)
    hi = spark.createDataFrame([("x", day + timedelta(hours=9 + k), float(k + 1)) for k in range(3)], "symbol string, ts timestamp, v double")
    at = [(10, 5), (10, 55), (11, 0), (11, 5)]
    lo = spark.createDataFrame([("x", day + timedelta(hours=a, minutes=b)) for a, b in at], "symbol string, ts timestamp")
    got = [r.v for r in J.align_to(lo, hi, Series(("symbol",), ("ts",)), ["v"]).orderBy("ts").collect()]
    assert got == [1.0, 1.0, 2.0, 2.0]


def test_strict_forward_asof(spark):
    left = spark.createDataFrame([("x", 1), ("x", 2), ("x", 9)], "symbol string, t long")
    right = spark.createDataFrame([("x", 2, 20), ("x", 5, 50)], "symbol string, t long, v long")
    got = lambda strict: [r.v for r in J.asof(left, right, ("symbol",), "t", ["v"], "forward", strict).orderBy("t").collect()]
    assert got(False) == [20, 20, None] and got(True) == [20, 50, None]


def test_calendar_flags(spark):
    days = [date(2021, 1, 1) + timedelta(days=k) for k in range(120)]
    d = spark.createDataFrame([(x,) for x in days if x.weekday() < 5], "date date")
    f = {str(r.date): r for r in C.flags(d).collect()}
    assert f["2021-01-01"].nfp and f["2021-01-15"].opex and f["2021-03-31"].quarter_end and f["2021-03-31"].month_end
    assert f["2021-04-30"].month_end and not f["2021-04-30"].quarter_end


def test_folds():
    folds = C.make_folds(date(2021, 9, 1), date(2026, 9, 1), 18, 6)
    assert len(folds) == 7 and all(a["test_end"] == b["test_start"] for a, b in zip(folds, folds[1:], strict=False))
    assert C.add_months(date(2024, 1, 31), 1) == date(2024, 2, 29)


def test_forward_return_and_grid(spark):
    b = bars(spark, [100, 100, 101], [100, 100, 101], [100, 100, 101])
    e = spark.createDataFrame([("x", 0, 1.0)], "symbol string, i long, side double")
    [r] = Q.signed_forward(b, e, BAR, (2, 9)).collect()
    assert r.fwd_2 == pytest.approx(math.log(1.01) * 1e4) and r.fwd_9 is None
    with pytest.raises(ValueError):
        Q.signed_forward(b, spark.createDataFrame([("x", 7, 1.0)], "symbol string, i long, side double"), BAR)


def test_holm_stops_at_the_first_failure(spark):
    d = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "name string, p double")
    assert {r.name: r.reject for r in Q.holm(d).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_selection_tie_goes_to_the_first_name(spark):
    rows = [(c, datetime(2021, 9, 2) + timedelta(hours=12 * k), 1.0 if k % 2 else -0.5) for c in ("b", "a") for k in range(100)]
    t = spark.createDataFrame(rows, "config string, entry_time timestamp, unit_net_R double")
    folds = C.folds_frame(spark, C.make_folds(date(2021, 9, 1), date(2023, 9, 1), 18, 6))
    assert [r.config for r in Q.select_configs(t, folds).collect()] == ["a"]


def test_drawdowns_with_and_without_floor(spark):
    d = spark.createDataFrame([("x", i, r) for i, r in enumerate([-0.1, 0.05, -0.02])], "symbol string, i long, ret double")
    low = lambda floor: P.drawdowns(d, BAR, "ret", floor).agg(F.min("drawdown")).head()[0]
    assert low(True) == pytest.approx(-0.1) and low(False) == pytest.approx(-0.02)
    [e] = P.drawdown_episodes(d, BAR, "ret").collect()
    assert (e.start, e.trough, e.duration_days) == (0, 0, 3)


def test_strategy_returns_charge_the_first_turn(spark):
    on = "symbol string, i long, "
    sig = spark.createDataFrame([("x", 0, 1.0), ("x", 1, 1.0), ("x", 2, -1.0)], on + "position double")
    ret = spark.createDataFrame([("x", 0, 0.01), ("x", 1, 0.02), ("x", 2, 0.03)], on + "ret double")
    got = [(r.turnover, round(r.net, 6)) for r in P.strategy_returns(sig, ret, BAR, cost_per_turn=0.001).orderBy("i").collect()]
    assert got == [(1.0, 0.009), (0.0, 0.02), (2.0, -0.032)]


def test_garch_recovers_parameters(spark):
    rng = np.random.default_rng(7)
    s, r = 1e-4, []
    for _ in range(2500):
        r.append(math.sqrt(s) * rng.normal())
        s = 2e-6 + 0.08 * r[-1] ** 2 + 0.90 * s
    f = G.fit(np.array(r), student=False)
    assert f["alpha"] == pytest.approx(0.08, abs=0.03) and f["beta"] == pytest.approx(0.90, abs=0.05) and f["alpha"] + f["beta"] < 1
    d = spark.createDataFrame([("x", i, float(x)) for i, x in enumerate(r)], "symbol string, i long, ret double")
    fits = spark.createDataFrame([("x", f["omega"], f["alpha"], f["beta"], 0.0)], "symbol string, omega double, alpha double, beta double, mu double")
    got = [x.variance for x in G.filter_garch(d, fits, BAR, "ret").orderBy("i").collect()]
    want = G.variances(np.array(r) ** 2, f["omega"], f["alpha"], f["beta"], float(np.var(r, ddof=1)))[:-1]
    np.testing.assert_allclose(got, want, rtol=1e-8)


def test_null_paths_are_fair_and_repeat(spark):
    a, b = (G.null_paths(spark, [3], 500).orderBy("bar").collect() for _ in range(2))
    assert a == b and all(x.low <= min(x.open, x.close) and x.high >= max(x.open, x.close) for x in a)


def test_empty_inputs(spark):
    e = bars(spark, [], [], [])
    assert E.ema(e, BAR, "close", 5).count() == 0 and N.order_blocks(e, BAR).count() == 0 and P.performance_summary(B.log_returns(e, BAR), BAR, "ret").count() == 0


def test_scenario_coverage_and_multiple(spark):
    from tessella.operators import stress as X

    days = [date(2020, 1, 1) + timedelta(days=k) for k in range(5)]
    rows = [(d, a, -0.05) for d in days for a in ("a", "b")]
    panel = spark.createDataFrame(rows, "date date, asset string, ret double")
    w = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "asset string, weight double")
    s = spark.createDataFrame([("k", days[0], days[-1])], "key string, start date, end date")
    [r] = X.replay(panel, w, s).collect()
    assert r.coverage == pytest.approx(0.8) and r.missing == "c" and r.worst_day == pytest.approx(-0.05)
    [m] = X.stress_vs_var(X.replay(panel, w, s), 0.02).collect()
    assert m.multiple == pytest.approx(2.5) and m.breach
    [r] = X.replay(panel, w, s, rescale_missing=False).collect()
    assert r.worst_day == pytest.approx(-0.04)


def test_components_add_up(spark):
    cov = spark.createDataFrame([("a", "a", 4e-4), ("a", "b", 1e-4), ("b", "b", 9e-4)], "asset_i string, asset_j string, value double")
    w = spark.createDataFrame([("a", 0.6), ("b", 0.4)], "asset string, weight double")
    [p] = K.portfolio_var(cov, w).collect()
    parts = K.component_var(cov, w).collect()
    assert sum(x.component_var for x in parts) == pytest.approx(p["var"]) and sum(x.pct for x in parts) == pytest.approx(1)
    rho = {(r.asset_i, r.asset_j): r.value for r in J.correlation_of(cov).collect()}
    assert rho[("a", "a")] == 1 and rho[("a", "b")] == pytest.approx(1 / 6)
    bad = spark.createDataFrame([("a", "a", 1e-4), ("a", "b", -9e-4), ("b", "b", 1e-4)], "asset_i string, asset_j string, value double")
    with pytest.raises(Exception, match="negative portfolio variance"):
        K.portfolio_var(bad, w).collect()


def test_mann_whitney_by_hand(spark):
    d = spark.createDataFrame([(True, 1.0), (True, 2.0), (False, 2.0), (False, 3.0), (False, 4.0)], "g boolean, v double")
    [r] = Q.mann_whitney(d, "v", "g").collect()
    assert r.u == 0.5 and r.mean_ratio == 0.5
    assert r.z == pytest.approx((0.5 - 3) / math.sqrt(6 / 12 * (6 - 6 / 20)))


def test_rank_ic_matches_pandas(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 30, 200).astype(float), rng.normal(size=200)
    d = spark.createDataFrame([("s", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "symbol string, i long, x double, y double")
    [c] = Q.cell_ics(d, "x", "y", F.lit("m"), "i").collect()
    assert c.ic == pytest.approx(pd.Series(x).rank().corr(pd.Series(y).rank()))
    q = pd.qcut(pd.Series(x).rank(method="first"), 5, labels=False)
    assert c.edge_bp == pytest.approx((y[q == 4].mean() - y[q == 0].mean()) / 2 * 1e4)


def test_rolling_dcc_uses_the_past_only(spark):
    rng = np.random.default_rng(6)
    f = rng.normal(0, 0.01, 620)
    rows = [(date(2020, 1, 1) + timedelta(days=t), a, float(f[t] + rng.normal(0, 0.006))) for t in range(620) for a in ("a", "b")]
    panel = spark.createDataFrame(rows, "date date, asset string, ret double")
    cut = rows[2 * 560][0]
    run = lambda p: {(r.date, r.asset_i, r.asset_j): r.value for r in G.rolling_dcc(p, ["a", "b"], window=300, refit=100, least=300).collect()}
    whole, part = run(panel), run(panel.filter(F.col("date") < F.lit(cut)))
    assert len(part) == 260 * 3 and all(whole[k] == pytest.approx(v) for k, v in part.items())
    assert all(whole[(d, "a", "b")] ** 2 < whole[(d, "a", "a")] * whole[(d, "b", "b")] for d in {k[0] for k in whole})


def test_conditional_var_and_gates(spark):
    d = spark.createDataFrame([(1e-4, 5.0), (1e-4, 2.0), (1e-4, None)], "v double, nu double")
    got = [r.x for r in d.select(K.conditional_var(F.col("v"), F.col("nu")).alias("x")).collect()]
    assert got[0] == pytest.approx(3.364929999 * math.sqrt(0.6) * 0.01, rel=1e-6) and all(x is None or math.isnan(x) for x in got[1:])
    g = spark.createDataFrame([(1.0, True, 0.5), (1.0, True, -0.5), (-1.0, True, -2.0), (1.0, None, 1.0)], "side double, g boolean, implied double")
    assert [r.a for r in g.select(Q.allowed_for("side", F.col("g"), F.col("implied")).alias("a")).collect()] == [True, False, True, False]


def test_intents_cut_shorts(spark):
    sig = spark.createDataFrame([("a", 1, 1.0), ("a", 2, -1.0), ("b", 2, -1.0)], "symbol string, date int, signal double")
    inst = spark.createDataFrame([("a", True), ("b", False)], "symbol string, shortable boolean")
    pos = spark.createDataFrame([("b", 2.0)], "symbol string, qty double")
    got = {r.symbol: (r.target, r.delta, r.order_side, r.order_qty) for r in P.intents(sig, inst, pos).collect()}
    assert got == {"a": (-1.0, -1.0, "sell", 1.0), "b": (0.0, -2.0, "sell", 2.0)}


def test_validators():
    with pytest.raises(ValueError):
        T.Barriers(stop_k=0)
    with pytest.raises(ValueError):
        C.in_sessions("ts", ["mars"])
    with pytest.raises(ValueError):
        K.check_confidence(0.4)
    with pytest.raises(ValueError):
        E.ewm_means(None, BAR, {}, 1.5)
