"""Choices in order, triggers of a cascade, and grids of configurations over one first-passage index."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessella.functions.ordering import Series
from tessella.operators import barriers as T
from tessella.operators import choice as X
from tessella.operators import patterns as N
from tessella.operators.joins import later

S = Series(("symbol",), ("ts",))
DAY = datetime(2024, 1, 1)


def hours(*n):
    return [DAY + timedelta(hours=k) for k in n]


# ---- choices


@pytest.mark.parametrize("block, super_", [(256, 2048), (8, 3), (1, 2), (5, 1000)])
def test_first_come_equals_a_scan(spark, block, super_):
    rng = random.Random(block)
    rows = []
    for symbol in ("a", "b", None):
        for i in range(150):
            start = rng.randrange(400)
            at = sorted({start + rng.randrange(6) for _ in range(rng.randrange(4))})
            rows.append((symbol, i, start, [(k, k + 1 + rng.randrange(9)) for k in at]))
    want = []
    for symbol in ("a", "b", None):
        state = -1
        for _, i, start, options in sorted((r for r in rows if r[0] == symbol), key=lambda r: (r[2], r[1])):
            took = next(((a, f) for a, f in options if a >= state), None)
            if took:
                want.append((symbol, i, start, *took))
                state = took[1]
    df = spark.createDataFrame(rows, "symbol string, i long, start long, options array<struct<at:bigint,free:bigint>>")
    got = [tuple(r) for r in X.first_come(df, ("symbol",), "start", "options", [F.col("start"), F.col("i")], 15, block, super_).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_first_come_of_nothing_without_keys_and_beyond_its_span(spark):
    schema = "bar long, next_free long"
    assert X.greedy(spark.createDataFrame([], schema), (), 3).collect() == []
    assert sorted(r.bar for r in X.greedy(spark.createDataFrame([(k, k + 2) for k in range(7)], schema), (), 2).collect()) == [0, 2, 4, 6]
    with pytest.raises(Exception, match="beyond the span"):
        X.greedy(spark.createDataFrame([(0, 9)], schema), (), 3).collect()


# ---- triggers


def fine(spark, closes, **more):
    n = len(closes)
    cols = {"symbol": ["x"] * n, "ts": hours(*range(n)), "high": [c + 0.2 for c in closes], "low": [c - 0.2 for c in closes], "close": [float(c) for c in closes], "sigma": [0.1] * n} | more
    kinds = {"symbol": "string", "ts": "timestamp"}
    return spark.createDataFrame(list(zip(*cols.values(), strict=True)), ", ".join(f"{c} {kinds.get(c, 'double')}" for c in cols))


def triggered(spark, bars, found, **options):
    f = spark.createDataFrame([("x", at, side, kind) for at, side, kind in found], "symbol string, known_at timestamp, side double, kind string")
    return sorted((r.bar, r.side, r.kind) for r in N.trigger_entries(bars, f, S, **options).collect())


def test_trigger_bars_rise_from_setup_to_setup(spark):
    #          0    1   2   3   4   5   6   7   8
    closes = [10, 9.9, 9, 8.9, 8, 9.5, 9.2, 9.1, 9]
    one, two = hours(1, 2)
    assert triggered(spark, fine(spark, closes), [(one, 1.0, "a")]) == [(5, 1.0, "a")]
    assert triggered(spark, fine(spark, closes), [(two, -1.0, "a")]) == [(2, -1.0, "a")]
    # the long one, known first, waits until bar 5; the short one may take a bar after it only
    assert triggered(spark, fine(spark, closes), [(one, 1.0, "a"), (two, -1.0, "b")]) == [(5, 1.0, "a"), (6, -1.0, "b")]
    assert triggered(spark, fine(spark, closes), [(one, 1.0, "a"), (two, -1.0, "b")], window=5) == [(5, 1.0, "a"), (6, -1.0, "b")]
    assert triggered(spark, fine(spark, closes), [(one, 1.0, "a"), (two, -1.0, "b")], window=4) == [(2, -1.0, "b")]


def test_a_tied_setup_looks_on_in_its_window(spark):
    closes = [10, 11, 12, 13, 14, 15]
    known = hours(1)[0]
    assert triggered(spark, fine(spark, closes), [(known, 1.0, "a"), (known, 1.0, "b"), (known, 1.0, "c")], window=2) == [(1, 1.0, "a"), (2, 1.0, "b")]
    # a group of its own has its own bars
    f = spark.createDataFrame([("x", known, 1.0, k, g) for k, g in (("a", "p"), ("b", "q"))], "symbol string, known_at timestamp, side double, kind string, kinds string")
    assert [r.bar for r in N.trigger_entries(fine(spark, closes), f, S, group=("kinds",)).collect()] == [1, 1]


def test_the_last_bar_and_unknown_sigmas_trigger_nothing(spark):
    closes = [10, 9, 8, 9]
    assert triggered(spark, fine(spark, closes), [(hours(1)[0], 1.0, "a")]) == []
    assert triggered(spark, fine(spark, [*closes, 7]), [(hours(1)[0], 1.0, "a")]) == [(3, 1.0, "a")]
    assert triggered(spark, fine(spark, [*closes, 10, 7], sigma=[0.1, 0.1, 0.1, None, 0.1, 0.1]), [(hours(1)[0], 1.0, "a")]) == [(4, 1.0, "a")]
    assert triggered(spark, fine(spark, closes), [(hours(9)[0], 1.0, "a")]) == []


def test_bias_and_vwap_filters(spark):
    closes = [10, 11, 12, 13, 14, 15, 16]
    known = [(hours(1)[0], 1.0, "a")]
    bars = fine(spark, closes, bias=[1.0, -1.0, 0.0, None, 1.0, 1.0, 1.0], vwap=[0.0, 0.0, 12.0, None, 99.0, 99.0, 99.0])
    assert triggered(spark, bars, known, bias="bias") == [(4, 1.0, "a")]
    assert triggered(spark, bars, known, vwap="vwap", vwap_filter="trend") == [(1, 1.0, "a")]
    assert triggered(spark, bars, known, vwap="vwap", vwap_filter="revert") == [(3, 1.0, "a")]  # an unknown vwap refuses none
    assert triggered(spark, bars, known, bias="bias", vwap="vwap", vwap_filter="revert") == [(4, 1.0, "a")]
    with pytest.raises(ValueError, match="vwap_filter"):
        triggered(spark, bars, known, vwap="vwap", vwap_filter="up")


def test_entries_move_to_the_first_bar_that_closes_after_them(spark):
    bars = fine(spark, [1, 2, 3, 4]).filter("true")
    e = spark.createDataFrame([("x", t, k) for k, t in enumerate([DAY + timedelta(minutes=30), DAY + timedelta(hours=1), DAY + timedelta(hours=1, minutes=5), DAY + timedelta(hours=2, minutes=30), DAY + timedelta(hours=9)])], "symbol string, time timestamp, n long")
    # bar 3 is the last; a stamp equal to a close belongs to the next bar; of two on one bar the first counts
    assert sorted((r.n, r.bar) for r in N.on_walk_frame(e, bars, S).collect()) == [(0, 0), (1, 1), (3, 2)]


def test_a_date_is_known_when_it_is_over(spark):
    rows = spark.sql("SELECT DATE '2024-01-01' AS d, TIMESTAMP '2024-01-01 06:00:00' AS t, s FROM VALUES (0L), (86400L), (388800L), (388801L) v(s)")
    got = rows.select("s", later(F.col("d"), F.col("s"), "date").cast("string"), later(F.col("t"), F.col("s"), "timestamp").cast("string")).orderBy("s").collect()
    assert [r[1] for r in got] == ["2024-01-01", "2024-01-02", "2024-01-06", "2024-01-06"]  # four and a half days: the sixth
    assert [r[2] for r in got][:3] == ["2024-01-01 06:00:00", "2024-01-02 06:00:00", "2024-01-05 18:00:00"]


def test_a_cascade_refuses_senseless_settings():
    for wrong in ({"lookback": 2}, {"near": 0.0}, {"near": 0.5, "far": 0.4}, {"trigger_window": 0}, {"stop_sigma": 0}, {"stop_mode": "x"}, {"vwap_filter": "x"}, {"bias_span": 0}, {"atr_period": 1}):
        with pytest.raises(ValueError):
            N.Cascade(**wrong)
    with pytest.raises(ValueError):
        N.setups(None, S, kinds=("other",))


def test_a_retrace_takes_the_earliest_breakout_whose_side_has_a_zone(spark):
    # bar 3 breaks out upwards, bar 4 downwards; bar 5 lies in both bands
    hi, lo = [10, 10, 10, 10, 10, 10], [5, 5, 5, 5, 5, 5]
    rows = [("x", k, float(h), float(low), float(c), float(hp), float(lp)) for k, (h, low, c, hp, lp) in enumerate(zip([9, 9, 9, 12, 9, 10.5], [6, 6, 6, 6, 2, 3.5], [8, 8, 8, 12, 2, 7], hi, lo, strict=True))]
    bars = spark.createDataFrame([(*r[:1], DAY + timedelta(hours=r[1]), *r[2:]) for r in rows], "symbol string, ts timestamp, high double, low double, close double, hi_prev double, lo_prev double")
    wide = {"near": 0.1, "far": 20.0}
    one = lambda **o: [(r.bar, r.side) for r in N.retrace_setups(bars, S, 6, **wide, **o).collect() if r.bar == 5]
    assert one() == [(5, 1.0)] and one(first=4) == [(5, -1.0)]
    zone = lambda side: spark.createDataFrame([("x", 2, side, 0.0, 99.0)], "symbol string, known_bar long, side double, lo double, hi double")
    assert one(zone_frame=zone(1.0)) == [(5, 1.0)] and one(zone_frame=zone(-1.0)) == [(5, -1.0)]


# ---- grids


@pytest.mark.parametrize("breakeven", [None, 0.004])
def test_a_grid_equals_its_single_walks(spark, breakeven):
    rng = random.Random(4)
    price, rows = 100.0, []
    for symbol in ("a", "b"):
        for k in range(260):
            new = price * (1 + rng.gauss(0, 0.01))
            high, low = max(price, new) * (1 + abs(rng.gauss(0, 0.004))), min(price, new) * (1 - abs(rng.gauss(0, 0.004)))
            rows.append((symbol, DAY + timedelta(hours=k), high, low, new))
            price = new
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, high double, low double, close double")
    numbered = T.numbered_bars(bars, S)
    picked = [r for r in numbered.collect() if rng.random() < 0.3]
    entries = [(r.symbol, r.bar, side, r.close, r.close * (1 - side * 0.01), r.close * (1 - side * 0.02)) for r in picked for side in (rng.choice((1.0, -1.0)),)]
    e = spark.createDataFrame(entries, "symbol string, bar long, side double, entry double, stop double, wide double")
    grid = [T.Geometry(f"{s}{rr}{n}{be}", rr, n, s, be) for s in ("stop", "wide") for rr in (1.0, 2.5) for n in (5, 12) for be in ((False, True) if breakeven else (False,))]
    cells = lambda rows: sorted((r.symbol, r.bar, r.outcome, r.ambiguous, r.be_armed, r.bars_held, round(r.exit, 9), round(r.net_R, 9)) for r in rows)
    done = T.grid_walk(T.looking_ahead(e, numbered, S, 12), S, grid, F.lit(1.0), breakeven)
    by: dict = {}
    for r in done.collect():
        by.setdefault(r.config, []).append(r)
    for g in grid:
        single = T.walk_explicit(bars, e.withColumn("stop", F.col(g.stop)), S, g.rr, g.max_bars, 1.0, breakeven if g.breakeven else None)
        assert cells(by[g.name]) == cells(single.collect()), g


def test_a_grid_reads_its_bars_once(spark):
    bars = fine(spark, [10 + k % 5 for k in range(50)])
    e = spark.createDataFrame([("x", k, 1.0, 10.0, 9.0) for k in range(0, 40, 3)], "symbol string, bar long, side double, entry double, stop double")
    grid = [T.Geometry(f"g{k}", 1 + k / 10, 8) for k in range(18)]
    d = T.grid_outcomes(T.passages(T.looking_ahead(e, T.numbered_bars(bars, S), S, 8), [8]), grid, F.lit(1.0))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") <= 2 and "MapInArrow" not in plan and "BatchEvalPython" not in plan
    assert d.groupBy("config").count().count() == 18
