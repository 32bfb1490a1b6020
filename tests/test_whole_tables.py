"""Queries cover the whole of their tables: their rows against loops over all rows read."""

import math
import statistics
from collections import defaultdict

import numpy as np
import pytest

from tessella.operators import garch as G
from tessella.operators import joins as J
from tessella.plans import base, registry

SF = "/root/testdata/sf0.001"


def test_expanding_median_runs_over_all_hours(spark):
    bars = defaultdict(list)
    for x in base.hourly(spark, SF).orderBy("symbol", "ts").collect():
        bars[x.symbol].append((str(x.ts), x.close))
    want = {}
    for symbol, own in bars.items():
        for k, (ts, _) in enumerate(own):
            want[symbol, ts] = statistics.median(c for _, c in own[: k + 1]) if k >= 49 else None
    got = {(x.symbol, x.ts): x["median"] for x in registry.queries()["expanding_median"](spark, SF).collect()}
    assert set(got) == set(want) and max(ts for _, ts in got) > "2024-01-29"
    assert all((got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v, abs=1e-6)) for k, v in want.items())


def test_best_partner_begins_with_the_panel(spark):
    """Against a loop over the panel; an asset's first correlation is known on the panel's second date."""
    sf = "/root/testdata/sf0.01"
    panel = defaultdict(dict)
    for x in base.panel(spark, sf).collect():
        panel[x.date][x.asset] = x.ret
    dates, want, sums = sorted(panel), {}, {}
    for t, d in enumerate(dates):
        names = sorted(panel[d])
        for a in names if t else ():
            rho = {b: sums[a, b] / math.sqrt(sums[a, a] * sums[b, b]) for b in names if b != a}
            partner = min(rho, key=lambda b: (-round(abs(rho[b]), 12), b))
            move = sum(panel[e][partner] for e in dates[max(0, t - 8) : t])
            want[str(d), a] = (partner, rho[partner], math.copysign(1, rho[partner]) * math.copysign(1, move) if abs(rho[partner]) >= 0.1 else 0.0)
        for a in names:
            for b in names:
                v = panel[d][a] * panel[d][b]
                sums[a, b] = 0.97 * sums[a, b] + 0.03 * v if t else v
    got = {(str(x.date), x.asset): (x.partner, x.rho, x.implied) for x in registry.queries()["best_partner_alignment"](spark, sf).collect()}
    assert set(got) == set(want) and min(got)[0] < "1995-06-01"
    assert all(got[k][0] == v[0] and got[k][1] == pytest.approx(v[1], abs=1e-7) and got[k][2] == v[2] for k, v in want.items())


def test_best_partner_ties_go_by_name(spark):
    rows = [(1, "a", "b", 1 - 1e-16), (1, "a", "c", -1.0), (1, "b", "c", 1.0 - 2e-16)]
    paths = spark.createDataFrame(rows, "date int, asset_i string, asset_j string, rho double")
    moves = spark.createDataFrame([(1, a, 1.0) for a in "abc"], "date int, asset string, move double")
    assert {x.asset: x.partner for x in J.best_partner(paths, moves, "date", 0.1).collect()} == {"a": "b", "b": "a", "c": "a"}


def test_aligned_returns_and_panel_have_all_instruments(spark):
    sf = "/root/testdata/sf0.01"
    close = defaultdict(dict)
    for x in base.daily(spark, sf).collect():
        close[str(x.date)][x.symbol] = x.close
    symbols, dates = sorted({s for own in close.values() for s in own}), sorted(close)
    assert len(symbols) == 5
    want = {}
    for before, d in zip(dates, dates[1:]):
        if all(s in close[d] and s in close[before] for s in symbols):
            want |= {(d, s): math.log(close[d][s] / close[before][s]) for s in symbols}
    got = {(str(x.date), x.symbol): x.ret for x in registry.queries()["aligned_log_returns"](spark, sf).collect()}
    assert got == pytest.approx(want, abs=1e-7) and len(want) > 0
    columns = dict(zip(("urgent", "high", "medium", "unspecified", "low"), symbols, strict=True))
    rows = registry.queries()["price_panel"](spark, sf).collect()
    assert {str(x.date): {s: x[c] for c, s in columns.items() if x[c] is not None} for x in rows} == dict(close)


def test_monte_carlo_simulates_every_symbol(spark):
    rows = defaultdict(list)
    for x in base.returns(spark, SF).filter("ret IS NOT NULL").orderBy("symbol", "date").collect():
        rows[x.symbol].append(x.ret)
    got = {(x.symbol, x.horizon): x for x in registry.queries()["monte_carlo_var"](spark, SF).collect()}
    assert set(got) == {(s, h) for s in rows for h in (1, 5, 10)} and len(rows) == 5
    for s in ("1-URGENT", "5-LOW"):
        for x in G.monte_carlo_var(spark, rows[s]).collect():
            y = got[s, x.horizon]
            assert (y.paths, y["var"], y.es, y.ratio_sqrt_time) == pytest.approx((x.paths, x["var"], x.es, x.ratio_sqrt_time))


def test_monte_carlo_of_a_constant_series_is_null(spark):
    d = spark.createDataFrame([(s, t, v) for t in range(150) for s, v in (("a", 0.0), ("b", 0.01 * math.sin(t * t)))], "symbol string, date int, ret double")
    for method in ("fhs", "parametric", "bootstrap"):
        got = {(x.symbol, x.horizon): (x.paths, x["var"]) for x in G.monte_carlo_by(d, base.DAILY, "ret", method, horizons=(1, 2), paths=400).collect()}
        assert got["a", 1] == got["a", 2] == (0, None) and got["b", 1][0] == 400 and got["b", 1][1] > 0


def test_dcc_queries_have_all_assets(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    panel = sorted({str(x.date) for x in base.panel(spark, sf).select("date").collect()})
    asked = []
    whole = G.rolling_dcc
    monkeypatch.setattr(G, "rolling_dcc", lambda p, assets, **options: asked.append((sorted(assets), options)) or whole(p, assets, **options))
    symbols = sorted(x.symbol for x in base.daily(spark, sf).select("symbol").distinct().collect())
    got = {str(x.date): x for x in registry.queries()["rolling_dcc_var"](spark, sf).collect()}
    assert asked == [(symbols, {})]
    assert sorted(got) == panel[400:] and all(x["var"] > 0 and x.es > x["var"] for x in got.values())
    pairs = {(x.asset_i, x.asset_j) for x in registry.queries()["dcc_cov"](spark, sf).select("asset_i", "asset_j").distinct().collect()}
    assert pairs == {(a, b) for a in symbols for b in symbols if a <= b}


def test_rolling_garch_carries_parameters_over_failed_refits(spark):
    rng = np.random.default_rng(3)
    r = rng.normal(0, 0.01, 700)
    r[300:520] = 0.0
    d = spark.createDataFrame([("a", t, float(x)) for t, x in enumerate(r)], "symbol string, date int, ret double")
    got = {x.date: x for x in G.rolling_garch(d, base.DAILY, "ret", min_obs=150, window=150, refit=50).collect()}
    assert sorted(got) == list(range(150, 700))
    # rows 450 and 500 begin with a window of zeros alone
    assert {t: got[t].refit_at for t in (400, 449, 450, 500, 549)} == {400: 401, 449: 401, 450: 401, 500: 401, 549: 401}
    f = G.fit(r[250:400])
    s = G.variances(r[250:400] ** 2, f["omega"], f["alpha"], f["beta"], float(np.var(r[250:400], ddof=1)))[-1]
    for t in range(400, 550):
        assert got[t].variance == pytest.approx(s) and got[t].nu == pytest.approx(f["nu"])
        s = f["omega"] + f["alpha"] * r[t] ** 2 + f["beta"] * s


def test_fits_as_one_matrix_equal_searches_one_by_one():
    rng = np.random.default_rng(1)
    windows = []
    for n in (750, 750, 300, 120):
        v, r = 1e-4, []
        for _ in range(n):
            r.append(math.sqrt(v) * rng.standard_t(6) * math.sqrt(4 / 6))
            v = 2e-6 + 0.08 * r[-1] ** 2 + 0.9 * v
        windows.append(np.array(r))
    windows[1][10] = np.nan
    windows += [np.ones(200), np.zeros(3), rng.normal(0, 0.01, 400)]
    for student in (True, False):
        together = G.fit_many(windows, student)
        assert [f is None for f in together] == [False] * 4 + [True, True, False]
        for w, f in zip(windows, together, strict=True):
            if f is None:
                assert G.fit(w, student)["omega"] is None
                continue
            r = w[np.isfinite(w)] * 100
            start = float(np.var(r, ddof=1))
            x0 = [math.log(start * 0.02), math.log(0.98 / 0.01999), math.log(0.08 / 0.90)] + [math.log(5.9 / 192)] * student
            best, value, ok = G.nelder_mead(lambda x, r=r, s=start, t=student: G.negative_loglik(r, *G.natural(x, t, False), s), np.array(x0))
            omega, alpha, beta, _, nu = G.natural(best, student, False)
            assert (f["omega"] * 1e4, f["alpha"], f["beta"], f["loglik"], f["converged"]) == (pytest.approx(omega, rel=1e-6), pytest.approx(alpha, rel=1e-6), pytest.approx(beta, rel=1e-6), pytest.approx(-value), ok)
            assert f["nu"] == (pytest.approx(nu, rel=1e-6) if student else None)
            own = G.filtered((r**2)[:, None], *[np.array([x]) for x in (omega, alpha, beta, start)])[:, 0]
            assert own == pytest.approx(G.variances(r**2, omega, alpha, beta, start)[:-1], rel=1e-12)


def test_rolling_garch_without_any_fit_is_empty(spark):
    d = spark.createDataFrame([("a", t, 0.0) for t in range(300)], "symbol string, date int, ret double")
    assert G.rolling_garch(d, base.DAILY, "ret", min_obs=150, window=150, refit=50, student=False).count() == 0


def test_garch_var_path_refits_by_the_operators_defaults(spark, monkeypatch):
    asked = []
    whole = G.rolling_garch
    monkeypatch.setattr(G, "rolling_garch", lambda d, series, ret, **options: asked.append(options) or whole(d, series, ret, **options))
    got = [(x.symbol, x.date) for x in registry.queries()["garch_var_path"](spark, SF).collect()]
    assert asked == [{}]
    rows = defaultdict(list)
    for x in base.returns(spark, SF).filter("ret IS NOT NULL").orderBy("symbol", "date").collect():
        rows[x.symbol].append(x.date)
    assert sorted(got) == sorted((s, d) for s, own in rows.items() for d in own[250:])
