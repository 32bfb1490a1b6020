"""Hashed draws, and the errors of quantiles against a plain bootstrap."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.ordering import Series
from tessella.operators import bootstrap as W
from tessella.operators import garch as G

S = Series(("symbol",), ("date",))


def test_hashed_numbers_have_their_laws(spark):
    d = spark.range(40_000).select(W.hashed_uniform(F.lit(3), F.col("id")).alias("u"), W.hashed_uniform(F.lit(4), F.col("id")).alias("v"))
    x = d.select("u", W.poisson_one(F.col("u")).alias("p"), W.normal_one(F.col("u"), F.col("v")).alias("z")).toPandas()
    assert 0 <= x.u.min() and x.u.max() < 1 and x.u.mean() == pytest.approx(0.5, abs=0.01)
    assert x.p.mean() == pytest.approx(1, abs=0.03) and x.p.var() == pytest.approx(1, abs=0.05)
    assert (x.p == 0).mean() == pytest.approx(math.exp(-1), abs=0.01)
    assert x.z.mean() == pytest.approx(0, abs=0.02) and x.z.std() == pytest.approx(1, abs=0.02)


def test_quantile_errors_against_a_plain_bootstrap(spark):
    rng = np.random.default_rng(5)
    x = {"a": rng.standard_t(4, 4000), "b": rng.normal(0, 2, 1000)}
    rows = [(k, i, float(v)) for k, xs in x.items() for i, v in enumerate(xs)] + [("c", 0, None), ("d", 0, 1.0)]
    d = spark.createDataFrame(rows, "symbol string, path long, ret double").repartition(7)
    got = {r.symbol: r for r in W.quantile_errors(d, ["symbol"], "ret", 0.05, 4000, 400).collect()}
    assert got.keys() == {"a", "b", "d"}
    for k, xs in x.items():
        q = np.quantile(xs, 0.05)
        boot = np.std([np.quantile(rng.choice(xs, len(xs)), 0.05) for _ in range(1500)], ddof=1)
        assert got[k].quantile == pytest.approx(q) and got[k]["mean"] == pytest.approx(xs[xs <= q].mean()) and got[k].n == len(xs)
        assert got[k].stderr == pytest.approx(boot, rel=0.15)
    assert got["d"].quantile == 1.0


def test_resampled_sums_draw_from_the_series(spark):
    d = spark.createDataFrame([("x", k, float(2**k)) for k in range(4)] + [("x", 9, None), ("y", 0, 5.0)], "symbol string, date int, ret double")
    rows = W.resampled_sums(d, ("symbol",), ("date",), "ret", (1, 3), 500).collect()
    assert len(rows) == 2 * 2 * 500
    one = [r.ret for r in rows if r.symbol == "x" and r.horizon == 1]
    assert set(one) == {1.0, 2.0, 4.0, 8.0} and all(one.count(v) > 90 for v in (1.0, 2.0, 4.0, 8.0))
    assert {r.ret for r in rows if r.symbol == "y"} == {5.0, 15.0}


def test_simulated_risk_grows_below_linearly_and_its_error_falls_with_paths(spark):
    rng = np.random.default_rng(2)
    v, r = 1e-4, []
    for _ in range(1200):
        r.append(math.sqrt(v) * rng.standard_normal())
        v = 2e-6 + 0.08 * r[-1] ** 2 + 0.9 * v
    d = spark.createDataFrame([("x", k, float(x)) for k, x in enumerate(r)], "symbol string, date int, ret double")
    few, many = ({(x.method, x.horizon): x for x in G.compare_methods(d, S, "ret", paths=n, horizons=(1, 10)).collect()} for n in (1000, 8000))
    assert few.keys() == {(m, h) for m in ("fhs", "parametric", "bootstrap") for h in (1, 10)}
    for m in ("fhs", "parametric", "bootstrap"):
        assert many[m, 1]["var"] < many[m, 10]["var"] < 10 * many[m, 1]["var"]
        assert many[m, 1].stderr < few[m, 1].stderr and many[m, 1].low < many[m, 1]["var"] < many[m, 1].high
        assert many[m, 1].ratio_sqrt_time == 1 and many[m, 10].sqrt_time == pytest.approx(many[m, 1]["var"] * math.sqrt(10))
        assert many[m, 1].es >= many[m, 1]["var"]


def test_null_paths_are_like_their_series(spark):
    rng = np.random.default_rng(4)
    rows = []
    for symbol, n, sd in (("a", 400, 0.01), ("b", 250, 0.03)):
        price = 50.0
        for k in range(n):
            price *= math.exp(rng.normal(0, sd))
            rows.append((symbol, k, price))
    rows.append(("c", 0, 1.0))  # one bar has no volatility
    d = spark.createDataFrame(rows, "symbol string, date int, close double")
    made, again = (sorted(map(tuple, G.null_paths_like(d, S, 2).collect())) for _ in range(2))
    assert made == again and {(r[0], r[1]) for r in made} == {("a", 0), ("a", 1), ("b", 0), ("b", 1)}
    for symbol, n, sd in (("a", 400, 0.01), ("b", 250, 0.03)):
        own = [r for r in made if r[0] == symbol and r[1] == 0]
        assert len(own) == n and own[0][3] == pytest.approx(next(x[2] for x in rows if x[0] == symbol))
        assert all(r[5] <= min(r[3], r[6]) and r[4] >= max(r[3], r[6]) for r in own)
        assert np.std(np.diff(np.log([r[6] for r in own]))) == pytest.approx(sd, rel=0.25)
