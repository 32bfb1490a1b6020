"""Special functions as Columns against plain Python, over rows of many parameters."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import distributions as dist
from tessella.functions import scalars
from tessella.functions import special as X
from tessella.operators import research as Q


def test_log_gamma(spark):
    xs = [1e-3, 0.3, 0.5, 1.0, 2.0, 3.7, 10.0, 123.4, 1e5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", X.log_gamma(F.col("x")).alias("y")).collect()
    for r in got:
        assert r.y == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-12)


def test_beta_and_its_inverse(spark):
    cases = [(x, a, b) for x, a, b in itertools.product([-1.0, 0.0, 1e-6, 0.2, 0.5, 0.9, 0.999999, 1.0, 2.0], [0.5, 1.0, 3.0, 40.0, 700.0], [0.5, 2.0, 60.0])] + [(None, 1.0, 1.0), (0.5, None, 1.0)]
    d = spark.createDataFrame(cases, "x double, a double, b double").select("*", X.beta_cdf(F.col("x"), F.col("a"), F.col("b")).alias("p"))
    for r in d.collect():
        assert (r.p is None) if None in (r.x, r.a) else r.p == pytest.approx(dist.beta_cdf(r.x, r.a, r.b), rel=1e-9, abs=1e-12)
    inside = [(x, a, b) for x, a, b in itertools.product([0.1, 0.4, 0.8], [0.5, 3.0, 20.0], [0.5, 2.0])]
    d = spark.createDataFrame(inside, "x double, a double, b double").withColumn("p", X.beta_cdf(F.col("x"), F.col("a"), F.col("b")))
    for r in d.select("x", "p", X.beta_ppf(F.col("p"), F.col("a"), F.col("b")).alias("y")).collect():
        assert r.p > 1 - 1e-9 or r.y == pytest.approx(r.x, rel=1e-6)


def test_students_t(spark):
    rows = [(p, n) for p in (0.001, 0.01, 0.3, 0.6, 0.975) for n in (2.5, 4.0, 8.3, 30.0, 400.0)]
    d = spark.createDataFrame(rows, "p double, n double").select("p", "n", X.t_ppf(F.col("p"), F.col("n")).alias("t"))
    d = X.with_t_constants(d, "n", 0.99, "q", "e")
    from tessella.operators.risk import t_constants

    for r in d.collect():
        assert r.t == pytest.approx(dist.t_ppf(r.p, r.n), rel=1e-8)
        assert (r.q, r.e) == pytest.approx(t_constants(r.n, 0.99), rel=1e-8)


def test_p_values_of_many_tests_without_python(spark):
    rows = [(float(t), n) for t in (-7, -2.2, 0, 0.5, 3) for n in (1, 2, 3, 12, 300)] + [(None, 5), (1.0, None)]
    d = Q.with_p_values(spark.createDataFrame(rows, "t double, cells long"))
    assert "Python" not in d._jdf.queryExecution().executedPlan().toString()
    for r in d.collect():
        want = None if r.t is None or r.cells is None or r.cells < 2 else dist.t_two_sided(r.t, r.cells - 1)
        assert r.p == (None if want is None else pytest.approx(want, rel=1e-9))


def test_implied_drift_of_rows(spark):
    rows = [(0.02, 0.03, scalars.touch_probability_value(0.02, 0.03, d, 0.05), 0.05) for d in (-0.02, -0.001, 0.0, 0.004, 0.03)] + [(0.02, 0.03, 1.0, 0.05), (0.0, 0.03, 0.4, 0.05), (0.02, 0.03, None, 0.05)]
    d = spark.createDataFrame(rows, "a double, b double, w double, s double")
    for r in d.select("*", scalars.implied_drift_of(*[F.col(c) for c in "abws"]).alias("d")).collect():
        want = math.nan if r.w is None else scalars.implied_drift(r.a, r.b, r.w, r.s)
        assert (r.d is None) if math.isnan(want) else r.d == pytest.approx(want, abs=1e-9)


def test_clustered_cells(spark):
    # two symbols: one beats its chance of a half by a quarter in each month, the other doesn't
    rows = []
    for month in range(1, 7):
        for k in range(8):
            for symbol, wins in (("a", 6 + month % 2), ("b", 4 - month % 2)):
                rows.append((symbol, f"2024-{month:02d}-01", "target" if k < wins else "stop", 1.0, math.e, 1 / math.e))
        rows.append(("a", f"2024-{month:02d}-02", "time", 1.0, 9.0, 0.1))
    d = spark.createDataFrame(rows, "symbol string, day string, outcome string, entry double, target double, stop double")
    cells = Q.excess_cells(d, Q.month_of(F.to_date("day")))
    assert cells.count() == 12 and {r.n for r in cells.collect()} == {8}
    got = {r.symbol: r for r in Q.clustered(cells, ("symbol",), 0.02).collect()}
    a = [0.25 + (m % 2) / 8 for m in range(1, 7)]
    sd = math.sqrt(sum((x - sum(a) / 6) ** 2 for x in a) / 5)
    t = (sum(a) / 6 - 0.02) / (sd / math.sqrt(6))
    assert got["a"].cells == 6 and got["a"]["mean"] == pytest.approx(sum(a) / 6) and got["a"].corrected == pytest.approx(sum(a) / 6 - 0.02)
    assert got["a"].t == pytest.approx(t) and got["a"].p == pytest.approx(dist.t_two_sided(t, 5), rel=1e-9)
    assert got.keys() == {"a", "b", None} and got[None].cells == 12
