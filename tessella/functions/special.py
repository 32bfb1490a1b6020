"""Special functions as Columns: log-gamma, the incomplete beta function and its inverse, Student's t, and bisection.

Iterations are folds over a sequence inside an expression, so a million rows take their tails without Python. Nulls give null.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of the continued fraction, which converges in about the root of its larger parameter, and of a bisection of [0, 1].
ROUNDS, HALVINGS = 120, 52


def log_gamma(x: Column) -> Column:
    """Of a positive number: Stirling's series ten steps further up."""
    steps = F.ln(x)
    for k in range(1, 10):
        steps = steps + F.ln(x + k)
    y = x + 10
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - 1 / (1680 * y * y * y * y * y * y * y)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - steps


def beta_fraction(a: Column, b: Column, x: Column, rounds: int = ROUNDS) -> Column:
    """The continued fraction of the incomplete beta function, forwards, with both ratios kept off 0."""
    off0 = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)
    state = lambda c, d, out: F.struct(c.alias("c"), d.alias("d"), out.alias("out"))

    def moved(t: Column, by: Column) -> Column:
        c, d = off0(1 + by / t["c"]), 1 / off0(1 + by * t["d"])
        return state(c, d, t["out"] * c * d)

    def step(s: Column, k: Column) -> Column:
        m = k.cast("double")
        even, odd = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        # a lambda of its own for each half, so that the first isn't written out in the second
        return F.transform(F.transform(F.array(s), lambda t: moved(t, even)), lambda t: moved(t, odd))[0]

    first = 1 / off0(1 - (a + b) * x / (a + 1))
    return F.reduce(F.sequence(F.lit(1), F.lit(rounds)), state(F.lit(1.0), first, first), step, lambda s: s["out"])


def beta_cdf(x: Column, a: Column, b: Column, rounds: int = ROUNDS) -> Column:
    """The regularised incomplete beta function."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.log1p(-x))
    near = x < (a + 1) / (a + b + 2)
    known = x.isNotNull() & a.isNotNull() & b.isNotNull()
    return F.when(known & (x <= 0), 0.0).when(known & (x >= 1), 1.0).when(near, front * beta_fraction(a, b, x, rounds) / a).otherwise(1 - front * beta_fraction(b, a, 1 - x, rounds) / b)


def bisected(below: Callable[[Column], Column], low: Column, high: Column, rounds: int = HALVINGS) -> Column:
    """The point of [low, high] up to which `below` holds."""
    ends = lambda lo, hi: F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    half = lambda s: (s["lo"] + s["hi"]) / 2
    # the middle is a lambda's variable, as `below` may read it many times
    step = lambda s, _: F.transform(F.array(half(s)), lambda x: F.when(below(x), ends(x, s["hi"])).otherwise(ends(s["lo"], x)))[0]
    return F.reduce(F.sequence(F.lit(1), F.lit(rounds)), ends(low, high), step, half)


def beta_ppf(p: Column, a: Column, b: Column, rounds: int = ROUNDS) -> Column:
    """The inverse of beta_cdf in x, for p in [0, 1]."""
    return F.when(p.isNotNull() & a.isNotNull() & b.isNotNull(), bisected(lambda x: beta_cdf(x, a, b, rounds) < p, F.lit(0.0), F.lit(1.0)))


def t_two_sided(t: Column, df: Column) -> Column:
    """The chance of a t value at least so far from 0."""
    return beta_cdf(df / (df + t * t), df / 2, F.lit(0.5))


def t_ppf(p: Column, df: Column) -> Column:
    """The p-quantile of Student's t, p in (0, 1)."""
    # by a lambda, so that the bisection is written out once
    return F.signum(p - 0.5) * F.transform(F.array(beta_ppf(2 * F.least(p, 1 - p), df / 2, F.lit(0.5), 50)), lambda x: F.sqrt(df * (1 - x) / x))[0]


def t_quantile(p: float, df: Column, rounds: int = 60, steps: int = 5) -> Column:
    """t_ppf of one p below a half for many df: Newton's method on the logarithm of the tail, from the expansion about the normal quantile. Much
    less work than a bisection."""
    z = NormalDist().inv_cdf(p)
    first = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df * df) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * df * df * df)

    def step(t: Column, _: Column) -> Column:
        tail = F.transform(F.array(t), lambda x: beta_cdf(df / (df + x * x), df / 2, F.lit(0.5), rounds) / 2)
        return t - F.transform(tail, lambda c: c * F.ln(c / p) / t_pdf(t, df))[0]

    return F.reduce(F.sequence(F.lit(1), F.lit(steps)), first, step)


def t_pdf(x: Column, df: Column) -> Column:
    return F.exp(log_gamma((df + 1) / 2) - log_gamma(df / 2) - (df + 1) / 2 * F.log1p(x * x / df)) / F.sqrt(df * math.pi)


def with_t_constants(rows: DataFrame, nu: str, confidence: float, quantile: str, shortfall: str) -> DataFrame:
    """rows with the quantile and the expected shortfall of a t variable scaled to deviation 1, in deviations; nu is at least 2.5. The
    quantile is a column before the shortfall reads it, as an expression would be worked out anew at each place."""
    n = F.greatest(F.col(nu), F.lit(2.5))
    q, scale = F.col(quantile), F.sqrt((n - 2) / n)
    d = rows.withColumn(quantile, t_quantile(1 - confidence, n))
    return d.withColumn(shortfall, -t_pdf(q, n) / (1 - confidence) * (n + q * q) / (n - 1) * scale).withColumn(quantile, q * scale)
