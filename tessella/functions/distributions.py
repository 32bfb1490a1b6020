"""Distributions for one-row results, in plain Python: normal, Student's t and chi-squared."""

from __future__ import annotations

import math
from statistics import NormalDist

_NORMAL = NormalDist()


def norm_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def norm_pdf(x: float) -> float:
    return _NORMAL.pdf(x)


def norm_cdf(x: float) -> float:
    return _NORMAL.cdf(x)


def chi2_sf(x: float, df: int) -> float:
    """Upper tail for one or two degrees of freedom."""
    if x <= 0:
        return 1.0
    return math.erfc(math.sqrt(x / 2)) if df == 1 else math.exp(-x / 2)


def _beta_fraction(a: float, b: float, x: float, rounds: int = 300, eps: float = 1e-15) -> float:
    """The continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, rounds):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < eps:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_cdf(x: float, df: float) -> float:
    tail = beta_cdf(df / (df + x * x), df / 2, 0.5) / 2
    return 1 - tail if x > 0 else tail


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def t_pdf(x: float, df: float) -> float:
    return math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - (df + 1) / 2 * math.log1p(x * x / df)) / math.sqrt(df * math.pi)


def t_ppf(p: float, df: float) -> float:
    """By bisection between bounds that are widened until they hold p."""
    if df > 1e7:
        return norm_ppf(p)
    low, high = -1.0, 1.0
    while t_cdf(low, df) > p:
        low *= 2
    while t_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2
