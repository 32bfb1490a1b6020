"""Scalar rules as Column expressions. Null in, null out, unless a rule says otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.ordering import column, ratio
from tessella.functions.special import bisected


def typical_price(high: Column, low: Column, close: Column) -> Column:
    return (high + low + close) / 3


def deannualise(rate: float, periods: int) -> float:
    """The per-period rate that compounds to an annual one."""
    return (1 + rate) ** (1 / periods) - 1


def effective_observations(lam: float) -> float:
    """1 / (1 - lambda); lambda must lie strictly between 0 and 1."""
    if not 0 < lam < 1:
        raise ValueError("lambda must be between 0 and 1")
    return 1 / (1 - lam)


def breakeven_win_rate(cost_r: Column | float, rr: Column | float) -> Column:
    return (F.lit(1.0) + cost_r) / (F.lit(1.0) + rr)


def touch_probability(entry: Column, target: Column, stop: Column, drift: float = 0.0, sigma: float = 1.0) -> Column:
    """The chance that the target is touched before the stop.

    With drift 0 it is b / (a + b), for log distances a to the target and b to the stop; null where either is 0. With drift, that of a Brownian motion with drift nu = drift - sigma^2 / 2 that leaves (-b, a), clipped to [0, 1].
    """
    a, b = F.abs(F.ln(target / entry)), F.abs(F.ln(entry / stop))
    a, b = F.when((a > 0) & (b > 0), a), F.when((a > 0) & (b > 0), b)
    if drift == 0:
        return ratio(b, a + b)
    nu = drift - sigma * sigma / 2
    if abs(nu) < 1e-12:
        return ratio(b, a + b)
    k = F.lit(2 * nu / (sigma * sigma))
    p = ratio(F.exp(k * b) - 1, F.exp(k * b) - F.exp(-k * a))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def touch_probability_value(a: float, b: float, drift: float, sigma: float) -> float:
    """The same for one pair of log distances."""
    nu = drift - sigma * sigma / 2
    if drift == 0 or abs(nu) < 1e-12:
        return b / (a + b) if a + b else math.nan
    k = 2 * nu / (sigma * sigma)
    top = math.expm1(min(k * b, 700))
    return min(1.0, max(0.0, top / (math.exp(min(k * b, 700)) - math.exp(min(-k * a, 700)))))


def implied_drift(a: float, b: float, win_rate: float, sigma: float, rounds: int = 200, bound: float = 5.0) -> float:
    """The drift at which the touch probability equals the win rate, by bisection; nan where none within the bounds does."""
    if not 0 < win_rate < 1 or a <= 0 or b <= 0:
        return math.nan
    low, high = -bound, bound
    if not touch_probability_value(a, b, low, sigma) <= win_rate <= touch_probability_value(a, b, high, sigma):
        return math.nan
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if touch_probability_value(a, b, mid, sigma) < win_rate else (low, mid)
    return (low + high) / 2


def touch_probability_of(a: Column, b: Column, drift: Column, sigma: Column) -> Column:
    """touch_probability_value as a Column, for a drift that varies by row."""
    nu = drift - sigma * sigma / 2
    k = 2 * nu / (sigma * sigma)
    moved = F.expm1(F.least(k * b, F.lit(700.0))) / (F.exp(F.least(k * b, F.lit(700.0))) - F.exp(F.least(-k * a, F.lit(700.0))))
    still = F.when(a + b != 0, b / (a + b))
    return F.when((drift == 0) | (F.abs(nu) < 1e-12), still).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), moved)))


def implied_drift_of(a: Column, b: Column, win_rate: Column, sigma: Column, bound: float = 5.0) -> Column:
    """implied_drift as a Column: the drift at which the touch probability is the win rate, null where none within the bounds is."""
    reach = lambda d: touch_probability_of(a, b, d, sigma)
    found = bisected(lambda d: reach(d) < win_rate, F.lit(-bound), F.lit(bound), 80)
    inside = (win_rate > 0) & (win_rate < 1) & (a > 0) & (b > 0) & (sigma > 0)
    return F.when(inside, F.when((reach(F.lit(-bound)) <= win_rate) & (win_rate <= reach(F.lit(bound))), found))


def scale_to_horizon(value: Column, days: float, horizon: float = 1.0) -> Column:
    return value * math.sqrt(days / horizon)


def quote_bp(native: Column, unit: Column | float, price: Column) -> Column:
    """A spread in native units as basis points of the price."""
    return native * unit / price * 1e4


def cost_bp_per_side(spread_bp: Column, commission_bp: Column | float) -> Column:
    return spread_bp / 2 + commission_bp


def gap_position(gap: Column, threshold: float, long_only: bool = False) -> Column:
    """The sign of a gap beyond the threshold, else 0; long_only clips shorts."""
    side = F.when(F.abs(gap) > threshold, F.signum(gap)).otherwise(F.lit(0.0))
    return F.greatest(side, F.lit(0.0)) if long_only else side


def gap_trade(gap: Column, intraday: Column, threshold: float, cost_bp: float, long_only: bool = False) -> Column:
    """The return of trading the day in the gap's direction, net of two sides' cost."""
    side = gap_position(gap, threshold, long_only)
    return side * intraday - 2 * cost_bp / 1e4 * F.abs(side)


def basel_zone(breaches: Column, observations: Column, confidence: float) -> tuple[Column, Column]:
    """Traffic-light zone and capital multiplier of breaches scaled to 250 days; n/a unless at 99 %."""
    if abs(confidence - 0.99) > 1e-9:
        return F.lit("n/a"), F.lit(None).cast("double")
    x = F.lit(250.0) * breaches / F.when(observations > 0, observations)
    # Zone bounds and supervisory multipliers, from 5 exceptions on.
    zone = F.when(observations <= 0, "undefined").when(x < 5, "green").when(x < 10, "amber").otherwise("red")
    multiplier = F.when(observations <= 0, F.lit(None)).when(x < 5, 3.00)
    for n, m in ((6, 3.40), (7, 3.50), (8, 3.65), (9, 3.75), (10, 3.85)):
        multiplier = multiplier.when(x < n, m)
    return zone, multiplier.otherwise(4.00)


def slippage_bp(side: Column, fill: Column, decision: Column) -> Column:
    return side * (ratio(fill, decision) - 1) * 1e4


def log_or_zero(x: Column | str) -> Column:
    """ln x, 0 where x is not positive."""
    c = column(x)
    return F.when(c > 0, F.ln(c)).otherwise(F.lit(0.0))
