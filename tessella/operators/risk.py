"""Value at Risk and Expected Shortfall, portfolio and component risk, back-tests. Losses are positive."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import distributions as dist
from tessella.functions.ordering import Series, finite, ratio
from tessella.functions.scalars import basel_zone, log_or_zero


def check_confidence(c: float) -> None:
    if not 0.5 < c < 1:
        raise ValueError("confidence must be between 0.5 and 1")


def historical_var(df: DataFrame, keys: tuple[str, ...], ret: str, confidence: float = 0.99, least: int = 30) -> DataFrame:
    """The interpolated loss quantile, and the mean of returns at or below it. One pass finds the quantile, a second the mean;
    the quantiles that are joined back are one row per key."""
    check_confidence(confidence)
    r = df.withColumn("__r", finite(ret)).filter("__r IS NOT NULL")
    q = r.groupBy(*keys).agg(F.percentile("__r", F.lit(1 - confidence)).alias("__q"), F.count(F.lit(1)).alias("n_obs")).filter(F.col("n_obs") >= least)
    tail = r.join(q, list(keys)).filter("__r <= __q").groupBy(*keys).agg(F.avg("__r").alias("__es"))
    return q.join(tail, list(keys)).select(*keys, "n_obs", (-F.col("__q")).alias("var"), (-F.col("__es")).alias("es"))


def normal_var(df: DataFrame, keys: tuple[str, ...], ret: str, confidence: float = 0.99) -> DataFrame:
    check_confidence(confidence)
    z, alpha = dist.norm_ppf(1 - confidence), 1 - confidence
    r = finite(ret)
    m = df.groupBy(*keys).agg(F.count(r).alias("n_obs"), F.avg(r).alias("mu"), F.stddev_samp(r).alias("sigma"))
    return m.select(*keys, "n_obs", (-(F.col("mu") + F.lit(z) * F.col("sigma"))).alias("var"), (-(F.col("mu") - F.lit(dist.norm_pdf(z) / alpha) * F.col("sigma"))).alias("es"))


def cornish_fisher_quantile(z: Column | float, s: Column, k: Column) -> Column:
    """A normal quantile corrected by skewness and excess kurtosis."""
    z = F.lit(z) if isinstance(z, float) else z
    return z + (z * z - 1) * s / 6 + (z * z * z - 3 * z) * k / 24 - (2 * z * z * z - 5 * z) * s * s / 36


def cornish_fisher_var(df: DataFrame, keys: tuple[str, ...], ret: str, confidence: float = 0.99, least: int = 60, points: int = 500) -> DataFrame:
    """ES is the mean of the corrected quantile over `points` equal steps of the tail. That mean is linear in the powers of z, so
    the grid enters as three constants."""
    check_confidence(confidence)
    alpha = 1 - confidence
    grid = [dist.norm_ppf(1e-6 + (alpha - 1e-6) * i / (points - 1)) for i in range(points)]
    m1, m2, m3 = (sum(z**p for z in grid) / points for p in (1, 2, 3))
    r = finite(ret)
    m = df.groupBy(*keys).agg(F.count(r).alias("n_obs"), F.avg(r).alias("mu"), F.stddev_samp(r).alias("sigma"), F.skewness(r).alias("s"), F.kurtosis(r).alias("k")).filter(F.col("n_obs") >= least)
    s, k = F.col("s"), F.col("k")
    tail = F.lit(m1) + F.lit(m2 - 1) * s / 6 + F.lit(m3 - 3 * m1) * k / 24 - F.lit(2 * m3 - 5 * m1) * s * s / 36
    q = cornish_fisher_quantile(dist.norm_ppf(alpha), s, k)
    return m.select(*keys, "n_obs", (-(F.col("mu") + F.col("sigma") * q)).alias("var"), (-(F.col("mu") + F.col("sigma") * tail)).alias("es"))


def normal_var_of_sigma(sigma: Column, confidence: float = 0.99, mu: float = 0.0) -> tuple[Column, Column]:
    z = dist.norm_ppf(1 - confidence)
    return -(F.lit(mu) + F.lit(z) * sigma), -(F.lit(mu) - F.lit(dist.norm_pdf(z) / (1 - confidence)) * sigma)


def t_constants(nu: float, confidence: float) -> tuple[float, float]:
    """The quantile and the expected shortfall of a t variable scaled to deviation 1, in deviations; nu is at least 2.5."""
    nu = max(nu, 2.5)
    scale, q = math.sqrt((nu - 2) / nu), dist.t_ppf(1 - confidence, nu)
    es = -dist.t_pdf(q, nu) / (1 - confidence) * (nu + q * q) / (nu - 1)
    return q * scale, es * scale


def ewma_var_series(df: DataFrame, series: Series, ret: str, confidence: float = 0.99, lam: float = 0.94, warmup: int = 30) -> DataFrame:
    from tessella.operators.ewm import ewma_variance

    var, es = normal_var_of_sigma(F.sqrt("variance"), confidence)
    return ewma_variance(df, series, ret, lam, warmup).withColumns({"var": var, "es": es})


def both_halves(cov: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The full matrix of a long one with i <= j."""
    other = cov.filter("asset_i <> asset_j").select(*extra, F.col("asset_j").alias("asset_i"), F.col("asset_i").alias("asset_j"), "value")
    return cov.select(*extra, "asset_i", "asset_j", "value").unionByName(other)


def portfolio_variance(cov: DataFrame, weights: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """w' S w, by `extra` keys (a date, say). Weights are one row per asset and are broadcast."""
    wi, wj = weights.select(F.col("asset").alias("asset_i"), F.col("weight").alias("wi")), weights.select(F.col("asset").alias("asset_j"), F.col("weight").alias("wj"))
    d = both_halves(cov, extra).join(F.broadcast(wi), "asset_i").join(F.broadcast(wj), "asset_j")
    return d.groupBy(*extra).agg(F.sum(F.col("wi") * F.col("wj") * F.col("value")).alias("variance"))


def portfolio_var(cov: DataFrame, weights: DataFrame, confidence: float = 0.99, nu: float | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """VaR and ES of a portfolio, normal or (with nu) scaled t; a negative variance raises."""
    check_confidence(confidence)
    v = portfolio_variance(cov, weights, extra)
    sigma = F.sqrt(F.when(F.col("variance") < 0, F.raise_error(F.lit("negative portfolio variance")).cast("double")).otherwise(F.col("variance")))
    if nu is None:
        var, es = normal_var_of_sigma(sigma, confidence)
    else:
        q, e = t_constants(nu, confidence)
        var, es = F.lit(-q) * sigma, F.lit(-e) * sigma
    return v.withColumns({"sigma": sigma, "var": var, "es": es})


def component_var(cov: DataFrame, weights: DataFrame, confidence: float = 0.99) -> DataFrame:
    """Each asset's marginal VaR, its component (they add up to the portfolio's VaR) and its share."""
    check_confidence(confidence)
    z = -dist.norm_ppf(1 - confidence)
    wj = weights.select(F.col("asset").alias("asset_j"), F.col("weight").alias("wj"))
    swi = both_halves(cov).join(F.broadcast(wj), "asset_j").groupBy(F.col("asset_i").alias("asset")).agg(F.sum(F.col("value") * F.col("wj")).alias("sw"))
    d = swi.join(F.broadcast(weights.select("asset", "weight")), "asset")
    total = F.sum(F.col("weight") * F.col("sw")).over(Window.partitionBy(F.lit(1)))  # one row per asset
    d = d.withColumn("__v", total)
    marginal = F.lit(z) * ratio(F.col("sw"), F.sqrt("__v"))
    d = d.withColumns({"marginal_var": marginal, "component_var": F.col("weight") * marginal})
    return d.withColumn("pct", ratio(F.col("weight") * F.col("sw"), F.col("__v"))).select("asset", "weight", "marginal_var", "component_var", "pct")


# ---- back-tests


def backtest_counts(df: DataFrame, series: Series, ret: str, var: str, confidence: float = 0.99, least: int = 100) -> DataFrame:
    """By key: observations, breaches (loss above VaR), transitions, severities and the Lopez loss. One window for the row before,
    one aggregation. Keys with fewer than `least` rows give no row; a negative VaR raises."""
    r, v = finite(ret), finite(var)
    d = df.withColumns({"__r": r, "__v": v}).filter("__r IS NOT NULL AND __v IS NOT NULL")
    d = d.withColumn("__v", F.when(F.col("__v") < 0, F.raise_error(F.lit("negative VaR")).cast("double")).otherwise(F.col("__v")))
    d = d.withColumn("__b", (-F.col("__r") > F.col("__v")).cast("int")).withColumn("__p", series.lag("__b"))
    over = F.when(F.col("__b") == 1, -F.col("__r") - F.col("__v"))
    count = lambda p, b: F.count_if((F.col("__p") == p) & (F.col("__b") == b)).alias(f"n{p}{b}")
    return d.groupBy(*series.keys).agg(
        F.count(F.lit(1)).alias("n_obs"), F.sum("__b").cast("long").alias("n_breaches"), count(0, 0), count(0, 1), count(1, 0), count(1, 1),
        F.coalesce(F.avg(over), F.lit(0.0)).alias("mean_severity"), F.coalesce(F.max(over), F.lit(0.0)).alias("max_severity"),
        F.coalesce(F.sum(1 + F.pow(over * 100, F.lit(2.0))), F.lit(0.0)).alias("lopez_loss"),
    ).filter(F.col("n_obs") >= least)


def kupiec(n: Column, x: Column, confidence: float) -> Column:
    """The proportion-of-failures likelihood ratio, with its two limits."""
    p = F.lit(1 - confidence)
    rate = x / n
    middle = -2 * ((n - x) * F.ln(1 - p) + x * F.ln(p) - (n - x) * log_or_zero(1 - rate) - x * log_or_zero(rate))
    return F.when(n > 0, F.when(x == 0, -2 * n * F.ln(1 - p)).when(x == n, -2 * n * F.ln(p)).otherwise(F.greatest(middle, F.lit(0.0))))


def christoffersen() -> Column:
    """The independence likelihood ratio from the transition counts n00 to n11; 0 where it is not defined."""
    a, b, c, d = (F.col(x).cast("double") for x in ("n00", "n01", "n10", "n11"))
    p01, p11, p = ratio(b, a + b), ratio(d, c + d), ratio(b + d, a + b + c + d)
    null = (a + c) * log_or_zero(1 - p) + (b + d) * log_or_zero(p)
    free = a * log_or_zero(1 - p01) + b * log_or_zero(p01) + c * log_or_zero(1 - p11) + d * log_or_zero(p11)
    return F.when((a + b == 0) | (c + d == 0) | (b + d == 0) | (p == 1), F.lit(0.0)).otherwise(F.greatest(-2 * (null - free), F.lit(0.0)))


# The coefficients of the Chebyshev fit to erfc.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def chi2_sf1(x: Column) -> Column:
    """The upper tail of chi-squared with one degree of freedom: erfc(sqrt(x / 2)), by a rational fit good to 1.2e-7."""
    z = F.sqrt(x / 2)
    t = 1 / (1 + z / 2)
    poly = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        poly = F.lit(c) + t * poly
    return t * F.exp(-z * z + poly)


def backtest(df: DataFrame, series: Series, ret: str, var: str, confidence: float = 0.99) -> DataFrame:
    """The whole battery by key: Kupiec, independence and conditional coverage with their p-values, Basel zone, Lopez loss, and
    `passed` (Kupiec and independence above 5 %)."""
    c = backtest_counts(df, series, ret, var, confidence)
    zone, mult = basel_zone(F.col("n_breaches"), F.col("n_obs"), confidence)
    d = c.withColumns({"expected": F.col("n_obs") * F.lit(1 - confidence), "breach_rate": F.col("n_breaches") / F.col("n_obs"), "kupiec": kupiec(F.col("n_obs"), F.col("n_breaches"), confidence), "independence": christoffersen()})
    d = d.withColumns({"conditional": F.col("kupiec") + F.col("independence"), "kupiec_p": chi2_sf1(F.col("kupiec")), "independence_p": F.when(F.col("independence") > 0, chi2_sf1(F.col("independence"))).otherwise(1.0)})
    return d.withColumns({"conditional_p": F.exp(-F.col("conditional") / 2), "basel_zone": zone, "basel_multiplier": mult, "passed": (F.col("kupiec_p") > 0.05) & (F.col("independence_p") > 0.05)})


def compare_models(results: DataFrame) -> DataFrame:
    """Passed models first, then by Lopez loss."""
    return results.orderBy(F.col("passed").desc(), F.col("lopez_loss").asc())


def conditional_var(variance: Column, nu: Column, confidence: float = 0.99) -> Column:
    """VaR of a scaled t with a nu of its own in each row; null where nu is 2 or less. For many different nu: the constant comes
    from Python, in Arrow batches."""
    @F.pandas_udf("double")
    def factor(x: pd.Series) -> pd.Series:
        known = {v: -dist.t_ppf(1 - confidence, v) * math.sqrt((v - 2) / v) for v in x.dropna().unique() if v > 2}
        return x.map(known)

    return factor(nu) * F.sqrt(variance)


def naive_strategy_var(df: DataFrame, series: Series, net: str = "net", confidence: float = 0.99, window: int = 500) -> DataFrame:
    """VaR fitted on the strategy's own returns, flat days and all."""
    from tessella.operators.rolling import rolling_historical_var

    return rolling_historical_var(df, series, net, confidence, window)


def compare_constructions(estimates: DataFrame, series: Series, net: str = "net", var: str = "var", position: str = "position", confidence: float = 0.99, in_market_only: bool = True) -> DataFrame:
    """Back-tests of several VaR constructions (column `construction` among the keys) on the days in the market; those with fewer
    than 100 such days give no row."""
    d = estimates.filter(F.col(position) != 0) if in_market_only else estimates
    return compare_models(backtest(d, series, net, var, confidence))
