"""Bootstraps by hash: draws that repeat by seed in any partitioning, and the sampling error of simulated quantiles.

A resample gives every path a Poisson(1) number of copies. A low quantile depends on the copies of the lowest paths, and on the
others only by how many copies they have together; so only the tail is joined with the resamples, and the rest is one number a resample.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: P(Poisson(1) <= k) for k from 0, up to where it is 1.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(17)]


def hashed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, which must not be null."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_one(u: Column) -> Column:
    """A Poisson(1) number by inversion."""
    return sum((F.when(u >= p, F.lit(1)).otherwise(F.lit(0)) for p in POISSON[1:]), F.when(u >= POISSON[0], F.lit(1)).otherwise(F.lit(0)))


def normal_one(u: Column, v: Column) -> Column:
    """A standard normal number from two uniform ones."""
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * math.pi * v)


def tail_share(alpha: float, paths: int) -> float:
    """A share of the paths beyond which no resample's quantile falls (ten standard deviations)."""
    return min(1.0, alpha + (10 * math.sqrt(alpha * paths) + 20) / paths)


def quantile_errors(draws: DataFrame, by: list[str], value: str, alpha: float, paths: int, resamples: int = 200, seed: int = 0, path: str = "path") -> DataFrame:
    """(by, quantile, mean, n, stderr) of the alpha-quantile of each group's draws: linearly interpolated, the mean of the draws up to it, and
    the standard deviation of the quantile over the resamples. A group has at most `paths` draws, told apart by `path`; nulls don't
    count."""
    some = draws.filter(F.col(value).isNotNull())
    known = some.groupBy(*by).agg(F.percentile(value, [alpha, tail_share(alpha, paths)]).alias("__q"), F.count(value).alias("n"))
    tail = some.join(known, by).filter(F.col(value) <= F.col("__q")[1])
    mean = tail.filter(F.col(value) <= F.col("__q")[0]).groupBy(*by).agg(F.avg(value).alias("mean"))
    rows = tail.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    names = [F.lit(seed), *[F.col(c) for c in by], F.col("__b")]
    rows = rows.withColumn("__w", poisson_one(hashed_uniform(*names, F.col(path))))
    w = Window.partitionBy(*by, "__b")
    lowest = w.orderBy(value, path).rowsBetween(Window.unboundedPreceding, 0)
    rest = F.col("n") - F.count(F.lit(1)).over(w)
    others = F.greatest(F.lit(0.0), F.round(rest + F.sqrt(rest) * normal_one(hashed_uniform(*names, F.lit("u")), hashed_uniform(*names, F.lit("v")))))
    rows = rows.withColumns({"__c": F.sum("__w").over(lowest), "__t": F.sum("__w").over(w) + others}).filter(F.col("__c") >= F.lit(alpha) * F.col("__t"))
    spread = rows.groupBy(*by, "__b").agg(F.min(value).alias("__x")).groupBy(*by).agg(F.stddev_samp("__x").alias("stderr"))
    return known.select(*by, F.col("__q")[0].alias("quantile"), "n").join(mean, by, "left").join(spread, by, "left")


def risk_terms(errors: DataFrame, keys: list[str], horizon: str = "horizon") -> DataFrame:
    """(keys, horizon, paths, var, es, stderr, low, high, sqrt_time, ratio_sqrt_time): losses, an interval of 95 % for VaR, and the first
    horizon's VaR scaled by the root of time, which a ratio below 1 says is too much."""
    d = errors.select(*keys, horizon, F.col("n").alias("paths"), (-F.col("quantile")).alias("var"), (-F.col("mean")).alias("es"), "stderr")
    first = F.min_by("var", horizon).over(Window.partitionBy(*keys)) * F.sqrt(F.col(horizon) / F.min(horizon).over(Window.partitionBy(*keys)))
    d = d.withColumns({"low": F.col("var") - 1.96 * F.col("stderr"), "high": F.col("var") + 1.96 * F.col("stderr"), "sqrt_time": first})
    return d.withColumn("ratio_sqrt_time", F.col("var") / F.when(F.col("sqrt_time") != 0, F.col("sqrt_time")))


def resampled_sums(returns: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], ret: str, horizons: tuple[int, ...], paths: int, seed: int = 0) -> DataFrame:
    """(keys, horizon, path, ret): sums of `horizon` returns drawn from each series with replacement. Draws meet the returns by ordinal."""
    own = returns.filter(F.col(ret).isNotNull()).withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    n = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    steps = n.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.col("horizon"))))
    at = F.floor(hashed_uniform(F.lit(seed), *[F.col(k) for k in keys], F.col("horizon"), F.col("path"), F.col("step")) * F.col("__n")) + 1
    drawn = steps.withColumn("__i", at.cast("int")).join(own.select(*keys, "__i", ret), [*keys, "__i"])
    return drawn.groupBy(*keys, "horizon", "path").agg(F.sum(F.col(ret).cast("decimal(28,18)")).cast("double").alias("ret"))
