"""Scenario replay and hypothetical shocks; correlation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.ordering import Series, ratio
from tessella.operators.joins import in_ranges
from tessella.operators.performance import drawdowns


def replay(returns: DataFrame, weights: DataFrame, scenarios: DataFrame, rescale_missing: bool = True, date: str = "date", asset: str = "asset", ret: str = "ret") -> DataFrame:
    """Every scenario (key, start, end) against a fixed portfolio, in one plan: total return, worst day and its date, annualised
    volatility, maximum drawdown, days, coverage and missing assets. Scenarios without data give no row.

    Scenarios and weights are dimensions of a few rows and are broadcast.
    """
    w = weights.select(F.col("asset").alias(asset), "weight")
    hit = in_ranges(returns.filter(F.col(ret).isNotNull()), scenarios, date, "start", "end")
    there = hit.select("key", asset).distinct().join(F.broadcast(w), asset)
    total = w.agg(F.sum("weight").alias("all"), F.collect_set(asset).alias("assets"))
    cover = there.groupBy("key").agg(F.sum("weight").alias("got"), F.collect_set(asset).alias("have")).join(F.broadcast(total))
    scale = F.when(F.col("got") > 0, 1 / F.col("got")).otherwise(1.0) if rescale_missing else F.lit(1.0)
    cover = cover.select("key", ratio(F.col("got"), F.col("all")).alias("coverage"), scale.alias("__k"), F.sort_array(F.array_except("assets", "have")).alias("missing"))
    daily = hit.join(F.broadcast(w), asset).groupBy("key", date).agg(F.sum(F.col("weight") * F.col(ret)).alias("__p"))
    daily = daily.join(F.broadcast(cover), "key").withColumn("port", F.col("__p") * F.col("__k"))
    d = drawdowns(daily, Series(("key",), (date,)), "port")
    return d.groupBy("key").agg(
        (F.product(1 + F.col("port")) - 1).alias("total_return"), F.min("port").alias("worst_day"), F.min_by(date, F.struct("port", date)).alias("worst_date"),
        (F.stddev_samp("port") * F.lit(252**0.5)).alias("volatility"), F.min("drawdown").alias("max_drawdown"), F.count(F.lit(1)).alias("n_days"),
        F.first("coverage").alias("coverage"), F.array_join(F.first("missing"), ",").alias("missing"),
    )


def stress_vs_var(results: DataFrame, var: float) -> DataFrame:
    """The worst day as a multiple of a VaR, and whether it broke it; worst first."""
    loss = -F.col("worst_day")
    return results.select("key", "worst_day", (loss / F.lit(var)).alias("multiple"), (loss > var).alias("breach")).orderBy(F.col("multiple").desc())


def hypothetical_shock(weights: DataFrame, shocks: DataFrame) -> DataFrame:
    """The weighted sum of shocks; an asset without one stays."""
    return weights.join(shocks, "asset", "left").agg(F.sum(F.col("weight") * F.coalesce("shock", F.lit(0.0))).alias("loss"))


def sample_correlation(panel: DataFrame, date: str = "date", asset: str = "asset", ret: str = "ret") -> DataFrame:
    """(asset_i, asset_j, n, covariance, correlation) for i <= j over common dates."""
    a, b = panel.select(date, F.col(asset).alias("asset_i"), F.col(ret).alias("x")), panel.select(date, F.col(asset).alias("asset_j"), F.col(ret).alias("y"))
    d = a.join(b, date).filter("asset_i <= asset_j")
    return d.groupBy("asset_i", "asset_j").agg(F.count(F.lit(1)).alias("n_obs"), F.covar_samp("x", "y").alias("covariance"), F.corr("x", "y").alias("correlation"))


def pairwise_table(paths: DataFrame, sample: DataFrame, date: str = "date", rho: str = "rho") -> DataFrame:
    """A correlation path's last, mean, least and largest value and its drift from the sample's, by pair; widest range first."""
    p = paths.filter(F.col(rho).isNotNull()).groupBy("asset_i", "asset_j").agg(F.max_by(rho, date).alias("last"), F.avg(rho).alias("mean"), F.min(rho).alias("min"), F.max(rho).alias("max"))
    d = p.join(sample.select("asset_i", "asset_j", F.col("correlation").alias("sample")), ["asset_i", "asset_j"])
    return d.withColumns({"range": F.col("max") - F.col("min"), "drift": F.col("last") - F.col("sample")}).orderBy(F.col("range").desc())


def dynamic_pairs(dynamic: DataFrame, weighted: DataFrame, sample: DataFrame, date: str = "date", rho: str = "rho") -> DataFrame:
    """The pair table with its dynamic columns: the sample's and the exponentially weighted correlation and the drift from one to the other,
    and the last, mean, least and largest value of a dynamic path; widest range first. weighted is a path too, its last value counts."""
    path = dynamic.filter(F.col(rho).isNotNull()).groupBy("asset_i", "asset_j").agg(F.max_by(rho, date).alias("last"), F.avg(rho).alias("mean"), F.min(rho).alias("min"), F.max(rho).alias("max"))
    end = weighted.filter(F.col(rho).isNotNull()).groupBy("asset_i", "asset_j").agg(F.max_by(rho, date).alias("ewma"))
    pairs = ["asset_i", "asset_j"]
    d = path.join(end, pairs).join(sample.select(*pairs, F.col("correlation").alias("sample")), pairs)
    return d.withColumns({"range": F.col("max") - F.col("min"), "drift": F.col("ewma") - F.col("sample")}).orderBy(F.col("range").desc(), *pairs)


def correlation_stress(panel: DataFrame, paths: DataFrame, quantile: float = 0.05, date: str = "date", ret: str = "ret", rho: str = "rho") -> DataFrame:
    """Mean path correlation on the worst share of dates (by the equal-weight mean return) and on all others, by pair."""
    mean = panel.groupBy(date).agg(F.avg(ret).alias("__m")).join(paths.filter(F.col(rho).isNotNull()).select(date).distinct(), date)
    cut = mean.agg(F.percentile("__m", F.lit(quantile)).alias("__q"))
    days = mean.join(F.broadcast(cut)).select(date, (F.col("__m") <= F.col("__q")).alias("__bad"))  # one row is broadcast
    d = paths.join(days, date)
    s = d.groupBy("asset_i", "asset_j").agg(F.avg(F.when(~F.col("__bad"), F.col(rho))).alias("calm"), F.avg(F.when(F.col("__bad"), F.col(rho))).alias("stressed"), F.count_if("__bad").alias("n_stressed"))
    return s.withColumn("increase", F.col("stressed") - F.col("calm"))


def monthly_trend_gap(trades: DataFrame, months: DataFrame) -> DataFrame:
    """Long against short results in months that rose and fell: by (symbol, month) the mean of longs minus that of shorts, then its
    correlation with and regression on the month's return."""
    cell = trades.groupBy("symbol", "month").agg(F.avg(F.when(F.col("side") > 0, F.col("net_R"))).alias("long"), F.avg(F.when(F.col("side") < 0, F.col("net_R"))).alias("short"))
    d = cell.join(months.select("symbol", "month", F.col("ret").alias("month_ret")), ["symbol", "month"]).withColumn("gap", F.col("long") - F.col("short")).filter("gap IS NOT NULL AND month_ret IS NOT NULL")
    return d.agg(F.count(F.lit(1)).alias("n_cells"), F.corr("gap", "month_ret").alias("corr"), F.regr_slope("gap", "month_ret").alias("slope"), F.regr_intercept("gap", "month_ret").alias("intercept"))


