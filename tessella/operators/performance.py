"""Performance, exposure and drawdown of return series; strategy returns; paper-trade intents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.ordering import Series, finite, ratio
from tessella.functions.scalars import slippage_bp


def sharpe(x: Column, periods: int | None = None) -> Column:
    """Mean over sample deviation; null for fewer than two rows or no deviation; annualised where periods is given."""
    s = F.when(F.count(x) >= 2, ratio(F.avg(x), F.stddev_samp(x)))
    return s * F.lit(periods**0.5) if periods else s


def sortino(x: Column, mar: float = 0.0, periods: int | None = None) -> Column:
    """Mean excess over the root mean square of the negative ones, of which there must be two."""
    e = x - F.lit(mar)
    down = F.when(e < 0, e * e)
    s = F.when(F.count(down) >= 2, ratio(F.avg(e), F.sqrt(F.avg(down))))
    return s * F.lit(periods**0.5) if periods else s


def annualised_return(x: Column, periods: int = 252) -> Column:
    """The compounded return per year; null where the whole loses everything."""
    growth = F.product(1 + x)
    return F.when(growth > 0, F.pow(growth, F.lit(float(periods)) / F.count(x)) - 1)


def annualised_volatility(x: Column, periods: int = 252) -> Column:
    return F.stddev_samp(x) * F.lit(periods**0.5)


def equity(df: DataFrame, series: Series, ret: str, out: str = "equity") -> DataFrame:
    """Compounded 1 + return; 0 from a total loss on."""
    r = F.coalesce(F.col(ret), F.lit(0.0))
    alive = F.min((r > -1).cast("int")).over(series.upto()) == 1
    return df.withColumn(out, F.when(alive, F.exp(F.sum(F.when(r > -1, F.ln(1 + r)).otherwise(0.0)).over(series.upto()))).otherwise(0.0))


def drawdowns(df: DataFrame, series: Series, ret: str, floor_at_initial: bool = False, out: str = "drawdown") -> DataFrame:
    """equity / its peak - 1. The peak is of the rows so far; floor_at_initial also counts the start at 1, so that a loss on the
    first row shows."""
    d = equity(df, series, ret, "equity")
    peak = F.max("equity").over(series.upto())
    if floor_at_initial:
        peak = F.greatest(peak, F.lit(1.0))
    return d.withColumn(out, F.when(peak > 0, F.col("equity") / peak - 1))


def performance_summary(df: DataFrame, series: Series, ret: str, rf: float = 0.0, periods: int = 252) -> DataFrame:
    """Return, volatility, Sharpe, Sortino, maximum drawdown, Calmar, hit rate, best, worst and observations by key."""
    d = drawdowns(df.withColumn("__r", finite(ret)).filter("__r IS NOT NULL"), series, "__r")
    r, per = F.col("__r"), (1 + rf) ** (1 / periods) - 1
    out = d.groupBy(*series.keys).agg(
        F.count(r).alias("n_obs"), annualised_return(r, periods).alias("annual_return"), annualised_volatility(r, periods).alias("annual_volatility"), sharpe(r - F.lit(per), periods).alias("sharpe"),
        sortino(r, per, periods).alias("sortino"), F.min("drawdown").alias("max_drawdown"), F.avg((r > 0).cast("double")).alias("hit_rate"), F.max(r).alias("best"), F.min(r).alias("worst"),
    )
    return out.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("annual_return") / F.abs("max_drawdown")))


def strategy_returns(signal: DataFrame, returns: DataFrame, series: Series, position: str = "position", ret: str = "ret", cost_per_turn: float = 0.0) -> DataFrame:
    """Inner join on keys and order; gross, turnover (the first row's own position), cost and net. The signal is used as it is:
    it must already be shifted."""
    if cost_per_turn < 0:
        raise ValueError("cost_per_turn must be non-negative")
    on = [*series.keys, *series.order]
    d = signal.select(*on, F.coalesce(position, F.lit(0.0)).alias("position")).join(returns.select(*on, F.col(ret).alias("__ret")), on)
    turn = F.abs(F.col("position") - F.coalesce(series.lag("position"), F.lit(0.0)))
    d = d.withColumns({"gross": F.col("position") * F.col("__ret"), "turnover": turn})
    d = d.withColumn("cost", F.col("turnover") * F.lit(float(cost_per_turn)))
    return d.withColumn("net", F.col("gross") - F.col("cost")).drop("__ret")


def exposure_summary(df: DataFrame, series: Series, position: str = "position") -> DataFrame:
    p = F.col(position)
    d = df.filter(p.isNotNull()).withColumn("__flip", F.coalesce(p != series.lag(position), F.lit(False)))
    share = lambda c: F.avg(c.cast("double"))
    return d.groupBy(*series.keys).agg(
        F.count(F.lit(1)).alias("observations"), share(p > 0).alias("long_share"), share(p < 0).alias("short_share"), share(p == 0).alias("flat_share"),
        (1 - share(p == 0)).alias("time_in_market"), F.count_if("__flip").alias("flips"), F.avg(F.abs(p)).alias("mean_abs_position"),
    )


def loss_attribution(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Losing days, split into those on the wrong side (gross below 0) and those lost to cost alone."""
    lose = F.col("net") < 0
    d = df.groupBy(*keys).agg(
        F.count_if(lose).alias("losing_days"), F.count_if(lose & (F.col("gross") < 0)).alias("wrong_way_days"), F.count_if(lose & (F.col("gross") >= 0)).alias("cost_only_days"),
        F.sum("cost").alias("total_cost_drag"), F.avg((F.col("position") == 0).cast("double")).alias("flat_day_share"),
    )
    return d.withColumn("cost_only_share", ratio(F.col("cost_only_days").cast("double"), F.col("losing_days")))


def drawdown_episodes(df: DataFrame, series: Series, ret: str) -> DataFrame:
    """One row per spell under water (the peak is floored at the start): start, trough, end, depth and rows."""
    d = drawdowns(df, series, ret, floor_at_initial=True)
    under = F.col("drawdown") < 0
    d = d.withColumn("__g", F.sum((~under).cast("int")).over(series.upto())).filter(under)
    at = series.order[0]
    return d.groupBy(*series.keys, "__g").agg(F.min(at).alias("start"), F.min_by(at, F.struct("drawdown", at)).alias("trough"), F.max(at).alias("end"), F.min("drawdown").alias("depth"), F.count(F.lit(1)).alias("duration_days")).drop("__g")


def drawdown_profile(df: DataFrame, series: Series, ret: str) -> DataFrame:
    """Maximum and current drawdown, longest spell and the share of rows under water, by key."""
    d = drawdowns(df, series, ret, floor_at_initial=True)
    base = d.groupBy(*series.keys).agg(
        F.min("drawdown").alias("max_drawdown"), F.max_by("drawdown", series.order[0]).alias("current_drawdown"), F.avg((F.col("drawdown") < 0).cast("double")).alias("time_under_water")
    )
    longest = drawdown_episodes(df, series, ret).groupBy(*series.keys).agg(F.max("duration_days").alias("max_duration_days"))
    return base.join(longest, list(series.keys), "left").withColumn("max_duration_days", F.coalesce("max_duration_days", F.lit(0)))


def worst_episodes(episodes: DataFrame, keys: tuple[str, ...], top: int = 5) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("depth", "start")
    return episodes.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def position_scaled_var(position: DataFrame, var: DataFrame, on: list[str]) -> DataFrame:
    """|position| times the asset's VaR."""
    return position.join(var, on).withColumn("strategy_var", F.abs("position") * F.col("var"))


def intents(signals: DataFrame, instruments: DataFrame, positions: DataFrame, key: str = "symbol", date: str = "date", unit: float = 1.0) -> DataFrame:
    """Orders that move held quantities to the last signal's target: unit times the signal, shorts cut to 0 where an instrument
    can't be sold short. Instruments are a dimension and are broadcast."""
    last = signals.groupBy(key).agg(F.max_by("signal", date).alias("signal"), F.max(date).alias("as_of"))
    d = last.join(F.broadcast(instruments.select(key, "shortable")), key).join(positions.select(key, F.col("qty").alias("held")), key, "left")
    target = F.when((F.col("signal") < 0) & ~F.col("shortable"), F.lit(0.0)).otherwise(F.col("signal") * unit)
    d = d.withColumns({"held": F.coalesce("held", F.lit(0.0)), "target": target})
    delta = F.col("target") - F.col("held")
    return d.withColumns({"delta": delta, "order_side": F.when(delta > 0, "buy").when(delta < 0, "sell"), "order_qty": F.abs(delta)})


def reconcile(log: DataFrame, orders: DataFrame, key: str = "order_id") -> DataFrame:
    """Slippage of fills against the decision's price in bp: mean, worst and count."""
    d = log.join(orders, key).withColumn("slip", slippage_bp(F.col("side"), F.col("fill"), F.col("decision")))
    return d.agg(F.count("slip").alias("fills"), F.avg("slip").alias("mean_bp"), F.max("slip").alias("worst_bp"))


