"""Trailing, prior, cumulative and expanding windows over bars. A frame short of its rows gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.ordering import Series, at_least, finite, ratio
from tessella.functions.scalars import typical_price


def require_volume(bars: DataFrame, volume: str = "volume") -> None:
    """A volume-weighted price without any volume would be mislabelled: raise."""
    if not bars.filter(F.col(volume) > 0).head(1):
        raise ValueError("volume is zero on every bar, so the VWAP is undefined")


def price_of(bars: DataFrame) -> Column:
    return typical_price(F.col("high"), F.col("low"), F.col("close"))


def rolling_vwap(bars: DataFrame, series: Series, window: int = 20, volume: str = "volume", out: str = "vwap") -> DataFrame:
    """Typical price weighted by volume over the last `window` bars."""
    w = series.trail(window)
    return bars.withColumn(out, at_least(ratio(F.sum(price_of(bars) * F.col(volume)).over(w), F.sum(volume).over(w)), F.col(volume), w, window))


def rolling_vwap_or_twap(bars: DataFrame, series: Series, window: int = 20, volume: str = "volume") -> DataFrame:
    """The same by tick counts, with `kind` = vwap; where a series has no counts at all, the plain mean, with `kind` = twap."""
    w = series.trail(window)
    live = F.coalesce(F.max(volume).over(Window.partitionBy(*series.keys)), F.lit(0)) > 0
    p, v = price_of(bars), F.col(volume)
    vwap = at_least(ratio(F.sum(p * v).over(w), F.sum(v).over(w)), v, w, window)
    twap = at_least(F.avg(p).over(w), p, w, window)
    return bars.withColumns({"vwap": F.when(live, vwap).otherwise(twap), "kind": F.when(live, "vwap").otherwise("twap")})


def session_vwap(bars: DataFrame, series: Series, session: str = "session", volume: str = "volume", out: str = "vwap") -> DataFrame:
    """Cumulative from the session's start, with the current bar."""
    w = Series((*series.keys, session), series.order).upto()
    return bars.withColumn(out, ratio(F.sum(price_of(bars) * F.col(volume)).over(w), F.sum(volume).over(w)))


def vwap_summary(frame: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Observations, share of closes above the vwap, mean absolute deviation and its extremes."""
    d = F.col("deviation")
    return frame.filter("deviation IS NOT NULL").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"), F.avg((d > 0).cast("double")).alias("share_above"), F.avg(F.abs(d)).alias("mean_abs_deviation"), F.min(d).alias("min_deviation"), F.max(d).alias("max_deviation")
    )


def rolling_sharpe(df: DataFrame, series: Series, ret: str, window: int = 126, periods: int = 252, rf: float = 0.0, out: str = "sharpe") -> DataFrame:
    """Mean over deviation of the excess return, annualised; null where the deviation is 0."""
    w, x = series.trail(window), F.col(ret) - F.lit((1 + rf) ** (1 / periods) - 1)
    return df.withColumn(out, at_least(ratio(F.avg(x).over(w), F.stddev_samp(x).over(w)) * F.lit(periods**0.5), x, w, window))


def quant_metrics(df: DataFrame, series: Series, ret: str, window: int = 126, periods: int = 252, rf: float = 0.0) -> DataFrame:
    """The stand-alone variant: arithmetic risk-free rate, deviation of raw returns, and the 5 % quantile as a loss."""
    w, r = series.trail(window), F.col(ret)
    sharpe = ratio(F.avg(r - F.lit(rf / periods)).over(w), F.stddev_samp(r).over(w)) * F.lit(periods**0.5)
    return df.withColumns({"sharpe": at_least(sharpe, r, w, window), "var_95": at_least(-F.percentile(r, F.lit(0.05)).over(w), r, w, window)})


def rolling_historical_var(df: DataFrame, series: Series, ret: str, confidence: float = 0.99, window: int = 500, out: str = "var") -> DataFrame:
    """The loss quantile of the `window` rows before."""
    w = series.prev(window)
    return df.withColumn(out, at_least(-F.percentile(F.col(ret), F.lit(1 - confidence)).over(w), F.col(ret), w, window))


def rolling_normal_var(df: DataFrame, series: Series, ret: str, z: float, window: int = 500, out: str = "var") -> DataFrame:
    """-(mean + z * deviation) of the `window` rows before; z is negative."""
    w = series.prev(window)
    return df.withColumn(out, at_least(-(F.avg(ret).over(w) + F.lit(z) * F.stddev_samp(ret).over(w)), F.col(ret), w, window))


def prior_extremes(bars: DataFrame, series: Series, lookback: int = 20, high: str = "high", low: str = "low") -> DataFrame:
    """hi_prev and lo_prev: highest high and lowest low of the `lookback` bars before."""
    w = series.prev(lookback)
    return bars.withColumns({"hi_prev": at_least(F.max(high).over(w), F.col(high), w, lookback), "lo_prev": at_least(F.min(low).over(w), F.col(low), w, lookback)})


def trailing_rank(df: DataFrame, series: Series, value: str, window: int = 500, least: int = 200, out: str = "rank") -> DataFrame:
    """The share of the window's earlier rows that are below the current value (nulls count in the denominator only)."""
    w = series.trail(window)
    d = df.withColumns({"__w": F.collect_list(value).over(series.prev(window - 1)), "__n": F.count(F.lit(1)).over(w), "__c": F.count(value).over(w)})
    below = F.size(F.filter("__w", lambda x: x < F.col(value)))
    return d.withColumn(out, F.when((F.col("__c") >= least) & F.col(value).isNotNull(), ratio(below, F.col("__n") - 1))).drop("__w", "__n", "__c")


def rolling_median(x: Column, frame, least: int) -> Column:
    return at_least(F.percentile(x, F.lit(0.5)).over(frame), x, frame, least)


def activity(bars: DataFrame, series: Series, window: int = 12, out: str = "activity") -> DataFrame:
    """The median volume of the bars before, over the series' own median. That one is of the full sample: not causal."""
    v = F.col("volume").cast("double")
    whole = F.percentile(v, F.lit(0.5)).over(Window.partitionBy(*series.keys))
    return bars.withColumn(out, ratio(rolling_median(v, series.prev(window), max(2, window // 3)), whole))


#: 3 - 2 * sqrt(2), of the high-low spread estimator.
K = 3 - 2 * 2**0.5


def corwin_schultz(bars: DataFrame, series: Series, session: str | None = "session", out: str = "spread") -> DataFrame:
    """The high-low spread estimate from two bars, not below 0; null on a session's first bar."""
    h, low = F.col("high"), F.col("low")
    ph, pl = series.lag("high"), series.lag("low")
    beta = F.pow(F.ln(h / low), F.lit(2.0)) + F.pow(F.ln(ph / pl), F.lit(2.0))
    gamma = F.pow(F.ln(F.greatest(h, ph) / F.least(low, pl)), F.lit(2.0))
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / K - F.sqrt(gamma / K)
    s = F.greatest(F.lit(0.0), 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha)))
    valid = ph.isNotNull()
    if session:
        valid = valid & (series.lag(session) == F.col(session))
    return bars.withColumn(out, F.when(valid, s))


def smoothed_spread(bars: DataFrame, series: Series, window: int = 12, spread: str = "spread", out: str = "smoothed") -> DataFrame:
    return bars.withColumn(out, rolling_median(F.col(spread), series.prev(window), max(2, window // 3)))


def wide_spread(bars: DataFrame, series: Series, multiple: float = 3.0, trailing: int = 2000, least: int = 200, value: str = "smoothed", out: str = "wide") -> DataFrame:
    """Whether the spread is above `multiple` times its trailing median."""
    med = rolling_median(F.col(value), series.trail(trailing), least)
    return bars.withColumn("__m", med).withColumn(out, F.coalesce(F.col(value) > multiple * F.col("__m"), F.lit(False))).drop("__m")


def activity_cost(bars: DataFrame, series: Series, base_bp: float = 1.0, cap: float = 10.0, power: float = 0.5, value: str = "activity", out: str = "cost_bp") -> DataFrame:
    """Cost that rises as activity falls, bounded by cap, so scaled that the median bar pays base_bp; base_bp where unknown."""
    if base_bp <= 0 or cap < 1 or not 0 < power <= 2:
        raise ValueError("base_bp > 0, cap >= 1 and 0 < power <= 2")
    m = F.pow(F.lit(1.0) / F.greatest(F.col(value), F.lit(1e-9)), F.lit(power))
    m = F.when(F.col(value).isNotNull(), F.greatest(F.lit(1 / cap), F.least(F.lit(cap), m)))
    d = bars.withColumn("__m", m).withColumn("__med", F.percentile("__m", F.lit(0.5)).over(Window.partitionBy(*series.keys)))
    scaled = F.when(F.col("__med") > 0, F.col("__m") / F.col("__med")).otherwise(F.col("__m"))
    return d.withColumn(out, F.coalesce(F.lit(base_bp) * F.least(scaled, F.lit(cap)), F.lit(base_bp))).drop("__m", "__med")


def quantile_gates(df: DataFrame, series: Series, sigma: str, var: str, window: int = 2000, low: float = 0.2, high: float = 0.8, cap: float = 0.9) -> DataFrame:
    """g_regime: sigma between its trailing quantiles; g_var: the VaR below its own."""
    w, least = series.trail(window), window // 4
    q = lambda c, p: at_least(F.percentile(F.col(c), F.lit(p)).over(w), F.col(c), w, least)
    d = df.withColumns({"__lo": q(sigma, low), "__hi": q(sigma, high), "__cap": q(var, cap)})
    inside = (F.col(sigma) >= F.col("__lo")) & (F.col(sigma) <= F.col("__hi"))
    return d.withColumns({"g_regime": F.coalesce(inside, F.lit(False)), "g_var": F.coalesce(F.col(var) <= F.col("__cap"), F.lit(False))}).drop("__lo", "__hi", "__cap")


def expanding_median(df: DataFrame, series: Series, value: str, least: int = 250, out: str = "median") -> DataFrame:
    return df.withColumn(out, rolling_median(F.col(value), series.upto(), least))


def vol_target_stake(sigma: Column, median: Column, low: float = 0.25, high: float = 4.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), ratio(median, sigma)))


def recent_nonzero(df: DataFrame, series: Series, value: str, bars: int = 12, out: str = "recent") -> DataFrame:
    """The last value other than 0 within the last `bars` rows and this one, else 0."""
    x = F.last(F.when(F.col(value) != 0, F.col(value)), ignorenulls=True).over(series.window().rowsBetween(-bars, 0))
    return df.withColumn(out, F.coalesce(x, F.lit(0.0)))


def open_drive(df: DataFrame, series: Series, hour: int, ts: Column, logret: str, session: str = "session", out: str = "drive") -> DataFrame:
    """From the session's bar that starts at `hour` on, that bar's return; null before."""
    w = Series((*series.keys, session), series.order).upto()
    return df.withColumn(out, F.last(F.when((F.hour(ts) == hour) & (F.minute(ts) == 0), F.col(logret)), ignorenulls=True).over(w))


def prior_poc(df: DataFrame, series: Series, session: str = "session", out: str = "poc") -> DataFrame:
    """The close of the previous session's bar with most volume (the first of equals)."""
    first = F.struct(F.col("volume").alias("v"), (-F.unix_micros(F.col(series.order[0]).cast("timestamp"))).alias("o"))
    s = df.groupBy(*series.keys, session).agg(F.max_by("close", first).alias("__poc"))
    s = s.withColumn(out, Series(series.keys, (session,)).lag("__poc")).drop("__poc")
    return df.join(s, [*series.keys, session], "left")


def research_features(bars: DataFrame, series: Series, hour: Column, minute_ts: Column, lam: float = 0.97) -> DataFrame:
    """Eight features of hourly bars, each known at the bar's close: momentum of 1, 4 and 24 bars and the distances to the session's
    vwap and the last session's point of control in units of sigma, signed relative volume, and the London and New York drives."""
    from tessella.operators.ewm import ewma_sigma

    d = bars.withColumn("lr", F.ln(F.col("close") / series.lag("close")))
    d = ewma_sigma(d, series, "lr", lam, "sigma", shift=False)
    d = session_vwap(d, series)
    d = prior_poc(d, series)
    d = open_drive(d, series, 3, minute_ts, "lr", out="ldn_drive")
    d = open_drive(d, series, 9, minute_ts, "lr", out="ny_drive")
    total = lambda n: at_least(F.sum("lr").over(series.trail(n)), F.col("lr"), series.trail(n), n)
    med = rolling_median(F.col("volume").cast("double"), series.trail(120), 60)
    d = d.withColumns({"__m4": total(4), "__m24": total(24), "__med": med})
    return d.withColumns({
        "mom_1h": finite(ratio(F.col("lr"), F.col("sigma"))),
        "mom_4h": finite(ratio(F.col("__m4"), F.col("sigma"))),
        "mom_24h": finite(ratio(F.col("__m24"), F.col("sigma"))),
        "vwap_rev": finite(ratio(ratio(F.col("close"), F.col("vwap")) - 1, F.col("sigma"))),
        "flow_proxy": finite(F.signum("lr") * ratio(F.col("volume").cast("double"), F.col("__med"))),
        "poc_rev": finite(ratio(ratio(F.col("close"), F.col("poc")) - 1, F.col("sigma"))),
    }).drop("__m4", "__m24", "__med")


def running_drawdown(df: DataFrame, series: Series, value: str, out: str = "drawdown") -> DataFrame:
    """The running sum against its own peak so far."""
    d = df.withColumn("__s", F.sum(value).over(series.upto()))
    return d.withColumn(out, F.col("__s") - F.max("__s").over(series.upto())).drop("__s")


def forward_returns(df: DataFrame, series: Series, horizons: tuple[int, ...] = (1, 4, 24), close: str = "close") -> DataFrame:
    """fwd_h: the log change to the close h bars on; null near the end."""
    return df.withColumns({f"fwd_{h}": F.ln(series.lead(close, h) / F.col(close)) for h in horizons})


