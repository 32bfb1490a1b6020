"""Exponentially weighted recursions, computed in parallel along a series.

A recursion y[t] = a[t] * y[t-1] + b[t] is a chain of affine maps, and affine maps compose. Rows of a series are cut into
blocks; inside a block the recursion from 0 and the product of the a's come from windows; one summary per block is folded in
order (in two levels, so that the folded arrays stay short); the carry into each block then finishes its rows. So a long
series does not run through one sequential fold, and everything stays in built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.ordering import Series, column, ratio

#: Rows of a block. The product of a block's a's divides, so it must not underflow: 1e-4 ** 64 is still far from that.
BLOCK = 64


def carries(summaries: DataFrame, keys: tuple[str, ...], level: str, block: int, width: int) -> DataFrame:
    """(keys, level, carry): the states before each block, from rows (keys, level, A, B); B and the carry are arrays of `width`."""
    nothing = F.array().cast("array<struct<k:bigint,c:array<double>>>")
    after = lambda y, x: F.zip_with(x.B, y, lambda b, v: x.A * v + b)
    step = lambda s, x: F.struct(after(s.y, x).alias("y"), F.concat(s.out, F.array(F.struct(x.k.alias("k"), s.y.alias("c")))).alias("out"))
    rows = F.sort_array(F.collect_list(F.struct(F.col(level).alias("k"), "A", "B")))
    groups = summaries.groupBy(*keys, F.floor(F.col(level) / block).alias("__g")).agg(rows.alias("r"))
    # the map of a whole group, then the states before each group, then inside the groups
    zeros = F.array(*[F.lit(0.0)] * width)
    whole = F.reduce("r", F.struct(F.lit(1.0).alias("A"), zeros.alias("B")), lambda s, x: F.struct((s.A * x.A).alias("A"), after(s.B, x).alias("B")))
    groups = groups.withColumn("__m", whole)
    over = groups.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("__g").alias("k"), F.col("__m.A").alias("A"), F.col("__m.B").alias("B")))).alias("r"))
    start = F.struct(zeros.alias("y"), nothing.alias("out"))
    outer = over.select(*keys, F.explode(F.reduce("r", start, step, lambda s: s.out)).alias("o")).select(*keys, F.col("o.k").alias("__g"), F.col("o.c").alias("__c"))
    inner = groups.join(outer, [*keys, "__g"])
    from_carry = F.struct(F.col("__c").alias("y"), nothing.alias("out"))
    return inner.select(*keys, F.explode(F.reduce("r", from_carry, step, lambda s: s.out)).alias("o")).select(*keys, F.col("o.k").alias(level), F.col("o.c").alias("__carry"))


def affine_scan(df: DataFrame, series: Series, a: Column, b: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """For each out, b of the dictionary a column out with out[t] = a[t] * out[t-1] + b[t], out[-1] = 0; recursions with one `a` run
    together. The a must be positive, and min(a) ** block above 1e-300; the first row's a has no effect."""
    keys, names = series.keys, list(b)
    inputs = {f"__b{k}": c for k, c in enumerate(b.values())}
    rows = df.withColumns({"__a": a, "__i": F.row_number().over(series.window()) - 1} | inputs)
    rows = rows.withColumn("__blk", F.floor(F.col("__i") / block))
    inside = Window.partitionBy(*keys, "__blk").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__p", F.exp(F.sum(F.ln("__a")).over(inside)))
    rows = rows.withColumns({f"__y{k}": F.col("__p") * F.sum(F.col(c) / F.col("__p")).over(inside) for k, c in enumerate(inputs)})
    at = F.max_by(F.struct("__p", F.array(*[f"__y{k}" for k in range(len(names))]).alias("y")), "__i")
    ends = rows.groupBy(*keys, "__blk").agg(at.alias("__e")).select(*keys, "__blk", F.col("__e.__p").alias("A"), F.col("__e.y").alias("B"))
    done = rows.join(carries(ends, keys, "__blk", block, len(names)), [*keys, "__blk"])
    done = done.withColumns({n: F.col(f"__y{k}") + F.col("__p") * F.col("__carry")[k] for k, n in enumerate(names)})
    return done.drop("__a", "__i", "__blk", "__p", "__carry", *inputs, *[f"__y{k}" for k in range(len(names))])


def ewm_means(df: DataFrame, series: Series, values: dict[str, Column], alpha: float, min_periods: int = 1) -> DataFrame:
    """Recursive exponentially weighted means, by name, of columns that are null on the same rows.

    A mean starts at the first value; a null keeps the state and lets its weight decay, so the value after a gap of g nulls weighs
    alpha / ((1 - alpha) ** (g + 1) + alpha). Null before `min_periods` values.
    """
    if not 0 < alpha <= 0.9999:
        raise ValueError("alpha must be above 0 and at most 0.9999")
    names = {n: f"__x{k}" for k, n in enumerate(values)}
    d = df.withColumns({names[n]: c for n, c in values.items()})
    there = F.col("__x0").isNotNull()
    d = d.withColumn("__row", F.row_number().over(series.window()))
    d = d.withColumns({"__n": F.count("__x0").over(series.upto()), "__last": F.max(F.when(there, F.col("__row"))).over(series.before())})
    gap = F.col("__row") - F.col("__last")
    old = F.pow(F.lit(1 - alpha), gap)
    weight = F.when((F.col("__n") == 1) & there, F.lit(1.0)).when(gap == 1, F.lit(alpha)).otherwise(F.lit(alpha) / (old + alpha))
    keep = F.when(gap == 1, F.lit(1 - alpha)).otherwise(old / (old + alpha))
    a = F.when(there & (F.col("__n") > 1), keep).otherwise(F.lit(1.0))
    done = affine_scan(d, series, a, {n: F.when(there, weight * F.col(x)).otherwise(F.lit(0.0)) for n, x in names.items()})
    return done.withColumns({n: F.when(F.col("__n") >= min_periods, F.col(n)) for n in names}).drop("__row", "__n", "__last", *names.values())


def ewm_mean(df: DataFrame, series: Series, value: Column | str, alpha: float, out: str, min_periods: int = 1) -> DataFrame:
    return ewm_means(df, series, {out: column(value)}, alpha, min_periods)


def ema(df: DataFrame, series: Series, value: Column | str, span: int, out: str = "ema") -> DataFrame:
    return ewm_mean(df, series, value, 2 / (span + 1), out)


def ewma_sigma(df: DataFrame, series: Series, ret: Column | str, lam: float = 0.94, out: str = "sigma", shift: bool = True) -> DataFrame:
    """Root of the exponentially weighted mean of squared returns; shifted, it knows the rows before only."""
    d = ewm_mean(df, series, F.pow(column(ret), F.lit(2.0)), 1 - lam, "__v")
    s = F.sqrt("__v")
    return d.withColumn(out, series.lag(s) if shift else s).drop("__v")


def true_range(high: Column, low: Column, last_close: Column) -> Column:
    """The largest of the bar's range and its distances to the last close, nulls skipped."""
    return F.greatest(high - low, F.abs(high - last_close), F.abs(low - last_close))


def atr(df: DataFrame, series: Series, period: int = 14, out: str = "atr") -> DataFrame:
    """The average true range with weight 1 / period, from `period` bars on, of the bars before."""
    d = df.withColumn("__tr", true_range(F.col("high"), F.col("low"), series.lag("close")))
    d = ewm_mean(d, series, "__tr", 1 / period, "__atr", min_periods=period)
    return d.withColumn(out, series.lag("__atr")).drop("__tr", "__atr")


def vwap_ema(df: DataFrame, series: Series, vwap: str = "vwap", span: int = 20) -> DataFrame:
    """ema of the vwap, the close's deviation from the vwap, and the gap of ema to vwap."""
    d = ema(df, series, vwap, span, "ema")
    return d.withColumns({"deviation": ratio(F.col("close"), F.col(vwap)) - 1, "ema_gap": ratio(F.col("ema"), F.col(vwap)) - 1})


def gap_signal(df: DataFrame, series: Series, gap: str = "ema_gap", out: str = "signal") -> DataFrame:
    """The sign of the gap on the row before; 0 where it is unknown."""
    return df.withColumn(out, F.coalesce(series.lag(F.coalesce(F.signum(gap), F.lit(0.0))), F.lit(0.0)))


def ewma_variance(df: DataFrame, series: Series, ret: str, lam: float = 0.94, warmup: int = 30, out: str = "variance") -> DataFrame:
    """The variance known before each row: it starts as the sample variance of the first `warmup` rows, is null in them, and a
    null return leaves it as it is."""
    seed = F.var_samp(F.when(F.col("__row") <= warmup, F.col(ret))).over(Window.partitionBy(*series.keys))
    d = df.withColumn("__row", F.row_number().over(series.window())).withColumn("__seed", seed)
    # row warmup + 1 has the seed; later ones take in the return of the row before
    last = series.lag(ret)
    at = F.col("__row") - 1 - warmup
    d = d.withColumn("__prev", last)
    a = F.when((at <= 0) | F.col("__prev").isNull(), F.lit(1.0)).otherwise(F.lit(lam))
    b = F.when(at < 0, F.lit(0.0)).when(at == 0, F.col("__seed")).when(F.col("__prev").isNull(), F.lit(0.0)).otherwise(F.lit(1 - lam) * F.col("__prev") * F.col("__prev"))
    done = affine_scan(d, series, a, {out: b})
    return done.withColumn(out, F.when(F.col("__row") > warmup, F.col(out))).drop("__row", "__seed", "__prev")


def pair_products(panel: DataFrame, date: str = "date", asset: str = "asset", ret: str = "ret", diagonal: bool = True) -> DataFrame:
    """(date, asset_i, asset_j, x): the products of returns of each pair of assets on a date. Assets are the few columns of a
    panel; the join is on the date."""
    other = panel.select(date, F.col(asset).alias("asset_j"), F.col(ret).alias("__rj"))
    pairs = panel.select(date, F.col(asset).alias("asset_i"), F.col(ret).alias("__ri")).join(other, date)
    keep = F.col("asset_i") <= F.col("asset_j") if diagonal else F.col("asset_i") < F.col("asset_j")
    return pairs.filter(keep).withColumn("x", F.col("__ri") * F.col("__rj"))


def ewma_covariance(panel: DataFrame, lam: float = 0.94, warmup: int = 30, date: str = "date", asset: str = "asset", ret: str = "ret") -> DataFrame:
    """The covariance path: each element is a recursion of its own on the product of two returns, started at the sample covariance
    of the first `warmup` dates and known before the date. (date, asset_i, asset_j, value)"""
    pairs = pair_products(panel, date, asset, ret)
    series = Series(("asset_i", "asset_j"), (date,))
    every = Window.partitionBy(*series.keys)
    d = pairs.withColumn("__row", F.row_number().over(series.window()))
    early = F.col("__row") <= warmup
    d = d.withColumn("__seed", F.covar_samp(F.when(early, F.col("__ri")), F.when(early, F.col("__rj"))).over(every)).withColumn("__prev", series.lag("x"))
    at = F.col("__row") - 1 - warmup
    a = F.when(at <= 0, F.lit(1.0)).otherwise(F.lit(lam))
    b = F.when(at < 0, F.lit(0.0)).when(at == 0, F.col("__seed")).otherwise(F.lit(1 - lam) * F.col("__prev"))
    done = affine_scan(d, series, a, {"value": b})
    return done.filter(F.col("__row") > warmup).select(date, "asset_i", "asset_j", "value")


def ewma_covariance_last(panel: DataFrame, lam: float = 0.94, warmup: int = 30, date: str = "date", asset: str = "asset", ret: str = "ret") -> DataFrame:
    """The covariance after all rows, in closed form: a weighted sum, without any recursion."""
    pairs = pair_products(panel, date, asset, ret)
    keys = ("asset_i", "asset_j")
    d = pairs.withColumns({"__row": F.row_number().over(Window.partitionBy(*keys).orderBy(date)), "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    early = F.col("__row") <= warmup
    weight = F.lit(1 - lam) * F.pow(F.lit(lam), F.col("__n") - F.col("__row"))
    seed = F.covar_samp(F.when(early, F.col("__ri")), F.when(early, F.col("__rj")))
    value = F.pow(F.lit(lam), F.max("__n") - warmup) * seed + F.sum(F.when(~early, weight * F.col("x")).otherwise(0.0))
    return d.groupBy(*keys).agg(value.alias("value"))


def ewma_correlation_path(panel: DataFrame, lam: float = 0.97, date: str = "date", asset: str = "asset", ret: str = "ret") -> DataFrame:
    """(date, asset_i, asset_j, rho) for i < j: the ratio of three recursions, clipped to [-1, 1], of the dates before."""
    pairs = pair_products(panel, date, asset, ret, diagonal=False)
    s = Series(("asset_i", "asset_j"), (date,))
    d = ewm_means(pairs, s, {"__cij": F.col("x"), "__cii": F.col("__ri") * F.col("__ri"), "__cjj": F.col("__rj") * F.col("__rj")}, 1 - lam)
    rho = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio(F.col("__cij"), F.sqrt(F.col("__cii") * F.col("__cjj")))))
    return d.withColumn("rho", s.lag(rho)).select(date, "asset_i", "asset_j", "rho")
