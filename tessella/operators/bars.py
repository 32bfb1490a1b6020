"""Bars: from ticks, from finer bars, by session; their checks and coverage. All are single grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.ordering import Series, column, finite

OHLC = ("open", "high", "low", "close")


def mid_and_spread(ticks: DataFrame, bid: str = "bid", ask: str = "ask") -> DataFrame:
    b, a = F.col(bid), F.col(ask)
    return ticks.withColumns({"mid": (b + a) / 2, "spread": a - b})


def ticks_to_bars(ticks: DataFrame, freq: str, keys: tuple[str, ...] = ("symbol",), ts: str = "ts", tie: str = "tick_id", price: str = "mid", spread: str = "spread") -> DataFrame:
    """OHLC of the price in windows of `freq`, with the number of ticks and the mean spread; empty windows give no row.

    Partial aggregation runs before the shuffle, so what moves is one row per task and bar. Also fit for a streaming source.
    """
    at, p = F.struct(ts, tie), F.col(price)
    bars = ticks.groupBy(*keys, F.window(ts, freq).alias("__w")).agg(
        F.min_by(p, at).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, at).alias("close"), F.count(p).alias("volume"), F.avg(spread).alias("mean_spread")
    )
    return bars.select(*keys, F.col("__w.start").alias("ts"), *OHLC, "volume", "mean_spread")


def rebar(bars: DataFrame, bucket: Column, keys: tuple[str, ...] = ("symbol",), ts: str = "ts", out: str = "ts", positive_volume: bool = True) -> DataFrame:
    """Coarser bars: first open, highest high, lowest low, last close and summed volume of each bucket (its label, left closed)."""
    b = bars.groupBy(*keys, bucket.alias("__b")).agg(
        F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", ts).alias("close"), F.sum("volume").alias("volume")
    )
    b = b.filter("open IS NOT NULL AND close IS NOT NULL")
    if positive_volume:
        b = b.filter("volume > 0")
    return b.select(*keys, F.col("__b").alias(out), *OHLC, "volume")


def every(ts: Column | str, step: str) -> Column:
    """The start of the window of width `step` that holds ts."""
    return F.window(ts, step)["start"]


def local(ts: Column | str, zone: str) -> Column:
    """The wall clock in a zone, of an instant in UTC."""
    return F.from_utc_timestamp(column(ts), zone)


def session_end_date(ts: Column | str, zone: str = "America/New_York", cut_hour: int = 17) -> Column:
    """The date on which the session of an instant ends: the next one from cut_hour on. Wall-clock arithmetic, so the two days a
    year that change clocks keep one session."""
    return F.to_date(local(ts, zone) + F.expr(f"INTERVAL {24 - cut_hour} HOURS"))


def session_start_date(ts: Column | str, zone: str = "America/New_York", cut_hour: int = 17) -> Column:
    return F.to_date(local(ts, zone) - F.expr(f"INTERVAL {cut_hour} HOURS"))


def to_daily(bars: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "ts", zone: str = "America/New_York", cut_hour: int = 17, label: str = "start") -> DataFrame:
    """One bar per session, labelled by the date on which the session starts or ends."""
    date = (session_start_date if label == "start" else session_end_date)(ts, zone, cut_hour)
    return rebar(bars, date, keys, ts, "date", positive_volume=False)


def monthly_returns(bars: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "date", close: str = "close") -> DataFrame:
    """The last close of each month and its change on the month before that has rows."""
    m = bars.groupBy(*keys, F.trunc(F.to_date(ts), "month").alias("month")).agg(F.max_by(close, ts).alias("close"))
    last = Series(keys, ("month",)).lag("close")
    return m.withColumn("ret", F.col("close") / F.when(last != 0, last) - 1)


def hourly_utc(bars: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "ts") -> DataFrame:
    return rebar(bars, every(ts, "1 hour"), keys, ts)


def clean_intraday(bars: DataFrame, series: Series, jump: float = 0.04) -> DataFrame:
    """Bars with volume, without those whose close jumps by more than `jump` against the bar before (found once, after the
    volume filter; the first bar stays)."""
    live = bars.filter("volume > 0")
    prior = series.lag("close")
    return live.withColumn("__j", F.abs(F.col("close") / F.when(prior != 0, prior) - 1)).filter("__j IS NULL OR __j <= " + str(jump)).drop("__j")


def deduplicated(rows: DataFrame, keys: tuple[str, ...], position: str, keep: str = "last") -> DataFrame:
    """One row per key: the first or last by position (a file order)."""
    order = F.col(position).desc() if keep == "last" else F.col(position).asc()
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("__r = 1").drop("__r")


def intraday_coverage(bars: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "ts", zone: str = "America/New_York") -> DataFrame:
    """Bars, sessions, span, share with volume, median ticks and bars per session."""
    c = bars.withColumn("__s", session_end_date(ts, zone)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bars"), F.count_distinct("__s").alias("sessions"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.avg((F.col("volume") > 0).cast("double")).alias("volume_positive"), F.percentile("volume", F.lit(0.5)).alias("median_ticks"),
    )
    return c.withColumn("bars_per_session", F.col("bars") / F.col("sessions"))


def coverage(prices: DataFrame, keys: tuple[str, ...] = ("symbol",), date: str = "date") -> DataFrame:
    """First and last date and rows of each instrument, and whether its start binds the aligned sample (the latest start)."""
    c = prices.groupBy(*keys).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count(F.lit(1)).alias("n_rows"))
    latest = c.agg(F.max_by(F.struct(*keys), F.struct("first_date", *keys)).alias("__b"))
    hit = None
    for k in keys:
        e = F.col(k) == F.col(f"__b.{k}")
        hit = e if hit is None else hit & e
    return c.join(F.broadcast(latest)).select(*c.columns, hit.alias("binding"))  # one row is broadcast


def aligned_dates(prices: DataFrame, instruments: int, key: str = "symbol", date: str = "date") -> DataFrame:
    """The dates on which every instrument has a price."""
    return prices.groupBy(date).agg(F.count_distinct(key).alias("__n")).filter(F.col("__n") == instruments).select(date)


def panel(prices: DataFrame, symbols: list[str], value: str = "close", key: str = "symbol", date: str = "date") -> DataFrame:
    """The wide panel: one column per symbol over the union of their dates. A symbol without rows raises."""
    prices = prices.where(F.col(key).isin(symbols))
    missing = set(symbols) - {r[0] for r in prices.select(key).distinct().collect()}
    if missing:
        raise ValueError(f"no rows for {sorted(missing)}")
    return prices.groupBy(date).pivot(key, symbols).agg(F.first(value, ignorenulls=True))


#: What a bar must not do, by name.
SANITY = {
    "high_below_low": "high < low",
    "high_misses_open_close": "high < greatest(open, close)",
    "low_misses_open_close": "low > least(open, close)",
    "close_not_positive": "close <= 0",
    "negative_volume": "volume < 0",
}


def sanity(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """How many bars break each rule; an empty table has no rows to count and gives none."""
    return bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.expr(rule)).alias(name) for name, rule in SANITY.items()])


def log_returns(prices: DataFrame, series: Series, value: str = "close", out: str = "ret", kind: str = "log") -> DataFrame:
    """Change on the series' own row before; the first row, and non-positive prices, give null."""
    if kind not in ("log", "simple"):
        raise ValueError("kind is 'log' or 'simple'")
    p = F.when(F.col(value) > 1e-12, finite(value))
    last = series.lag(p)
    return prices.withColumn(out, F.ln(p / last) if kind == "log" else p / last - 1)


def aligned_returns(prices: DataFrame, instruments: int, key: str = "symbol", date: str = "date", value: str = "close") -> DataFrame:
    """Log returns on the grid of all dates: a return needs prices on a date and on the grid's date before, and only dates on
    which all instruments have one remain."""
    dates = prices.select(date).distinct()
    # the grid's previous date by rank, so that the join below needs no window over a filled grid
    numbered = dates.withColumn("__d", F.dense_rank().over(Window.orderBy(date)))
    p = prices.filter(F.col(value) > 1e-12).join(numbered, date)
    w = Window.partitionBy(key).orderBy("__d")
    r = p.withColumn("ret", F.when(F.lag("__d").over(w) == F.col("__d") - 1, F.ln(F.col(value) / F.lag(value).over(w)))).filter("ret IS NOT NULL")
    full = Window.partitionBy(date)
    return r.withColumn("__n", F.count(F.lit(1)).over(full)).filter(F.col("__n") == instruments).select(date, key, "ret")
