"""Price patterns: sweeps, swings, gaps, order blocks, setups and their triggers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.ordering import Series, at_least, ratio
from tessella.operators.barriers import numbered_bars
from tessella.operators.choice import first_come, greedy, option
from tessella.operators.ewm import atr, ema, ewma_sigma
from tessella.operators.joins import align_to, asof, later, median_step, shifted_to_close, touches_zone
from tessella.operators.rolling import prior_extremes, session_vwap


def with_sigma(bars: DataFrame, series: Series, lam: float = 0.94) -> DataFrame:
    """bars with `lr`, the log return, and `sigma`, its causal EWMA deviation."""
    d = bars.withColumn("lr", F.ln(F.col("close") / series.lag("close")))
    return ewma_sigma(d, series, "lr", lam)


def sweeps(bars: DataFrame, series: Series, lookback: int = 20, min_pierce: float = 0.25, close_frac: float = 0.5, lam: float = 0.94) -> DataFrame:
    """bars with sweep (1: the prior low was pierced and regained, -1: the high, 0), the level, and how many sigmas deep."""
    d = prior_extremes(with_sigma(bars, series, lam), series, lookback)
    high, low, close, sig = (F.col(c) for c in ("high", "low", "close", "sigma"))
    place = ratio(close - low, high - low)
    down, up = ratio(F.col("lo_prev") - low, sig * close), ratio(high - F.col("hi_prev"), sig * close)
    bull = (low < F.col("lo_prev")) & (close > F.col("lo_prev")) & (down >= min_pierce) & (place >= 1 - close_frac)
    bear = (high > F.col("hi_prev")) & (close < F.col("hi_prev")) & (up >= min_pierce) & (place <= close_frac)
    bull, bear = F.coalesce(bull, F.lit(False)), F.coalesce(bear, F.lit(False))
    d = d.withColumn("sweep", F.when(bull, 1.0).when(bear, -1.0).otherwise(0.0))
    return d.withColumns({"level": F.when(F.col("sweep") > 0, F.col("lo_prev")).when(F.col("sweep") < 0, F.col("hi_prev")), "pierce": F.when(F.col("sweep") > 0, down).when(F.col("sweep") < 0, up)})


def stop_beyond(entry: Column, side: Column, structural: Column, floor: Column) -> Column:
    """A stop at the structural level, at least `floor` away."""
    return entry - side * F.greatest(F.abs(entry - structural), floor)


def reversal_entries(bars: DataFrame, series: Series, lookback: int = 20, stop_sigma: float = 1.0, **options) -> DataFrame:
    """Entries at the close of sweeps, against the pierce, the stop beyond the bar; not on the first bars nor the last one."""
    d = numbered_bars(sweeps(bars, series, lookback, **options), series)
    d = d.withColumn("__next", series.lead("close"))
    d = d.filter((F.col("sweep") != 0) & (F.col("sigma") > 0) & (F.col("bar") > lookback) & F.col("__next").isNotNull())
    structural = F.when(F.col("sweep") > 0, F.col("low")).otherwise(F.col("high"))
    return d.select(*series.keys, "bar", F.col("sweep").alias("side"), F.col("close").alias("entry"), stop_beyond(F.col("close"), F.col("sweep"), structural, stop_sigma * F.col("sigma") * F.col("close")).alias("stop"))


def swings(bars: DataFrame, series: Series, k: int = 2) -> DataFrame:
    """bars with swing_low and swing_high: the last extreme that is the only one among k bars on both sides, from k bars after it
    on."""
    w = series.window().rowsBetween(-2 * k, 0)
    d = bars
    for name, col, best in (("swing_low", "low", F.min), ("swing_high", "high", F.max)):
        mid = series.lag(col, k)
        d = d.withColumns({"__mid": mid, "__all": F.collect_list(col).over(w)})
        only = (F.size("__all") == 2 * k + 1) & (F.size(F.filter("__all", lambda x: x == F.col("__mid"))) == 1)
        extreme = F.col("__mid") == (F.array_min("__all") if best is F.min else F.array_max("__all"))
        d = d.withColumn("__s", F.when(only & extreme, F.col("__mid"))).withColumn(name, F.last("__s", ignorenulls=True).over(series.upto())).drop("__mid", "__all", "__s")
    return d


def fair_value_gaps(bars: DataFrame, series: Series, min_gap_sigma: float = 0.25, lam: float = 0.94) -> DataFrame:
    """(keys, known_bar, side, lo, hi, formed_bar): three bars whose outer two leave a gap of at least min_gap_sigma sigmas; known at
    the close of the third."""
    d = numbered_bars(with_sigma(bars, series, lam), series)
    d = d.withColumns({"__h": series.lag("high", 2), "__l": series.lag("low", 2), "__m": series.lag("low", 1)})
    floor = min_gap_sigma * F.col("sigma") * F.col("__m")
    up = (F.col("__h") < F.col("low")) & (F.col("low") - F.col("__h") >= floor)
    down = (F.col("__l") > F.col("high")) & (F.col("__l") - F.col("high") >= floor)
    d = d.filter((F.col("sigma") > 0) & (up | down)).withColumn("side", F.when(up, 1.0).otherwise(-1.0))
    lo, hi = F.when(F.col("side") > 0, F.col("__h")).otherwise(F.col("high")), F.when(F.col("side") > 0, F.col("low")).otherwise(F.col("__l"))
    return d.select(*series.keys, F.col("bar").alias("known_bar"), "side", lo.alias("lo"), hi.alias("hi"), (F.col("bar") - 1).alias("formed_bar"))


def order_blocks(bars: DataFrame, series: Series, lookback: int = 20, max_scan: int = 10) -> DataFrame:
    """(keys, known_bar, side, lo, hi, formed_bar): at a close beyond the prior extreme, the last bar of the opposite colour among
    the max_scan before it (never the series' first bar)."""
    d = numbered_bars(prior_extremes(bars, series, lookback), series)
    w = series.prev(max_scan)
    candle = F.struct("bar", "low", "high")
    late = F.col("bar") > 0
    d = d.withColumns({
        "__down": F.last(F.when((F.col("close") < F.col("open")) & late, candle), ignorenulls=True).over(w),
        "__up": F.last(F.when((F.col("close") > F.col("open")) & late, candle), ignorenulls=True).over(w),
    })
    bull, bear = F.col("close") > F.col("hi_prev"), F.col("close") < F.col("lo_prev")
    side = F.when(bull, 1.0).when(bear, -1.0)
    block = F.when(bull, F.col("__down")).when(bear, F.col("__up"))
    d = d.filter(F.col("bar") > lookback).withColumns({"side": side, "__z": block}).filter("__z IS NOT NULL")
    return d.select(*series.keys, F.col("bar").alias("known_bar"), "side", F.col("__z.low").alias("lo"), F.col("__z.high").alias("hi"), F.col("__z.bar").alias("formed_bar"))


def zones(bars: DataFrame, series: Series, **options) -> DataFrame:
    """Gaps and order blocks together, with their kind."""
    return fair_value_gaps(bars, series, **options).withColumn("kind", F.lit("fvg")).unionByName(order_blocks(bars, series).withColumn("kind", F.lit("ob")))


def bias(bars: DataFrame, series: Series, span: int = 9, session: str = "session") -> DataFrame:
    """bars with bias: the side of the vwap's EMA against the session's vwap."""
    d = ema(session_vwap(bars, series, session), series, "vwap", span, "__ema")
    return d.withColumn("bias", F.coalesce(F.signum(F.col("__ema") - F.col("vwap")), F.lit(0.0))).drop("__ema")


def reclaim(bars: DataFrame, series: Series, level: Column, side: int, window: int) -> Column:
    """The first bar, from this one to `window` after, that closes back beyond a level: struct(k, close, extreme so far, sigma).
    The series' last bar is left out."""
    ahead = F.col("__ahead")
    k = F.array_position(F.transform(ahead, lambda b: b.close > level if side > 0 else b.close < level), F.lit(True))
    upto = F.slice(ahead, 1, F.greatest(k, F.lit(1)).cast("int"))
    worst = F.array_min(F.transform(upto, lambda b: b.low)) if side > 0 else F.array_max(F.transform(upto, lambda b: b.high))
    hit = F.get(ahead, (k - 1).cast("int"))
    return F.when(k > 0, F.struct((k - 1).alias("k"), hit.close.alias("close"), worst.alias("worst"), hit.sigma.alias("sigma")))


def swept_levels(bars: DataFrame, series: Series, low_level: Column, high_level: Column, window: int, stop_sigma: float, first_bar: int, kind: str) -> DataFrame:
    """Candidate entries where a level is swept and reclaimed within `window` bars, both sides: (keys, start, bar, side, entry, stop,
    level, kind). `bars` must have sigma."""
    d = numbered_bars(bars, series)
    d = d.withColumns({"__lo": low_level, "__hi": high_level, "__n": F.count(F.lit(1)).over(Window.partitionBy(*series.keys))})
    d = d.withColumn("__ahead", F.collect_list(F.struct("bar", "high", "low", "close", "sigma")).over(series.window().rowsBetween(0, window)))
    d = d.withColumn("__ahead", F.filter("__ahead", lambda b: b.bar < F.col("__n") - 1))
    d = d.filter((F.col("bar") >= first_bar) & (F.col("sigma") > 0) & (F.col("bar") < F.col("__n") - 1))
    out = None
    for side, level, swept in ((1.0, "__lo", F.col("low") < F.col("__lo")), (-1.0, "__hi", F.col("high") > F.col("__hi"))):
        s = d.filter(swept).withColumn("__r", reclaim(d, series, F.col(level), int(side), window)).filter("__r IS NOT NULL")
        stop = stop_beyond(F.col("__r.close"), F.lit(side), F.col("__r.worst"), stop_sigma * F.col("__r.sigma") * F.col("__r.close"))
        s = s.select(*series.keys, F.col("bar").alias("start"), (F.col("bar") + F.col("__r.k")).alias("bar"), F.lit(side).alias("side"), F.col("__r.close").alias("entry"), stop.alias("stop"), F.col(level).alias("level"), F.lit(kind).alias("kind"))
        out = s if out is None else out.unionByName(s)
    return out


def one_at_a_time(candidates: DataFrame, keys: tuple[str, ...], window: int) -> DataFrame:
    """The candidates that a scan meets which goes on behind each entry's bar: starts up to that bar are passed over, save the short
    side's on the very bar of a long entry."""
    # a bar has two turns, the long side's first; an entry leaves off at its own bar's other side or at the next bar
    short = F.when(F.col("side") < 0, 1).otherwise(0)
    turns = candidates.withColumns({"turn": 2 * F.col("start") + short, "next_free": 2 * F.col("bar") + 1 + short})
    return greedy(turns, keys, 2 * window + 1, "turn", "next_free").drop("turn", "next_free")


def inducement_entries(bars: DataFrame, series: Series, major: int = 20, k: int = 2, window: int = 3, stop_sigma: float = 1.0, lam: float = 0.94) -> DataFrame:
    """The nearer swing, inside the major level, is swept and reclaimed."""
    d = swings(with_sigma(bars, series, lam), series, k)
    w = series.prev(major)
    lo, hi = at_least(F.min("low").over(w), F.col("low"), w, major), at_least(F.max("high").over(w), F.col("high"), w, major)
    low_level, high_level = F.when(F.col("swing_low") > lo, F.col("swing_low")), F.when(F.col("swing_high") < hi, F.col("swing_high"))
    return one_at_a_time(swept_levels(d, series, low_level, high_level, window, stop_sigma, major + k + 1, "inducement"), series.keys, window)


def turtle_soup_entries(bars: DataFrame, series: Series, lookback: int = 20, min_age: int = 4, window: int = 3, stop_sigma: float = 1.0, require_age: bool = True, lam: float = 0.94) -> DataFrame:
    """A new extreme beyond one that is at least min_age bars old, reclaimed."""
    d = numbered_bars(with_sigma(bars, series, lam), series)
    w = series.prev(lookback)
    lows, highs = F.struct(F.col("low").alias("p"), F.col("bar").alias("b")), F.struct((-F.col("high")).alias("p"), F.col("bar").alias("b"))
    d = d.withColumns({"__pl": F.min(lows).over(w), "__ph": F.min(highs).over(w), "__c": F.count("low").over(w)})
    old = lambda c: (F.col("bar") - F.col(f"{c}.b") >= min_age) if require_age else F.lit(True)
    full = F.col("__c") == lookback
    low_level, high_level = F.when(full & old("__pl"), F.col("__pl.p")), F.when(full & old("__ph"), -F.col("__ph.p"))
    return one_at_a_time(swept_levels(d, series, low_level, high_level, window, stop_sigma, lookback + 1, "turtle_soup"), series.keys, window)


def retrace_setups(bars: DataFrame, series: Series, window: int = 6, near: float = 0.33, far: float = 1.0, first: int = 0, zone_frame: DataFrame | None = None) -> DataFrame:
    """Bars that come back into the band of a breakout among the last `window` bars, from ordinal `first` on: side and level of the earliest
    such breakout. With zones, one whose side has a zone that the bar touches. `bars` must have hi_prev and lo_prev."""
    breakout = F.struct("bar", "close", "hi_prev", "lo_prev")
    d = numbered_bars(bars, series)
    some = F.when((F.col("bar") >= first) & ((F.col("close") > F.col("hi_prev")) | (F.col("close") < F.col("lo_prev"))), breakout)
    d = d.withColumn("__w", F.collect_list(some).over(series.prev(window)))

    def long(b: Column) -> Column:
        i = b.close - b.hi_prev
        return F.coalesce((i > 0) & (F.col("low") >= b.hi_prev + i * (1 - far)) & (F.col("low") <= b.hi_prev + i * (1 - near)), F.lit(False))

    def short(b: Column) -> Column:
        j = b.lo_prev - b.close
        return F.coalesce((j > 0) & (F.col("high") >= b.lo_prev - j * (1 - near)) & (F.col("high") <= b.lo_prev - j * (1 - far)), F.lit(False))

    up, down = (F.get(F.filter("__w", fits), F.lit(0)) for fits in (long, short))
    either = F.array(F.when(up.isNotNull(), F.struct(up.bar.alias("of"), F.lit(1.0).alias("side"), up.hi_prev.alias("level"))), F.when(down.isNotNull(), F.struct(down.bar.alias("of"), F.lit(-1.0).alias("side"), down.lo_prev.alias("level"))))
    rows = [*series.keys, "bar", F.col(series.order[0]).alias("ts"), "low", "high"]
    if zone_frame is None:
        d = d.withColumn("__f", F.array_min(either)).filter("__f IS NOT NULL").select(*rows, "__f.*")
    else:
        d = d.select(*rows, F.explode(F.filter(either, lambda x: x.isNotNull())).alias("__f")).select(*rows[:-3], "ts", "low", "high", "__f.*")
        w = Window.partitionBy(*series.keys, "bar").orderBy("of")
        d = touches_zone(d, zone_frame, series.keys).withColumn("__r", F.row_number().over(w)).filter("__r = 1")
    return d.select(*series.keys, "bar", "ts", "side", "level", F.lit("retrace").alias("kind"))


KINDS = ("breakout", "fakeout", "retrace")


def setups(bars: DataFrame, series: Series, lookback: int = 20, zone_frame: DataFrame | None = None, kinds: tuple[str, ...] = KINDS, window: int = 6, near: float = 0.33, far: float = 1.0, **options) -> DataFrame:
    """(keys, bar, ts, side, level, kind) of breakouts, fakeouts (sweeps) and retraces; ts is the bar's stamp, and a setup is known
    when that bar closes. With zones, a retrace must touch one of its side."""
    if set(kinds) - set(KINDS) or not kinds:
        raise ValueError(f"kinds are some of {KINDS}")
    d = sweeps(bars, series, lookback, **options)
    n = numbered_bars(d, series).filter(F.col("bar") > lookback)
    out_cols = [*series.keys, "bar", F.col(series.order[0]).alias("ts")]
    up, down = F.col("close") > F.col("hi_prev"), F.col("close") < F.col("lo_prev")
    found = {
        "breakout": lambda: n.filter(up | down).select(*out_cols, F.when(up, 1.0).otherwise(-1.0).alias("side"), F.when(up, F.col("hi_prev")).otherwise(F.col("lo_prev")).alias("level"), F.lit("breakout").alias("kind")),
        "fakeout": lambda: n.filter("sweep <> 0").select(*out_cols, F.col("sweep").alias("side"), F.lit(None).cast("double").alias("level"), F.lit("fakeout").alias("kind")),
        "retrace": lambda: retrace_setups(d, series, window, near, far, lookback + 1, zone_frame).filter(F.col("bar") > lookback),
    }
    out = None
    for kind in kinds:
        rows = found[kind]()
        out = rows if out is None else out.unionByName(rows)
    return out


def trigger_entries(
    bars: DataFrame, found: DataFrame, series: Series, known: str = "known_at", window: int = 6, stop_sigma: float = 1.0, sigma: str = "sigma", sigma_is_price: bool = False,
    bias: str | None = None, vwap: str | None = None, vwap_filter: str = "none", group: tuple[str, ...] = (),
) -> DataFrame:
    """For each setup, in the order in which they are known, the first bar that is admissible and after the last setup's bar, among the
    `window` that begin at or after it is known. A bar is admissible if `sigma` is positive there, it closes on in the setup's
    direction, it isn't the series' last, `bias` (if named) is the setup's side, and by vwap_filter the close is on the near side of
    `vwap` (revert: a long below it, trend: above it; an unknown vwap refuses none).

    Setups meet their bars by ordinal: the first such bar's ordinal comes from an as-of join, and the bars after it from an array
    gathered ahead, so no pair of setup and bar is formed. Setups of different `group` columns don't stand in each other's way.
    """
    if vwap_filter not in ("none", "revert", "trend") or window < 1 or stop_sigma <= 0:
        raise ValueError("vwap_filter is none, revert or trend; window from 1; stop_sigma above 0")
    keys, ts = list(series.keys), series.order[0]
    b = numbered_bars(bars, series).withColumns({"__prev": series.lag("close"), "__more": series.lead("close").isNotNull()})
    extra = [F.col(bias).alias("bias") if bias else F.lit(None).cast("double").alias("bias"), F.col(vwap).alias("vwap") if vwap else F.lit(None).cast("double").alias("vwap")]
    moved = F.struct("bar", F.col(ts).alias("ts"), "close", "low", "high", "__prev", "__more", F.col(sigma).alias("sigma"), *extra)
    b = b.withColumn("__ahead", F.collect_list(moved).over(series.window().rowsBetween(0, window - 1)))
    start = b.select(*keys, F.col(ts).alias(known), "__ahead")
    d = asof(found, start, series.keys, known, ["__ahead"], direction="forward").filter("__ahead IS NOT NULL")
    side = F.col("side")

    def good(x: Column) -> Column:
        ok = x["__more"] & (x.sigma > 0) & F.when(side > 0, x.close > x["__prev"]).otherwise(x.close < x["__prev"])
        if bias:
            ok = ok & (x.bias == side)
        if vwap and vwap_filter != "none":
            toward = side if vwap_filter == "trend" else -side
            ok = ok & F.coalesce(toward * (x.close - x.vwap) > 0, F.lit(True))
        return F.coalesce(ok, F.lit(False))

    options = F.transform(F.filter("__ahead", good), lambda x: option(x.bar, x.bar + 1))
    d = d.withColumns({"__options": options, "__start": F.get("__ahead", F.lit(0)).bar})
    d = first_come(d, (*keys, *group), "__start", "__options", [F.col(known), F.col("kind"), side], window)
    d = d.withColumn("__t", F.get(F.filter("__ahead", lambda x: x.bar == F.col("__at")), F.lit(0)))
    entry = F.col("__t.close")
    structural = F.when(side > 0, F.col("__t.low")).otherwise(F.col("__t.high"))
    unit = F.col("__t.sigma") * (F.lit(1.0) if sigma_is_price else entry)
    return d.select(*keys, *group, F.col("__at").alias("bar"), F.col("__t.ts").alias("time"), "side", entry.alias("entry"), stop_beyond(entry, side, structural, stop_sigma * unit).alias("stop"), "kind", structural.alias("structural"), unit.alias("unit"))


def on_walk_frame(entries: DataFrame, bars: DataFrame, series: Series, group: tuple[str, ...] = ()) -> DataFrame:
    """Entries of a finer frame on the frame they are walked on: `bar` becomes the first bar that closes after the entry's time (never
    the last bar), price and stop stay; of entries that come to one bar the first counts."""
    ends = numbered_bars(bars, series).withColumn("__more", series.lead("close").isNotNull())
    ends = shifted_to_close(ends, series, series.order[0]).select(*series.keys, F.col(series.order[0]).alias("time"), F.col("bar").alias("__bar"), "__more")
    at = asof(entries, ends, series.keys, "time", ["__bar", "__more"], direction="forward", strict=True).filter("__more")
    w = Window.partitionBy(*series.keys, *group, "__bar").orderBy("time")
    first = at.withColumn("__r", F.row_number().over(w)).filter("__r = 1")
    return first.withColumn("bar", F.col("__bar")).drop("__bar", "__more", "__r")


@dataclass(frozen=True)
class Cascade:
    """What each frame of a cascade does: setups on a coarse one, triggers on a fine one, a bias from the coarsest."""

    lookback: int = 20
    kinds: tuple[str, ...] = KINDS
    retrace_window: int = 6
    near: float = 0.33
    far: float = 1.0
    trigger_window: int = 6
    stop_sigma: float = 1.0
    stop_mode: str = "atr"
    atr_period: int = 14
    lam: float = 0.94
    bias_span: int = 9
    vwap_filter: str = "none"

    def __post_init__(self) -> None:
        if self.lookback < 3 or self.retrace_window < 1 or self.trigger_window < 1 or self.bias_span < 1 or self.atr_period < 2:
            raise ValueError("lookback from 3, windows and bias_span from 1, atr_period from 2")
        if not 0 < self.near < self.far or self.stop_sigma <= 0 or self.stop_mode not in ("atr", "sigma") or self.vwap_filter not in ("none", "revert", "trend"):
            raise ValueError("0 < near < far, stop_sigma above 0, stop_mode atr or sigma, vwap_filter none, revert or trend")


def cascade_entries(fine: DataFrame, coarse: DataFrame, series: Series, cfg: Cascade = Cascade(), zone_frame: DataFrame | None = None, bias_bars: DataFrame | None = None, allow: Column | None = None, kind_sets: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Entries of the cascade on the frame of `coarse`. `fine` must have `session` if a vwap filter is set, and bias_bars (a coarser
    frame, or none for no bias) must have it. `allow` is a condition on an entry's `time` and keys: sessions, blackouts.

    With kind_sets (name to kinds), each set is a cascade of its own, named by `kinds`; setups are found once for all.
    """
    sets = kind_sets or {"all": cfg.kinds}
    every = tuple(k for k in KINDS if any(k in s for s in sets.values()))
    found = setups(coarse, series, cfg.lookback, zone_frame, every, cfg.retrace_window, cfg.near, cfg.far, lam=cfg.lam)
    names = F.filter(F.array(*[F.when(F.col("kind").isin(*s), F.lit(n)) for n, s in sets.items()]), lambda n: n.isNotNull())
    step = median_step(coarse, series, series.order[0])
    known = later(F.col("ts"), F.col("step"), dict(coarse.dtypes)[series.order[0]])
    found = found.join(step, list(series.keys)).withColumns({"known_at": known, "kinds": F.explode(names)}).drop("bar", "ts", "step", "level")
    b = atr(fine, series, cfg.atr_period, "__unit") if cfg.stop_mode == "atr" else with_sigma(fine, series, cfg.lam).withColumnRenamed("sigma", "__unit")
    if bias_bars is not None:
        b = align_to(b, bias(bias_bars, series, cfg.bias_span).select(*series.keys, series.order[0], "bias"), series, ["bias"], series.order[0])
    if cfg.vwap_filter != "none":
        b = session_vwap(b, series)
    e = trigger_entries(b, found, series, "known_at", cfg.trigger_window, cfg.stop_sigma, "__unit", cfg.stop_mode == "atr", "bias" if bias_bars is not None else None, "vwap" if cfg.vwap_filter != "none" else None, cfg.vwap_filter, ("kinds",))
    return on_walk_frame(e.filter(allow) if allow is not None else e, coarse, series, ("kinds",))


def breakout_retrace(bars: DataFrame, series: Series, lookback: int = 20, max_bars: int = 12, near: float = 0.33, far: float = 1.0, stop_sigma: float = 1.0, session: str = "session", trend: str | None = None, lam: float = 0.94) -> DataFrame:
    """Breakout, retrace into the band, resume: an entry at the close beyond the breakout bar's extreme, by max_bars bars later and in
    the same session; a bar beyond the band's far end ends the setup, and the bar that arms it can't enter.

    The state of one setup is folded over an array of its next bars; which setups count is the greedy choice of the scan.
    """
    d = numbered_bars(prior_extremes(with_sigma(bars, series, lam), series, lookback), series)
    d = d.withColumn("__ahead", F.collect_list(F.struct("bar", F.col(series.order[0]).alias("ts"), "high", "low", "close", "sigma", F.col(session).alias("s"))).over(series.following(max_bars)))
    up, down = F.col("close") > F.col("hi_prev"), F.col("close") < F.col("lo_prev")
    d = d.withColumn("side", F.when(up, 1.0).when(down, -1.0)).filter((F.col("bar") > lookback) & F.col("side").isNotNull() & (F.col("sigma") > 0))
    if trend:
        d = d.filter(F.col(trend) == F.col("side"))
    side = F.col("side")
    d = d.withColumn("level", F.when(side > 0, F.col("hi_prev")).otherwise(F.col("lo_prev")))
    impulse = F.abs(F.col("close") - F.col("level"))
    # everything in the direction of the trade: prices times side, so that one rule serves both
    d = d.withColumns({"__i": impulse, "__x": F.when(side > 0, F.col("high")).otherwise(-F.col("low")), "__near": side * F.col("level") + impulse * (1 - near), "__far": side * F.col("level") + impulse * (1 - far)})
    start = F.struct(F.lit(0).alias("state"), F.col("__x").alias("deep"), F.lit(None).cast("bigint").alias("bar"), F.lit(None).cast("double").alias("close"), F.lit(None).cast("double").alias("sigma"))

    def step(a: Column, b: Column) -> Column:
        # state 0: waiting, 1: armed, 2: entered, 3: over
        reach, close = F.when(side > 0, b.low).otherwise(-b.high), side * b.close
        deep = F.least(a.deep, reach)
        out = lambda s, dp: F.struct(F.lit(s).alias("state"), dp.alias("deep"), F.lit(None).cast("bigint").alias("bar"), F.lit(None).cast("double").alias("close"), F.lit(None).cast("double").alias("sigma"))
        enter = F.struct(F.lit(2).alias("state"), a.deep.alias("deep"), b.bar.alias("bar"), b.close.alias("close"), b.sigma.alias("sigma"))
        return (
            F.when(a.state >= 2, a)
            .when(b.s != F.col(session), out(3, a.deep))
            .when((a.state == 1) & (close > F.col("__x")), enter)
            .when(reach < F.col("__far"), out(3, deep))
            .when((a.state == 1) | (reach <= F.col("__near")), out(1, deep))
            .otherwise(out(0, deep))
        )

    d = d.withColumn("__r", F.reduce("__ahead", start, step)).filter("__r.state = 2")
    entry = F.col("__r.close")
    floor, struct_d = stop_sigma * F.col("__r.sigma") * entry, F.abs(entry - side * F.col("__r.deep"))
    d = d.select(
        *series.keys, F.col("bar").alias("breakout_bar"), F.col("__r.bar").alias("bar"), "side", entry.alias("entry"), (entry - side * F.greatest(struct_d, floor)).alias("stop"), F.col("level").alias("breakout_level"),
        (F.col("__i") / F.col("close")).alias("impulse_frac"), (F.abs(F.col("__x") - F.col("__r.deep")) / F.col("__i")).alias("retrace_frac"), (F.col("__r.bar") - F.col("bar")).alias("wait_bars"),
        F.when(struct_d >= floor, "structure").otherwise("sigma_floor").alias("stop_from"), (side * F.col("__r.deep")).alias("structural"), (F.col("__r.sigma") * entry).alias("unit"),
    )
    return greedy(d.withColumn("next_free", F.col("bar") + 1), series.keys, max_bars + 1, "breakout_bar", "next_free").drop("next_free")
