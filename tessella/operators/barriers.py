"""Barrier-exit trades: what each entry would do, then which entries are taken.

An entry's outcome depends on its own bars ahead only. So all outcomes are found set-wise: bars are gathered by blocks, an entry
takes its next bars from its block and the one after it, and array functions find the first touch. For a grid of configurations the
bars ahead become an index of record prices, in which each configuration finds its first touches. Which entries are taken depends on the ones before: an entry
is dropped while an earlier one runs. That greedy choice needs an entry's bar and the first free bar after it, nothing else
(`operators/choice.py`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.ordering import Series, ratio
from tessella.functions.scalars import breakeven_win_rate, touch_probability
from tessella.operators.choice import greedy


@dataclass(frozen=True)
class Barriers:
    """Geometry and cost of a triple-barrier walk."""

    stop_k: float = 3.0
    rr: float = 1.0
    max_bars: int = 10
    cost_bp: float = 2.0

    def __post_init__(self) -> None:
        if self.stop_k <= 0 or self.rr <= 0 or self.max_bars < 1 or self.cost_bp < 0:
            raise ValueError("stop_k and rr must be positive, max_bars at least 1, cost_bp not negative")


def numbered_bars(bars: DataFrame, series: Series) -> DataFrame:
    """bars with `bar`, their ordinal from 0."""
    return bars.withColumn("bar", (F.row_number().over(series.window()) - 1).cast("long"))


def first_touch(ahead: Column, side: Column, target: Column, stop: Column) -> Column:
    """The number (from 1) of the first bar ahead that reaches the target or the stop; 0 if none does."""
    hit = F.transform(ahead, lambda b: F.when(side > 0, (b.high >= target) | (b.low <= stop)).otherwise((b.low <= target) | (b.high >= stop)))
    return F.array_position(hit, F.lit(True))


def reaches(b: Column, side: Column, level: Column, upward: bool) -> Column:
    """Whether a bar reaches a level in the trade's favour (upward) or against it."""
    return F.when(side > 0, b.high >= level).otherwise(b.low <= level) if upward else F.when(side > 0, b.low <= level).otherwise(b.high >= level)


def outcomes(entries: DataFrame, rr: float, cost_bp: Column, breakeven_frac: float | None = None) -> DataFrame:
    """What each entry comes to. entries has bar, side, entry, stop, and `ahead`: an array of the bars (high, low, close) after
    the entry, as many as it may last. A bar that touches both barriers counts as stopped; the breakeven stop works from the bar
    after the one that closes beyond the trigger."""
    side, entry, stop, ahead = (F.col(c) for c in ("side", "entry", "stop", "ahead"))
    d = entries.withColumn("__d", F.abs(entry - stop)).filter("__d > 0 AND size(ahead) > 0")
    d = d.withColumn("target", entry + side * F.col("__d") * rr)
    target = F.col("target")
    if breakeven_frac is None:
        d = d.withColumn("__arm", F.lit(0).cast("long"))
    else:
        trigger = entry + side * breakeven_frac * entry
        closed = F.transform(ahead, lambda b: F.when(side > 0, b.close >= trigger).otherwise(b.close <= trigger))
        d = d.withColumn("__arm", F.array_position(closed, F.lit(True)))
    # before the arming bar's close the first stop holds; after it, the entry price
    d = d.withColumn("__first", first_touch(ahead, side, target, stop))
    later = F.when(F.col("__arm") > 0, F.slice(ahead, (F.col("__arm") + 1).cast("int"), F.size(ahead))).otherwise(F.array().cast(entries.schema["ahead"].dataType))
    second = first_touch(later, side, target, entry)
    armed = (F.col("__arm") > 0) & ((F.col("__first") == 0) | (F.col("__first") > F.col("__arm")))
    d = d.withColumns({"be_armed": armed, "__hit": F.when(armed, F.when(second > 0, F.col("__arm") + second).otherwise(F.lit(0))).otherwise(F.col("__first"))})
    d = d.withColumn("__b", F.get(ahead, F.greatest(F.col("__hit") - 1, F.lit(0)).cast("int")))
    level = F.when(F.col("be_armed"), entry).otherwise(stop)
    at_target, at_stop = reaches(F.col("__b"), side, target, True), reaches(F.col("__b"), side, level, False)
    stopped = F.when(F.col("be_armed"), "breakeven").otherwise("stop")
    last = F.get(ahead, F.size(ahead) - 1)
    d = d.withColumns({
        "outcome": F.when(F.col("__hit") == 0, "time").when(at_stop, stopped).otherwise("target"),
        "ambiguous": (F.col("__hit") > 0) & at_target & at_stop,
        "exit": F.when(F.col("__hit") == 0, last["close"]).when(at_stop, level).otherwise(target),
        "bars_held": F.when(F.col("__hit") == 0, F.size(ahead)).otherwise(F.col("__hit")).cast("long"),
    })
    gross, cost = side * (F.col("exit") - entry) / F.col("__d"), 2 * cost_bp / 1e4 * entry / F.col("__d")
    d = d.withColumns({"stop_frac": F.col("__d") / entry, "cost_R": cost, "gross_R": gross, "unit_net_R": gross - cost, "net_R": gross - cost})
    return d.withColumn("next_free", F.col("bar") + F.greatest(F.col("bars_held"), F.lit(1))).drop("__d", "__arm", "__first", "__hit", "__b", "ahead")


def ahead_blocks(bars: DataFrame, series: Series, horizon: int, *more: Column) -> DataFrame:
    """(keys, __blk, __bars): the bars of each block of `horizon` bars and of the next one, once for all entries of the block. A bar has
    high, low, close and the columns of `more`; bars must have `bar`."""
    item = F.struct("bar", "high", "low", "close", *more)
    d = bars.groupBy(*series.keys, F.floor(F.col("bar") / horizon).alias("__blk")).agg(F.sort_array(F.collect_list(item)).alias("__own"))
    following = F.lead("__own").over(Window.partitionBy(*series.keys).orderBy("__blk"))
    return d.withColumn("__bars", F.when(following.isNull(), F.col("__own")).otherwise(F.concat("__own", following))).drop("__own")


def looking_ahead(entries: DataFrame, bars: DataFrame, series: Series, horizon: int, *more: str) -> DataFrame:
    """entries (keys, bar) with `ahead`, the up to `horizon` bars after their own, and columns of their own bar. Only entries get an array
    of their own; bars must have `bar`."""
    blocks = ahead_blocks(bars, series, horizon, *[F.col(c) for c in more])
    at = (F.col("bar") - F.col("__blk") * horizon).cast("int")
    d = entries.withColumn("__blk", F.floor(F.col("bar") / horizon)).join(blocks, [*series.keys, "__blk"])
    own = F.get("__bars", at)
    return d.filter(own.isNotNull()).withColumns({"ahead": F.slice("__bars", at + 2, horizon)} | {f"__own_{c}": own[c] for c in more}).drop("__blk", "__bars")


def walk(bars: DataFrame, series: Series, cfg: Barriers = Barriers(), signal: str = "signal", sigma: str = "sigma", allow: str | None = None, size: str | None = None) -> DataFrame:
    """One row per trade taken where the signal changes to one other than 0 (and the gate allows, and sigma is known). The stop is
    stop_k sigmas of the close away, the target rr times that."""
    d = outcomes(flips(bars, series, cfg.max_bars, cfg.stop_k, signal, sigma, allow), cfg.rr, F.lit(cfg.cost_bp))
    stake = F.coalesce(F.col(size), F.lit(1.0)) if size else F.lit(1.0)
    return greedy(d.withColumns({"stake": stake, "net_R": F.col("unit_net_R") * stake}), series.keys, cfg.max_bars)


def flips(bars: DataFrame, series: Series, horizon: int, stop_k: float = 1.0, signal: str = "signal", sigma: str = "sigma", allow: str | None = None) -> DataFrame:
    """Entries where the signal changes to one other than 0, with side, entry, stop and `ahead`."""
    b = numbered_bars(bars, series)
    s = F.coalesce(F.col(signal), F.lit(0.0))
    flip = (s != F.coalesce(series.lag(s), F.lit(0.0))) & (s != 0)
    flip = flip & (F.coalesce(F.col(allow), F.lit(False)) if allow else F.lit(True)) & (F.coalesce(F.col(sigma), F.lit(0.0)) > 0)
    # entries ride along in their blocks, so bars are read once
    own = F.when(flip, F.struct(*b.columns)).alias("row")
    blocks = ahead_blocks(b.withColumn("__row", own), series, horizon, F.col("__row").alias("row"))
    at = lambda x: (x["bar"] - F.col("__blk") * horizon).cast("int")
    mine = F.filter("__bars", lambda x: x["row"].isNotNull() & (at(x) < horizon))
    plain = F.transform("__bars", lambda x: F.struct(x["high"].alias("high"), x["low"].alias("low"), x["close"].alias("close")))
    d = blocks.withColumn("__plain", plain).select(F.explode(F.transform(mine, lambda x: F.struct(x["row"].alias("row"), F.slice("__plain", at(x) + 2, horizon).alias("ahead")))).alias("x"))
    d = d.select("x.row.*", "x.ahead").withColumns({"side": F.signum(signal), "entry": F.col("close")})
    return d.withColumn("stop", F.col("entry") - F.col("side") * stop_k * F.col(sigma) * F.col("entry"))


def walk_explicit(bars: DataFrame, entries: DataFrame, series: Series, rr: float = 2.0, max_bars: int = 40, cost_bp: float | str = 1.0, breakeven_frac: float | None = None, allow_overlap: bool = False) -> DataFrame:
    """One row per trade of given entries (keys, bar, side, entry, stop). cost_bp may name a column of bars. A row with a stop of
    no width, or on the last bar, is no trade and blocks none."""
    if rr <= 0 or max_bars < 1 or (breakeven_frac is not None and breakeven_frac <= 0):
        raise ValueError("rr, max_bars and breakeven_frac must be positive")
    d = with_cost(entries, bars, series, max_bars, cost_bp)
    d = outcomes(d, rr, F.col("__cost"), breakeven_frac).drop("__cost")
    return d if allow_overlap else greedy(d, series.keys, max_bars)


def with_cost(entries: DataFrame, bars: DataFrame, series: Series, horizon: int, cost_bp: float | str) -> DataFrame:
    """entries with `ahead`, `entry_time` and `__cost` of their bar."""
    cost = F.lit(float(cost_bp)) if not isinstance(cost_bp, str) else F.col(cost_bp)
    b = numbered_bars(bars, series).withColumns({"entry_time": F.col(series.order[0]), "cost": cost})
    d = looking_ahead(entries.drop("entry_time"), b, series, horizon, "entry_time", "cost")
    return d.withColumnRenamed("__own_entry_time", "entry_time").withColumnRenamed("__own_cost", "__cost")


# ---- many configurations over one reading of the bars


@dataclass(frozen=True)
class Geometry:
    """One configuration of a grid: its name, the reward ratio, the time limit, whether the breakeven stop works, and the column of
    entries that holds its stop."""

    name: str
    rr: float
    max_bars: int
    stop: str = "stop"
    breakeven: bool = False


def passages(entries: DataFrame, horizons: list[int], breakeven_frac: float | Column | None = None) -> DataFrame:
    """entries with a first-passage index in place of `ahead`: `up` and `down`, the record prices in and against the trade's favour with
    the bar that set each (so the first bar to reach any level is the first record that does), the close and bar at each horizon, and
    for a breakeven stop the bar that arms it, the next that touches the entry, and the records in favour after arming."""
    side, ahead = F.col("side"), F.col("ahead")
    good, bad = (lambda b: F.when(side > 0, b["high"]).otherwise(-b["low"])), (lambda b: F.when(side > 0, b["low"]).otherwise(-b["high"]))
    kind = "struct<n:int,best:double,records:array<struct<k:int,level:double>>>"

    def records(bars: Column, level, better, after: Column) -> Column:
        def step(a: Column, b: Column) -> Column:
            n, x = a["n"] + 1, level(b)
            new = (n > after) & (a["best"].isNull() | better(x, a["best"]))
            more = F.struct(n.alias("n"), x.alias("best"), F.concat(a["records"], F.array(F.struct(n.alias("k"), x.alias("level")))).alias("records"))
            return F.when(F.coalesce(new, F.lit(False)), more).otherwise(F.struct(n.alias("n"), a["best"].alias("best"), a["records"].alias("records"))).cast(kind)

        empty = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("best"), F.array().cast("array<struct<k:int,level:double>>").alias("records")).cast(kind)
        return F.reduce(bars, empty, step, lambda a: a["records"])

    higher, lower = (lambda x, y: x > y), (lambda x, y: x < y)
    d = entries.withColumns({"up": records(ahead, good, higher, F.lit(0)), "down": records(ahead, bad, lower, F.lit(0))})
    if breakeven_frac is not None:
        frac = breakeven_frac if isinstance(breakeven_frac, Column) else F.lit(breakeven_frac)
        trigger = side * (F.col("entry") + side * frac * F.col("entry"))
        d = d.withColumn("arm", F.array_position(F.transform(ahead, lambda b: side * b["close"] >= trigger), F.lit(True)).cast("int"))
        touched = F.transform(ahead, lambda b, n: (n + 1 > F.col("arm")) & (bad(b) <= side * F.col("entry")))
        d = d.withColumns({"back": F.array_position(touched, F.lit(True)).cast("int"), "up_after": records(ahead, good, higher, F.col("arm"))})
    last = F.array(*[F.struct(F.lit(h).alias("horizon"), F.least(F.lit(h), F.size(ahead)).alias("k"), F.get(ahead, F.least(F.lit(h), F.size(ahead)) - 1)["close"].alias("close")) for h in sorted(set(horizons))])
    return d.filter(F.size("ahead") > 0).withColumn("ends", last).drop("ahead")


def first_reach(records: Column, reached) -> Column:
    """The bar of the first record that satisfies; 0 if none does."""
    return F.coalesce(F.get(F.filter(records, lambda r: reached(r["level"])), F.lit(0))["k"], F.lit(0))


def grid_outcomes(indexed: DataFrame, grid: list[Geometry], cost_bp: Column) -> DataFrame:
    """What each entry comes to under each geometry, as by outcomes(), from passages(): a row an entry and geometry (`config`)."""
    cells = F.array(*[F.struct(F.lit(g.name).alias("config"), F.lit(float(g.rr)).alias("rr"), F.lit(g.max_bars).alias("most"), F.col(g.stop).cast("double").alias("level"), F.lit(g.breakeven).alias("be")) for g in grid])
    d = indexed.withColumn("__g", F.explode(cells))
    side, entry, be = F.col("side"), F.col("entry"), F.col("__g.be")
    d = d.withColumns({"config": F.col("__g.config"), "stop": F.col("__g.level"), "__d": F.abs(entry - F.col("__g.level"))}).filter("__d > 0")
    d = d.withColumn("target", entry + side * F.col("__d") * F.col("__g.rr"))
    end = F.get(F.filter("ends", lambda e: e["horizon"] == F.col("__g.most")), F.lit(0))
    within = lambda k: F.when(k <= F.col("__g.most"), k).otherwise(F.lit(0))
    target, stop = side * F.col("target"), side * F.col("stop")
    at_target, at_stop = within(first_reach(F.col("up"), lambda x: x >= target)), within(first_reach(F.col("down"), lambda x: x <= stop))
    d = d.withColumns({"__t": at_target, "__s": at_stop, "__end": end})
    first = F.when(F.col("__t") == 0, F.col("__s")).when(F.col("__s") == 0, F.col("__t")).otherwise(F.least("__t", "__s"))
    if any(g.breakeven for g in grid):
        arm = F.when(be, within(F.col("arm"))).otherwise(F.lit(0))
        armed = (arm > 0) & ((first == 0) | (first > arm))
        d = d.withColumn("be_armed", armed)
        d = d.withColumns({
            "__t": F.when(F.col("be_armed"), within(first_reach(F.col("up_after"), lambda x: x >= target))).otherwise(F.col("__t")),
            "__s": F.when(F.col("be_armed"), within(F.col("back"))).otherwise(F.col("__s")),
        })
    else:
        d = d.withColumn("be_armed", F.lit(False))
    stopped = (F.col("__s") > 0) & ((F.col("__t") == 0) | (F.col("__s") <= F.col("__t")))
    done = (F.col("__t") > 0) | (F.col("__s") > 0)
    level = F.when(F.col("be_armed"), entry).otherwise(F.col("stop"))
    d = d.withColumns({
        "outcome": F.when(~done, "time").when(stopped & F.col("be_armed"), "breakeven").when(stopped, "stop").otherwise("target"),
        "ambiguous": (F.col("__t") > 0) & (F.col("__t") == F.col("__s")),
        "exit": F.when(~done, F.col("__end.close")).when(stopped, level).otherwise(F.col("target")),
        "bars_held": F.when(~done, F.col("__end.k")).otherwise(F.coalesce(F.when(stopped, F.col("__s")), F.col("__t"))).cast("long"),
    })
    gross, cost = side * (F.col("exit") - entry) / F.col("__d"), 2 * cost_bp / 1e4 * entry / F.col("__d")
    d = d.withColumns({"stop_frac": F.col("__d") / entry, "cost_R": cost, "gross_R": gross, "unit_net_R": gross - cost, "net_R": gross - cost})
    return d.withColumn("next_free", F.col("bar") + F.greatest(F.col("bars_held"), F.lit(1))).drop("__g", "__d", "__t", "__s", "__end", "up", "down", "ends", "arm", "back", "up_after")


def grid_walk(entries: DataFrame, series: Series, grid: list[Geometry], cost_bp: Column, breakeven_frac: float | Column | None = None, group: tuple[str, ...] = ()) -> DataFrame:
    """The trades of each geometry over entries with `ahead` (as many bars as the longest time limit): entries are indexed once, and
    each geometry takes its own trades that don't overlap. `group` columns keep trades apart as keys do."""
    longest = max(g.max_bars for g in grid)
    d = grid_outcomes(passages(entries, [g.max_bars for g in grid], breakeven_frac), grid, cost_bp)
    return greedy(d, (*series.keys, *group, "config"), longest)


def barrier_summary(trades: DataFrame, keys: tuple[str, ...], rr: float) -> DataFrame:
    """Win rates over all trades and over those that met a barrier, the hurdle, the gap to it, shares and means."""
    out, r = F.col("outcome"), F.col("net_R")
    met = out.isin("target", "stop")
    share = lambda c: F.avg(c.cast("double"))
    d = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), share(r > 0).alias("win_rate"), F.avg(F.when(met, (out == "target").cast("double"))).alias("barrier_win_rate"), F.avg("cost_R").alias("mean_cost_R"),
        share(out == "time").alias("time_share"), share(out == "target").alias("target_share"), share(out == "stop").alias("stop_share"), share(out == "breakeven").alias("breakeven_share"),
        share(F.col("ambiguous")).alias("ambiguous_share"), F.avg("bars_held").alias("mean_bars"), F.avg(r).alias("mean_net_R"), F.stddev_samp(r).alias("sd_net_R"),
    )
    return d.withColumn("hurdle", breakeven_win_rate(F.col("mean_cost_R"), rr)).withColumn("gap", F.col("barrier_win_rate") - F.col("hurdle"))


def touch_benchmark(trades: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Wins against the driftless touch probabilities of trades that met a barrier: a Poisson-binomial z."""
    t = trades.filter(F.col("outcome").isin("target", "stop")).withColumn("__p", touch_probability(F.col("entry"), F.col("target"), F.col("stop"))).filter("__p IS NOT NULL")
    d = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("outcome") == "target").cast("double")).alias("observed"), F.avg("__p").alias("expected"), F.sum(F.col("__p") * (1 - F.col("__p"))).alias("__v"))
    return d.withColumn("z", ratio((F.col("observed") - F.col("expected")) * F.col("n"), F.sqrt("__v"))).drop("__v")


def pooled_z(cells: DataFrame) -> DataFrame:
    """z of several runs in one, weighted by the root of their trades."""
    return cells.agg(ratio(F.sum(F.col("z") * F.sqrt("n")), F.sqrt(F.sum("n"))).alias("z"))


def drop_one(trades: DataFrame, key: str) -> DataFrame:
    """The pooled mean and count without each key in turn, from one pass of sums."""
    cells = trades.groupBy(key).agg(F.count("net_R").alias("n"), F.sum("net_R").alias("s"))
    whole = trades.agg(F.count("net_R").alias("all_n"), F.sum("net_R").alias("all_s"))
    d = cells.join(F.broadcast(whole))  # one row is broadcast
    left = F.col("all_n") - F.col("n")
    return d.select(F.col(key).alias("dropped"), left.alias("trades"), ratio(F.col("all_s") - F.col("s"), left).alias("mean_net_R"))


def subsets(trades: DataFrame, key: str, names: list[str], size: int = 3) -> DataFrame:
    """The pooled mean of every subset of `size` keys, best first. Cells are summed first; a cell meets the subsets it is in."""
    from itertools import combinations

    spark = trades.sparkSession
    sets = spark.createDataFrame([(",".join(c), list(c)) for c in combinations(sorted(names), size)], "subset string, members array<string>")
    cells = trades.groupBy(key).agg(F.count("net_R").alias("n"), F.sum("net_R").alias("s"), F.sum("cost_R").alias("c"))
    rows = sets.withColumn("__k", F.explode("members")).join(cells, F.col("__k") == F.col(key))
    return rows.groupBy("subset").agg(F.sum("n").alias("trades"), ratio(F.sum("s"), F.sum("n")).alias("mean_net_R"), ratio(F.sum("c"), F.sum("n")).alias("mean_cost_R")).orderBy(F.col("mean_net_R").desc(), "subset")
