"""Event studies, rank information coefficients, multiple testing, group comparisons and walk-forward selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.ordering import Series, ratio
from tessella.functions.scalars import touch_probability
from tessella.functions.special import t_two_sided
from tessella.operators.joins import asof


def signed_forward(bars: DataFrame, entries: DataFrame, series: Series, horizons: tuple[int, ...] = (1, 4, 24, 96)) -> DataFrame:
    """entries with fwd_h: side * log change to the close h bars on, in bp; null where the data ends. An entry whose stamp is no bar
    raises."""
    on = [*series.keys, *series.order]
    b = bars.select(*on, *[(F.ln(series.lead("close", h) / F.col("close"))).alias(f"__f{h}") for h in horizons])
    lost = entries.join(b, on, "left_anti")
    if lost.head(1):
        raise ValueError("an entry is not on the bars' grid")
    return entries.join(b, on).select(*entries.columns, *[(F.col("side") * F.col(f"__f{h}") * 1e4).alias(f"fwd_{h}") for h in horizons])


def month_of(ts: Column | str) -> Column:
    """The calendar month as yyyy-MM."""
    return F.date_format(ts, "yyyy-MM")


def cell_means(df: DataFrame, value: str, month: Column, key: str = "symbol", least: int = 3) -> DataFrame:
    """(key, month, n, mean) of cells with at least `least` values."""
    return df.filter(F.col(value).isNotNull()).groupBy(key, month.alias("month")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).filter(F.col("n") >= least)


def pooled(cells: DataFrame, value: str = "mean", by: tuple[str, ...] = (), h0: float = 0.0) -> DataFrame:
    """Equal-weighted cells against h0: cells, mean, t (null under 3 cells or without spread) and the share above 0."""
    x = F.col(value)
    d = cells.groupBy(*by).agg(F.count(x).alias("cells"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("__sd"), F.avg((x > 0).cast("double")).alias("share_pos"))
    t = F.when(F.col("cells") >= 3, ratio((F.col("mean") - h0) * F.sqrt("cells"), F.col("__sd")))
    return d.withColumn("t", t).drop("__sd")


def with_p_values(tests: DataFrame, t: str = "t", cells: str = "cells") -> DataFrame:
    """Two-sided p of t with cells - 1 degrees of freedom."""
    n = F.col(cells).cast("double")
    return tests.withColumn("p", F.when((n >= 2) & F.col(t).isNotNull(), t_two_sided(F.col(t), n - 1)))


def excess_cells(trades: DataFrame, month: Column, key: str = "symbol", least: int = 3) -> DataFrame:
    """(key, month, n, mean) of wins beyond each trade's own touch probability, of trades that met a barrier."""
    won = (F.col("outcome") == "target").cast("double")
    own = trades.filter(F.col("outcome") != "time").withColumn("excess", won - touch_probability(F.col("entry"), F.col("target"), F.col("stop")))
    return cell_means(own, "excess", month, key, least)


def clustered(cells: DataFrame, by: tuple[str, ...] = (), h0: float = 0.0) -> DataFrame:
    """Cell means against h0, cells being the clusters: cells, mean, corrected (less h0), t and p, by group and, if there are groups, over all
    cells (a group of nulls)."""
    out = with_p_values(pooled(cells, "mean", by, h0))
    if by:
        every = with_p_values(pooled(cells, "mean", (), h0)).select(*[F.lit(None).cast(dict(cells.dtypes)[b]).alias(b) for b in by], "*")
        out = out.unionByName(every)
    return out.withColumn("corrected", F.col("mean") - h0).drop("share_pos")


def average_rank(x: Column, keys: list) -> Column:
    """The rank with ties averaged."""
    first = F.rank().over(Window.partitionBy(*keys).orderBy(x))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, x))
    return first + (ties - 1) / 2.0


def cell_ics(df: DataFrame, feature: str, fwd: str, month: Column, tie: str, keys: tuple[str, ...] = ("symbol",), least: int = 60) -> DataFrame:
    """(keys, month, n, ic, edge_bp): Spearman's correlation in each cell, and half the gap of the mean forward return between top and
    bottom quintile. Ties of the feature are cut by `tie`. Cells need `least` rows and five different feature values.

    All ranks of a cell come from windows over the same keys, so there is one shuffle.
    """
    cell = [*keys, "month"]
    d = df.withColumn("month", month).filter(F.col(feature).isNotNull() & F.col(fwd).isNotNull())
    w = Window.partitionBy(*cell)
    d = d.withColumns({"__x": average_rank(F.col(feature), cell), "__y": average_rank(F.col(fwd), cell), "__rn": F.row_number().over(w.orderBy(feature, tie)), "__n": F.count(F.lit(1)).over(w)})
    # quintile edges at equal steps of the ranks 1 to n
    q = F.greatest(F.lit(1), F.ceil(5.0 * (F.col("__rn") - 1) / F.when(F.col("__n") > 1, F.col("__n") - 1)))
    d = d.withColumn("__q", q)
    c = d.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"), F.corr("__x", "__y").alias("ic"), F.count_distinct(feature).alias("__u"),
        ((F.avg(F.when(F.col("__q") == 5, F.col(fwd))) - F.avg(F.when(F.col("__q") == 1, F.col(fwd)))) / 2 * 1e4).alias("edge_bp"),
    )
    return c.filter((F.col("n") >= least) & (F.col("__u") >= 5)).drop("__u")


def ic_summary(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Cells pooled to one test: mean ic, t, the share of cells with the mean's sign, and the mean edge."""
    mean = cells.groupBy(*by).agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("cells"), F.stddev_samp("ic").alias("__sd"), F.avg((F.col("ic") > 0).cast("double")).alias("__pos"), F.avg((F.col("ic") < 0).cast("double")).alias("__neg"), F.avg("edge_bp").alias("edge_bp"))
    t = F.when(F.col("cells") >= 3, ratio(F.col("mean_ic") * F.sqrt("cells"), F.col("__sd")))
    hit = F.when(F.col("mean_ic") > 0, F.col("__pos")).when(F.col("mean_ic") < 0, F.col("__neg")).otherwise(0.5)
    return mean.withColumns({"t": t, "hit": hit}).drop("__sd", "__pos", "__neg")


def holm(tests: DataFrame, p: str = "p", alpha: float = 0.05, tie: tuple[str, ...] = ()) -> DataFrame:
    """tests with `reject`: Holm's step-down over the family. Null p-values don't count and are never rejected. A family of tests is a
    handful of rows; its ranking is one window."""
    d = tests.withColumn("__ok", F.col(p).isNotNull() & ~F.isnan(p))
    m = F.count_if("__ok").over(Window.partitionBy("__fam"))
    d = d.withColumn("__fam", F.lit(1))
    w = Window.partitionBy("__fam", "__ok").orderBy(p, *tie)
    d = d.withColumns({"__m": m, "__k": F.row_number().over(w)})
    d = d.withColumn("__pass", (F.col("__ok") & (F.col(p) <= F.lit(alpha) / (F.col("__m") - F.col("__k") + 1))).cast("int"))
    all_so_far = F.min("__pass").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("reject", F.col("__ok") & (all_so_far == 1)).drop("__ok", "__fam", "__m", "__k", "__pass")


def mann_whitney(df: DataFrame, value: str, group: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """U of the rows where the boolean `group` holds, its tie-corrected z (no continuity correction), and the ratio of means."""
    k = list(keys) or [F.lit(1)]
    d = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).withColumns({"__r": average_rank(F.col(value), k), "__t": F.count(F.lit(1)).over(Window.partitionBy(*k, F.col(value)))})
    g, x = F.col(group), F.col(value)
    s = d.groupBy(*keys).agg(
        F.count_if(g).cast("double").alias("n1"), F.count_if(~g).cast("double").alias("n2"), F.sum(F.when(g, F.col("__r"))).alias("__r1"),
        F.sum((F.pow("__t", F.lit(2.0)) - 1)).alias("__ties"), F.avg(F.when(g, x)).alias("__m1"), F.avg(F.when(~g, x)).alias("__m2"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("__r1") - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * (n + 1 - F.col("__ties") / (n * (n - 1)))
    return s.select(*keys, n1.cast("long").alias("n_event"), n2.cast("long").alias("n_other"), u.alias("u"), ratio(u - n1 * n2 / 2, F.sqrt(var)).alias("z"), ratio(F.col("__m1"), F.col("__m2")).alias("mean_ratio"))


def gap_stats(df: DataFrame, value: str, keys: tuple[str, ...], least: int = 20, periods: int = 252) -> DataFrame:
    """Days traded (value not 0), mean, t and Sharpe; keys with fewer than `least` days give none."""
    x = F.when(F.col(value) != 0, F.col(value))
    d = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("__sd")).filter(F.col("n") >= least)
    return d.withColumns({"t": ratio(F.col("mean") * F.sqrt("n"), F.col("__sd")), "sharpe": ratio(F.col("mean") * F.lit(periods**0.5), F.col("__sd"))}).drop("__sd")


def realised_clustering(df: DataFrame, series: Series, ret: str) -> DataFrame:
    """The first autocorrelation of squared returns."""
    d = df.withColumn("__s", F.col(ret) * F.col(ret)).withColumn("__l", series.lag("__s"))
    return d.groupBy(*series.keys).agg(F.corr("__s", "__l").alias("clustering"))


# ---- walk-forward


def slice_fold(trades: DataFrame, folds: DataFrame, start: str, end: str, ts: str = "entry_time") -> DataFrame:
    """Trades with each fold whose half-open span holds them; folds are a few rows."""
    return trades.join(F.broadcast(folds), (F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end)))


def select_configs(trades: DataFrame, folds: DataFrame, least: int = 30, value: str = "unit_net_R", ts: str = "entry_time") -> DataFrame:
    """(fold, config): the best mean over the training span among configurations with enough trades, the first by name among
    equals."""
    train = slice_fold(trades, folds, "train_start", "train_end", ts)
    score = train.groupBy("fold", "config").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("score")).filter(F.col("n") >= least)
    w = Window.partitionBy("fold").orderBy(F.col("score").desc(), "config")
    return score.withColumn("__r", F.row_number().over(w)).filter("__r = 1").select("fold", "config", "score")


def out_of_sample(trades: DataFrame, folds: DataFrame, picks: DataFrame, ts: str = "entry_time") -> DataFrame:
    """The picked configurations' trades in the test spans."""
    return slice_fold(trades, folds, "test_start", "test_end", ts).join(F.broadcast(picks.select("fold", "config")), ["fold", "config"])


def walk_forward_summary(oos: DataFrame, picks: DataFrame, value: str = "unit_net_R", fixed: DataFrame | None = None) -> DataFrame:
    """Trades, win rate, mean and t out of sample, and how often the most chosen configuration was picked. With `fixed`, the trades of one
    configuration in the same test spans, its mean and what picking gained over it."""
    r = F.col(value)
    s = oos.agg(F.count(r).alias("trades"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("mean_net_R"), F.stddev_samp(r).alias("__sd"))
    s = s.withColumn("t", F.when(F.col("trades") > 2, ratio(F.col("mean_net_R") * F.sqrt("trades"), F.col("__sd")))).drop("__sd")
    chosen = picks.groupBy("config").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("selection_stability"), F.count(F.lit(1)).alias("distinct_configs"))
    s = s.join(F.broadcast(chosen))  # one row each
    if fixed is None:
        return s
    s = s.join(F.broadcast(fixed.agg(F.avg(value).alias("fixed_mean_net_R"))))  # one row
    return s.withColumn("selection_edge", F.col("mean_net_R") - F.col("fixed_mean_net_R"))


def held_out_of(picks: DataFrame, trades: DataFrame, folds: DataFrame, value: str = "unit_net_R", ts: str = "entry_time") -> DataFrame:
    """picks with the trades and mean of each pick in its test span."""
    seen = out_of_sample(trades, folds, picks, ts).groupBy("fold").agg(F.count(value).alias("n_test"), F.avg(value).alias("test_mean"))
    return picks.join(seen, "fold", "left").withColumn("n_test", F.coalesce("n_test", F.lit(0)))


def reversion_score(df: DataFrame, ranks: dict[str, int]) -> Column:
    """The mean of trailing ranks, each turned so that high means long: rank for a sign of 1, 1 - rank for -1."""
    turned = [F.col(c) if sign > 0 else 1 - F.col(c) for c, sign in ranks.items()]
    total = turned[0]
    for t in turned[1:]:
        total = total + t
    return total / len(turned)


def reversion_positions(bars: DataFrame, series: Series, score: str = "score", session: str = "session", at_hour: Column | None = None, hour: int = 11, hold: int = 24, low: float = 0.2, high: float = 0.8, cost_bp: float = 1.0, swap_bp: float = 0.0, nights: Column | None = None) -> DataFrame:
    """One decision per session, at the bar of the decision hour: long in the top quintile of the score, short in the bottom one,
    out `hold` bars later; gross, cost and net in bp."""
    ahead = series.lead("close", hold)
    out_time = series.lead(series.order[0], hold)
    # a count of nights may look ahead too, so it is made before rows are dropped
    d = bars.withColumns({"exit": ahead, "exit_time": out_time, "nights": nights if nights is not None else F.lit(0)})
    s = F.col(score)
    side = F.when(s >= high, 1.0).when(s <= low, -1.0)
    d = d.withColumn("side", side).filter((at_hour if at_hour is not None else F.hour(series.order[0])) == hour)
    w = Window.partitionBy(*series.keys, session).orderBy(*series.order)
    d = d.withColumn("__r", F.row_number().over(w)).filter("__r = 1 AND side IS NOT NULL AND exit IS NOT NULL")
    d = d.withColumn("gross_bp", F.col("side") * F.ln(F.col("exit") / F.col("close")) * 1e4)
    d = d.withColumn("cost_bp", F.lit(2 * cost_bp) + F.col("nights") * F.lit(swap_bp))
    return d.select(*series.keys, F.col(series.order[0]).alias("entry_time"), "exit_time", "side", F.col(score).alias("score"), F.col("close").alias("entry"), "exit", "gross_bp", "cost_bp", (F.col("gross_bp") - F.col("cost_bp")).alias("net_bp"), "nights")


def reversion_summary(trades: DataFrame, keys: tuple[str, ...] = (), trades_per_year: float = 252.0) -> DataFrame:
    """Trades, win rate, mean gross, cost and net, t, Sharpe and the share of longs."""
    n = F.col("net_bp")
    d = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.avg((n > 0).cast("double")).alias("win_rate"), F.avg("gross_bp").alias("gross_bp"), F.avg("cost_bp").alias("cost_bp"), F.avg(n).alias("net_bp"),
        F.stddev_samp(n).alias("__sd"), F.avg((F.col("side") > 0).cast("double")).alias("long_share"),
    )
    return d.withColumns({"t": ratio(F.col("net_bp") * F.sqrt("trades"), F.col("__sd")), "sharpe": ratio(F.col("net_bp") * F.lit(trades_per_year**0.5), F.col("__sd"))}).drop("__sd")


def choose_in_sample(trades: DataFrame, least: int = 30, value: str = "net_R") -> DataFrame:
    """(config, in_mean, out_n, out_mean) of the configuration with the best mean among in-sample trades, of those with enough; its
    held-out trades beside. trades has config and the boolean in_sample."""
    x, inside = F.col(value), F.col("in_sample")
    d = trades.groupBy("config").agg(
        F.count(F.when(inside, x)).alias("in_n"), F.avg(F.when(inside, x)).alias("in_mean"), F.count(F.when(~inside, x)).alias("out_n"), F.avg(F.when(~inside, x)).alias("out_mean")
    )
    return d.filter(F.col("in_n") >= least).orderBy(F.col("in_mean").desc(), "config").limit(1)


def breakdown(trades: DataFrame, dims: list[str], value: str = "net_R") -> DataFrame:
    """Trades, win rate and mean over all rows and by each dimension alone, in one pass of grouping sets; a dimension that a row does
    not group by is null."""
    sets = [[]] + [[F.col(d)] for d in dims]
    x = F.col(value)
    return trades.groupingSets(sets, *[F.col(d) for d in dims]).agg(F.grouping_id().alias("level"), F.count(x).alias("trades"), F.avg((x > 0).cast("double")).alias("win_rate"), F.avg(x).alias("mean"))


def allowed_for(side: Column | str, all_gates: Column, implied: Column) -> Column:
    """Whether the gates let a side trade: all are open and the partner implies that side."""
    s = F.col(side) if isinstance(side, str) else side
    return F.coalesce(all_gates & (F.signum(implied) == F.signum(s)), F.lit(False))


def permitted(entries: DataFrame, gates: DataFrame, keys: tuple[str, ...], ts: str, side: str = "side") -> DataFrame:
    """entries with `allowed`, by the last row of a regime table (keys, ts, all_gates, implied) at or before their stamp; an entry before
    the table begins isn't allowed."""
    return asof(entries, gates, keys, ts, ["all_gates", "implied"]).withColumn("allowed", allowed_for(side, F.col("all_gates"), F.col("implied")))
