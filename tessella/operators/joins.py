"""As-of, range, interval and pair joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.ordering import Series, ratio


def asof(left: DataFrame, right: DataFrame, keys: tuple[str, ...], on: str, values: list[str], direction: str = "backward", strict: bool = False) -> DataFrame:
    """left with the values of the nearest right row at or before (`backward`) or at or after (`forward`) its stamp; strict leaves
    out equal stamps.

    Both sides are put in one table and a window carries the last right row along: one shuffle by key and a sort, whatever the
    ratio of the sides, and no pair of rows is formed. Right stamps must be unique by key.
    """
    packed = F.struct(*values)
    # at equal stamps, a right row that counts comes first in the direction of travel
    side = F.lit(1 if strict else 0)
    r = right.select(*keys, F.col(on), packed.alias("__v"), side.alias("__side"), *[F.lit(None).cast(t).alias(f"__l_{c}") for c, t in left.dtypes])
    own = left.select(*keys, F.col(on), F.lit(None).cast(right.select(packed.alias("v")).schema["v"].dataType).alias("__v"), F.lit(0 if strict else 1).alias("__side"), *[F.col(c).alias(f"__l_{c}") for c in left.columns])
    is_left = own.withColumn("__left", F.lit(True)).unionByName(r.withColumn("__left", F.lit(False)))
    order = F.col(on).asc() if direction == "backward" else F.col(on).desc()
    w = Window.partitionBy(*keys).orderBy(order, "__side").rowsBetween(Window.unboundedPreceding, 0)
    done = is_left.withColumn("__n", F.last("__v", ignorenulls=True).over(w)).filter("__left")
    return done.select(*[F.col(f"__l_{c}").alias(c) for c in left.columns], *[F.col(f"__n.{v}").alias(v) for v in values])


def median_step(bars: DataFrame, series: Series, ts: str = "ts") -> DataFrame:
    """(keys, step): the median distance of neighbouring stamps in seconds."""
    gap = F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(series.lag(F.col(ts).cast("timestamp")))
    return bars.withColumn("__g", gap).groupBy(*series.keys).agg(F.percentile("__g", F.lit(0.5)).cast("long").alias("step"))


def later(at: Column, seconds: Column, kind: str) -> Column:
    """A stamp of a type (date, timestamp, ...) so many seconds on; a date that isn't over by then becomes the next one, as nothing is known
    before its time."""
    room = F.when(F.lit(kind == "date"), F.lit(86_399)).otherwise(F.lit(0))
    return (at.cast("timestamp") + F.make_dt_interval(secs=seconds + room)).cast(kind)


def shifted_to_close(bars: DataFrame, series: Series, ts: str = "ts") -> DataFrame:
    """Bars stamped with the time at which they are complete: their stamp and the median step."""
    return bars.join(median_step(bars, series, ts), list(series.keys)).withColumn(ts, later(F.col(ts), F.col("step"), dict(bars.dtypes)[ts])).drop("step")


def align_to(lower: DataFrame, higher: DataFrame, series: Series, values: list[str], ts: str = "ts") -> DataFrame:
    """Each lower-frame row with the values of the last higher-frame bar that has closed by its stamp."""
    return asof(lower, shifted_to_close(higher, series, ts), series.keys, ts, values)


def in_ranges(rows: DataFrame, ranges: DataFrame, value: str, start: str, end: str, half_open: bool = False) -> DataFrame:
    """Rows with each range that holds their value. Ranges are a dimension of a few rows, and are broadcast."""
    upper = F.col(value) < F.col(end) if half_open else F.col(value) <= F.col(end)
    return rows.join(F.broadcast(ranges), (F.col(value) >= F.col(start)) & upper)


def touches_zone(bars: DataFrame, zones: DataFrame, keys: tuple[str, ...], bar: str = "bar", max_age: int = 24) -> DataFrame:
    """Bars (keys, bar, side, low, high) whose range overlaps a zone (keys, known_bar, side, lo, hi) of their side that was known
    before and is not older than max_age: a left semi-join.

    Bars and zones meet by blocks of max_age bars: a zone can be live in its own block and the next, so it is sent to two, and
    the join has equal keys.
    """
    z = zones.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("side").alias("__side"), "known_bar", "lo", "hi")
    z = z.withColumn("__blk", F.explode(F.sequence(F.floor(F.col("known_bar") / max_age), F.floor(F.col("known_bar") / max_age) + 1)))
    b = bars.withColumn("__b", F.floor(F.col(bar) / max_age))
    on = (F.col("__b") == F.col("__blk")) & (F.col("side") == F.col("__side"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    live = (F.col("known_bar") < F.col(bar)) & (F.col("known_bar") >= F.col(bar) - max_age) & (F.col("low") <= F.col("hi")) & (F.col("high") >= F.col("lo"))
    return b.join(z, on & live, "left_semi").drop("__b")


def observed_spread(bid: DataFrame, ask: DataFrame, keys: tuple[str, ...], ts: str = "ts") -> DataFrame:
    """(keys, ts, spread, crossed): (ask - bid) / mid on stamps of both sides, not below 0."""
    j = bid.select(*keys, ts, F.col("close").alias("__b")).join(ask.select(*keys, ts, F.col("close").alias("__a")), [*keys, ts])
    s = (F.col("__a") - F.col("__b")) / ((F.col("__a") + F.col("__b")) / 2)
    return j.select(*keys, ts, F.greatest(F.lit(0.0), s).alias("spread"), (s < 0).alias("crossed"))


def real_cost_bp(bars: DataFrame, spreads: DataFrame, series: Series, bucket: Column, commission_bp: float = 0.0, ts: str = "ts") -> DataFrame:
    """Half the median spread observed inside each bar, carried forward, else the series' median (of the full sample: not
    causal), and the commission. bucket is a spread row's bar stamp."""
    keys = series.keys
    inside = spreads.groupBy(*keys, bucket.alias(ts)).agg(F.percentile(F.col("spread") * 1e4 / 2, F.lit(0.5)).alias("__m"))
    d = bars.join(inside, [*keys, ts], "left")
    carried = F.last("__m", ignorenulls=True).over(series.upto())
    whole = F.percentile("__m", F.lit(0.5)).over(Window.partitionBy(*keys))
    return d.withColumn("cost_bp", F.coalesce(carried, whole) + F.lit(commission_bp)).drop("__m")


def best_partner(paths: DataFrame, moves: DataFrame, date: str, rho_min: float, rho: str = "rho") -> DataFrame:
    """(date, asset, partner, rho, implied): the partner of largest absolute correlation (the first by name among those equal to 12
    digits: a path begins with correlations of 1 or -1, which only rounding errors would tell apart) and the side it implies: sign(rho) * sign(its own recent move), 0 below rho_min. paths has each pair once; moves is (date, asset,
    move)."""
    both = paths.select(date, F.col("asset_i").alias("asset"), F.col("asset_j").alias("partner"), rho).unionByName(paths.select(date, F.col("asset_j").alias("asset"), F.col("asset_i").alias("partner"), rho))
    w = Window.partitionBy(date, "asset").orderBy(F.round(F.abs(rho), 12).desc(), "partner")
    top = both.filter(F.col(rho).isNotNull()).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    m = moves.select(date, F.col("asset").alias("partner"), "move")
    implied = F.when(F.abs(rho) >= rho_min, F.signum(rho) * F.signum("move")).otherwise(F.lit(0.0))
    return top.join(m, [date, "partner"], "left").withColumn("implied", F.coalesce(implied, F.lit(0.0))).select(date, "asset", "partner", rho, "implied")


def distinct_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by order: the union of chunks without their overlaps."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def correlation_of(cov: DataFrame, date: tuple[str, ...] = ()) -> DataFrame:
    """Long correlations of long covariances (i <= j): value / sqrt(variances), 1 on the diagonal, null where a variance is not
    positive."""
    var = cov.filter("asset_i = asset_j").select(*date, F.col("asset_i").alias("a"), F.when(F.col("value") > 0, F.col("value")).alias("v"))
    out = cov.join(var.select(*date, F.col("a").alias("asset_i"), F.col("v").alias("vi")), [*date, "asset_i"]).join(var.select(*date, F.col("a").alias("asset_j"), F.col("v").alias("vj")), [*date, "asset_j"])
    rho = F.when((F.col("asset_i") == F.col("asset_j")) & F.col("vi").isNotNull(), F.lit(1.0)).otherwise(ratio(F.col("value"), F.sqrt(F.col("vi") * F.col("vj"))))
    return out.select(*date, "asset_i", "asset_j", rho.alias("value"))
