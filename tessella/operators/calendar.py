"""Sessions, calendar flags, blackout masks, folds and splits."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.ordering import Series, column
from tessella.operators.bars import local

# Trading centres, their zones and hours (half open, on the centre's own clock).
CENTRES = {
    "tokyo": ("Asia/Tokyo", 9.0, 17.0),
    "london": ("Europe/London", 8.0, 16.5),
    "newyork": ("America/New_York", 8.0, 16.0),
    "sydney": ("Australia/Sydney", 8.0, 17.0),
}


def clock(ts: Column) -> Column:
    """Hours of the day with minutes as fractions."""
    return F.hour(ts) + F.minute(ts) / 60.0


def in_sessions(ts: Column | str, names: list[str], centres: dict[str, tuple[str, float, float]] = CENTRES) -> Column:
    """Whether an instant (UTC) is inside any named centre's hours, Monday to Friday on that centre's clock."""
    unknown = set(names) - set(centres)
    if unknown:
        raise ValueError(f"unknown sessions {sorted(unknown)}")
    inside = F.lit(False)
    for n in names:
        zone, low, high = centres[n]
        at = local(ts, zone)
        inside = inside | ((clock(at) >= low) & (clock(at) < high) & ~F.dayofweek(at).isin(1, 7))
    return inside


def blackout(ts: Column | str, zone: str = "America/New_York", releases: list[float] = (), index_open: bool = False) -> Column:
    """Whether an instant falls in a span of bad fills: the rollover from 16:45 to 18:00 (half open), 10 minutes before to 20 after
    a release, and for an index its 08:30 release (both ends in)."""
    at = local(ts, zone)
    h = F.hour(at) * 60 + F.minute(at)
    out = (h >= 16 * 60 + 45) & (h < 18 * 60)
    for r in [*releases, *([8.5] if index_open else [])]:
        out = out | ((h >= r * 60 - 10) & (h <= r * 60 + 20))
    return out


def flags(dates: DataFrame, col: str = "date", keys: tuple[str, ...] = ()) -> DataFrame:
    """Calendar flags of trading dates: first Friday present (nfp), third Friday present (opex), first and last date present of the
    month, last of the quarter, and turn (either end of the month)."""
    d = F.to_date(col)
    month = F.trunc(d, "month")
    friday = F.dayofweek(d) == 6
    base = Window.partitionBy(*keys, month)
    nth = F.when(friday, F.row_number().over(Window.partitionBy(*keys, month, friday).orderBy(col)))
    last = F.col(col) == F.max(col).over(base)
    first = F.col(col) == F.min(col).over(base)
    out = dates.withColumns({"nfp": F.coalesce(nth == 1, F.lit(False)), "opex": F.coalesce(nth == 3, F.lit(False)), "month_end": last, "month_first": first})
    return out.withColumns({"quarter_end": F.col("month_end") & F.month(d).isin(3, 6, 9, 12), "turn": F.col("month_end") | F.col("month_first")})


def flag_summary(flagged: DataFrame, names: list[str]) -> DataFrame:
    """Count and share of each flag, a row each."""
    wide = flagged.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(n)).alias(n) for n in names])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("flag"), F.col(n).alias("n_days"), (F.col(n) / F.col("n")).alias("share")) for n in names])).alias("r")
    return wide.select(rows).select("r.*")


def event_flags(dates: DataFrame, events: DataFrame, names: list[str], date_col: str = "date", event_col: str = "event") -> DataFrame:
    """One boolean column per event name for each date."""
    wide = events.groupBy(F.to_date(date_col).alias(date_col)).pivot(event_col, names).agg(F.count(F.lit(1)) > 0)
    return dates.join(wide, date_col, "left").select(*dates.columns, *[F.coalesce(F.col(n), F.lit(False)).alias(n) for n in names])


def day_of(ts: Column | str, cut_hour: int = 17) -> Column:
    """The trading day of a wall-clock stamp: it turns at cut_hour."""
    return F.to_date(column(ts) - F.expr(f"INTERVAL {cut_hour} HOURS"))


def nights_between(start: Column | str, end: Column | str, cut_hour: int = 17) -> Column:
    """Rollovers crossed, never negative."""
    return F.greatest(F.lit(0), F.datediff(day_of(end, cut_hour), day_of(start, cut_hour)))


def add_months(d: date, n: int) -> date:
    """n months on; a day the month doesn't have becomes its last."""
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    nxt = date(y + (m == 11), (m + 1) % 12 + 1, 1)
    return date(y, m + 1, min(d.day, (nxt - timedelta(days=1)).day))


def make_folds(start: date, end: date, train_months: int, test_months: int, step_months: int | None = None) -> list[dict]:
    """Walk-forward folds: half-open train and test spans, the test right after its training, none past the end. The step is the
    test's length unless given; spans and step are at least a month."""
    step, k, out = test_months if step_months is None else step_months, 0, []
    for name, months in (("train_months", train_months), ("test_months", test_months), ("step_months", step)):
        if months < 1:
            raise ValueError(f"{name} must be at least 1, not {months}")
    while True:
        a = add_months(start, k * step)
        b = add_months(a, train_months)
        c = add_months(b, test_months)
        if c > end:
            return out
        out.append({"fold": k, "train_start": a, "train_end": b, "test_start": b, "test_end": c})
        k += 1


def folds_frame(spark: SparkSession, folds: list[dict]) -> DataFrame:
    return spark.createDataFrame(folds, "fold int, train_start date, train_end date, test_start date, test_end date")


def split_at(rows: DataFrame, series: Series, share: float = 0.67) -> DataFrame:
    """rows with `in_sample`: whether the row is among the first share of its series, by ordinal."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*series.keys))
    return rows.withColumn("in_sample", F.row_number().over(series.window()) <= F.floor(n * F.lit(share)))


def gap_frame(bars: DataFrame, series: Series) -> DataFrame:
    """The gap from the last close to the open, and the change from open to close."""
    last = series.lag("close")
    return bars.withColumns({"gap": F.col("open") / F.when(last != 0, last) - 1, "intraday": F.col("close") / F.when(F.col("open") != 0, F.col("open")) - 1})
