"""Readers and writers with explicit schemas. Paths may be files, folders or globs of any file system Spark knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.ordering import finite
from tessella.operators.bars import deduplicated

M1 = "datetime string, open double, high double, low double, close double, volume double"
TICK = "datetime string, bid double, ask double, volume double"
DAILY = "Date string, Open double, High double, Low double, Close double, Volume double"
INTRADAY = "Datetime string, Open double, High double, Low double, Close double, Volume double"

# The columns of the formats above, and the characters of a symbol that don't stand in a file name with what stands
# for them.
CODEC = {"=": "_eq_", "^": "_c_", "/": "_"}


def file_stem(symbol: str) -> str:
    for a, b in CODEC.items():
        symbol = symbol.replace(a, b)
    return symbol


def symbol_of(stem: str) -> str:
    """The symbol of a file stem."""
    for a, b in CODEC.items():
        stem = stem.replace(b, a)
    return stem


def cached_symbols(spark: SparkSession, folder: str, suffix: str = ".csv") -> list[str]:
    """The symbols whose files are in a folder, by name; files are listed, not read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*{suffix}")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return sorted(symbol_of(f.getPath().getName()[: -len(suffix)]) for f in found)


def to_utc(wall: Column, zone: str) -> Column:
    """The instant of a wall-clock stamp; null for clock times that a change of clocks skips or repeats, as neither is one instant."""
    at = F.to_utc_timestamp(wall, zone)
    hour = F.expr("INTERVAL 1 HOUR")
    skipped = F.from_utc_timestamp(at, zone) != wall
    repeated = (F.from_utc_timestamp(at - hour, zone) == wall) | (F.from_utc_timestamp(at + hour, zone) == wall)
    return F.when(~skipped & ~repeated, at)


def read_csv(spark: SparkSession, path: str, schema: str, sep: str, header: bool) -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("header", header).option("recursiveFileLookup", True).csv(path)


def positioned(raw: DataFrame, out: str, most: int = 200_000) -> DataFrame:
    """raw, straight from files, with `out`: each row's ordinal over all files, by path and place in the file, whatever the splits.

    Rows of one split stand together in a partition, so a row's place in its split is known where it is read. What comes before
    the split is counted apart: a row a split, summed up in the order of paths and offsets.
    """
    d = raw.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__block")).withColumn("__id", F.monotonically_increasing_id())
    heads = d.groupBy("__path", "__block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__path", "__block").rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.withColumn("__before", F.coalesce(before, F.lit(0).cast("long"))).drop("__n")
    small = F.broadcast(heads) if heads.count() <= most else heads
    return d.join(small, ["__path", "__block"]).withColumn(out, F.col("__before") + F.col("__id") - F.col("__first")).drop("__path", "__block", "__id", "__first", "__before")


def minute_bars(spark: SparkSession, path: str, zone: str = "America/New_York", symbol: str | None = None) -> DataFrame:
    """`yyyyMMdd HHmmss;o;h;l;c;v` without header: (symbol, ts, o, h, l, c, tick_count). There are no tick counts in this format: null,
    never made up. Of repeated stamps the first in file order stays."""
    raw = positioned(read_csv(spark, path, M1, ";", False).withColumn("__file", F.input_file_name()), "__pos")
    wall = F.try_to_timestamp("datetime", F.lit("yyyyMMdd HHmmss"))
    d = raw.withColumn("ts", to_utc(wall, zone)).filter("ts IS NOT NULL").withColumn("symbol", F.lit(symbol) if symbol else F.regexp_extract("__file", r"([A-Za-z]{6})[^/]*$", 1))
    d = deduplicated(d, ("symbol", "ts"), "__pos", keep="first")
    return d.select("symbol", "ts", "open", "high", "low", "close", F.lit(None).cast("double").alias("tick_count"))


def ticks(spark: SparkSession, path: str, zone: str = "America/New_York", symbol: str | None = None) -> DataFrame:
    """`yyyyMMdd HHmmssSSS,bid,ask,v` without header: (symbol, ts, tick_id, bid, ask, mid, spread). Repeated stamps stay. tick_id is the row's place in its files."""
    raw = positioned(read_csv(spark, path, TICK, ",", False).withColumn("__file", F.input_file_name()), "tick_id")
    wall = F.try_to_timestamp("datetime", F.lit("yyyyMMdd HHmmssSSS"))
    d = raw.withColumn("ts", to_utc(wall, zone)).filter("ts IS NOT NULL").withColumn("symbol", F.lit(symbol) if symbol else F.regexp_extract("__file", r"([A-Za-z]{6})[^/]*$", 1))
    return d.select("symbol", "ts", "tick_id", "bid", "ask", ((F.col("bid") + F.col("ask")) / 2).alias("mid"), (F.col("ask") - F.col("bid")).alias("spread"))


def load_report(raw: DataFrame, stamp: str = "datetime", volume: str = "volume") -> DataFrame:
    """Files, rows, first and last stamp, repeated stamps, and whether all volume is 0."""
    return raw.withColumn("__file", F.input_file_name()).agg(
        F.count_distinct("__file").alias("files"), F.count(F.lit(1)).alias("n_rows"), F.min(stamp).alias("first_ts"), F.max(stamp).alias("last_ts"),
        (F.count(stamp) - F.count_distinct(stamp)).alias("duplicates"), F.bool_and(F.coalesce(F.col(volume), F.lit(0)) == 0).alias("volume_all_zero"),
    )


def normalised(raw: DataFrame, stamp: str, out: str, kind: str) -> DataFrame:
    """Lower-case OHLCV columns, with NaN and infinities as null."""
    names = {c.lower(): c for c in raw.columns}
    stamp_col = F.col(stamp).cast(kind).alias(out)
    return raw.select(stamp_col, *[finite(F.col(names[c]).cast("double")).alias(c) for c in ("open", "high", "low", "close", "volume")])


def daily_cache(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """One instrument's daily file; of repeated dates the last in file order stays."""
    raw = positioned(read_csv(spark, path, DAILY, ",", True), "__pos")
    kept = deduplicated(raw, ("Date",), "__pos", keep="last")
    return normalised(kept, "Date", "date", "date").withColumn("symbol", F.lit(symbol))


def intraday_cache(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """One instrument's intraday file with stamps in UTC; of repeated stamps the last in file order stays."""
    raw = positioned(read_csv(spark, path, INTRADAY, ",", True), "__pos")
    kept = deduplicated(raw, ("Datetime",), "__pos", keep="last")
    return normalised(kept, "Datetime", "ts", "timestamp").withColumn("symbol", F.lit(symbol))


def broker_spreads(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """A broker's bar export with its spread: (symbol, ts, o, h, l, c, volume, spread), the spread over the bar's middle price."""
    raw = read_csv(spark, path, "Datetime string, Open double, High double, Low double, Close double, TickVolume double, SpreadPoints double, SpreadPrice double", ",", True)
    mid = (F.col("High") + F.col("Low")) / 2
    return raw.select(F.lit(symbol).alias("symbol"), F.col("Datetime").cast("timestamp").alias("ts"), *[F.col(c).alias(c.lower()) for c in ("Open", "High", "Low", "Close")], F.col("TickVolume").alias("volume"), (F.col("SpreadPrice") / F.when(mid > 0, mid)).alias("spread"))


def event_calendar(spark: SparkSession, path: str) -> DataFrame:
    """(date, event) of an events file."""
    return read_csv(spark, path, "date string, event string", ",", True).select(F.to_date("date").alias("date"), F.trim("event").alias("event"))


def write_cache(df: DataFrame, path: str, partition: str = "symbol") -> None:
    """Parquet by instrument, so that a reader of one prunes the rest."""
    df.write.mode("overwrite").partitionBy(partition).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """JSON lines, appended."""
    df.write.mode("append").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as CSV with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
