"""The tables the queries stand on, in Spark and in SQL: ticks and hourly bars of `events`, daily bars and returns of `orders`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.ordering import Series
from tessella.operators import bars as B

DAILY = Series(("symbol",), ("date",))
HOURLY = Series(("symbol",), ("ts",))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, tick_id, bid, ask, mid, spread, size: the event's value as bid, the ask k hundredths of a percent above."""
    k = F.get_json_object("props", "$.k").cast("long")
    return (
        read(spark, sf_dir, "events")
        .filter("value > 0")
        .select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("tick_id"), F.col("value").alias("bid"), (F.col("value") * (1 + k * 1e-4)).alias("ask"), k.alias("size"))
        .transform(B.mid_and_spread)
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.ticks_to_bars(ticks(spark, sf_dir), "1 hour", price="bid")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date and OHLCV of a day's orders, in the order of their keys."""
    o = read(spark, sf_dir, "orders")
    p = F.col("o_totalprice")
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(
        F.min_by(p, "o_orderkey").alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, "o_orderkey").alias("close"), F.count(F.lit(1)).alias("volume")
    )


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily with `ret`, the log return, scaled by 100 (the synthetic prices jump about)."""
    return B.log_returns(daily(spark, sf_dir), DAILY).withColumn("ret", F.col("ret") / 100)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, asset, ret) on dates that all five symbols have."""
    d = daily(spark, sf_dir)
    full = B.aligned_dates(d, 5)
    p = B.log_returns(d.join(full, "date"), DAILY).filter("ret IS NOT NULL")
    return p.select("date", F.col("symbol").alias("asset"), (F.col("ret") / 100).alias("ret"))


TICKS_SQL = """ticks AS (
  SELECT event_type AS symbol, ts, event_id AS tick_id, value AS bid, value * (1 + k * 1e-4) AS ask, k AS size, (value * (1 + k * 1e-4) + value) / 2 AS mid, value * (1 + k * 1e-4) - value AS spread
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE value > 0))"""

HOURLY_SQL = TICKS_SQL + """, bars AS (
  SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(bid, (ts, tick_id)) AS open, max(bid) AS high, min(bid) AS low, arg_max(bid, (ts, tick_id)) AS close, count(*) AS volume, avg(spread) AS mean_spread
  FROM ticks GROUP BY ALL)"""

DAILY_SQL = """daily AS (
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
    arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY ALL)"""

RETURNS_SQL = DAILY_SQL + """, rets AS (
  SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) / 100 AS ret, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM daily)"""

PANEL_SQL = DAILY_SQL + """, full_dates AS (SELECT date FROM daily GROUP BY date HAVING count(*) = 5),
panel AS (SELECT date, symbol AS asset, ret FROM (
  SELECT date, symbol, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) / 100 AS ret FROM daily JOIN full_dates USING (date)) WHERE ret IS NOT NULL)"""
