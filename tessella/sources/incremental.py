"""Tables that are rebuilt where their inputs changed.

A table has a partition for each key, and a record of the fingerprint of the rows that each partition was built from. A run compares
fingerprints, builds the partitions whose inputs are new or changed, overwrites these alone, and writes the record last. Rows carry
the fingerprint they were built from, and a reader takes those that the record names: a run that was cut off leaves the table as it
was, and a key whose inputs are gone, or now give no rows, is gone from the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.stage import staged

RECORD, BUILT = "_record", "__built"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def fingerprints(rows: DataFrame, key: str, salt: str = "") -> DataFrame:
    """(key, __built): number and hash sum of each key's rows, in any order."""
    total = F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))
    return rows.groupBy(key).agg(F.concat_ws(":", F.lit(salt), F.count(F.lit(1)).cast("string"), total.cast("string")).alias(BUILT))


def fingerprint(rows: DataFrame) -> str:
    """Of a whole table."""
    return fingerprints(rows.withColumn("__all", F.lit(1)), "__all").select(BUILT).first()[0] if rows.head(1) else "empty"


def rebuild(path: str, key: str, inputs: DataFrame, make: Callable[[DataFrame], DataFrame], version: str = "", shared: tuple[DataFrame, ...] = ()) -> list:
    """Bring the table at path up to date; returns the keys that were built. `make` gets the inputs of those keys. Tables in `shared`, and
    the version of the rules, bear on all keys."""
    spark = inputs.sparkSession
    now = staged(fingerprints(inputs, key, "/".join([version, *map(fingerprint, shared)])), "prints")
    record = f"{path}/{RECORD}"
    stale = staged(now.join(spark.read.parquet(record), [key, BUILT], "left_anti") if exists(spark, record) else now, "stale")
    built = [r[0] for r in stale.select(key).collect()]  # a name for each partition that is built
    if built:
        made = make(inputs.join(stale.select(key), key, "left_semi")).join(stale, key)
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    if built or not exists(spark, record) or spark.read.parquet(record).count() != now.count():
        now.write.mode("overwrite").parquet(record)
    return sorted(built)


def table(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows that the record names."""
    rows = spark.read.parquet(path).withColumn(key, F.col(key).cast("string"))
    return rows.join(spark.read.parquet(f"{path}/{RECORD}"), [key, BUILT], "left_semi").drop(BUILT)
