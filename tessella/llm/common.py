"""What the corpus operators share: table access, scratch tables, ranks and bounded samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Words everywhere in this package: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test or corpus table by name; the path may be of any file system Spark knows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by the cluster (spark.checkpoint.dir). Where that is unset, a local master gets a temporary folder; any
    other master is refused, as its executors don't share one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialise(df: DataFrame, label: str = "part") -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there, and a lost executor costs nothing. The
    folder goes when the application ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tessella-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def unused(taken: list[str], *names: str) -> list[str]:
    """Column names made from the given ones that clash with no taken one, whatever its case."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        k = 0
        while f"{name}_{k}" in have:
            k += 1
        out.append(f"{name}_{k}")
        have.add(out[-1])
    return out


def sampled(df: DataFrame, key: Column, rows: int, total: int, salt: int = 0) -> DataFrame:
    """About `rows` of `total` rows, chosen by the hash of key: the same rows on every run and in every partitioning."""
    if total <= rows:
        return df
    cut = int((rows / total) * 2**32)
    return df.filter(F.pmod(F.xxhash64(F.lit(salt), key), F.lit(2**32)) < F.lit(cut))


def looked_up(rows: DataFrame, few: DataFrame, on: list[str], spread: Column, most: int = 100_000) -> DataFrame:
    """rows joined with a table that has one row a key. The table is counted, and broadcast up to `most` rows; beyond that, each of its
    rows is copied to 32 salts and rows are dealt among them by the hash of `spread`, so that a frequent key is no single task's."""
    if few.count() <= most:
        return rows.join(F.broadcast(few), on)
    (salt,) = unused([*rows.columns, *few.columns], "salt")
    copies = few.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(31))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(F.lit(3), spread), F.lit(32)).cast("int")).join(copies, [*on, salt]).drop(salt)


def numbered(df: DataFrame, group: list[str], key: Column, out: str, rows: int, per_bucket: int = 20_000) -> DataFrame:
    """Add column `out`: a gapless number from 0 inside each group, without putting a group into one task.

    Rows go to hash buckets of about per_bucket rows of a table of `rows` rows. Bucket sizes are counted, summed up inside
    each group (one row per bucket), and row_number runs inside (group, bucket) only. Rows equal in key may take either
    order. Group columns must not be null.
    """
    n = max(1, -(-rows // per_bucket))
    b = df.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(7), key), F.lit(n)).cast("int"))
    starts = (
        b.groupBy(*group, "__bucket")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn(
            "__start",
            F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .drop("__n")
    )
    names = [*group, "__bucket"]
    return (
        b.withColumn(out, F.row_number().over(Window.partitionBy(*names).orderBy(key)) - 1)
        .join(starts, names)
        .withColumn(out, (F.col(out) + F.col("__start")).cast("long"))
        .drop("__bucket", "__start")
    )


def struct_of(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])
