"""The queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import cascade, market, risk, trading

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (market, risk, trading, cascade)


def queries() -> dict[str, Query]:
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    # as in the queries, -0 is 0
    return {name: sql.replace("round(", "0.0 + round(") for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["historical_var_es"](spark, sf_dir)
