"""A corpus pipeline: quality rules, language ID, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of `documents`.

Defined results. Rows with a null or empty text, and all others that fail the base rules, go in the first stage; a null id, lang
or source is kept. Without labels the forest's default threshold holds, without any known lang the language stage keeps all
rows. Of repeated rows and near copies one stays, and mixing uses it as often as its source's share asks. Columns beyond
those of `documents`, whatever their names, pass through to the last stage, which returns pieces. Empty tables give none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import language_id, mixing, near_duplicates, packing, quality_rules
from tessella.llm.common import materialise, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Rows that Spark sends to a Python worker at once. Workers of one stage stay alive for a while beside the next stage's, so what
#: each holds is kept small.
BATCH_ROWS = "2000"


def lean(stage: Stage) -> Stage:
    """The stage with small Arrow batches."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", lean(quality_rules.stage)),
    ("language_id", lean(language_id.stage)),
    ("near_duplicates", lean(near_duplicates.stage)),
    ("mixing", lean(mixing.stage)),
    ("packing", lean(packing.stage)),
]

#: Isolation forests, n-gram models and tokenizers are beyond SQL; tests/llm/test_contracts.py holds each stage's rows against a
#: brute-force version, and the number of run()'s rows against its stages one by one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
