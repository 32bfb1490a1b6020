"""Every query with SQL against DuckDB on the smallest tables; the others must run and have stable columns."""

import duckdb
import pytest

from tessella.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Fits of minutes; tests/test_whole_tables.py holds their operators to account.
SLOW = {"garch_var_path", "dcc_cov", "rolling_dcc_var"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def cells(df):
    names = sorted(df.columns)
    return sorted(tuple("~" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in row) for row in df[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    ours = registry.queries()[name](spark, SF).toPandas()
    theirs = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert cells(ours) == cells(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - SLOW))
def test_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.columns == registry.queries()[name](spark, SF).columns
    df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
