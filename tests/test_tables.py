"""Stable places of rows in files, incremental tables, and dynamic correlations pair by pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import garch as G
from tessella.operators import research as Q
from tessella.operators import stress as S
from tessella.sources import files
from tessella.sources import incremental as I


@pytest.fixture
def split(spark):
    """Set the size of splits."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def to(size):
        for n in names:
            spark.conf.set(n, size)

    yield to
    for n, v in before.items():
        spark.conf.set(n, v)


def test_tick_ids_and_repeats_do_not_depend_on_splits(spark, tmp_path, split):
    rng = np.random.default_rng(3)
    want = []
    for name in ("EURUSD_2.csv", "EURUSD_1.csv"):
        rows = [f"20260105 10{k // 600 % 60:02d}{k // 10 % 60:02d}000,{rng.random():.4f},{1 + rng.random():.4f},0" for k in range(3000)]
        (tmp_path / name).write_text("\n".join(rows) + "\n")
        want = rows + want  # files count by path
    found = []
    for size in ("128m", "3k", "40k"):
        split(size)
        d = files.ticks(spark, str(tmp_path))
        found.append([(r.tick_id, r.bid) for r in d.orderBy("tick_id").collect()])
        assert d.rdd.getNumPartitions() >= (1 if size == "128m" else 2)
    assert found[0] == found[1] == found[2] == [(k, float(r.split(",")[1])) for k, r in enumerate(want)]


def test_the_first_and_last_of_repeated_stamps_do_not_depend_on_splits(spark, tmp_path, split):
    (tmp_path / "EURUSD_M1.csv").write_text("".join(f"20260105 10{k % 40:02d}00;{k};{k};{k};{k};0\n" for k in range(2000)))
    (tmp_path / "d.csv").write_text("Date,Open,High,Low,Close,Volume\n" + "".join(f"2026-01-{k % 25 + 1:02d},{k},{k},{k},{k},5\n" for k in range(1000)))
    for size in ("128m", "2k"):
        split(size)
        assert sorted(r.open for r in files.minute_bars(spark, str(tmp_path / "EURUSD_M1.csv")).collect()) == [float(k) for k in range(40)]
        assert sorted(r.open for r in files.daily_cache(spark, str(tmp_path / "d.csv"), "x").collect()) == [float(k) for k in range(975, 1000)]


def test_symbols_of_a_folder(spark, tmp_path):
    names = ["^EUR/USD=X", "GC=F", "plain"]
    for n in names:
        (tmp_path / f"{files.file_stem(n)}.csv").write_text("")
        assert files.symbol_of(files.file_stem(n)) == n
    (tmp_path / "other.txt").write_text("")
    assert files.cached_symbols(spark, str(tmp_path)) == sorted(names)
    assert files.cached_symbols(spark, str(tmp_path / "none")) == []


def rows_of(spark, cells):
    return spark.createDataFrame(cells, "symbol string, date int, x double")


def test_a_rerun_rebuilds_what_changed(spark, tmp_path):
    path, made = str(tmp_path / "table"), []

    def make(stale):
        made.append(sorted({r.symbol for r in stale.select("symbol").collect()}))
        return stale.filter("x >= 0").withColumn("y", F.col("x") * 2)

    a = [("a", k, float(k)) for k in range(3)]
    b = [("b", k, float(k)) for k in range(2)]
    assert I.rebuild(path, "symbol", rows_of(spark, a + b), make) == ["a", "b"]
    # the same rows in another order and partitioning
    assert I.rebuild(path, "symbol", rows_of(spark, (b + a)[::-1]).repartition(3), make) == []
    seen = lambda: sorted((r.symbol, r.date, r.y) for r in I.table(spark, path, "symbol").collect())
    assert seen() == [("a", 0, 0.0), ("a", 1, 2.0), ("a", 2, 4.0), ("b", 0, 0.0), ("b", 1, 2.0)]
    assert I.rebuild(path, "symbol", rows_of(spark, a + [("b", 0, 9.0)]), make) == ["b"]
    assert seen() == [("a", 0, 0.0), ("a", 1, 2.0), ("a", 2, 4.0), ("b", 0, 18.0)]
    # rows that give nothing, a key that is gone, one that is new
    assert I.rebuild(path, "symbol", rows_of(spark, [("b", 0, -1.0), ("c", 5, 1.0)]), make) == ["b", "c"]
    assert seen() == [("c", 5, 2.0)]
    assert I.rebuild(path, "symbol", rows_of(spark, [("c", 5, 1.0)]), make) == [] and seen() == [("c", 5, 2.0)]
    # a shared table or the rules bear on all
    shared = (rows_of(spark, a),)
    assert I.rebuild(path, "symbol", rows_of(spark, a + b), make, "2", shared) == ["a", "b"]
    assert I.rebuild(path, "symbol", rows_of(spark, a + b), make, "2", shared) == []
    assert I.rebuild(path, "symbol", rows_of(spark, a + b), make, "2", (rows_of(spark, b),)) == ["a", "b"]
    assert made == [["a", "b"], ["b"], ["b", "c"], ["a", "b"], ["a", "b"]]


def test_permission_comes_from_the_last_row_before(spark):
    g = spark.createDataFrame([("a", 10, True, 1.0), ("a", 20, True, -1.0), ("a", 30, False, 1.0), ("a", 40, None, 1.0)], "symbol string, ts int, all_gates boolean, implied double")
    e = spark.createDataFrame([("a", t, s) for t in (5, 10, 19, 25, 35, 45) for s in (1.0, -1.0)] + [("b", 25, 1.0)], "symbol string, ts int, side double")
    got = {(r.symbol, r.ts, r.side) for r in Q.permitted(e, g, ("symbol",), "ts").filter("allowed").collect()}
    assert got == {("a", 10, 1.0), ("a", 19, 1.0), ("a", 25, -1.0)}


def test_dynamic_correlations_equal_the_fold_of_the_panel(spark):
    rng = np.random.default_rng(8)
    z = rng.normal(size=(300, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 1]])
    names = ["a", "b", "c"]
    df = spark.createDataFrame([(t, names[k], float(z[t, k])) for t in range(300) for k in range(3)], "date int, asset string, z double")
    want = G.dcc_filter(z, 0.04, 0.9, np.corrcoef(z, rowvar=False))
    d = G.dcc_scan(df, 0.04, 0.9)
    got = {(r.date, r.asset_i, r.asset_j): r.rho for r in d.collect()}
    assert len(got) == 900
    for (t, i, j), rho in got.items():
        assert rho == pytest.approx(want[t, names.index(i), names.index(j)], abs=1e-9)
    assert "Python" not in d._jdf.queryExecution().executedPlan().toString()
    table = S.dynamic_pairs(d, d, S.sample_correlation(df.withColumnRenamed("z", "ret"))).collect()
    assert [r.range for r in table] == sorted((r.range for r in table), reverse=True)
    for r in table:
        path = want[:300, names.index(r.asset_i), names.index(r.asset_j)]
        assert (r.last, r["mean"], r["min"], r["max"]) == pytest.approx((path[-1], path.mean(), path.min(), path.max()))
        assert r.drift == pytest.approx(r.ewma - r.sample)
    with pytest.raises(ValueError):
        G.dcc_scan(df, 0.1, 0.95)
