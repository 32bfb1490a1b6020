"""Readers on written files, and streams run to their end."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessella.sources import files
from tessella.streaming.bars import session_bars, stream_bars, stream_ewma


def test_minute_bars_drop_clock_changes_and_repeats(spark, tmp_path):
    p = tmp_path / "EURUSD_M1.csv"
    p.write_text("20260105 100000;1;2;0.5;1.5;0\n20260105 100000;9;9;9;9;0\n20260308 023000;1;1;1;1;0\n20261101 013000;1;1;1;1;0\nnonsense;1;1;1;1;0\n")
    rows = files.minute_bars(spark, str(p)).collect()
    assert [(r.symbol, str(r.ts), r.open, r.tick_count) for r in rows] == [("EURUSD", "2026-01-05 15:00:00", 1.0, None)]
    report = files.load_report(files.read_csv(spark, str(p), files.M1, ";", False)).head()
    assert (report.files, report.n_rows, report.duplicates, report.volume_all_zero) == (1, 5, 1, True)


def test_ticks_keep_repeats(spark, tmp_path):
    p = tmp_path / "EURUSD_T.csv"
    p.write_text("20260105 100000123,1.0,1.2,0\n20260105 100000123,1.1,1.3,0\n")
    rows = files.ticks(spark, str(p)).orderBy("tick_id").collect()
    assert [round(r.mid, 6) for r in rows] == [1.1, 1.2] and round(rows[0].spread, 6) == 0.2


def test_caches_keep_the_last_and_codec(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text("Date,Open,High,Low,Close,Volume\n2026-01-05,1,1,1,1,5\n2026-01-05,2,2,2,2,5\n2026-01-06,NaN,1,1,1,5\n")
    rows = files.daily_cache(spark, str(p), "EURUSD=X").orderBy("date").collect()
    assert [(r.open, r.close) for r in rows] == [(2.0, 2.0), (None, 1.0)]
    assert files.file_stem("^EUR/USD=X") == "_c_EUR_USD_eq_X"
    out = str(tmp_path / "cache")
    files.write_cache(files.daily_cache(spark, str(p), "a"), out)
    assert spark.read.parquet(out).filter("symbol = 'a'").count() == 2
    log = str(tmp_path / "log")
    for _ in range(2):
        files.append_log(spark.range(1), log)
    assert spark.read.json(log).count() == 2


def ticks(spark, folder):
    start = datetime(2026, 1, 5, 16, 30)
    rows = [("x", start + timedelta(minutes=10 * k), k, 100.0 + k) for k in range(12)]
    spark.createDataFrame(rows, "symbol string, ts timestamp, tick_id long, mid double").coalesce(1).write.parquet(folder)
    return spark.readStream.schema("symbol string, ts timestamp, tick_id long, mid double").parquet(folder)


def finish(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_stream_of_bars_holds_back_open_windows(spark, tmp_path):
    s = ticks(spark, str(tmp_path / "t")).withColumn("spread", F.lit(0.1))
    rows = finish(stream_bars(s, "30 minutes", "5 minutes"), "bars30")
    assert sorted(r.open for r in rows) == [100.0, 103.0, 106.0] and {r.volume for r in rows} == {3}


def test_session_bars_begin_at_the_cut(spark, tmp_path):
    b = session_bars(ticks(spark, str(tmp_path / "t")), "1 minute")
    rows = finish(b, "sessions")
    assert [(str(r.session_start), r.volume) for r in rows] == [("2026-01-04 17:00:00", 3)]


def test_stream_state_is_the_recursion(spark, tmp_path):
    folder = str(tmp_path / "r")
    start = datetime(2026, 1, 5)
    spark.createDataFrame([("x", start + timedelta(minutes=k), r) for k, r in enumerate([0.1, 0.2, 0.3])], "symbol string, ts timestamp, ret double").coalesce(1).write.parquet(folder)
    s = spark.readStream.schema("symbol string, ts timestamp, ret double").parquet(folder)
    got = [r.variance for r in sorted(finish(stream_ewma(s), "ewma"), key=lambda r: r.ts)]
    assert got[0] is None and abs(got[1] - 0.01) < 1e-12 and abs(got[2] - (0.94 * 0.01 + 0.06 * 0.04)) < 1e-12
