from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from caseweave.sources import audit, tables
from caseweave.streaming import jobs


def test_lenient_dates(spark):
    df = spark.createDataFrame([("2024-05-01",), ("31/31/2024",), (None,)], "d string")
    assert [r["d"] for r in tables.coerce_temporal(df, dates=["d"]).collect()] == [dt.date(2024, 5, 1), None, None]


def test_csv_keeps_quotes_and_line_breaks(spark, tmp_path):
    rows = [("1", 'say "hi", then\nleave'), ("2", "plain")]
    tables.export_csv({"t": spark.createDataFrame(rows, "a string, b string")}, str(tmp_path))
    assert {tuple(r) for r in tables.read_csv(spark, f"{tmp_path}/t.csv", ["a", "b"]).collect()} == set(rows)


def test_audit_rows_are_appended_and_read_newest_first(spark, tmp_path):
    path = str(tmp_path / "audit")
    for i in range(3):
        assert audit.write_audit(spark, path, f"u{i}", "SCRB", "chat", {"n": i})
    log = spark.read.parquet(path)
    assert log.count() == 3 and log.select("audit_id").distinct().count() == 3
    assert audit.tail(log, 1).first()["user_id"] == "u2"


def test_status(spark):
    spark.range(4).createOrReplaceTempView("there")
    got = {r["table_name"]: (r["present"], r["row_count"]) for r in tables.status(spark, ["there", "not_there"]).collect()}
    assert got == {"there": (True, 4), "not_there": (False, 0)}


def test_stream_windows_equal_batch_once_closed(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(hours=7 * i), "k") for i in range(100)]
    df = spark.createDataFrame(rows, "ts timestamp, k string")
    df.write.parquet(str(tmp_path / "in"))
    stream = jobs.read_files(spark, str(tmp_path / "in"), "ts timestamp, k string")
    jobs.write_once(jobs.window_counts(stream, "ts", ["k"]), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("window_start", "k", "n").collect()}
    closed = F.col("window_end") <= F.lit(rows[-1][0] - dt.timedelta(days=2))
    want = {tuple(r) for r in jobs.window_counts(df, "ts", ["k"]).where(closed).select("window_start", "k", "n").collect()}
    assert got == want and got


def test_sweep_writes_one_result_per_batch(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_files(spark, str(tmp_path / "in"), "id long")
    for _ in range(2):  # the second run finds nothing new
        jobs.sweep(stream, lambda df, _: df.agg(F.count("*").alias("n")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [20]
