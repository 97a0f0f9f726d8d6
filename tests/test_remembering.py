"""Sweeps that remember earlier batches, and stored series that are never missing."""
from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from caseweave.operators import detect, linkage as lk
from caseweave.sources import snapshots
from caseweave.streaming import jobs

AS_OF, START = dt.date(2025, 6, 30), dt.date(2025, 1, 1)


def events(spark):
    rng = random.Random(1)
    days = [START + dt.timedelta(days=i) for i in range((AS_OF - START).days + 1)]
    rows = [(rng.choice("abcd"), dt.datetime.combine(rng.choice(days), dt.time(rng.randrange(24)))) for _ in range(300)]
    rows += [("a", dt.datetime.combine(AS_OF - dt.timedelta(days=i % 9), dt.time(3))) for i in range(40)]
    rows.sort(key=lambda r: r[1])
    return spark.createDataFrame(rows, "kind string, ts timestamp"), rows


def find(counts, _=None, weight="n", ts="day"):
    return detect.spikes(counts, ts, ["kind"], AS_OF, START, window_days=14, weight=weight, z_min=0.5).select("kind", "recent", "history")


@pytest.mark.parametrize("fold_every", [1, 2, 50])
def test_batches_give_the_answer_of_the_whole(spark, tmp_path, fold_every):
    whole, rows = events(spark)
    paths = {n: str(tmp_path / n) for n in ("in", "store", "out", "state")}
    for i in range(5):
        part = rows[i * len(rows) // 5:(i + 1) * len(rows) // 5]
        spark.createDataFrame(part, "kind string, ts timestamp").write.mode("append").parquet(paths["in"])
        stream = jobs.read_files(spark, paths["in"], "kind string, ts timestamp")
        jobs.remembering_sweep(stream, "ts", ["kind"], find, paths["store"], paths["out"], paths["state"], fold_every).awaitTermination()
    got = sorted(map(tuple, jobs.latest_leads(spark, paths["out"]).collect()))
    want = sorted(map(tuple, find(whole, weight=None, ts="ts").collect()))
    assert got == want and want


def test_a_repeated_batch_counts_once(spark, tmp_path):
    whole, rows = events(spark)
    memory = jobs.DayCounts(spark, str(tmp_path / "m"), ["kind"], "ts", fold_every=2)
    parts = [spark.createDataFrame(rows[i::4], "kind string, ts timestamp") for i in range(4)]
    for i, part in enumerate(parts):
        memory.add(part, i)
        out = memory.add(part, i)
    assert out.agg(F.sum("n")).first()[0] == len(rows)


def test_a_rescan_never_leaves_readers_without_series(spark, tmp_path):
    path = str(tmp_path / "series")
    with pytest.raises(FileNotFoundError):
        lk.stored_series(spark, path)
    first = spark.range(5).withColumnRenamed("id", "series")
    assert lk.save_series(first, path) == 1
    pinned = lk.stored_series(spark, path)
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("series"))
    with pytest.raises(Exception, match="no"):
        lk.save_series(broken, path)
    assert lk.stored_series(spark, path).count() == 5
    lk.save_series(spark.range(9).withColumnRenamed("id", "series"), path)
    assert lk.stored_series(spark, path).count() == 9 and pinned.count() == 5 and lk.stored_series(spark, path, 1).count() == 5
    for n in (1, 2, 3):
        lk.save_series(spark.range(n).withColumnRenamed("id", "series"), path)
    assert len(snapshots.versions(spark, path)) == 3 and lk.stored_series(spark, path).count() == 3
    with pytest.raises(FileNotFoundError):
        lk.stored_series(spark, path, 1)
