"""Streams equal their batch queries: late, repeated and unordered files included."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.plans import catalogue
from lodestone.streaming import windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The events in four files, the newest first, one of them twice."""
    path = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet(f"{SF}/events.parquet")
    for part in (3, 1, 2, 0, 1):
        e.filter(F.col("event_id") % 4 == part).orderBy(F.desc("event_id")).coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, stream, tmp_path, name, mode="complete"):
    windows.run_available(stream, name, str(tmp_path / "checkpoint"), mode)
    return spark.table(name)


def test_windows_over_distinct_events(spark, folder, tmp_path):
    once = windows.event_stream(spark, folder, maxFilesPerTrigger="1")
    got = run(spark, windows.deduplicated_stream(once, "60 days"), tmp_path, "once", "append")
    assert got.count() == got.select("event_id").distinct().count() == spark.read.parquet(f"{SF}/events.parquet").count()
    counted = windows.rate_window_stream(got.select("event_id", "ts", "event_type", "value"))
    want = catalogue.QUERIES["rate_window"](spark, SF).select(F.col("window_start").cast("timestamp").alias("window_start"), "event_type", "n", "most")
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, want.collect()))


def test_rate_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(path)
    got = run(spark, windows.rate_window_stream(windows.event_stream(spark, path, maxFilesPerTrigger="1"), late="60 days"), tmp_path, "rates")
    want = catalogue.QUERIES["rate_window"](spark, SF).select(F.col("window_start").cast("timestamp").alias("window_start"), "event_type", "n", "most")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_latest_state_ignores_order_and_repeats(spark, folder, tmp_path):
    got = windows.latest_of(run(spark, windows.latest_state_stream(windows.event_stream(spark, folder, maxFilesPerTrigger="1"), "60 days"), tmp_path, "latest"))
    want = catalogue.QUERIES["profile_state_latest"](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_sessions(spark):
    rows = [(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:20:00"), (1, "2024-01-01 11:30:00"), (2, "2024-01-01 10:05:00")]
    e = spark.createDataFrame(rows, "user_id long, ts string")
    got = windows.session_stream(e).orderBy("user_id", "start").select("user_id", "n").collect()
    assert [tuple(r) for r in got] == [(1, 2), (1, 1), (2, 1)]
