"""Local times against the standard library's zones, ranks against Python, and catch-up that neither repeats nor replays."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone
from itertools import accumulate
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from lodestone.operators import schedules as S
from lodestone.operators.ranks import running


def brute(local, zone):
    z = ZoneInfo(zone)
    at = {fold: local.replace(tzinfo=z, fold=fold).astimezone(timezone.utc) for fold in (0, 1)}
    shows = [t for t in at.values() if t.astimezone(z).replace(tzinfo=None) == local]
    if shows:
        utc, kind = min(shows), "FOLD" if len(set(shows)) > 1 else "PLAIN"
    else:  # the first second that shows a later local time
        old, new = min(at.values()) - timedelta(days=2), max(at.values()) + timedelta(days=2)
        while new - old > timedelta(seconds=1):
            middle = old + timedelta(seconds=(new - old).total_seconds() // 2)
            old, new = (old, middle) if middle.astimezone(z).replace(tzinfo=None) > local else (middle, new)
        utc, kind = new, "GAP"
    return utc.replace(tzinfo=None), kind, 0, int(utc.astimezone(z).utcoffset().total_seconds() // 60)


WORKED = {
    ("2024-03-10 02:30", "America/New_York"): ("2024-03-10 07:00", "GAP"), ("2024-03-31 02:30", "Europe/Berlin"): ("2024-03-31 01:00", "GAP"), ("2024-11-03 01:30", "America/New_York"): ("2024-11-03 05:30", "FOLD"),
    ("2024-10-27 02:30", "Europe/Berlin"): ("2024-10-27 00:30", "FOLD"), ("2024-10-06 02:15", "Australia/Lord_Howe"): ("2024-10-05 15:30", "GAP"), ("2024-04-07 01:45", "Australia/Lord_Howe"): ("2024-04-06 14:45", "FOLD"),
    ("2011-12-30 12:00", "Pacific/Apia"): ("2011-12-30 10:00", "GAP"), ("2018-11-04 00:00", "America/Sao_Paulo"): ("2018-11-04 03:00", "GAP"), ("2024-07-01 09:00", "Asia/Kolkata"): ("2024-07-01 03:30", "PLAIN"),
    ("2024-03-10 03:00", "America/New_York"): ("2024-03-10 07:00", "PLAIN"), ("2024-03-10 02:00", "America/New_York"): ("2024-03-10 07:00", "GAP"), ("2024-11-03 02:00", "America/New_York"): ("2024-11-03 07:00", "PLAIN"),
}


def resolved(spark, rows):
    df = spark.createDataFrame([(t, z) for t, z in rows], "t string, zone string").withColumn("local", F.col("t").cast("timestamp_ntz"))
    return {(r["t"], r["zone"]): r["r"] for r in df.select("t", "zone", S.resolved(F.col("local"), F.col("zone")).alias("r")).collect()}


def test_worked_cases(spark):
    got = resolved(spark, WORKED)
    assert {k: (f"{r['utc']:%Y-%m-%d %H:%M}", r["kind"]) for k, r in got.items()} == WORKED
    assert resolved(spark, [(None, "Europe/Berlin"), ("2024-01-01", None)]) == {(None, "Europe/Berlin"): None, ("2024-01-01", None): None}


def test_against_the_standard_library(spark):
    rng, rows = random.Random(1), set()
    zones = ["America/New_York", "Europe/Berlin", "Europe/Dublin", "Asia/Kolkata", "Australia/Lord_Howe", "America/Sao_Paulo", "Africa/Casablanca", "Pacific/Apia", "UTC"]
    for zone in zones:
        day = datetime(2010, 1, 1)
        z = ZoneInfo(zone)
        while day < datetime(2020, 1, 1):  # the days on which an offset changes, and a few others
            if day.replace(tzinfo=z).utcoffset() != (day + timedelta(days=1)).replace(tzinfo=z).utcoffset() or rng.random() < 0.01:
                rows |= {(f"{day + timedelta(minutes=m):%Y-%m-%d %H:%M:%S}", zone) for m in range(-30, 270, 15)}
            day += timedelta(days=1)
    got = resolved(spark, sorted(rows))
    assert {k: tuple(r) for k, r in got.items()} == {k: brute(datetime.fromisoformat(k[0]), k[1]) for k in rows}
    assert {r["kind"] for r in got.values()} == {"PLAIN", "GAP", "FOLD"}


def test_session_zone_does_not_matter(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        got = resolved(spark, WORKED)
        assert {k: (f"{r['utc']:%Y-%m-%d %H:%M}", r["kind"]) for k, r in got.items()} == WORKED
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_catch_up_runs_the_newest_and_never_twice(spark):
    rows = [(p, f"{p}-{h}", datetime(2024, 1, 1) + timedelta(hours=h)) for p in (1, 2, 3) for h in range(40)] + [(1, "1-39", datetime(2024, 1, 2, 15))]
    df = spark.createDataFrame(rows, "plan_id int, occurrence_id string, due timestamp_ntz")
    ends = [F.lit("2024-01-01 05:00:00").cast("timestamp_ntz"), F.lit("2024-01-02 15:00:00").cast("timestamp_ntz")]
    done = spark.createDataFrame([("2-39",), ("2-38",), ("3-1",)], "occurrence_id string")
    got = {r["occurrence_id"]: r["action"] for r in S.catch_up(df, done, *ends, most=2).collect()}
    assert sorted(k for k, a in got.items() if a == "RUN") == ["1-38", "1-39", "2-36", "2-37", "3-38", "3-39"]
    assert len(got) == 3 * 34 - 2 and "1-5" not in got and "1-6" in got
    delivered = spark.createDataFrame([(k,) for k in got], "occurrence_id string").union(done)
    assert S.catch_up(df, delivered, *ends, most=2).collect() == []


def test_running_ranks_and_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "hot", "a", "b", None]), i, rng.choice([None, 1, 5, 7]), "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long, v long, rank string").repartition(7)

    def brute_force(key):
        out = {}
        for k in {key(r) for r in rows}:
            own = sorted((r for r in rows if key(r) == k), key=lambda r: -r[1])
            for n, (r, s) in enumerate(zip(own, accumulate(x[2] or 0 for x in own)), 1):
                out[r[1]] = (n, s)
        return out

    got = running(df, ["k"], [-F.col("i")], sums={"total": F.col("v")})
    assert got.columns == ["k", "i", "v", "rank", "total"]
    assert {r["i"]: (r["rank"], r["total"]) for r in got.collect()} == brute_force(lambda r: r[0])
    whole = running(df, [], [-F.col("i")], sums={"total": F.col("v")})
    assert {r["i"]: (r["rank"], r["total"]) for r in whole.collect()} == brute_force(lambda r: 0)
    assert running(df.limit(0), ["k"], [F.col("i")]).collect() == []
