"""WARC archives: exact round trips, with nulls, empty and long payloads, embedded markers, ties, repeated rows and empty tables."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from lodestone.llm import warc
from lodestone.llm.common import materialise

PAGES = "page_id long, url string, html string"
LONG = "é" + "0123456789abcdef" * 30_000
ROWS = [
    (1, "http://a/1", "x" * 99), (2, "http://a/2", "x" * 99),  # below the bound: both responses
    (5, "http://a/5", "y" * 100), (3, "http://a/3", "y" * 100), (4, None, "y" * 100), (3, "http://b/3", "y" * 100),  # a tie for the smallest
    (None, "http://a/n", "z" * 200), (None, "http://a/m", "z" * 200), (None, "http://a/o", "y" * 100),
    (6, "http://a/6\r\nWARC-Type: x", None), (7, "http://a/7", ""), (8, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40), (9, "u", "WARC/1.1\r\n"),
    (10, "u", LONG), (11, "u", LONG), (12, "u", "a" * warc.CHUNK_BYTES), (13, "u", "a" * (warc.CHUNK_BYTES - 3) + "\r\n\r\nWARC/1.1\r\n" + "b" * 70_000), (14, "u", "\r\n\r\n"),
    (10, "u", LONG),
]


def brute(rows):
    first = {}
    for i, _, t in rows:
        if len((t or "").encode()) >= warc.DEDUP_BYTES and i is not None:
            first[t] = min(first.get(t, i), i)
    out = []
    for i, _, t in rows:
        raw = (t or "").encode()
        to = first.get(t)
        again = to is not None and to != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def round_trip(spark, rows, tmp_path):
    pages = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("mine") for c in ("record", "chunk", "digest", "size", "refers_to")})
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    warc.write_archives(pages, path)
    return sorted((tuple(r) for r in warc.read_archives(spark, path).collect()), key=str)


def test_round_trip_equals_brute_force(spark, tmp_path):
    assert round_trip(spark, ROWS, tmp_path) == brute(ROWS)
    assert round_trip(spark, [], tmp_path) == []


def test_hot_digests_are_joined_alike(spark, tmp_path, monkeypatch):
    rows = ROWS + [(100 + i, "u", "hot" * 50) for i in range(60)]
    monkeypatch.setattr(warc, "HOT_PAGES", 3)
    monkeypatch.setattr(warc, "HOT_MOST", 10**9)
    assert round_trip(spark, rows, tmp_path) == brute(rows)


def test_chunks_carry_the_digest_so_far(spark):
    got = materialise(warc.chunk_table(spark.createDataFrame(ROWS, PAGES)), "chunks").orderBy("record", "chunk").collect()
    whole = {}
    for r in got:
        data = whole.get(r["record"], b"") + bytes(r["data"])
        whole[r["record"]] = data
        assert len(r["data"]) <= warc.CHUNK_BYTES and r["size"] == len(data) and r["digest"] == hashlib.sha256(data).hexdigest()
        assert b"WARC/1.1\r\n" not in bytes(r["data"])
    assert sorted(whole.values()) == sorted((t or "").encode() for *_, t in ROWS)
    assert sum(r["last"] for r in got) == len(ROWS) == len(whole)
