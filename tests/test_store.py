"""Appends and exports under repeated and cut deliveries, and files that were altered, lost or added."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.operators import store as S


def test_a_ledger_takes_each_row_once(spark, tmp_path):
    own = S.Ledger(spark, f"file://{tmp_path}/ledger", "id long, v string", ["id"])
    assert own.read().collect() == [] and own.manifests().collect() == []
    first = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "null")], "id long, v string").withColumn("extra", F.lit(1))
    assert own.append(first.filter("id is not null")) == 2
    assert own.append(first.filter("id is not null")) == 0
    assert own.append(spark.createDataFrame([(3, "c")], "id long, v string"), commit=False) == 1  # cut before its manifest
    assert sorted(r["id"] for r in own.read().collect()) == [1, 2]
    again = S.Ledger(spark, f"file://{tmp_path}/ledger", "id long, v string", ["id"])
    assert again.append(spark.createDataFrame([(2, "z"), (3, "c")], "id long, v string")) == 1
    assert sorted(map(tuple, again.read().collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(r["rows"] for r in again.manifests().collect()) == [0, 1, 2]


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_export_and_what_is_done_to_it(spark, tmp_path, fmt):
    folder = f"file://{tmp_path}/{fmt}"
    rows = spark.createDataFrame([(i, ["=1+1", "+x", "-y", "@z", "\tq", 'say "hi", ö\nthere', None][i % 7]) for i in range(70)], "id long, v string").repartition(3)
    manifest = S.export(rows, folder, fmt, "all", "2024-01-01T00:00:00Z", filters="none")
    assert (manifest["row_count"], manifest["limit"], manifest["columns"]) == (70, None, ["id", "v"])
    kept = json.loads("".join(p.read_text() for p in Path(tmp_path, fmt, "manifest").glob("part-*")))
    assert kept == manifest
    reader = spark.read.schema("id long, v string")
    back = reader.option("header", "true").option("escape", '"').option("multiLine", "true").csv(f"{folder}/data") if fmt == "csv" else reader.json(f"{folder}/data")
    values = dict(map(tuple, back.collect()))
    assert len(values) == 70 and values[5] == 'say "hi", ö\nthere' and values[0] == ("'=1+1" if fmt == "csv" else "=1+1")
    assert S.verified(spark, folder).collect() == []

    parts = sorted(Path(tmp_path, fmt, "data").glob("part-*"))
    altered = parts[0].read_bytes()
    Path(tmp_path, fmt, "data", f".{parts[0].name}.crc").unlink()  # as on a store without checksums of its own
    parts[0].write_bytes(altered[:-2] + b"9\n")
    parts[1].unlink()
    Path(tmp_path, fmt, "data", "part-extra").write_text("x")
    spark.catalog.clearCache()
    assert sorted(map(tuple, S.verified(spark, folder).collect())) == sorted([(parts[0].name, "DIFFERS"), (parts[1].name, "MISSING"), ("part-extra", "UNEXPECTED")])


def test_limits_are_stated_and_cut_exports_seen(spark, tmp_path):
    rows = spark.range(100).repartition(4)
    manifest = S.export(rows, f"file://{tmp_path}/a", "json", "all", "now", limit=10, order=[F.desc("id")])
    assert manifest["row_count"] == manifest["limit"] == 10
    assert sorted(r["id"] for r in spark.read.json(f"file://{tmp_path}/a/data").collect()) == list(range(90, 100))
    rows.write.json(f"file://{tmp_path}/b/data")
    assert [tuple(r) for r in S.verified(spark, f"file://{tmp_path}/b").collect()] == [("manifest", "NO_MANIFEST")]
    with pytest.raises(ValueError):
        S.export(rows, f"file://{tmp_path}/c", "xlsx", "all", "now")
    empty = S.export(rows.limit(0), f"file://{tmp_path}/d", "csv", "all", "now")
    assert empty["row_count"] == 0 and S.verified(spark, f"file://{tmp_path}/d").collect() == []
