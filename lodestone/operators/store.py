"""Appends and exports that prove themselves, and backups that are compared by content.

What is written has a manifest that is written last, so a folder without one was cut short and is no part of anything. Counts are
taken while rows are written (`observe`), hashes from the files as they lie there, and readers compare both.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_safe

SCHEMA_VERSION = 1


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of all files below a folder, paths relative to it; hidden ones and markers are left out. Each file is read by one task."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = F.lit(_plain(folder).rstrip("/") + "/")
    path = F.regexp_replace("path", "^[a-z]+:/+", "/")
    return rows.filter(~F.regexp_extract("path", "([^/]*)$", 1).rlike("^[._]")).select(F.substring(path, F.length(base) + 1, F.length(path)).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _plain(folder: str) -> str:
    """A folder's path without scheme, as files are listed."""
    scheme, _, rest = folder.partition(":")
    return "/" + rest.lstrip("/") if rest and "/" not in scheme else folder


def compared(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem) where a manifest and what lies there differ: MISSING, UNEXPECTED or DIFFERS."""
    a, b = manifest.select("path", F.struct("bytes", "sha256").alias("was")), files.select("path", F.struct("bytes", "sha256").alias("now"))
    both = a.join(b, "path", "full_outer").filter(~F.col("was").eqNullSafe(F.col("now")))
    return both.select("path", F.when(F.col("now").isNull(), "MISSING").when(F.col("was").isNull(), "UNEXPECTED").otherwise("DIFFERS").alias("problem"))


def _write_json(spark: SparkSession, path: str, record: dict) -> None:
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.text(path)


class Ledger:
    """A table of batches in a folder: rows are appended once for each key, whatever is delivered again."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str]):
        self.spark, self.folder, self.schema, self.keys = spark, folder.rstrip("/"), schema, keys

    def _batches(self) -> list[str]:
        """Names of the batches whose manifest was written; one for each append."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests")
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        return sorted(s.getPath().getName() for s in system.listStatus(path) if system.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def read(self) -> DataFrame:
        """The rows of all committed batches."""
        paths = [f"{self.folder}/batches/{b}" for b in self._batches()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def append(self, batch: DataFrame, commit: bool = True) -> int:
        """Append the rows whose key the ledger lacks, one for each key, and give their number. commit=False leaves the batch without manifest, as a cut append does."""
        fresh = batch.dropDuplicates(self.keys).join(self.read().select(*self.keys), self.keys, "left_anti").select(*[c for c in self.spark.createDataFrame([], self.schema).columns])
        name, seen = uuid.uuid4().hex, Observation()
        fresh.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.folder}/batches/{name}")
        rows = int(seen.get["rows"])
        if commit:
            _write_json(self.spark, f"{self.folder}/manifests/{name}", {"rows": rows, "keys": self.keys, "schema_version": SCHEMA_VERSION})
        return rows

    def manifests(self) -> DataFrame:
        """(batch, rows) of the committed batches."""
        read = [self.spark.read.text(f"{self.folder}/manifests/{b}").select(F.lit(b).alias("batch"), F.get_json_object("value", "$.rows").cast("long").alias("rows")) for b in self._batches()]
        out = self.spark.createDataFrame([], "batch string, rows long")
        for r in read:
            out = out.unionByName(r)
        return out


def export(rows: DataFrame, folder: str, fmt: str, scope: str, generated_at: str, filters: str = "", limit: int | None = None, order: list[Column] | None = None) -> dict:
    """Write rows as csv or json with a manifest, and give the manifest: every row of the scope, unless a limit is asked for, which the manifest then states.

    Texts that a spreadsheet would run are neutralised in csv. The manifest lists all files with their hashes and is written last.
    """
    if fmt not in ("csv", "json"):
        raise ValueError(f"no such format: {fmt}")
    spark, seen = rows.sparkSession, Observation()
    if limit is not None:
        rows = (rows.orderBy(*order) if order else rows).limit(limit)
    if fmt == "csv":
        rows = rows.select(*[csv_safe(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in rows.schema.fields])
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    if fmt == "csv":
        counted.write.option("header", "true").option("encoding", "UTF-8").option("escape", '"').csv(f"{folder}/data")
    else:
        counted.write.json(f"{folder}/data")
    files_of(spark, f"{folder}/data").write.parquet(f"{folder}/files")
    manifest = {"schema_version": SCHEMA_VERSION, "scope": scope, "filters": filters, "limit": limit, "row_count": int(seen.get["rows"]), "generated_at": generated_at, "format": fmt, "columns": rows.columns}
    _write_json(spark, f"{folder}/manifest", manifest)
    return manifest


def verified(spark: SparkSession, folder: str) -> DataFrame:
    """(path, problem) of an export: what differs from its list of files, and NO_MANIFEST where it was cut short."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([("manifest", "NO_MANIFEST")], "path string, problem string")
    return compared(spark.read.parquet(f"{folder}/files"), files_of(spark, f"{folder}/data"))
