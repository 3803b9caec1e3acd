"""What the corpus operators share: table reads, materialisation and small column helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the mixing and counting contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On a local master, as in tests, a temporary one if that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialise(df: DataFrame, label: str, compression: str = "snappy", **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and return a frame that reads it: lineage ends there, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(compression=compression, **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of jobs that are over: it does once the driver has collected their handles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that none of the taken columns has, whatever their case."""
    low = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def uniform(seed: str, *parts: Column) -> Column:
    """A reproducible draw from [0, 1): the first 52 bits of the md5 of seed and parts."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def small_or_split(big: DataFrame, small: DataFrame, key: str, max_rows: int = 100_000, salts: int = 32) -> DataFrame:
    """Left join of big to small, a materialised table with one row for each key (nulls match).

    small is broadcast only if it has been counted and holds at most max_rows rows. Beyond that it is
    repeated once per salt and big spreads each key over the salts, so a hot key fills no single task.
    """
    own, small_salt, salt = fresh(big.columns + small.columns, "small_key", "small_salt", "salt")
    small = small.withColumnRenamed(key, own)
    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(small), big[key].eqNullSafe(small[own]), "left").drop(own)
    small = small.withColumn(small_salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # rows of one key are spread by position, so equal rows spread too; the salt only decides where a row meets its partner
    big = big.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    on = big[key].eqNullSafe(small[own]) & (big[salt] == small[small_salt])
    return big.join(small, on, "left").drop(own, small_salt, salt)
