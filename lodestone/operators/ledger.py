"""Operators over append-only ledgers: current revisions, anti-joined appends, as-of joins, closures and streaks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order; never depends on the order in which rows arrived."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def new_rows(batch: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """What an idempotent append adds: one row per key that the ledger lacks."""
    return batch.dropDuplicates(keys).join(ledger.select(*keys), keys, "left_anti")


def violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key parent lacks; a null key refers to nothing and is no orphan."""
    return child.filter(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """left with the values of right's last row at or before left_time, in one shuffle: union and last non-null."""
    a = left.select("*", F.col(left_time).alias("_at"), F.lit(1).alias("_side"), *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values])
    pad = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in keys]
    b = right.select(*[F.col(k) for k in keys], *pad, F.col(right_time).alias("_at"), F.lit(0).alias("_side"), *[F.col(v) for v in values])
    order = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b)
    for v in values:
        both = both.withColumn(v, F.last(v, ignorenulls=True).over(order))
    return both.filter("_side = 1").drop("_at", "_side")


def streak(df: DataFrame, keys: list[str], order: list, broken: Column, name: str) -> DataFrame:
    """How many rows in a row, this one included, were not broken."""
    own = Window.partitionBy(*keys).orderBy(*order)
    islands = df.withColumn("_island", F.sum(broken.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return islands.withColumn(name, F.sum((~broken).cast("int")).over(within)).drop("_island")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on a local master without one, a temporary folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """df through Parquet in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable over edges (a, b). Each round also follows the label of the label.

    Labels and edges grow with the input, so they are joined by shuffles in every round: broadcasts would pass each round through the driver.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.hint("merge"), both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near.hint("merge"), "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        moved = written(lower.join(jump.hint("merge"), "via").select("node", "old", F.least("via", "far").alias("root")), "labels")
        labels = moved.select("node", "root")
        if moved.filter("root < old").isEmpty():
            return labels
