"""Ranks and running sums inside keys of any size, by two levels of prefix sums over ranges of the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ledger import written


def running(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank", sums: dict[str, Column] | None = None) -> DataFrame:
    """df with each row's place from 1 in its key, and sums up to and with it, in a total order of the rows.

    Rows are dealt by ranges of key and order, so that a key that holds most of them spans many tasks. Inside a range, windows of one
    key are at most as long as the range; what the ranges before it hold of a key is a prefix sum over one row for each key and range.
    No key at all means one order of all rows. Null keys are one key. Columns of the names that are added are replaced.
    """
    sums = sums or {}
    added = [rank, *sums]
    names = [c for c in df.columns if c not in added]
    by = [f"_o{i}" for i in range(len(order))]
    own = df.select(*[F.col(c) for c in names], *[c.alias(b) for c, b in zip(order, by)], *[F.coalesce(v, F.lit(0)).alias(f"_v{i}") for i, v in enumerate(sums.values())])
    dealt = own.repartitionByRange(*[F.col(k) for k in keys], *[F.col(b) for b in by]).withColumn("_range", F.spark_partition_id())
    rows = written(dealt, "ranges")
    inside = Window.partitionBy("_range", *keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*by)))
    for i in range(len(sums)):
        local = local.withColumn(f"_s{i}", F.sum(f"_v{i}").over(inside))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_range", *keys).agg(F.count("*").alias("_n"), *[F.sum(f"_v{i}").alias(f"_s{i}") for i in range(len(sums))])
    # a row for each range that holds a key: ranges are as many as tasks
    offsets = totals.select("_range", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before{c}") for c in ["_n", *(f"_s{i}" for i in range(len(sums)))]])
    on = F.col("a._range") == F.col("b._range")
    for i, k in enumerate(keys):
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b._k{i}"))
    both = local.alias("a").join(offsets.alias("b"), on)
    return both.select(*[F.col(f"a.{c}") for c in names], (F.col("a._n") + F.col("b._before_n")).alias(rank), *[(F.col(f"a._s{i}") + F.col(f"b._before_s{i}")).alias(name) for i, name in enumerate(sums)])
