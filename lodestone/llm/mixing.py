"""Mixing sources to target weights.

Token totals per source give each source a target by water filling: weights share all tokens, no target
passes MAX_REPEAT times its source, and what a capped source gives up is shared again by weight. A document is
then emitted floor(rate) times plus once more with probability equal to the fraction, where
rate = target / source total; the extra copy is decided by a hash of its id and text, so reruns agree. Rows that share source, id and
text are numbered, and their number is part of the hash, so that each draws for itself; groups of any size are numbered in parts.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; a null doc_id
draws as the empty string, with its text; which of the rows that share source, id and text gets which draw follows their places in the table; a source without tokens has rate 0 and target 0;
an empty table gives an empty result. `emit` returns all columns of its input unchanged, whatever their names; `mix` replaces
columns named like those it adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, materialise, small_or_split, uniform

MAX_REPEAT = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"


def text_size(column: str = "text"):
    """Number of words in a text; null counts as 0."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """From rows (source, size): one row per source with source_size and target.

    Only the per-source totals pass through the unpartitioned windows, never documents. Ordered by the level
    at which a source would hit its cap, the capped sources are a prefix, and the common level is the largest of
    (tokens left) / (weight left) over the prefixes.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * MAX_REPEAT)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("cap").over(filling), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(filling), F.lit(0)).alias("weight_before"),
    )
    level = (F.col("total") - F.col("cap_before")).cast("double") / (F.col("weights") - F.col("weight_before")).cast("double")
    levelled = left.withColumn("level", F.max(level).over(everything))
    return levelled.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


#: Parts in which the rows of one group are numbered.
PARTS = 64


def _numbered(docs: DataFrame, copy: str) -> DataFrame:
    """docs plus the number, from 0, of each row among those that share its source, id and text."""
    group, row, part, before, mark = fresh([*docs.columns, copy], "group", "row", "part", "before", "mark")
    same = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    repeated = docs.groupBy(same.alias(group)).agg(F.count("*").alias(before)).filter(F.col(before) > 1).select(group, F.lit(True).alias(mark))
    repeated = materialise(repeated, "mix-repeated")
    if repeated.isEmpty():
        return docs.withColumn(copy, F.lit(0).cast("long"))
    keyed = materialise(docs.withColumns({group: same, row: F.monotonically_increasing_id()}), "mix-rows")
    marked = small_or_split(keyed, repeated, group)
    alone = marked.filter(F.col(mark).isNull()).select(*docs.columns, F.lit(0).cast("long").alias(copy))
    own = marked.filter(mark).withColumn(part, F.pmod(F.col(row), F.lit(PARTS)).cast("int"))
    upto = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # at most PARTS rows of a group
    counts = own.groupBy(group, part).agg(F.count("*").alias(before))
    counts = materialise(counts.select(group, part, F.coalesce(F.sum(before).over(upto), F.lit(0)).alias(before)), "mix-parts")
    place = F.row_number().over(Window.partitionBy(group, part).orderBy(row)) - 1
    numbered = own.withColumn(copy, place.cast("long")).join(counts, [group, part])
    return alone.unionByName(numbered.select(*docs.columns, (F.col(copy) + F.col(before)).alias(copy)))


def _mixed(docs: DataFrame, seed: str) -> tuple[DataFrame, dict[str, str]]:
    """docs plus size, source_size, target and copies, under names that docs does not have; and those names."""
    wanted = ("size", "source_size", "target", "copies")
    name = dict(zip(wanted, fresh(docs.columns, *wanted)))
    (copy,) = fresh([*docs.columns, *name.values()], "copy")
    targets = materialise(source_targets(docs.select("source", text_size().alias("size"))), "mix-targets")
    targets = targets.select("source", F.col("source_size").alias(name["source_size"]), F.col("target").alias(name["target"]))
    sized = small_or_split(_numbered(docs, copy).withColumn(name["size"], text_size()), targets, "source")
    total = F.col(name["source_size"])
    rate = F.when(total > 0, F.col(name["target"]) / total).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    own = uniform(seed, F.col("doc_id"), F.when(F.col(copy) == 0, text).otherwise(F.concat(text, F.lit(":"), F.col(copy).cast("string"))))
    return sized.withColumn(name["copies"], (whole + F.when(own < rate - whole, 1).otherwise(0)).cast("long")).drop(copy), name


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs plus size, source_size, target and copies (how often the mix takes the document), which replace columns of these names."""
    mixed, name = _mixed(docs, seed)
    kept = [c for c in docs.columns if c.lower() not in name]
    return mixed.select(*kept, *[F.col(n).alias(wanted) for wanted, n in name.items()])


def emit(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed corpus itself: every document as often as the mix takes it, with exactly its own columns."""
    mixed, name = _mixed(docs, seed)
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col(name["copies"]))).alias(*fresh(mixed.columns, "copy"))
    return mixed.filter(F.col(name["copies"]) > 0).select(*docs.columns, times).select(*docs.columns)


def op5_mix(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    mixed = mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP5_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS cap FROM totals
), levels AS (
  SELECT *,
    CAST(CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(cap) OVER f AS BIGINT), 0) AS DOUBLE)
      / CAST(CAST(sum(weight) OVER () AS BIGINT) - coalesce(CAST(sum(weight) OVER f AS BIGINT), 0) AS DOUBLE) AS level
  FROM ranked
  WINDOW f AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), (max(level) OVER ()) * weight) AS target FROM levels
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || d.digest || CASE WHEN d.copy > 0 THEN ':' || d.copy ELSE '' END), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS u
  FROM (SELECT *, row_number() OVER (PARTITION BY source, doc_id, digest) - 1 AS copy FROM sized) d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM rated
"""
