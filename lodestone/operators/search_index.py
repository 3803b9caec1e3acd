"""A stored index of fields: written once, read by term buckets, searched with block maxima.

A posting's weight sums over the fields w_f * tf_f / (1 - b + b * len_f / mean len_f); a term's score in a document is
idf * weight * (k1 + 1) / (k1 + weight), which grows with the weight. Postings are sorted by bucket, term and falling weight over ranges, and cut into
blocks of BLOCK: a term of any number of documents is many rows in many ranges, weights of one block are alike, and a block's greatest
weight bounds what it can add. Blocks lie in folders by a hash of their term, with the terms' document frequencies beside them: a search opens
only its terms' folders. Terms are counted inside of their documents, so postings are shuffled once, into the order of the blocks.

A search takes the strongest blocks of its terms first; the k-th best sum that they give a document is a threshold that
no member of the result falls below. A block that cannot reach it, even with the best of all other terms, holds no member and is never
opened into postings; the rest are summed exactly. Until that is known, only what is said of blocks is read, not their postings.
Structured filters are lists of documents that postings are semi-joined to, in both steps.

The manifest is written last: a folder without it is no index.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..policy import POLICY
from .ledger import written
from .term_counts import counted

BLOCK, BUCKETS = 128, 32
#: Sums in another order may differ in their last digits: no block is left out on less.
SLACK = 1e-9


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    folder: str
    n_docs: int
    fields: tuple[str, ...]
    doc_type: str

    def stored(self) -> DataFrame:
        """(term, block, most, n, postings, bucket)."""
        postings = f"postings array<struct<doc:{self.doc_type},weight:double>>"
        return self.spark.read.schema(f"term string, block string, most double, n int, {postings}, bucket int").parquet(f"{self.folder}/blocks")

    def terms(self) -> DataFrame:
        """(term, df, bucket)."""
        return self.spark.read.schema("term string, df long, bucket int").parquet(f"{self.folder}/terms")

    def blocks(self) -> DataFrame:
        """(term, block, df, most, postings, bucket)."""
        return self.stored().join(self.terms(), ["bucket", "term"]).select("term", "block", "df", "most", "postings", "bucket")


def opened(spark: SparkSession, folder: str) -> Index:
    """The index that a folder holds; a folder whose manifest was never written raises an error."""
    known = spark.read.schema("n_docs long, fields array<string>, doc_type string").json(f"{folder}/manifest").first()
    return Index(spark, folder, known["n_docs"], tuple(known["fields"]), known["doc_type"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings (bucket, term, doc, weight) as blocks: consecutive ones of a term, BLOCK at most."""
    for b in batches:
        if not b.num_rows:
            continue
        term = b.column("term").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        within = np.arange(b.num_rows) - np.repeat(begins, np.diff([*begins, b.num_rows]))
        starts = np.flatnonzero(within % BLOCK == 0).astype(np.int32)
        first, n = pa.array(starts), np.diff([*starts, b.num_rows]).astype(np.int32)
        postings = pa.ListArray.from_arrays(pa.array(np.concatenate([starts, [b.num_rows]]).astype(np.int32)), pa.StructArray.from_arrays([b.column("doc"), b.column("weight")], ["doc", "weight"]))
        name = uuid.uuid4().hex
        yield pa.RecordBatch.from_arrays([b.column("term").take(first), pa.array([f"{name}:{i}" for i in range(len(starts))]), b.column("weight").take(first), pa.array(n), postings, b.column("bucket").take(first)], ["term", "block", "most", "n", "postings", "bucket"])


def build(docs: DataFrame, key: str, fields: dict[str, tuple[Column, float]], folder: str) -> Index:
    """An index of docs in a new folder; fields name columns of token arrays and their weights. Rows with a null key or no tokens are counted, not indexed."""
    spark = docs.sparkSession
    path = f"{folder}/index-{uuid.uuid4().hex}"
    names = list(fields)
    counts = written(counted(docs.filter(F.col(key).isNotNull()), key, {f: tokens for f, (tokens, _) in fields.items()}), "counts")
    whole = counts.agg(F.count("*").alias("n_docs"), *[F.avg(f"len.{f}").alias(f"mean_{f}") for f in names]).first()

    def part(f: str) -> Column:
        mean = whole[f"mean_{f}"] or 1.0
        return fields[f][1] * F.col(f"p.tf_{f}") / (1 - POLICY.bm25_b + POLICY.bm25_b * F.col(f"len.{f}") / mean)

    bucket = F.pmod(F.xxhash64("p.term"), F.lit(BUCKETS)).cast("int")
    weighed = counts.select("doc", "len", F.explode("postings").alias("p")).select(bucket.alias("bucket"), F.col("p.term").alias("term"), "doc", sum((part(f) for f in names[1:]), part(names[0])).alias("weight"))
    order = ["bucket", "term", F.desc("weight"), "doc"]
    blocks = weighed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cut, f"term string, block string, most double, n int, postings array<struct<doc:{docs.schema[key].dataType.simpleString()},weight:double>>, bucket int")
    blocks.write.partitionBy("bucket").parquet(f"{path}/blocks")
    known = spark.createDataFrame([(int(whole["n_docs"]), names, docs.schema[key].dataType.simpleString())], "n_docs long, fields array<string>, doc_type string")
    index = Index(spark, path, int(whole["n_docs"]), tuple(names), docs.schema[key].dataType.simpleString())
    df = index.stored().groupBy("bucket", "term").agg(F.sum("n").alias("df"))
    df.repartitionByRange("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    known.coalesce(1).write.json(f"{path}/manifest")
    return opened(spark, path)


def score(weight: Column, df: Column, n_docs: int) -> Column:
    idf = F.log1p((F.lit(n_docs) - df + 0.5) / (df + 0.5))
    return idf * weight * (POLICY.bm25_k1 + 1) / (weight + POLICY.bm25_k1)


def search(index: Index, queries: DataFrame, top: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, doc, score): the best documents of each query (query_id, terms array<string>), of those in allowed (doc) if that is given."""
    return _search(index, queries, top, allowed)[0]


def _search(index: Index, queries: DataFrame, top: int, allowed: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The result, and the blocks of the queries' terms before and after the threshold."""
    n_docs = index.n_docs
    wanted = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).distinct()
    buckets = [r[0] for r in wanted.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()]  # at most BUCKETS numbers
    here = F.col("bucket").isin(buckets)
    stored = index.stored().filter(here)
    # what is asked and what is needed are written, so that their sizes are known and blocks are not shuffled to meet a few rows
    asked = written(wanted.join(index.terms().filter(here), "term").select("query_id", "term", "df"), "asked")
    said = written(stored.select("term", "block", "most", "n").join(asked.select("term").distinct(), "term", "left_semi"), "said")

    def unpacked(rows: DataFrame) -> DataFrame:
        """Scores by query and document, dealt by document: sums and filters need no other shuffle, and no task sums what a whole file of blocks holds."""
        postings = rows.select("query_id", "df", F.explode("postings").alias("p")).select("query_id", F.col("p.doc").alias("doc"), score(F.col("p.weight"), F.col("df"), n_docs).alias("s")).repartition("doc")
        return postings if allowed is None else postings.join(allowed.select("doc").distinct(), "doc", "left_semi")

    # the strongest blocks of each term that hold as many postings as the result has rows
    strongest = Window.partitionBy("term").orderBy(F.desc("most"), "block")
    head = said.withColumn("place", F.row_number().over(strongest)).filter(F.col("place") <= top)
    before = F.sum("n").over(strongest.rowsBetween(Window.unboundedPreceding, -1))
    heads = written(head.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < top).select("term", "block"), "heads")
    first = stored.join(heads, ["term", "block"]).join(asked, "term")
    sums = unpacked(first).groupBy("query_id", "doc").agg(F.sum("s").alias("s"))
    best = sums.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "doc"))).filter(F.col("place") <= top)
    threshold = best.groupBy("query_id").agg(F.when(F.count("*") == top, F.min("s")).otherwise(0.0).alias("least"))
    most = said.groupBy("term").agg(F.max("most").alias("most")).join(asked, "term").select("query_id", "term", "df", score(F.col("most"), F.col("df"), n_docs).alias("most_of_term"))
    reach = most.groupBy("query_id").agg(F.sum("most_of_term").alias("most_of_all"))
    needed = F.coalesce("least", F.lit(0.0)) * (1 - SLACK) - F.col("most_of_all") + F.col("most_of_term")
    limits = written(most.join(reach, "query_id").join(threshold, "query_id", "left").select("query_id", "term", "df", needed.alias("needed")), "limits")
    kept = stored.join(limits, "term").filter(score(F.col("most"), F.col("df"), n_docs) >= F.col("needed") - SLACK)
    scored = unpacked(kept).groupBy("query_id", "doc").agg(F.round(F.sum("s"), 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc"))).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "doc", "score"), said.join(asked, "term"), kept
