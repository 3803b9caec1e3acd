"""Exact similarity join on word shingles by prefix and positional filtering, over all rows or inside blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import let
from ..functions.text import normalised
from .ledger import written

#: A prefix shingle of more representatives than this is dealt over several tasks, each of which meets all with so many.
HOT = 1_000


def shingles(text: Column, words: int) -> Column:
    """The distinct hashes of runs of so many words, sorted; a shorter text is one run, a wordless one none."""
    hashes = F.transform(F.filter(F.split(normalised(text), " "), lambda w: w != ""), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0)))
        joined = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
        return F.when(F.size(h) > 0, F.array_sort(F.array_distinct(joined))).otherwise(F.array().cast("array<long>"))

    return let(hashes, runs)


def classes(docs: DataFrame, words: int, blocks: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, text): members (doc_id, root), documents of a block with equal sets of shingles being one class under its least doc_id, and sets (doc_id, s) of the roots.

    Wordless texts are left out. The blocks' columns stay with the members; with blocks a set holds hashes of shingle and block. Shingles are written
    once and stay where they are: only digests are shuffled, and what is no root is left out of each scan.
    """
    own = docs.select("doc_id", *blocks, shingles(F.col("text"), words).alias("s"))
    if blocks:
        own = own.withColumn("_block", F.xxhash64(*blocks)).withColumn("s", F.array_sort(F.transform("s", lambda g: F.xxhash64(g, F.col("_block"))))).drop("_block")
    # what is made of s is made of the written column: in one plan each use would work the shingles out again
    own = written(own.withColumn("row", F.monotonically_increasing_id()), "shingles").filter(F.size("s") > 0).withColumn("digest", F.md5(F.col("s").cast("string")))
    firsts = own.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    members = written(own.join(firsts, "digest").select("doc_id", *blocks, F.col("first.doc_id").alias("root"), "row", F.col("first.row").alias("first")), "classes")
    # one row for each root, also where a doc_id is repeated
    chosen = members.filter("row = first").groupBy("root").agg(F.min("row").alias("row"))
    copies = written(members.select("row").join(chosen.select("row"), "row", "left_anti"), "copies")
    return members.drop("row", "first"), own.join(copies, "row", "left_anti").select("doc_id", "s")


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(doc_a, doc_b, jaccard) of rows (doc_id, s) with distinct doc_ids and different sets, doc_a < doc_b, at or above the threshold.

    Shingles are ordered by how rare they are. Two sets that similar share one of the first n - ceil(threshold * n) + 1 of each, so only
    those are joined; where they meet, what can still follow in either set bounds the overlap, and so does their size. What is left is
    counted exactly.
    """
    # one shuffle of the shingles: their number of documents is counted where they lie, and they are not joined to it
    rows = sets.select("doc_id", F.size("s").alias("n"), F.explode("s").alias("g"))
    counted = rows.withColumn("df", F.count("*").over(Window.partitionBy("g"))).filter("df > 1")
    # a shingle of one document finds nothing, but takes the first places of its set: only their number counts
    shared = counted.groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("by_df"))
    room = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    alone = F.col("n") - F.size("by_df")
    kept = F.slice("by_df", 1, F.greatest(room - alone, F.lit(0)).cast("int"))
    places = shared.select("doc_id", "n", alone.alias("alone"), F.posexplode(kept).alias("i", "x"))
    first = written(places.select("doc_id", "n", (F.col("alone") + F.col("i")).alias("at"), F.col("x.g").alias("g"), F.ceil(F.col("x.df") / HOT).cast("int").alias("salts")), "prefixes")
    one = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("a")
    other = first.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).alias("b")
    small, most = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    needed = F.ceil((F.col("a.n") + F.col("b.n")) * threshold / (1 + threshold) - 1e-9)
    reach = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) + F.least("a.at", "b.at")
    may = (small >= most * threshold - 1e-9) & (reach >= needed) & (F.col("a.doc_id") < F.col("b.doc_id"))
    pairs = written(one.join(other, ["g", "salt"]).filter(may).select(F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b")).distinct(), "pairs")
    # of the sets only those that some pair names are moved
    named = written(pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct().join(sets, "doc_id"), "named")
    left = pairs.join(named.select(F.col("doc_id").alias("doc_a"), F.col("s").alias("sa")), "doc_a").join(named.select(F.col("doc_id").alias("doc_b"), F.col("s").alias("sb")), "doc_b")
    both = F.size(F.array_intersect("sa", "sb"))
    jaccard = both / (F.size("sa") + F.size("sb") - both)
    return left.select("doc_a", "doc_b", jaccard.alias("j")).filter(F.col("j") >= threshold).select("doc_a", "doc_b", F.round("j", 6).alias("jaccard"))


def near_pairs(docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """(doc_a, doc_b, jaccard): pairs of representatives of (doc_id, text) at or above the threshold, and members beside theirs at 1.

    Documents with equal sets of shingles are one class, so copies are never paired with each other.
    """
    own, sets = classes(docs, words)
    members = own.filter("doc_id <> root").select(F.col("root").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return similar_sets(sets, threshold).unionByName(members)
