"""Companies by six signals: strong ones join what shares them, weak ones only together, and what many share is no signal at all.

A signal is a row (company_id, kind, value). Domain, board, careers address and registered id are strong, name and application host weak. A value that
more than SHARED companies have is a platform's, not a company's: it joins nobody and is reported. Each value's companies are joined to the
least of them, so a value of any number of companies gives one edge a company; two weak signals make one of their own. All joins are shuffles:
their sides grow with the companies, and broadcasts would pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ledger import closure, written

STRONG, WEAK = ("DOMAIN", "ATS_BOARD", "CAREERS_URL", "STRUCTURED_ID"), ("NAME", "APPLICATION_HOST")
SHARED = 3


def edges(signals: DataFrame, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """(a, b, kind, value) joining companies, a the least of a value, and the values (kind, value, n) that too many share."""
    known = signals.filter(F.col("value").isNotNull() & (F.col("value") != "")).select("company_id", "kind", "value").distinct()
    names, hosts = (known.filter(F.col("kind") == k).select("company_id", F.col("value").alias(k)) for k in WEAK)
    both = names.join(hosts.hint("merge"), "company_id").select("company_id", F.lit("NAME+HOST").alias("kind"), F.concat_ws("\u0001", *WEAK).alias("value"))
    usable = written(known.filter(F.col("kind").isin(*STRONG)).unionByName(both), "signals")
    counted = usable.groupBy("kind", "value").agg(F.min("company_id").alias("a"), F.count("*").alias("n"))
    # a company's own name and host never count as a platform's
    platform = (F.col("n") > shared) & (F.col("kind") != "NAME+HOST")
    joined = usable.join(counted.filter((F.col("n") > 1) & ~platform).hint("merge"), ["kind", "value"]).filter("company_id <> a")
    return joined.select("a", F.col("company_id").alias("b"), "kind", "value"), counted.filter(platform).select("kind", "value", "n")


def resolved(signals: DataFrame, shared: int = SHARED) -> DataFrame:
    """(company_id, root, n_kinds): each company with the least that it is one with, and how many kinds of evidence joined it to others."""
    joined = written(edges(signals, shared)[0], "edges")
    labels = closure(joined.select("a", "b"))
    kinds = joined.select(F.explode(F.array("a", "b")).alias("company_id"), "kind").distinct().groupBy("company_id").agg(F.count("*").alias("n_kinds"))
    every = signals.select("company_id").distinct()
    out = every.join(labels.withColumnRenamed("node", "company_id").hint("merge"), "company_id", "left").join(kinds.hint("merge"), "company_id", "left")
    return out.select("company_id", F.coalesce("root", "company_id").alias("root"), F.coalesce("n_kinds", F.lit(0)).alias("n_kinds"))
