"""Coverage generations and what they say of absence: a barrier, five conditions, and misses counted by numbers of generations.

A generation is (source_id, generation) with whether it may speak of absence. Complete generations of a source are numbered, and every generation
knows how many complete ones there were up to it; so the misses between two sightings of an identity are a difference of
two numbers, and no row for each identity and generation is ever made. Any sighting ends a run of misses, also one in a generation that is not complete:
presence can be proven by any accepted evidence, absence only by a complete one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ledger import written

#: States of a generation, and how far its source's word reaches (fixed names).
STATES = ("COMPLETE", "PARTIAL", "CANCELLED", "FAILED", "BUDGET_EXHAUSTED", "UNKNOWN")
AUTHORITATIVE = ("AUTHORITATIVE_FULL_SOURCE", "AUTHORITATIVE_DECLARED_SCOPE")


def completion(failed: Column, cancelled: Column, exhausted: Column, terminal: Column, pending: Column) -> Column:
    """The barrier: COMPLETE only once the end of the listing is proven, no page failed and nothing is left to follow; what stands in the way first is named."""
    return (
        F.when(cancelled, "CANCELLED").when(failed & ~terminal, "FAILED").when(exhausted, "BUDGET_EXHAUSTED").when(failed | pending, "PARTIAL")
        .when(terminal, "COMPLETE").otherwise("UNKNOWN")
    )


def inadmissible(state: Column, authority: Column, inference: Column, in_scope: Column, invalidated: Column) -> Column:
    """The first of the five conditions of absence evidence that does not hold, or null where all do; an unknown condition does not hold."""
    conditions = {"NOT_COMPLETE": state == "COMPLETE", "NO_AUTHORITY": authority.isin(*AUTHORITATIVE), "INFERENCE_OFF": inference, "OTHER_SCOPE": in_scope, "INVALIDATED": ~invalidated}
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in conditions.items()])


def numbered(generations: DataFrame) -> DataFrame:
    """Rows (source_id, generation, complete, number, total): the complete generations of a source up to this one, and in all."""
    rows = generations.groupBy("source_id", "generation").agg(F.max("complete").alias("complete"))
    upto = Window.partitionBy("source_id").orderBy("generation").rowsBetween(Window.unboundedPreceding, 0)  # a source's generations, not its sightings
    one = F.col("complete").cast("long")
    return rows.select("*", F.sum(one).over(upto).alias("number"), F.sum(one).over(Window.partitionBy("source_id")).alias("total"))


def misses_since(seen: DataFrame, generations: DataFrame) -> DataFrame:
    """(source_id, k, last_seen, misses): complete generations of the source after the last sighting (source_id, k, generation) of an identity."""
    last = seen.groupBy("source_id", "k").agg(F.max("generation").alias("last_seen"))
    known = numbered(generations).select("source_id", F.col("generation").alias("last_seen"), (F.col("total") - F.col("number")).alias("misses"))
    return last.join(known, ["source_id", "last_seen"], "left").select("source_id", "k", "last_seen", F.coalesce("misses", F.lit(0)).cast("long").alias("misses"))


def nth_misses(seen: DataFrame, generations: DataFrame, n: int) -> DataFrame:
    """(source_id, generation, k, misses): each complete generation in which an identity was missing for the n-th time running."""
    known = written(numbered(generations), "generations")
    at = known.select("source_id", "generation", "number", "complete", "total")
    shown = seen.select("source_id", "k", "generation").distinct().join(at, ["source_id", "generation"])
    order = Window.partitionBy("source_id", "k").orderBy("generation")
    # complete generations before the next sighting: that one itself does not count, nor does any after the last if there is no next
    before_next = F.coalesce(F.lead(F.col("number") - F.col("complete").cast("long")).over(order), F.col("total"))
    runs = shown.select("source_id", "k", (F.col("number") + n).alias("number"), before_next.alias("until")).filter("number <= until")
    when = known.filter("complete").select("source_id", "number", "generation")
    return runs.join(when, ["source_id", "number"]).select("source_id", "generation", "k", F.lit(n).cast("long").alias("misses"))


def applied(presence: DataFrame | None, done: DataFrame | None, seen: DataFrame, generations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A batch of generations and their sightings applied to what is known: (source_id, k, generation) last seen, and the ledger of generations.

    A generation that the ledger holds changes nothing; an older one that comes late never moves a last sighting back.
    """
    fresh = generations.select("source_id", "generation", "complete").dropDuplicates(["source_id", "generation"])
    if done is not None:
        fresh = fresh.join(done, ["source_id", "generation"], "left_anti")
    fresh = written(fresh, "fresh")
    own = seen.select("source_id", "k", "generation").join(fresh, ["source_id", "generation"], "left_semi")
    rows = own if presence is None else own.unionByName(presence)
    last = written(rows.groupBy("source_id", "k").agg(F.max("generation").alias("generation")), "presence")
    return last, fresh if done is None else written(done.unionByName(fresh), "applied")
