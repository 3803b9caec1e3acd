"""Merges that can be undone: components as of any time, and dependents that keep their owner.

A ledger holds events (event_id, at, kind, kept, absorbed), kind being MERGE, UNDO or REDO of a pair; it is only ever appended to. An edge holds at
a time if the latest event of its pair up to then is no UNDO. Jobs joined by edges are one, under their least id. What
depends on a job (dispositions, applications, notes, reminders, inbox events) keeps the job that it was made for as its owner, also if
it was made on the merged job: what a time shows of it follows from the owner's component then, so an undo restores it and a redo moves it
again, and nothing is rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ledger import closure, written


def edges_as_of(events: DataFrame, at) -> DataFrame:
    """Pairs (a, b) that hold at a time; of events at one time the one with the greatest id counts."""
    known = events.filter(F.col("at") <= F.lit(at)).groupBy("kept", "absorbed").agg(F.max_by("kind", F.struct("at", "event_id")).alias("kind"))
    return known.filter("kind <> 'UNDO'").select(F.col("kept").alias("a"), F.col("absorbed").alias("b"))


def components_as_of(events: DataFrame, at) -> DataFrame:
    """(node, root) of the jobs that some edge holds at a time; other jobs are their own root."""
    return closure(edges_as_of(events, at))


def components_after(labels: DataFrame, events: DataFrame, before, at) -> DataFrame:
    """components_as_of(events, at) from the labels of an earlier time: only components that an edge left or joined since are worked out again."""
    changed = events.filter((F.col("at") > F.lit(before)) & (F.col("at") <= F.lit(at))).select(F.explode(F.array("kept", "absorbed")).alias("node")).distinct()
    touched = written(changed.join(labels, "node", "left").select(F.coalesce("root", "node").alias("root")).distinct(), "touched")
    # every job of a touched component, and the jobs that no component had
    members = written(labels.join(touched, "root", "left_semi").select("node").union(touched.select("root")).distinct(), "members")
    again = edges_as_of(events, at).join(members.select(F.col("node").alias("a")), "a", "left_semi")
    return written(labels.join(touched, "root", "left_anti").select("node", "root").unionByName(closure(again)), "components")


def owned_as_of(dependents: DataFrame, labels: DataFrame, at) -> DataFrame:
    """Dependents (owner, made_at, …) that exist at a time, each with the job that shows it (shown_on); all columns stay."""
    names = [c for c in dependents.columns if c != "shown_on"]
    rows = dependents.filter(F.col("made_at") <= F.lit(at)).select(*names)
    return rows.join(labels.select(F.col("node").alias("owner"), F.col("root").alias("_root")), "owner", "left").select(*names, F.coalesce("_root", "owner").alias("shown_on"))


def conflicts(shown: DataFrame, value: str) -> DataFrame:
    """(shown_on, n, values): jobs whose dependents disagree, with all that they say."""
    said = shown.groupBy("shown_on").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(value)).alias("values"))  # as many values as the vocabulary has
    return said.filter(F.size("values") > 1)


def undone(events: DataFrame, at) -> DataFrame:
    """The ledger's rows as a reader sees them: (kept, absorbed, merged_at, undone_at), undone_at null while the merge holds."""
    known = events.filter(F.col("at") <= F.lit(at))
    last = F.max_by(F.struct("kind", "at"), F.struct("at", "event_id"))
    rows = known.groupBy("kept", "absorbed").agg(F.min(F.when(F.col("kind") == "MERGE", F.col("at"))).alias("merged_at"), last.alias("last"))
    return rows.select("kept", "absorbed", "merged_at", F.when(F.col("last.kind") == "UNDO", F.col("last.at")).alias("undone_at"))
