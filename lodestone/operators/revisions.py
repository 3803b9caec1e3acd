"""Revisions of recipes and configurations: identity by content, candidates gated by fixtures and differences, and a pointer that is only appended to."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_id(config: dict) -> str:
    """The identity of a configuration: SHA-256 of its JSON with sorted names and no blanks, so that neither order nor spacing makes a revision."""
    import hashlib

    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def compared(active: DataFrame, candidate: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """A row for each record of either output: keys, lost, gained, and for each field whether it differs where both have the record."""
    a = active.select(*keys, F.struct(*fields).alias("_a"))
    b = candidate.select(*keys, F.struct(*fields).alias("_b"))
    both = a.join(b, keys, "full_outer")
    differs = [(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")) & F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias(f"{f}_differs") for f in fields]
    return both.select(*keys, F.col("_b").isNull().alias("lost"), F.col("_a").isNull().alias("gained"), *differs)


def verdict(fixtures: DataFrame, active: DataFrame, candidate: DataFrame, keys: list[str], fields: list[str], least: float = 1.0, most_lost: float = 0.0) -> DataFrame:
    """One row: n_fixtures, n_passed, n_lost, n_gained, n_differs, decision.

    ACTIVATE if `least` of the fixtures (keys and expected fields) come out of the candidate as expected, and at most `most_lost` of the active
    output's records are gone; REJECT otherwise, and without any fixture.
    """
    wanted = fixtures.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    got = candidate.select(*keys, *fields, F.lit(True).alias("_there"))
    same = reduce(lambda x, y: x & y, [F.col(f).eqNullSafe(F.col(f"_{f}")) for f in fields]) & F.col("_there").isNotNull()
    passed = wanted.join(got, keys, "left").agg(F.count("*").alias("n_fixtures"), F.count(F.when(same, 1)).alias("n_passed"))
    diff = compared(active, candidate, keys, fields)
    any_field = reduce(lambda x, y: x | y, [F.col(f"{f}_differs") for f in fields])
    changes = diff.agg(F.count(F.when(F.col("lost"), 1)).alias("n_lost"), F.count(F.when(F.col("gained"), 1)).alias("n_gained"), F.count(F.when(any_field, 1)).alias("n_differs"), F.count(F.when(~F.col("gained"), 1)).alias("_n_active"))
    both = passed.join(F.broadcast(changes))  # one row each
    ok = (F.col("n_fixtures") > 0) & (F.col("n_passed") >= F.col("n_fixtures") * least) & (F.col("n_lost") <= F.col("_n_active") * most_lost)
    return both.select("n_fixtures", "n_passed", "n_lost", "n_gained", "n_differs", F.when(ok, "ACTIVATE").otherwise("REJECT").alias("decision"))


def pointer(events: DataFrame, name: str = "name") -> DataFrame:
    """(name, revision, since): what is in force after all events (event_id, name, kind, revision), kind being ACTIVATE or ROLLBACK.

    A rollback puts the revision in force that was so before the last activation which it names; runs that started earlier keep what they pinned.
    """
    own = Window.partitionBy(name).orderBy("event_id")
    marked = events.withColumn("_undone", F.max(F.when(F.col("kind") == "ROLLBACK", F.col("event_id"))).over(Window.partitionBy(name, "revision")))
    held = marked.filter((F.col("kind") == "ACTIVATE") & (F.col("_undone").isNull() | (F.col("_undone") < F.col("event_id"))))
    last = held.withColumn("_n", F.row_number().over(own.orderBy(F.desc("event_id")))).filter("_n = 1")
    return last.select(name, "revision", F.col("event_id").alias("since"))


def problems(manifest: Column, schema: dict[str, tuple[str, tuple[str, ...] | None]]) -> Column:
    """What is wrong with a manifest of JSON text, in the order of the schema: name -> (string | number | list, allowed values or None).

    NOT_JSON, missing and mistyped fields, values outside of the allowed ones, and fields that the schema does not know.
    """
    names = F.json_object_keys(manifest)

    def one(name: str, kind: str, allowed: tuple[str, ...] | None) -> Column:
        value = F.get_json_object(manifest, f"$.{name}")
        typed = {"string": ~value.rlike(r"^[\[{]"), "number": value.rlike(r"^-?[0-9]+$"), "list": value.startswith("[") & F.from_json(value, "array<string>").isNotNull()}[kind]
        values = F.from_json(value, "array<string>") if kind == "list" else F.array(value)
        outside = F.lit(False) if allowed is None else F.exists(values, lambda v: ~v.isin(*allowed))
        return F.when(value.isNull(), f"MISSING:{name}").when(~typed, f"TYPE:{name}").when(outside, f"VALUE:{name}")

    unknown = F.transform(F.array_sort(F.array_except(names, F.array(*[F.lit(n) for n in schema]))), lambda n: F.concat(F.lit("UNKNOWN:"), n))
    found = F.concat(F.array_compact(F.array(*[one(n, *rule) for n, rule in schema.items()])), unknown)
    return F.when(names.isNull(), F.array(F.lit("NOT_JSON"))).otherwise(found)
