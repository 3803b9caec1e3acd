"""Misses against a count over all generations, the barrier and the five conditions case by case, and generations applied in any order."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import coverage as C
from lodestone.plans import runtime, scoring

SEEN, GENERATIONS = "source_id long, k long, generation int", "source_id long, generation int, complete boolean"


def history(seed=4):
    rng = random.Random(seed)
    gens = [(s, g, rng.random() < 0.6) for s in range(4) for g in range(25) if rng.random() < 0.9]
    known = {(s, g) for s, g, _ in gens}
    seen = [(s, k, g) for s in range(4) for k in range(12) for g in range(25) if (s, g) in known and rng.random() < (0.9 if k == 0 else 0.15)]
    return seen + seen[:10], gens + gens[:5]


def streaks(seen, gens):
    """Every generation with the misses in a row up to it, by going through all of them."""
    out = {}
    for s, k in {(s, k) for s, k, _ in seen}:
        own, misses, started = {g for a, b, g in seen if (a, b) == (s, k)}, 0, False
        for g, complete in sorted({(g, c) for a, g, c in gens if a == s}):
            if g in own:
                misses, started = 0, True
            elif started and complete:
                misses += 1
                out[s, g, k] = misses
    return out


def test_misses(spark):
    seen, gens = history()
    s, g = spark.createDataFrame(seen, SEEN), spark.createDataFrame(gens, GENERATIONS)
    every = streaks(seen, gens)
    for n in (1, 2, 3):
        assert {tuple(r)[:3] for r in C.nth_misses(s, g, n).collect()} == {at for at, misses in every.items() if misses == n}
    want = {}
    for source, k in {(a, b) for a, b, _ in seen}:
        last = max(x for a, b, x in seen if (a, b) == (source, k))
        want[source, k] = (last, len({x for a, x, c in gens if a == source and c and x > last}))
    assert {(r["source_id"], r["k"]): (r["last_seen"], r["misses"]) for r in C.misses_since(s, g).collect()} == want


def test_generations_are_applied_once_in_any_order(spark):
    seen, gens = history(7)
    s, g = spark.createDataFrame(seen, SEEN), spark.createDataFrame(gens, GENERATIONS)
    rng, results = random.Random(1), []
    for cuts in ([(0, 25)], [(12, 25), (0, 12), (5, 25)], [(0, 9), (9, 25), (0, 25)], [(i, i + 5) for i in rng.sample(range(0, 25, 5), 5)]):
        last = done = None
        for a, b in cuts:
            part = (F.col("generation") >= a) & (F.col("generation") < b)
            last, done = C.applied(last, done, s.filter(part), g.filter(part))
        results.append(sorted(map(tuple, C.misses_since(last, done).collect())))
        assert done.count() == len({x[:2] for x in gens})
    assert all(r == results[0] for r in results) and results[0] == sorted(map(tuple, C.misses_since(s, g).collect()))


@pytest.mark.parametrize("flags, want", [  # failed, cancelled, exhausted, terminal, pending
    ((0, 0, 0, 1, 0), "COMPLETE"), ((0, 0, 0, 1, 1), "PARTIAL"), ((1, 0, 0, 1, 0), "PARTIAL"), ((1, 0, 0, 0, 0), "FAILED"), ((0, 1, 1, 1, 0), "CANCELLED"), ((0, 0, 1, 1, 0), "BUDGET_EXHAUSTED"), ((0, 0, 0, 0, 0), "UNKNOWN"), ((0, 0, 0, 0, 1), "PARTIAL"),
])
def test_barrier(spark, flags, want):
    assert spark.range(1).select(C.completion(*[F.lit(bool(x)) for x in flags])).first()[0] == want


@pytest.mark.parametrize("given, want", [
    (("COMPLETE", "AUTHORITATIVE_FULL_SOURCE", True, True, False), None), (("PARTIAL", "AUTHORITATIVE_FULL_SOURCE", True, True, False), "NOT_COMPLETE"), (("COMPLETE", "NON_AUTHORITATIVE_QUERY", True, True, False), "NO_AUTHORITY"),
    (("COMPLETE", "AUTHORITATIVE_DECLARED_SCOPE", False, True, False), "INFERENCE_OFF"), (("COMPLETE", "AUTHORITATIVE_DECLARED_SCOPE", True, False, False), "OTHER_SCOPE"), (("COMPLETE", "AUTHORITATIVE_FULL_SOURCE", True, True, True), "INVALIDATED"),
    (("COMPLETE", None, True, True, False), "NO_AUTHORITY"), (("COMPLETE", "AUTHORITATIVE_FULL_SOURCE", True, True, None), "INVALIDATED"),
])
def test_five_conditions(spark, given, want):
    state, authority, *flags = given
    columns = [F.lit(state), F.lit(authority).cast("string"), *[F.lit(x).cast("boolean") for x in flags]]
    assert spark.range(1).select(C.inadmissible(*columns)).first()[0] == want


@pytest.mark.parametrize("counts, want", [  # satisfied, partial, failed, cancelled, pending
    ((3, 0, 0, 0, 0), "SUCCEEDED"), ((0, 0, 0, 0, 0), "SUCCEEDED"), ((2, 0, 1, 0, 0), "PARTIAL"), ((0, 1, 1, 0, 0), "PARTIAL"), ((2, 1, 0, 0, 0), "PARTIAL"), ((0, 0, 2, 0, 0), "FAILED"), ((3, 0, 0, 1, 0), "CANCELLED"), ((3, 0, 0, 0, 1), "RUNNING"), ((0, 0, 1, 1, 1), "RUNNING"),
])
def test_run_truth_table(spark, counts, want):
    row = spark.createDataFrame([counts], "satisfied long, partial long, failed long, cancelled long, pending long")
    assert row.select(F.expr(runtime._RUN)).first()[0] == want


def test_every_disposition_meets_every_trigger():
    table = {(d, t): e for d, t, e in scoring.DECISIONS}
    assert len(table) == len(scoring.DECISIONS) == 5 * 3
    assert table["SHORTLISTED", "ORDINARY"] == "EMIT" and table["SNOOZED", "ORDINARY"] == "COALESCE" and table["SNOOZED", "PROFILE_ELIGIBLE"] == "SUPPRESS"
    assert {e for (d, _), e in table.items() if d in ("DISMISSED", "ARCHIVED")} == {"SUPPRESS", "NOT_APPLICABLE"}


@pytest.mark.parametrize("doc, depth", [('{"a":{},"b":{}}', 2), ('{"a":[[[[1]]]]}', 5), ("[]", 1), ('{"a":"{{{[[["}', 1), ('"x"', 0), (r'["\"[[", [{}]]', 3)])
def test_json_depth(spark, doc, depth):
    assert spark.range(1).select(tx.json_depth(F.lit(doc))).first()[0] == depth
