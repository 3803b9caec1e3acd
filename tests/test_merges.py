"""Merges, undos and redos against a union-find over the edges that hold at each time."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestone.operators import merges as M

EVENTS = "event_id long, at int, kind string, kept long, absorbed long"


def history(seed=5, jobs=60):
    rng = random.Random(seed)
    pairs, events = [], []
    for i in range(160):
        at = i // 8
        if pairs and rng.random() < 0.45:
            pair = rng.choice(pairs)
            kind = rng.choice(["UNDO", "REDO"])
        else:
            a, b = sorted(rng.sample(range(jobs), 2)) if rng.random() < 0.7 else (rng.randrange(5), rng.randrange(5, jobs))
            pair, kind = (a, b), "MERGE"
            pairs.append(pair)
        events.append((i, at, kind, *pair))
    return events


def brute(events, at):
    state = {}
    for _, when, kind, a, b in sorted(events, key=lambda e: (e[1], e[0])):
        if when <= at:
            state[a, b] = kind
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for (a, b), kind in state.items():
        if kind != "UNDO":
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


def test_components_as_of_and_after(spark):
    events = history()
    df = spark.createDataFrame(events, EVENTS)
    labels, before = M.components_as_of(df, 3), 3
    assert {r["node"]: r["root"] for r in labels.collect()} == brute(events, 3)
    for at in (4, 9, 19):
        labels = M.components_after(labels, df, before, at)
        want = brute(events, at)
        assert {r["node"]: r["root"] for r in labels.collect()} == want == {r["node"]: r["root"] for r in M.components_as_of(df, at).collect()}
        before = at


def test_dependents_follow_their_owner(spark):
    # 1 takes 2, a note is then made on the merged job for 2, the merge is undone and done again; 3 joins and stays
    events = [(0, 10, "MERGE", 1, 2), (1, 20, "MERGE", 1, 3), (2, 30, "UNDO", 1, 2), (3, 40, "REDO", 1, 2)]
    made = [("disposition", 1, 5, "SHORTLISTED"), ("disposition", 2, 5, "DISMISSED"), ("application", 2, 6, "sent"), ("application", 1, 6, "sent"), ("note", 2, 25, "edited on the merged job"), ("reminder", 9, 1, "alone")]
    df = spark.createDataFrame(events, EVENTS)
    dependents = spark.createDataFrame(made, "kind string, owner long, made_at int, value string").withColumn("shown_on", F.lit("mine")).withColumn("root", F.lit("mine"))

    def shown(at):
        got = M.owned_as_of(dependents, M.components_as_of(df, at), at)
        assert got.columns == ["kind", "owner", "made_at", "value", "root", "shown_on"]
        return sorted((r["kind"], r["owner"], r["shown_on"]) for r in got.collect())

    first = [("application", 1, 1), ("application", 2, 2), ("disposition", 1, 1), ("disposition", 2, 2), ("reminder", 9, 9)]
    merged = [("application", 1, 1), ("application", 2, 1), ("disposition", 1, 1), ("disposition", 2, 1), ("note", 2, 1), ("reminder", 9, 9)]
    restored = [("application", 1, 1), ("application", 2, 2), ("disposition", 1, 1), ("disposition", 2, 2), ("note", 2, 2), ("reminder", 9, 9)]
    assert (shown(9), shown(29), shown(39), shown(40)) == (first, merged, restored, merged)
    assert {r["node"]: r["root"] for r in M.components_as_of(df, 35).collect()} == {1: 1, 3: 1}

    at_29 = M.owned_as_of(dependents.filter("kind = 'disposition'"), M.components_as_of(df, 29), 29)
    assert [tuple(r) for r in M.conflicts(at_29, "value").collect()] == [(1, 2, ["DISMISSED", "SHORTLISTED"])]
    assert sorted(tuple(r) for r in M.undone(df, 35).collect()) == [(1, 2, 10, 30), (1, 3, 20, None)]
    assert sorted(tuple(r) for r in M.undone(df, 45).collect()) == [(1, 2, 10, None), (1, 3, 20, None)]


def test_empty(spark):
    df = spark.createDataFrame([], EVENTS)
    labels = M.components_as_of(df, 1)
    assert labels.collect() == [] and M.components_after(labels, df, 1, 2).collect() == []
