"""Ledger operators and the similarity join by themselves, with nulls, ties, repeated rows and empty tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import ledger
from lodestone.operators import near as near_module
from lodestone.operators.near import near_pairs


def test_new_rows_and_constraints(spark):
    have = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    batch = spark.createDataFrame([(2, "x"), (3, "c"), (3, "c"), (4, None)], "k int, v string")
    assert sorted(map(tuple, ledger.new_rows(batch, have, ["k"]).collect())) == [(3, "c"), (4, None)]
    assert ledger.new_rows(ledger.new_rows(batch, have, ["k"]), have.unionByName(ledger.new_rows(batch, have, ["k"])), ["k"]).count() == 0
    assert [tuple(r) for r in ledger.violations(batch, ["k"]).collect()] == [(3, 2)]
    assert sorted(r["k"] for r in ledger.orphans(batch, have, "k", "k").collect()) == [3, 3, 4]


def test_latest_by_is_a_total_order(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 4, "z"), (2, None, "n")], "k int, at int, v string")
    got = ledger.latest_by(rows.repartition(3), ["k"], F.desc("at"), F.desc("v"))
    assert sorted((r["k"], r["v"]) for r in got.collect()) == [(1, "b"), (2, "n")]


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3), ("c", 9, 4)], "k string, t int, n int")
    right = spark.createDataFrame([("a", 2, 20.0), ("a", 5, 50.0), ("a", 6, 60.0), ("b", 1, 10.0)], "k string, at int, rate double")
    got = ledger.as_of(left, right, ["k"], "t", "at", ["rate"])
    assert sorted((r["n"], r["rate"]) for r in got.collect()) == [(1, 50.0), (2, None), (3, 10.0), (4, None)]


def test_streak(spark):
    rows = spark.createDataFrame([("a", i, b) for i, b in enumerate([False, False, True, False, False, False])], "k string, i int, broken boolean")
    got = ledger.streak(rows, ["k"], ["i"], F.col("broken"), "run").orderBy("i").collect()
    assert [r["run"] for r in got] == [1, 2, 0, 1, 2, 3]


def test_closure_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500)], "a long, b long")
    got = dict(map(tuple, ledger.closure(edges).collect()))
    assert all(got[i] == 0 for i in range(201)) and got[501] == got[500] == 500
    assert ledger.closure(spark.createDataFrame([], "a long, b long")).count() == 0


def shingled(text):
    ws = (text or "").lower().split()
    return {" ".join(ws[i:i + 5]) for i in range(max(len(ws) - 4, 1))} if ws else set()


def test_near_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_module, "HOT", 3)
    rng = random.Random(6)
    texts = [None, "", "  ", "one two", "ONE  two"]
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(80)]
        texts.append(" ".join(base))
        for n in (1, 2, 6):
            own = list(base)
            for at in rng.sample(range(80), n):
                own[at] = f"x{rng.randrange(999)}"
            texts.append(" ".join(own))
    texts += [texts[6].upper()] * 30 + ["a common line of seven words only " + texts[9]]
    sets = [shingled(t) for t in texts]
    root = {}
    for i, s in enumerate(sets):
        if s:
            root.setdefault(frozenset(s), i)
    want = {(root[frozenset(s)], i, 1.0) for i, s in enumerate(sets) if s and root[frozenset(s)] != i}
    reps = sorted(root.values())
    for x, i in enumerate(reps):
        for j in reps[x + 1:]:
            same = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if same >= 0.8:
                want.add((i, j, round(same, 6)))
    got = near_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("s", F.lit("mine")), 5, 0.8)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 40


def test_secrets_in_nested_json(spark):
    raw = '{"a":{"Token":"x\\"y","n":[{"password":12},{"api_key":null}]},"cookie":"c","plain":"token: z"}'
    got = spark.createDataFrame([(raw,), (None,)], "t string").select(tx.redacted_json(F.col("t")).alias("t")).collect()
    assert got[0]["t"] == '{"a":{"Token":"[secret]","n":[{"password":"[secret]"},{"api_key":"[secret]"}]},"cookie":"[secret]","plain":"token: [secret]"}' and got[1]["t"] is None


def test_the_similarity_join_moves_shingles_once(spark):
    """Plans of the sets and of the pairs: what is no root is left out of the scan without another exchange of the sets."""
    rows = spark.createDataFrame([(i, " ".join(f"w{(i // 2) * 7 + k}" for k in range(30))) for i in range(40)] + [(3, "one id with another text"), (3, "one id with another text")], "doc_id long, text string")
    members, sets = near_module.classes(rows, 5)
    assert sorted(map(tuple, members.filter("doc_id <> root").collect())) == [(i + 1, i) for i in range(0, 40, 2)]
    ids = [r["doc_id"] for r in sets.collect()]
    # an id that stands for two texts is one row
    assert sorted(ids) == sorted([*range(0, 40, 2), 3])
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
