"""Companies by their signals against a union-find, with platforms that many share."""

from __future__ import annotations

import random
from collections import defaultdict

from lodestone.operators import companies as C

SIGNALS = "company_id long, kind string, value string"


def brute(signals, shared):
    by_value, names, hosts = defaultdict(set), defaultdict(set), defaultdict(set)
    for c, kind, value in signals:
        if value:
            if kind in C.STRONG:
                by_value[kind, value].add(c)
            elif kind in C.WEAK:
                (names if kind == "NAME" else hosts)[c].add(value)
    for c, own in names.items():
        for n in own:
            for h in hosts.get(c, ()):
                by_value["NAME+HOST", (n, h)].add(c)
    root = {c: c for c, *_ in signals}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    kinds = defaultdict(set)
    for (kind, _), members in by_value.items():
        if len(members) > 1 and (len(members) <= shared or kind == "NAME+HOST"):
            for c in members:
                kinds[c].add(kind)
                a, b = sorted((find(min(members)), find(c)))
                root[b] = a
    return sorted((c, find(c), len(kinds[c])) for c in root)


def test_signals(spark):
    rng = random.Random(2)
    rows = [(c, rng.choice([*C.STRONG, *C.WEAK, "UNKNOWN"]), rng.choice([f"v{rng.randrange(40)}", "platform.example", None, ""])) for c in range(80) for _ in range(rng.randrange(1, 4))]
    rows += [(200, "NAME", "acme"), (201, "NAME", "acme"), (202, "NAME", "acme"), (200, "APPLICATION_HOST", "h"), (201, "APPLICATION_HOST", "h"), (203, "DOMAIN", "acme.example"), (200, "DOMAIN", "acme.example"), rows[0]]
    df = spark.createDataFrame(rows, SIGNALS)
    got = sorted(map(tuple, C.resolved(df).collect()))
    assert got == brute(rows, C.SHARED)
    roots = {c: r for c, r, _ in got}
    assert roots[200] == roots[201] == roots[203] != roots[202]  # a name alone is weak
    assert ("DOMAIN", "platform.example") in {(r["kind"], r["value"]) for r in C.edges(df)[1].collect()}
    assert C.resolved(spark.createDataFrame([], SIGNALS)).collect() == []
