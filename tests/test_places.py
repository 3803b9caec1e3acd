from __future__ import annotations

import random

from lodestone.operators import places as P

GAZETTEER = [
    (1, "New York", "US", "AMERICA"), (2, "New York City", "US", "AMERICA"), (3, "York", "GB", "EUROPE"), (4, "City of York", "GB", "EUROPE"), (5, "Paris", "FR", "EUROPE"), (6, "Paris", "US", "AMERICA"), (7, "FR", "FR", "EUROPE"), (8, "US", "US", "AMERICA"),
    (9, "São Paulo", "BR", "AMERICA"), (10, "EUROPE", None, "EUROPE"), (11, "York New", "XX", "NOWHERE"), (12, "!!", "XX", None), (13, "Köln", "DE", "EUROPE"), (13, "Cologne", "DE", "EUROPE"),
]
TEXTS = {
    "New York City and York": [(0, 2), (4, 3)], "new-york, CITY OF YORK!": [(0, 1), (3, 4)], "York New York": [(0, 11), (2, 3)], "Paris, FR": [(0, 5), (2, 7)], "Paris (Europe)": [(0, 5), (2, 10)], "Paris": [(0, 5), (0, 6)], "US or Paris": [(0, 8), (2, 6)],
    "SÃO PAULO / Köln / Cologne": [(0, 9), (3, 13), (5, 13)], "Newyork yorks": [], "": [], "nothing": [], "Paris Paris New York": [(0, 6), (1, 6), (2, 1)],
}


def found(spark, texts, gazetteer):
    names = spark.createDataFrame(gazetteer, "place_id long, name string, country string, region string")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("*", "'x' AS name", "0 AS start")
    out = {i: [] for i in range(len(texts))}
    for r in P.mentions(df, "id", "text", names).collect():
        out[r["id"]].append((r["start"], r["place_id"], r["ambiguous"]))
    return {i: sorted(v) for i, v in out.items()}


def test_nested_overlapping_and_ambiguous_names(spark):
    got = found(spark, [*TEXTS, None], GAZETTEER)
    assert {t: [x[:2] for x in got[i]] for i, t in enumerate(TEXTS)} == TEXTS and got[len(TEXTS)] == []
    alone = list(TEXTS).index("Paris")
    assert {(i, x) for i, v in got.items() for x in v if x[2]} == {(alone, (0, 5, True)), (alone, (0, 6, True))}
    assert found(spark, ["Paris"], []) == {0: []}


def test_leftmost_longest_against_a_scan(spark):
    rng = random.Random(8)
    names = list({tuple(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(14)})
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 25))) for _ in range(80)]
    got = found(spark, texts, [(i, " ".join(n), f"c{i}", None) for i, n in enumerate(names)])
    for k, text in enumerate(texts):
        ws, want, i = text.split(), [], 0
        while i < len(ws):
            here = [n for n in names if tuple(ws[i:i + len(n)]) == n]
            if here:
                best = max(here, key=len)
                want.append((i, names.index(best), False))
                i += len(best)
            else:
                i += 1
        assert got[k] == want


def test_offsets_and_remote(spark):
    texts = ["UTC+2 to utc -3", "GMT +5:30", "none", "Remote (UTC-11)", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(P.remote(df["t"]).alias("r"), P.offsets(df["t"]).alias("o")).collect()
    assert [(r["r"], r["o"]["low"], r["o"]["high"]) for r in got] == [(False, -180, 120), (False, 330, 330), (False, None, None), (True, -660, -660), (False, None, None)]
