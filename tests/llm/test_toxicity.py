"""Toxicity: the kernel against enumeration, accuracy on held-out texts, gapped insults, and the defined cases."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import toxicity as T

DOCS, LABELS = "doc_id long, text string", "doc_id long, toxic int"
INSULTS = ["blorgface", "snivelwort", "grubmuncher"]
SYLLABLES = ["ka", "to", "mi", "re", "lu", "shi", "no", "pa", "du", "ve", "sa", "li"]


def brute_kernel(s: str, t: str, order: int = T.ORDER, decay: float = T.DECAY) -> float:
    """Sum over common subsequences of decay to the power of both spans."""
    total = 0.0
    for a in combinations(range(len(s)), order):
        for b in combinations(range(len(t)), order):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel_equals_enumeration():
    rng = random.Random(1)
    pairs = [("".join(rng.choice("abcé") for _ in range(rng.randrange(9))), "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 8)))) for _ in range(200)]
    got = T.subsequence_kernel(T._codes([s for s, _ in pairs], 9, -1), T._codes([t for _, t in pairs], 8, -2))
    assert np.allclose(got, [brute_kernel(s, t) for s, t in pairs])


def test_segments():
    assert T.segments("You i-d!i.o.t, a b c D x") >= {"you", "idiot", "abcdx"}
    assert T.segments(None) == T.segments("") == T.segments("a b 12 !!") == set()
    assert all(len(w) <= T.WINDOW for w in T.segments("q" * 1000))


def sentence(rng, insult=None):
    ws = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(4, 12))]
    if insult:
        ws.insert(rng.randrange(len(ws)), insult)
    return " ".join(ws).capitalize() + "."


def corpus(n=600, seed=4):
    rng = random.Random(seed)
    rows = [(i, " ".join(sentence(rng, rng.choice(INSULTS) if i % 6 == 0 and k == 1 else None) for k in range(rng.randrange(2, 8)))) for i in range(n)]
    return rows, [(i, int(i % 6 == 0)) for i in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus()
    return T.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (1, None), (10**6, 1)], LABELS))


def scores(spark, model, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), DOCS)
    return [r[0] for r in rows.orderBy("doc_id").select(T.score_column(model)).collect()]


def test_held_out_accuracy(spark, model):
    rows, labels = corpus(400, seed=9)
    got = scores(spark, model, [t for _, t in rows])
    right = sum((s >= T.THRESHOLD) == bool(y) for s, (_, y) in zip(got, labels))
    assert right >= 0.97 * len(rows)


def test_gapped_and_inserted_characters_are_tolerated(spark, model):
    rng = random.Random(2)
    clean = [sentence(rng) for _ in range(5)]
    bad = ["blorg-face", "b l o r g f a c e", "blorxgface", "SNIVELWORT!!", "sniv.el.wort", "snivelxwort", "grubmuncherly"]
    got = scores(spark, model, [*[f"{clean[i % 5][:-1]} {w} ka to mi." for i, w in enumerate(bad)], *clean])
    assert min(got[:len(bad)]) >= T.THRESHOLD > max(got[len(bad):])


def test_defined_cases(spark, model):
    long = " ".join(["kato mire"] * 60_000)
    got = scores(spark, model, [None, "", " \n", long, long + " blorgface.", "q" * 5000])
    assert got[0] == got[1] == got[2] < T.THRESHOLD and got[3] < T.THRESHOLD <= got[4] and 0 <= got[5] <= 1
    docs = spark.createDataFrame([(1, "ka to"), (1, "ka to"), (None, "you blorgface."), (2, None)], DOCS).withColumns({c: F.lit("mine") for c in ("toxicity", "score", "x")})
    kept = T.reject(docs, model)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["toxicity"]) for r in kept.collect()) == [(1, "mine"), (1, "mine"), (2, "mine")]
    none = T.fit(docs, spark.createDataFrame([], LABELS))
    assert none is None and T.reject(docs, none).count() == 4
    assert T.reject(spark.createDataFrame([], DOCS), model).count() == 0
