from __future__ import annotations

import math

import numpy as np
import pytest

from lodestone.llm import top_k as K

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, asked, k=K.K):
    def whole(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]

    rows = [(i, whole(v)) for i, v in rows]
    rows = [(i, v) for i, v in rows if i is not None and v is not None]
    out = []
    for q, a in {(i, tuple(v)) for i, v in rows if i in asked}:
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block, queries", [(64, 3), (8192, 16_384)])
def test_against_brute_force(spark, monkeypatch, block, queries):
    monkeypatch.setattr(K, "BLOCK", block)
    monkeypatch.setattr(K, "QUERIES_AT_ONCE", queries)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 12).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(9)]  # ties
    rows += [(400, None), (401, [None] * 12), (402, [float("nan")] + [0.0] * 11), (403, [float("inf")] * 12), (None, rows[0][1]), (404, [0.0] * 12), (405, [1.0]), (50, rows[50][1])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rank", "'x' AS block")
    got = K.top_k(df, df.filter("vec_id % 50 = 0"))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, {i for i in range(0, 450, 50)})


def test_large_numbers_and_steps(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(0, 1, 8) * 1e5).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in K.top_k(df, df.filter("vec_id % 50 = 0")).collect()) == brute(rows, {0, 50, 100})


def test_few_and_none(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert K.top_k(df, df).count() == 0
    two = spark.createDataFrame([(0, [0.5]), (1, [-0.5])], SCHEMA)
    assert [tuple(r) for r in K.top_k(two, two.filter("vec_id = 0")).collect()] == [(0, 1, 1, -128 * 128)]


def test_block_search_is_exact():
    rng = np.random.default_rng(9)
    for scale in (1, 40, 10_000_000):
        v = rng.integers(-3 * scale, 3 * scale + 1, (3000, 16))
        index, ids = K.ImpactIndex(v), np.arange(3000)
        for q in v[:10]:
            s = v @ q
            want = [(int(i), int(s[i])) for i in np.lexsort((ids, -s))[:5]]
            assert index.search(q, np.zeros(3000, bool), ids, 5) == want
            assert index.read > 0
            # a bound from elsewhere drops only what is below it
            assert [x for x in index.search(q, np.zeros(3000, bool), ids, 5, want[2][1]) if x[1] >= want[2][1]] == [x for x in want if x[1] >= want[2][1]]


def test_walk_stops_on_proof():
    """Sparse impacts: few postings are read, and the result is that of all."""
    rng = np.random.default_rng(2)
    v = np.where(rng.random((5000, 32)) < 0.05, rng.integers(0, 2000, (5000, 32)), 0)
    index, ids, q = K.ImpactIndex(v), np.arange(5000), np.zeros(32, np.int64)
    q[:3] = 50, 7, 1
    s = v @ q
    assert index.search(q, np.zeros(5000, bool), ids, 5) == [(int(i), int(s[i])) for i in np.lexsort((ids, -s))[:5]]
    assert index.read < 3 * 5000 / 2
