from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest

from lodestone.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=V.ENTRIES, rounds=V.ROUNDS):
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = -(-max(len(v) for _, v, _ in kept) // V.PARTS) * V.PARTS
    kept = [(i, [*v, *[0] * (dims - len(v))], lab) for i, v, lab in kept]
    width = dims // V.PARTS
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * width:(p + 1) * width] for _, v, _ in first] for p in range(V.PARTS)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, v, _ in kept:
                x = v[p * width:(p + 1) * width]
                groups.setdefault(nearest(x, book)[1], []).append(x)
            for e, xs in groups.items():
                book[e] = [sum(c) // len(xs) for c in zip(*xs)]
    out, total = [], {}
    for i, v, lab in kept:
        found = [nearest(v[p * width:(p + 1) * width], books[p]) for p in range(V.PARTS)]
        error = sum(d for d, _ in found)
        total[lab] = total.get(lab, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, lab))
    sha = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted(((i, code, error, total[lab], sha) for i, code, error, lab in out), key=str)


def table(n=150):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.02, 32)], int(i) % 3) for i in rng.permutation(n)]
    rows += [(n + i, rows[4][1], None) for i in range(5)] + [rows[6]]
    rows += [(n + 10, None, 1), (n + 11, [None] * 32, 1), (n + 12, [math.nan, *[0.0] * 31], 1), (n + 13, [math.inf] * 32, None), (n + 14, [0.0] * 32, None), (None, rows[9][1], 2), (n + 15, [0.5, -0.25], 0), (n + 16, [], 0), (n + 17, [None] * 70, 0)]
    return rows


def test_query_against_brute_force(spark, tmp_path):
    spark.createDataFrame(table(), SCHEMA).selectExpr("*", "'x' AS code", "1 AS part").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = V.op12_vector_codes(spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(table())


def test_fewer_rows_than_entries_and_empty(spark, tmp_path):
    rows = table(20)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    assert sorted((tuple(r) for r in V.op12_vector_codes(spark, f"{tmp_path}/a").collect()), key=str) == brute(rows)
    for name, rows in (("b", []), ("c", [(1, None, 1)])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert V.op12_vector_codes(spark, f"{tmp_path}/{name}").collect() == []


def test_columns_stay_and_clashes_raise(spark):
    df = spark.createDataFrame(table(20), SCHEMA).selectExpr("*", "'x' AS code")
    books = V.train(df)
    with pytest.raises(ValueError):
        V.encode(df, books)
    assert V.encode(df, books, "own_code", "own_error").columns == ["vec_id", "embedding", "label", "code", "own_code", "own_error"]


@pytest.mark.parametrize("spread", [1, 3, 40, 100_000])
def test_tree_equals_full_search(spread):
    rng = np.random.default_rng(spread)
    entries, points = rng.integers(-spread, spread + 1, (64, 4)), rng.integers(-spread, spread + 1, (3000, 4))
    squares = ((points[:, None] - entries[None]) ** 2).sum(2)
    tree = V.VantageTree(entries)
    index, best = tree.nearest(points)
    assert (best == squares.min(1)).all() and (index == squares.argmin(1)).all()
    if spread > 3:
        assert tree.seen < 0.7 * squares.size  # the bounds prune


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(V.OP12_SQL)
    columns = [d[0] for d in want.description]
    got = V.op12_vector_codes(spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)
