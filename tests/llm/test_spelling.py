from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import spelling as S

DOCS = "doc_id long, text string"


def counts(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: chr(ord(m.group()) + 32), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def is_near(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(v) - len(u) > 1 or u == v:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def brute(n):
    form, met = {}, {}
    for w in n:
        near = [v for v in n if is_near(w, v)]
        met[w] = len(near)
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], met[w], form[w] and n[form[w]]) for w in n)


def corpus(seed=1, bases=14):
    rng = random.Random(seed)
    letters = "abéß"
    words = []
    for _ in range(bases):
        base = "".join(rng.choice(letters + "cd") for _ in range(rng.choice([7, 7, 8, 9, 12])))
        words += [base] * rng.choice([2, 30, 400])
        for _ in range(25):
            i, k = rng.randrange(len(base) + 1), rng.randrange(3)
            other = base[:i] + (rng.choice(letters) if k < 2 else "") + base[i + (k > 0):]
            words += [other.title() if rng.random() < 0.1 else other] * rng.choice([1, 2, 3, 30])
            if rng.random() < 0.4:
                words += [other + rng.choice(letters)] * 2
    words += ["aaaaaaa"] * 200 + ["aaaaaaaa"] * 20 + ["aaaaaaaaa"] * 2 + ["baaaaaaa"] * 2
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::60]) + ". x1") for i in range(60)]
    rows += [(100, None), (101, ""), (None, "Unnumbered unnumbered"), (102, "ÀÖØßÿ×÷" * 2 + " ÀÖØßÿ×÷ÀÖØßÿ×÷"), (103, "elongated " * 30_000), (104, "elongatd elongatd"), rows[3], (105, "q" * 5000 + " " + "q" * 5000)]
    return rows


@pytest.mark.parametrize("hot", [S.HOT, 40, 3])
def test_against_brute_force(spark, hot):
    rows = corpus()
    words = S.word_counts(spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("word", "n", "key", "form")}))
    n = counts(rows)
    assert dict(map(tuple, words.collect())) == n
    got = sorted(map(tuple, S.group_variants(words, hot=hot).collect()), key=lambda r: r[0])
    assert got == brute(n)
    assert any(r[2] not in (r[0], r[1]) for r in got)  # some root is two forms away


def test_large_blocks_are_subdivided(spark):
    words = spark.createDataFrame([(w, c) for w, c in counts(corpus()).items()], "word string, n long")
    sizes = S.blocks(words, 20).groupBy("m", "a", "b", "key").count()
    assert sizes.filter("count > 20 AND m - a - b > 1").count() == 0
    assert S.blocks(words, 20).filter("a > 0 AND b > 0").count() > 0


def test_empty(spark, tmp_path):
    for name, rows in (("a", []), ("b", [(1, None), (2, "short words")])):
        spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = S.op11_spelling(spark, f"{tmp_path}/{name}")
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.collect() == []


def test_query_equals_its_sql(spark, tmp_path):
    """On the corpus above, nulls and all, and on a whole table."""
    spark.createDataFrame(corpus(), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    for sf, files in ((str(tmp_path), f"{tmp_path}/documents.parquet/*.parquet"), ("/root/testdata/sf0.001", "/root/testdata/sf0.001/documents.parquet")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
        got = S.op11_spelling(spark, sf)
        want = con.execute(S.OP11_SQL)
        assert [d[0] for d in want.description] == got.columns
        rows = sorted(map(tuple, got.collect()), key=str)
        assert rows == sorted(want.fetchall(), key=str) and len(rows) > 100
