"""The stored index against scores worked out in Python; its searches open only their terms' folders and leave out blocks."""

from __future__ import annotations

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from lodestone.operators import search_index as S
from lodestone.policy import POLICY

FIELDS = {"title": 3.0, "body": 1.0}


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, [*rng.choices(vocabulary, weights, k=rng.randrange(4))], rng.choices(vocabulary, weights, k=rng.choice([3, 20, 80]))) for i in range(n)]
    return docs + [(5000, None, None), (5001, [], []), (None, ["t1"], ["t1"]), (5002, ["t0"] * 400, ["t0"] * 9000), (5003, docs[4][1], docs[4][2])]


def brute(docs, queries, top, allowed=None):
    docs = [(i, {"title": t or [], "body": b or []}) for i, t, b in docs if i is not None]
    mean = {f: sum(len(x[f]) for _, x in docs) / len(docs) for f in FIELDS}
    weight, df = {}, Counter()
    for i, x in docs:
        tf = {f: Counter(x[f]) for f in FIELDS}
        for term in set(x["title"]) | set(x["body"]):
            weight[i, term] = sum(w * tf[f][term] / (1 - POLICY.bm25_b + POLICY.bm25_b * len(x[f]) / mean[f]) for f, w in FIELDS.items())
            df[term] += 1
    out = []
    for q, terms in queries:
        scores = []
        for i, _ in docs:
            own = [t for t in set(terms) if (i, t) in weight]
            if own and (allowed is None or i in allowed):
                scores.append((round(sum(math.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * weight[i, t] * (POLICY.bm25_k1 + 1) / (weight[i, t] + POLICY.bm25_k1) for t in own), 6), i))
        out += [(q, n, i, s) for n, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:top], 1)]
    return out


def test_two_searches_of_one_index(spark, tmp_path):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, title array<string>, body array<string>").withColumn("doc", F.lit("mine"))
    index = S.build(df, "doc_id", {f: (F.col(f), w) for f, w in FIELDS.items()}, f"file://{tmp_path}")
    queries = [(1, ["t0", "t3", "t3"]), (2, ["t40", "t1", "nowhere"]), (3, ["t59"]), (4, []), (5, ["nowhere"]), (6, ["t0"])]
    asked = spark.createDataFrame(queries, "query_id long, terms array<string>")
    got, met, kept = S._search(index, asked, 5, None)
    close = lambda rows: [(*r[:3], round(r[3], 5)) for r in sorted(map(tuple, rows))]
    assert close(got.collect()) == close(brute(docs, queries, 5))
    assert kept.count() < 0.7 * met.count()  # bounds leave blocks closed

    allowed = {i for i, *_ in docs if i is not None and i % 7 == 0}
    one = [(9, ["t2", "t50"])]
    only = spark.createDataFrame([(i,) for i in allowed] * 2, "doc long")
    second = S.search(index, spark.createDataFrame(one, "query_id long, terms array<string>"), 20, only)
    assert close(second.collect()) == close(brute(docs, one, 20, allowed))
    opened = second.filter("rank = 1").inputFiles() and {f.split("bucket=")[1].split("/")[0] for f in second.inputFiles() if "bucket=" in f}
    buckets = {str(r[0]) for r in spark.createDataFrame([(t,) for t in one[0][1]], "t string").select(F.pmod(F.xxhash64("t"), F.lit(S.BUCKETS))).collect()}
    plan = second._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]
    assert buckets <= (opened or buckets)
    hot = index.blocks().filter("term = 't0'").select(F.size("postings").alias("n"), "df")
    assert hot.count() > 3 and hot.agg(F.max("n")).first()[0] < 2 * S.BLOCK


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, title array<string>, body array<string>")
    index = S.build(df, "doc_id", {f: (F.col(f), w) for f, w in FIELDS.items()}, f"file://{tmp_path}")
    asked = spark.createDataFrame([(1, ["a"])], "query_id long, terms array<string>")
    assert S.search(index, asked, 5).collect() == []


def test_postings_are_shuffled_once_to_build(spark, tmp_path, monkeypatch):
    """Counts, levels, parts and folders each shuffled all postings before."""
    df = spark.createDataFrame(corpus(), "doc_id long, title array<string>, body array<string>")
    plans, own = [], S.Index.stored
    write = type(df.write).partitionBy
    monkeypatch.setattr(type(df.write), "partitionBy", lambda self, *a: plans.append(self._df._jdf.queryExecution().executedPlan().toString()) or write(self, *a))
    index = S.build(df, "doc_id", {f: (F.col(f), w) for f, w in FIELDS.items()}, f"file://{tmp_path}")
    assert plans[0].count("Exchange ") == 1 and "rangepartitioning" in plans[0]
    blocks = own(index).withColumn("least", F.array_min(F.transform("postings", lambda p: p["weight"]))).withColumn("top", F.array_max(F.transform("postings", lambda p: p["weight"])))
    assert blocks.filter("most <> top OR n <> size(postings)").count() == 0 and blocks.groupBy("term", "block").count().filter("count > 1").count() == 0
