"""The pipeline against a brute-force version, stage by stage and as a whole."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest

import corpus_pipeline as P
from lodestone.llm import decontaminate, sharding, toxicity
from test_near_copies import brute_kept, edited
from test_toxicity import INSULTS, sentence

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, leak string, copy string, row string, toxicity string, text_hash string"
CLASHES = ("mine",) * 7
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def folded(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def documents():
    rng = random.Random(12)
    texts = [" ".join(sentence(rng) for _ in range(rng.randrange(4, 30))) for _ in range(150)]
    texts += [t[:-1] + f" {rng.choice(INSULTS)} ka." for t in texts[:12]]  # toxic
    near = [f"n{rng.randrange(9000)}" for _ in range(120)]
    texts += [" ".join(near), " ".join(edited(rng, near, 2)), " ".join(edited(rng, near, 1)), texts[20], texts[20].upper(), texts[21]]
    items = [" ".join(f"b{rng.randrange(900)}" for _ in range(30)) for _ in range(4)]
    texts += [items[0], texts[30] + " " + texts[31] + " " + items[1].upper() + " " + texts[32], items[2] + " ka " + items[2]]
    texts += [None, "", " \n", "ka", " ".join(f"v{rng.randrange(9000)}" for _ in range(30_000))]
    rows = [(i, t, "en", ["a", "a", "b", None][i % 4], len(t or ""), *CLASHES) for i, t in enumerate(texts)]
    rows += [(None, "a text of nobody ka to mi re lu", None, None, None, *CLASHES), rows[40], (41, "another text under a number that repeats", "en", "z", 1, *CLASHES)]
    return rows, list(enumerate(items)) + [(9, None), (10, "!")]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(4)
    rows, items = documents()
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    train = [(10_000 + i, " ".join(sentence(rng, rng.choice(INSULTS) if i % 6 == 0 and k == 1 else None) for k in range(4)), "en", "t", 1, *CLASHES) for i in range(400)]
    spark.createDataFrame(rows + train, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(10_000 + i, int(i % 6 == 0), 0) for i in range(400)], "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def order(row):
    return (row[0] is None, row[0] or 0, hashlib.blake2b(b" ".join(folded(row[1]).encode().split()), digest_size=16).digest())


def brute_near(rows):
    rows = sorted(rows, key=order)
    return [rows[i] for i in brute_kept([r[1] for r in rows])]


def brute_benchmark(rows, items):
    windows = set()
    for _, t in items:
        ws = ITEM.findall(folded(t))
        windows |= {tuple(ws[i:i + 10]) for i in range(max(len(ws) - 9, 1)) if ws}
    sizes, out = sorted({len(w) for w in windows}), []
    for r in rows:
        spans = [m.span() for m in ITEM.finditer(folded(r[1]))]
        ws = [folded(r[1])[a:b] for a, b in spans]
        hit = {k for s in sizes for i in range(len(ws) - s + 1) if tuple(ws[i:i + s]) in windows for k in range(i, i + s)}
        if len(hit) > decontaminate.MAX_COVERAGE * len(ws):
            continue
        text, at, first = r[1], 0, None
        if hit:
            keep = []
            for k in range(len(ws) + 1):
                if k in hit and k - 1 not in hit:
                    keep.append(text[at:spans[k][0]])
                if k - 1 in hit and k not in hit:
                    at = spans[k - 1][1]
            text = "".join([*keep, text[at:]])
        out.append((r[0], text, r[2], r[3], len(text) if hit else r[4], *r[5:]))
    return out


def brute_mix(rows):
    size = Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight, capped = {s: 1 + i % 3 for i, s in enumerate(names)}, set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names if s not in capped}
        over = {s for s, x in share.items() if x > 3 * size[s] + 1e-9}
        if not over:
            break
        capped |= over
    out = []
    for r in rows:
        rate = (3.0 if r[3] in capped else share[r[3]] / size[r[3]]) if size[r[3]] else 0.0
        digest = hashlib.md5((r[1] or "").encode()).hexdigest()
        u = int(hashlib.md5(f"mix-1:{'' if r[0] is None else r[0]}:{digest}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out += [r] * (math.floor(rate) + (u < rate - math.floor(rate)))
    return out


def checked_shards(rows, got, columns):
    """Shards hold exactly the rows, equal texts together, slots gapless, and no shard above the least capacity."""
    own = ("size", "text_crc32", "shard", "slot")
    kept = [i for i, c in enumerate(columns) if c not in own]
    assert Counter(tuple(r[columns[i]] for i in kept) for r in got) == Counter(tuple(r[i] for i in kept) for r in rows)
    sizes, slots = Counter(), {}
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(sharding.SHARDS))
    assert max(sizes.values()) <= sum(sizes.values()) / sharding.SHARDS + max(Counter(r["text"] for r in got).values()) * max(r["size"] for r in got)


def plain(df):
    return [tuple(r) for r in df.collect()]


def test_stages_and_the_whole_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = documents()[1]
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = [(tuple(r)[:-1], r["x"]) for r in docs.withColumn("x", toxicity.score_column(model)).collect()]
    rows = [r for r, s in score if s < toxicity.THRESHOLD]
    gone = {r[0] for r, s in score if s >= toxicity.THRESHOLD}
    assert set(range(150, 162)) <= gone and not gone & (set(range(150)) | set(range(162, 180)))
    stage = dict(P.STAGES)
    one = stage["toxicity"](spark, docs, sf_dir)
    assert Counter(plain(one)) == Counter(rows) and one.columns == docs.columns
    want = brute_near(rows)
    two = stage["simhash_near_dedup"](spark, spark.createDataFrame(rows, DOCS), sf_dir)
    assert Counter(plain(two)) == Counter(want) and two.columns == docs.columns
    rows, want = want, brute_benchmark(want, items)
    three = stage["benchmark_decontamination"](spark, spark.createDataFrame(rows, DOCS), sf_dir)
    assert Counter(plain(three)) == Counter(want) and three.columns == docs.columns
    assert 0 < len(rows) - len(want) < 4
    rows, want = want, brute_mix(want)
    four = stage["source_mixing"](spark, spark.createDataFrame(rows, DOCS), sf_dir)
    assert Counter(plain(four)) == Counter(want) and four.columns == docs.columns
    checked_shards(want, stage["minimax_sharding"](spark, spark.createDataFrame(want, DOCS), sf_dir).collect(), docs.columns)
    checked_shards(want, P.run(spark, sf_dir).collect(), docs.columns)


def test_stages_on_empty_tables(spark, sf_dir):
    empty = spark.createDataFrame([], DOCS)
    for name, stage in P.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name
