from __future__ import annotations

import random

import xxhash

from lodestone.llm import simhash
from lodestone.llm.common import read

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def brute_fingerprint(text):
    words = [w for w in _fold(text or "").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _fold(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_components(fps):
    """Smallest id reachable from each id of {id: fingerprint}."""
    out = {}
    for i in sorted(fps):
        if i in out:
            continue
        stack = [i]
        while stack:
            a = stack.pop()
            if a not in out:
                out[a] = i
                stack += [b for b in fps if b not in out and (fps[a] ^ fps[b]).bit_count() <= 3]
    return out


def run(spark, rows):
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in found), key=str)


def test_whole_table_equals_brute_force(spark):
    rows = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    fps = {i: brute_fingerprint(t) for i, t in rows}
    groups = brute_components(fps)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.op8_simhash(spark, SF).collect()}
    assert got == {i: (fps[i], groups[i]) for i in fps}
    assert len(set(groups.values())) < len(groups)


def test_links_connect_like_all_pairs(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(40):  # dense clusters: large groups at one anchor
            x = base
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(200)} | {0, 2**64 - 1, 7, 1 << 63}
    ids = {i: f for i, f in enumerate(sorted(fps))}
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    labels = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
    want = brute_components(ids)
    by_fp = {f: want[i] for i, f in ids.items()}
    got = {}
    for r in labels:
        got.setdefault(r["label"], set()).add(r["node"] % 2**64)
    expected = {}
    for f, root in by_fp.items():
        expected.setdefault(root, set()).add(f)
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in expected.values() if len(v) > 1}


def test_every_pair_in_reach_shares_an_anchor(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        rows.append(tuple(x - 2**64 if x >= 2**63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "a long, b long")
    shared = df.select(simhash.anchors("a").alias("x"), simhash.anchors("b").alias("y")).collect()
    assert all(set(r["x"]) & set(r["y"]) for r in shared)
    assert max(len(r["x"]) for r in shared) <= 32


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE "), (6, "one two"), (None, "one"), (7, "x " * 50_000), (7, "x " * 50_000)]
    got = run(spark, rows)
    want = {str(r[0]): brute_fingerprint(r[1]) for r in rows}
    assert all(f == want[str(i)] for i, f, _ in got) and len(got) == len(rows)
    groups = {str(i): c for i, _, c in got}
    assert groups["1"] == groups["2"] == groups["3"] == 1
    assert groups["4"] == groups["5"] == groups["None"] == 4
    assert groups["7"] == 7


def test_empty_and_extra_columns(spark):
    assert run(spark, []) == []
    docs = spark.createDataFrame([(2, "a b c d", "x", 1), (1, "a b c d", "y", 2), (3, "q r s t u", "z", 3)], "doc_id long, text string, fp string, label int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
