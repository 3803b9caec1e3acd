from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestone.llm import near_copies, simhash


def brute_shingles(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i:i + 5]) for i in range(max(len(ws) - 4, 1))} if ws else set()


def brute_kept(texts):
    """The least index of each component at a five-word Jaccard of 0.8 or more."""
    sets = [brute_shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted({find(i) for i in range(len(sets))})


def edited(rng, ws, n):
    out = list(ws)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**6)}"
    return out


def kept(spark, rows):
    return [tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]


def test_stage_equals_brute_force(spark):
    """Near copies at five words and 0.8: far beyond 3 bits, and a large group; pairs below 0.8 stay."""
    rng = random.Random(3)
    texts = [None, "", " \n", "one", "ONE", "one two"]
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(300)]
        texts += [" ".join(x) for x in (base, edited(rng, base, 5), edited(rng, base, 3), edited(rng, base, 12))]
    hub = [f"h{rng.randrange(3000)}" for _ in range(300)]
    texts += [" ".join(x) for x in (hub, *(edited(rng, hub, rng.randint(2, 9)) for _ in range(60)))]
    rng.shuffle(texts)
    assert sorted(i for i, _ in kept(spark, list(enumerate(texts)))) == brute_kept(texts)


def test_below_the_similarity_nothing_is_linked():
    a = " ".join(f"w{i}" for i in range(100))
    b = a.replace("w50 ", "x ").replace("w20 ", "y ")
    assert near_copies.jaccard(a, a.upper()) == 1 and near_copies.jaccard(a, b) == 86 / 106


def test_rows_with_null_or_repeated_ids(spark):
    rng = random.Random(4)
    a, b, c, d, e = ([f"{k}{rng.randrange(3000)}" for _ in range(200)] for k in "abcde")
    a2, b2 = edited(rng, a, 2), edited(rng, b, 2)
    rows = [(i, " ".join(x)) for i, x in ((None, c), (None, d), (7, a), (7, b), (3, b2), (None, a2), (None, e), (None, e))]
    got = sorted(kept(spark, rows), key=str)
    # every text apart stays, whatever its id; the null copy of 7 and the 7 that copies 3 go
    assert got == sorted(((i, " ".join(x)) for i, x in ((None, c), (None, d), (7, a), (3, b2), (None, e))), key=str)


def test_close_fingerprints_are_candidates_without_a_shared_band(spark):
    """The SimHash step finds pairs by itself, and the texts still decide."""
    rng = random.Random(8)
    base = [f"s{rng.randrange(3000)}" for _ in range(400)]
    texts = [" ".join(base), " ".join(edited(rng, base, 1)), " ".join(f"o{i}" for i in range(300)), " ".join(f"p{i}" for i in range(300))]
    sketch = bytes(near_copies.BITS // 8)
    rows = [(i, [i * 100 + b for b in range(near_copies.BANDS)], sketch, fp) for i, fp in enumerate((0, 5, 7, 1 << 40))]
    nodes = spark.createDataFrame(rows, "node long, bands array<long>, sketch binary, fp long")
    close = simhash.close(nodes)
    assert {tuple(r) for r in close.collect()} >= {(0, 1), (1, 2)}
    found = near_copies.links(nodes, spark.createDataFrame(list(enumerate(texts)), "node long, text string"), close, simhash.components)
    assert [tuple(r) for r in found.collect()] == [(0, 1)]


def test_sketches_tell_near_copies_from_others():
    rng = random.Random(9)
    for n in (8, 9, 13, 40, 300):
        base = [f"t{rng.randrange(10**6)}" for _ in range(n)]
        for other in (base[:-1], base + ["end"], edited(rng, base, 1)):
            near = near_copies.jaccard(" ".join(base), " ".join(other)) >= 0.8
            x, y = (near_copies.wide_simhash(near_copies._hashes(near_copies.shingles(" ".join(t)))) for t in (base, other))
            assert not near or near_copies._apart(x, y) <= near_copies.FAR
    unlike = near_copies.wide_simhash(near_copies._hashes(near_copies.shingles(" ".join(f"u{i}" for i in range(300)))))
    assert near_copies._apart(x, unlike) > near_copies.FAR


def test_a_large_group_below_the_similarity_gives_no_square_of_rows(spark):
    """Members that are all alike at about 0.77 share bands; a few real links among them are found, and only those leave the group."""
    rng = random.Random(10)
    base = [f"g{rng.randrange(3000)}" for _ in range(300)]
    texts = [" ".join(edited(rng, base, 4)) for _ in range(150)]
    texts += [t.rsplit(" ", 2)[0] + " x y" for t in texts[:5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string").select("node", "text", near_copies.signed().alias("sig"))
    nodes = docs.select("node", "sig.bands", "sig.sketch", near_copies.hashed_shingles().alias("s"))
    rows = nodes.select(F.explode("bands").alias("band"), "node", "sketch", F.col("node").alias("label"), "bands", "s")
    sets = [brute_shingles(t) for t in texts]
    near = {(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    got = {tuple(r) for r in near_copies.decided(rows).collect()}
    assert got <= near and len(got) < len(texts) * near_copies.BANDS
    labels = dict(map(tuple, simhash.components(near_copies.decided(rows)).collect()))
    assert all(labels.get(i, i) == labels.get(j, j) for i, j in near)
