"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, lm_scoring, mixing, sharding, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = "item_id long, text string"


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Éa", "x,", "Q.", "don't", "naïve", "a-b"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 12, 40]))), "en", rng.choice(["a", "b", "B", None]), 1) for i in range(n)]
    rows += [(1000, None, None, None, None), (1001, "", "en", "a", 0), (1002, " \t\n ", "en", "a", 3), (None, "a null id", None, "z", None), (1003, "long " * 20_000, "en", "b", 1)]
    rows += [(1004, rows[3][1], "en", "a", 1), rows[5], (1005, "\x0b one\x0ctwo three", "en", "a", 1)]
    return rows


def frame(spark, rows):
    """Columns that clash with helpers' names ride along."""
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("size", "copies", "target", "_leak", "h", "slot_range", "part", "word")})


def test_decontamination_against_brute_force(spark):
    rng = random.Random(2)
    rows = corpus()
    items = [(1, " ".join(f"w{rng.randrange(60)}" for _ in range(25))), (2, "Only FIVE words, here now"), (3, None), (4, "!!"), (10, " ".join(f"w{rng.randrange(60)}" for _ in range(10))), (None, "nobody owns this"), (1, " ".join(f"w{rng.randrange(60)}" for _ in range(25)))]
    rows += [(2000, "pre " + items[0][1].upper() + " post " + items[1][1], "en", "a", 1), (2001, "so nobody  owns-this!", "en", "a", 1), (2002, " ".join(items[4][1].split()[1:]), "en", "a", 1), (2003, items[4][1] + " " + items[4][1], "en", "a", 1)]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = Counter()
    for item, text in items:
        ws = pattern.findall(low(text))
        size = min(10, len(ws))
        for i in range(len(ws) - size + 1) if ws else ():
            windows[tuple(ws[i:i + size]), item] += 1

    def want(doc_id, text):
        ws = pattern.findall(low(text))
        hit, found = set(), set()
        for (gram, item) in windows:
            for i in range(len(ws) - len(gram) + 1):
                if tuple(ws[i:i + len(gram)]) == gram:
                    hit |= set(range(i, i + len(gram)))
                    found.add(item)
        listed = sorted(str(x) for x in found if x is not None)
        return doc_id, len(ws), len(hit), listed

    found = decontaminate.annotate(frame(spark, rows), spark.createDataFrame(items, ITEMS))
    got = [(r["doc_id"], r["leak"]["n_words"], r["leak"]["n_hit"], sorted(map(str, r["leak"]["items"]))) for r in found.collect()]
    assert sorted(got, key=str) == sorted((want(i, t) for i, t, *_ in rows), key=str)
    left = decontaminate.remove(frame(spark, rows), spark.createDataFrame(items, ITEMS))
    assert left.columns == frame(spark, rows).columns and all(r["_leak"] == r["size"] == "x" for r in left.collect())
    kept = {r["doc_id"]: r for r in left.collect()}
    assert 2003 not in kept and kept[0]["text"] == rows[0][1] and 1000 in kept
    assert decontaminate.remove(frame(spark, rows), spark.createDataFrame([], ITEMS)).count() == len(rows)


def test_decontamination_in_several_shards(spark, monkeypatch):
    rows, items = corpus(), [(i, f"item{i} " + " ".join(f"w{j}" for j in range(i, i + 12))) for i in range(8)]
    rows += [(3000 + i, "z " + t + " z", "en", "a", 1) for i, t in items]
    docs, bench = spark.createDataFrame(rows, DOCS).select("doc_id", "text"), spark.createDataFrame(items, ITEMS)
    one = sorted(decontaminate.annotate(docs, bench).select("doc_id", "leak").collect(), key=str)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 30)
    assert sorted(decontaminate.annotate(docs, bench).select("doc_id", "leak").collect(), key=str) == one
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 8)  # items in overlapping pieces
    assert sorted(decontaminate.annotate(docs, bench).select("doc_id", "leak").collect(), key=str) == one


def test_mix_meets_targets_and_agrees(spark):
    rng = random.Random(6)
    rows = corpus() + [(5000 + i, "w " * rng.randrange(1, 9), "en", "a" if i % 3 else "huge", 1) for i in range(3000)]
    docs = frame(spark, rows).withColumns({"row": F.lit("mine"), "group": F.lit("mine")})
    got = mixing.mix(docs).collect()
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(size.values()), set()
    while True:  # fill, cap, share again
        left = total - sum(3 * size[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names if s not in capped}
        over = {s for s, x in share.items() if x > 3 * size[s]}
        if not over:
            break
        capped |= over
    for r in got:
        assert math.isclose(r["target"], 3.0 * size[r["source"]] if r["source"] in capped else share[r["source"]])
        assert r["source_size"] == size[r["source"]] and 0 <= r["copies"] <= 3
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["copies"] * r["size"]
    for s in ("huge", "a"):
        assert abs(taken[s] - next(r["target"] for r in got if r["source"] == s)) < 0.05 * size[s]
    assert mixing.emit(docs).count() == sum(r["copies"] for r in got)
    assert sorted((str(r["doc_id"]), r["copies"]) for r in mixing.mix(docs.repartition(7)).collect()) == sorted((str(r["doc_id"]), r["copies"]) for r in got)
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_equal_rows_draw_for_themselves(spark):
    """A source of repeated rows is taken near its target, whoever repeats: rows with one id, with none, and with other columns that differ."""
    rows = [(7, "two words", "en", "a", 1)] * 400 + [(None, "some three words", "en", "b", i) for i in range(400)] + [(i, "one", "en", "c", 1) for i in range(400)] + [(8, "w " * 50_000, "en", "c", 1)] * 2
    docs = spark.createDataFrame(rows, DOCS).withColumn("copy", F.lit("mine"))
    got = mixing.mix(docs).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    assert abs(taken["a"] - target["a"]) < 0.1 * target["a"] and abs(taken["b"] - target["b"]) < 0.1 * target["b"]
    assert len(got) == len(rows) and {r["copy"] for r in got} == {"mine"}
    assert Counter((r["doc_id"], r["copies"]) for r in got) == Counter((r["doc_id"], r["copies"]) for r in mixing.mix(docs.repartition(5)).collect())


def test_shards_are_contiguous_minimax(spark):
    rows = corpus(n=400)
    rows = rows + [(7000 + i, "copy of one text", "en", "a", 1) for i in range(40)]
    got = sharding.shard(frame(spark, rows).withColumn("text_crc32", F.lit("mine"))).collect()
    sizes, by_text = Counter(), {}
    for r in got:
        text = r["text"] if "text" in r.__fields__ else None
        sizes[r["shard"]] += r["size"]
        by_text.setdefault(r["text_hash"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values()) and sum(sizes.values()) == sum(len((t or "").encode()) + 1 for _, t, *_ in rows)
    groups = Counter()
    for r in got:
        groups[r["text_hash"]] += r["size"]
    order = [groups[h] for h in sorted(groups)]

    def shards_needed(capacity):
        n, room = 1, capacity
        for g in order:
            if g > room:
                n, room = n + 1, capacity
            room -= g
        return n

    least = next(c for c in range(max(order), sum(order) + 1) if shards_needed(c) <= sharding.SHARDS)
    assert max(sizes.values()) <= least
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.default_path())
    own = token_counts.counter(token_counts.default_path())
    texts = [t for _, t, *_ in corpus() if t is not None] + ["a<|endoftext|>b <|endoftext|>", "  two  spaces\n\n\tx", "日本語 ñandú 🙂🙂", "a" * 3000, "don't we'll", " 　 x", "\r\n" * 50, "1234567 89"]
    for t in texts:
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids), t[:60]
        assert own.counts(t)[-1] == own.count(t) and len(own.counts(t)) == len(t) + 1
        for budget in (0, 1, 7, 10**9):
            cut = own.longest_prefix(t, budget)
            assert own.count(t[:cut]) <= budget and (budget < 10**9 or cut == len(t))
    rows = frame(spark, corpus()).select("doc_id", "text", token_counts.token_count().alias("n")).collect()
    assert all(r["n"] == own.count(r["text"]) for r in rows)


def test_every_prefix_counts_as_the_library_does(spark):
    """All prefixes of random texts, and the longest within a budget, by brute force; nulls, empty and long texts through Spark."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.default_path())
    own, rng = token_counts.counter(token_counts.default_path()), random.Random(8)
    atoms = ["a", "the", " ", "  ", "\n", "'", "'re", "'s", "ll", "!", "<|endoftext|>", "<|end", "é", "日本", "🙂", "23", " international", "isation", "\u3000", "\r\n", "'v", "\x1c", "\x1f", "\x85", "\x0b"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(12))) for _ in range(400)]
    cuts = {}
    for t in texts:
        want = [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert own.counts(t) == want, t
        cuts[t] = max(i for i, n in enumerate(want) if n <= 4)
        assert own.longest_prefix(t, 4) == cuts[t]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate([None, "", "word " * 40_000, " " * 50, *texts[:40]])]
    got = frame(spark, rows).select("text", token_counts.prefix_table().alias("n"), token_counts.truncated(budget=4).alias("cut"), token_counts.counted(budget=4).alias("c")).collect()
    for r in got:
        assert r["n"][-1] == r["c"]["n_tokens"] == own.count(r["text"]) and len(r["n"]) == len(r["text"] or "") + 1
        assert r["cut"] == (None if r["text"] is None else r["text"][:r["c"]["kept_chars"]])
        if r["text"] in cuts:
            assert r["c"]["kept_chars"] == cuts[r["text"]]
    assert spark.createDataFrame([], DOCS).select(token_counts.counted()).count() == 0


def test_prefix_counts_of_one_piece():
    own = token_counts.counter(token_counts.default_path())
    for word in (b"internationalisation", b" unbelievable", "éàü".encode()):
        assert own.prefix_counts(word) == [len(own.encode_alone(word[:i])) for i in range(len(word) + 1)]


#: Texts that copy sentences from each other, as those of the corpus do.
SENTENCES = [" ".join(random.Random(i).choice(["river", "stone", "light", "cloudy", "in", "on"]) for _ in range(7)) + "." for i in range(30)]


def lm(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    held = (lm_scoring.remainder(F.col("doc_id"), lm_scoring.FOLDS) == lm_scoring.HELD_OUT).alias("held_out")
    return lm_scoring.score_texts(docs.select("doc_id", held, "text")).collect()


def test_language_model_base_and_gain(spark):
    rng = random.Random(3)
    rows = corpus() + [(1006, "y" * 70_000 + " x", "en", "a", 1)] + [(8000 + i, " ".join(rng.choice(SENTENCES) for _ in range(12)), "en", "a", 1) for i in range(60)]
    tokens = {i: [w for w in re.findall(r"[^\x20\x09-\x0D]+", low(t))] + ["\n"] for i, (_, t, *_) in enumerate(rows)}
    held = {i: zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 10 == 0 for i, r in enumerate(rows)}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(rows[i][0]), held[i], len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in tokens.items())
    got = lm(spark, rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def model_of(words, counts, depth=lm_scoring.PREFIX):
    """A mixer, its tables and the words, learnt from counts by word (or by word and side)."""
    import numpy as np

    counts = np.array([c if isinstance(c, list) else [0, c, 0, 0] for c in counts], float)
    every, n = np.full(len(words), 15), len(words)
    learnt = lm_scoring.Words(words, counts, (counts > 0) @ (1 << np.arange(4)), np.full(n, depth))
    zeros, ones = np.zeros((2, lm_scoring.ORDERS, 1 << lm_scoring.TABLE_BITS))
    lm_scoring.count_contexts(learnt, zeros, ones)
    mixer = lm_scoring.Mixer()
    mixer.learn(lm_scoring.Tables(zeros, ones, True), learnt)
    return mixer, lm_scoring.Tables(zeros, ones, False), lm_scoring.Words(words, counts, every, np.full(n, depth))


def test_words_of_the_model_are_a_distribution():
    words = sorted([b"aa", b"ab", b"abc", b"zebra", b"q" * 120, b"abcdefghij", b"abcdefghik", lm_scoring.END])
    counts = {b"aa": 5, b"ab": [4, 0, 0, 1], b"abc": 3, b"zebra": 0, b"abcdefghij": [9, 0, 1, 0], lm_scoring.END: 2}
    mixer, tables, shown = model_of(words, [counts.get(w, 0) for w in words])
    scores = mixer.score(tables, shown)
    assert (scores < 0).all() and ((10.0 ** scores).sum(axis=0) <= 1 + 1e-9).all()
    at = words.index
    assert scores[at(b"aa"), 1] > scores[at(b"zebra"), 1] and scores[at(b"abcdefghij"), 0] > scores[at(b"abcdefghik"), 0]
    assert scores[at(b"q" * 120), 1] < scores[at(b"zebra"), 1]
    assert scores[at(b"ab"), 0] > scores[at(b"ab"), 2]  # what stands before a word counts


def test_trie_gives_each_word_what_it_has_alone():
    """A prefix that words share is worked out once; walking every word by itself gives the same numbers."""
    import numpy as np

    rng = random.Random(11)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 70))).encode() for _ in range(300)} | {b"a\x00", b"a\x01b", lm_scoring.END})
    counts = [rng.randrange(4) for _ in words]
    mixer, tables, shown = model_of(words, counts)
    both = mixer.score(tables, shown)
    for i in range(0, len(words), 17):
        prefix = [j for j, w in enumerate(words) if w[:lm_scoring.PREFIX] == words[i][:lm_scoring.PREFIX] or j == i]
        own = lm_scoring.Words([words[j] for j in prefix], shown.counts[prefix], shown.sides[prefix], shown.depth[prefix])
        assert np.allclose(mixer.score(tables, own)[prefix.index(i)], both[i])


def test_copy_weights_are_probabilities_and_follow_the_text():
    import numpy as np

    by_words = [np.full(40, -30.0), np.full(40, -30.0), np.zeros(0), np.full(3, -2.0)]
    counts = [np.ones(40, int), np.zeros(40, int), np.zeros(0, int), np.array([1, 0, 2])]
    copied, fresh, none, short = lm_scoring.copy_scores(by_words, counts, 1000)
    assert none == 0 and copied > 40 * -3.3 and 40 * -30.5 < fresh < 40 * -30 and short < 0
    # a text's score doesn't depend on the texts beside it
    assert np.isclose(copied, lm_scoring.copy_scores(by_words[:1], counts[:1], 1000)[0])


def test_phrases_meet_again_at_other_offsets():
    import numpy as np

    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 1 << 63, 500, np.int64).astype(np.uint64)
    ends, cuts = np.zeros(500, bool), hashes & np.uint64(7) == 0
    ids = rng.integers(0, 500, 400)
    a = lm_scoring.phrases(ids, ends, cuts, hashes)
    b = lm_scoring.phrases(np.concatenate([rng.integers(0, 500, 13), ids]), ends, cuts, hashes)
    assert len(set(a.tolist()) & set(b.tolist())) > len(a) / 2
    starts = lm_scoring.phrase_starts(ids, ends, cuts)
    assert (np.diff(np.append(starts, len(ids))) <= lm_scoring.PHRASE).all() and starts[0] == 0


def test_hot_prefixes_are_dealt_on(spark, monkeypatch):
    """However words are dealt, counts are the same, and so are the predictors of every byte: with one model, scores agree to rounding."""
    rng = random.Random(7)
    rows = [(i, " ".join(f"http{rng.choice('abc')}{rng.randrange(40)}.{'organisation' if rng.random() < 0.3 else 'org'}{rng.choice(['', '/index', '/idx'])} http" for _ in range(30)), "en", "a", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "doc_id % 10 = 0 AS held_out", "text")
    parts = lm_scoring.materialise(lm_scoring.to_parts(docs), "lm-parts")
    model, found = None, {}
    for most in (16_000, 5, 2):
        monkeypatch.setattr(lm_scoring, "HOT_WORDS", most)
        words = lm_scoring.vocabulary(parts, 1000)
        model = model or lm_scoring.train(words)
        scores = {}
        for r in lm_scoring.score_words(words, model).collect():
            number, count, marks, score = lm_scoring._unsqueeze(r["words"])
            scores.setdefault(r["part"], []).extend(zip(number.tolist(), count.tolist(), marks.tolist(), *score.T.tolist()))
        found[most] = {part: sorted(own) for part, own in scores.items()}, words.agg(F.max("depth")).first()[0]
    assert [found[k][1] for k in found] == [4, 16, 16]
    for most in (5, 2):
        for part, own in found[16_000][0].items():
            for x, y in zip(own, found[most][0][part], strict=True):
                assert x[:3] == y[:3] and all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6) for a, b in zip(x[3:], y[3:]))


def test_scores_hardly_depend_on_how_words_are_dealt(spark, monkeypatch):
    """Weights are learnt by tasks and averaged, so the model itself moves a little with the dealing; counts do not."""
    rng = random.Random(7)
    rows = [(i, " ".join(f"http{rng.choice('abc')}{rng.randrange(40)}.org" for _ in range(30)), "en", "a", 1) for i in range(60)]
    one = {r["doc_id"]: r for r in lm(spark, rows)}
    monkeypatch.setattr(lm_scoring, "HOT_WORDS", 5)
    two = {r["doc_id"]: r for r in lm(spark, rows)}
    for i, r in one.items():
        assert (r["n_known"], r["base_score"], r["train_tokens"]) == (two[i]["n_known"], two[i]["base_score"], two[i]["train_tokens"])
        assert math.isclose(r["score"], two[i]["score"], rel_tol=0.02)


def test_language_model_without_rows(spark):
    assert lm(spark, []) == []
    only = lm(spark, [(i, "q", "en", "a", 1) for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0])
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in only)


@pytest.mark.parametrize("text, words", [("A b", [b"a", b"b"]), ("É-x 9\x7f", ["É".encode(), b"x", b"9"]), (None, []), ("...", [])])
def test_words_of(text, words):
    assert decontaminate.words_of(text) == words
