from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import licences as L

DOCS = "doc_id long, text string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def places(ws):
    out = []
    for label, phrase in L.PHRASES:
        p = phrase.split()
        out += [(label, i) for i in range(len(ws) - len(p) + 1) if ws[i:i + len(p)] == p]
    return sorted(out)


def segments(ws, template):
    """Runs of at least SEED words, shared by text and template, that neither side can be made longer."""
    out = []
    for i in range(len(ws)):
        for j in range(len(template)):
            if ws[i] == template[j] and not (i and j and ws[i - 1] == template[j - 1]):
                k = 0
                while i + k < len(ws) and j + k < len(template) and ws[i + k] == template[j + k]:
                    k += 1
                if k >= L.SEED:
                    out.append((i, j, k))
    return sorted(out)


def corpus():
    rng = random.Random(4)
    mit, isc, bsd3, gpl = (next(t for label, t in reversed(L.TEMPLATES) if label == name) for name in ("mit", "isc", "bsd-3-clause", "gpl-3.0"))
    known = sorted({w for _, t in L.TEMPLATES for w in words(t)})

    def shaken(text, share):
        return " ".join(w if rng.random() > share else rng.choice(["zzz", "the", ""]) for w in text.split())

    rows = [(i, " ".join(rng.choice(known) for _ in range(rng.choice([0, 3, 40, 200])))) for i in range(40)]
    rows += [(100 + i, "alpha beta. " + shaken(rng.choice([mit, isc, bsd3, gpl]), 0.05) + " omega") for i in range(20)]
    rows += [(200, "Released under the MIT License."), (201, "Licensed under CC BY-NC 4.0.\nMore"), (202, "THE gnu General\nPublic  License,"), (203, None), (204, ""), (205, " ?! "), (206, mit + " x " + gpl + " y " + mit), rows[45]]
    rows += [(207, "Apache License. apache license MIT-license"), (None, "cc by cc by"), (208, "word " * 50_000 + "Licensed under the Apache License, Version 2.0."), (209, ("Released under the MIT License. " * 3000))]
    return rows


def test_walk_against_brute_force():
    automaton = L.LicenceAutomaton()
    for _, text in corpus():
        ws = words(text)
        if len(ws) > 1000:
            continue
        found, parts = automaton.walk(L.words_of(text))
        assert sorted(found) == places(ws)
        for item, (_, template) in enumerate(L.TEMPLATES):
            assert sorted(parts.get(item, [])) == segments(ws, words(template))


def test_chains_cover_the_most_words():
    rng = random.Random(5)

    def best(parts, gap):
        parts, covered = sorted(parts), {}
        for j, (w, a, n) in enumerate(parts):
            covered[j] = max([n, *(covered[k] + new for k in range(j) if (p := parts[k])[0] < w and p[1] < a and w - p[0] - p[2] <= gap and (new := n - max(0, p[0] + p[2] - w, p[1] + p[2] - a)) > 0)])
        return max(covered.values(), default=0)

    for _ in range(300):
        parts = list({(rng.randrange(60), rng.randrange(25), rng.randrange(3, 9)) for _ in range(rng.randrange(14))})
        got = L.chains(parts, 12)
        assert max((c for *_, c in got), default=0) == best(parts, 12)
        assert all(start < stop and covered > 0 for start, stop, covered in got)


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(corpus(), DOCS).withColumns({c: F.lit("x") for c in ("licences", "words", "score")})
    got = L.annotate(df)
    assert got.columns == ["doc_id", "text", "licences", "words", "score"]
    return {r["doc_id"]: r["licences"] for r in got.collect()}


def test_texts_are_found_though_words_change(found):
    for doc_id in range(100, 120):  # a word in twenty is another: most are found, and each with the score of its best chain
        spans = found[doc_id]["spans"]
        assert found[doc_id]["score"] > 0.7 and all(s["share"] >= L.SHARE for s in spans) and bool(spans) == (found[doc_id]["score"] >= L.SHARE)
    assert sum(bool(found[i]["spans"]) for i in range(100, 120)) >= 18
    assert {s["label"] for i in range(100, 120) for s in found[i]["spans"]} == {"mit", "isc", "bsd-3-clause", "gpl-3.0"}
    assert not any(found[i]["spans"] for i in range(40))
    assert [(s["label"], s["share"]) for s in found[206]["spans"]] == [("mit", 1.0), ("gpl-3.0", 1.0), ("mit", 1.0)]
    assert [s["label"] for s in found[201]["spans"]] == ["cc-by-nc-4.0"]
    assert [(s["start"], s["stop"]) for s in found[208]["spans"]] == [(50_000, 50_008)]
    assert len(found[209]["spans"]) == 3000 and len(found[209]["places"]) == 3000
    assert [found[i]["score"] for i in (200, 203, 204, 205)] == [1.0, 0.0, 0.0, 0.0]


def test_query(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = L.op13_licences(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def want(doc_id, text):
        ws = words(text)
        at = places(ws)
        return doc_id, len(ws), len(at), min((i for _, i in at), default=None), max((i for _, i in at), default=None), ",".join(sorted({x for x, _ in at}))

    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == sorted((want(*r) for r in rows), key=str)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got.collect())
    assert L.op13_licences(spark, str(tmp_path)).limit(0).collect() == []


def test_bound_on_templates():
    with pytest.raises(ValueError):
        L.LicenceAutomaton([("x", "word " * (L.MOST_WORDS + 1))])
