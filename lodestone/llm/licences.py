"""Licence scans: matching statistics against licence templates, and chains of long matches.

The templates' words (A-Z lowered; runs of digits, a-z and non-ASCII bytes) and the base phrases are put in one generalised suffix automaton.
A text is streamed through it once, keeping the longest match that ends at each word. Where a match of SEED words or
more cannot go on in a template, it is a segment of it: a run of words that the text and the template share. Segments of a template that follow
one another in both, at most GAP words of the text apart, are chained so that they cover most words of the template. A
chain that covers SHARE of it is a span with the template's label; a span inside one that covers more words goes. Base phrases are
found by the same walk, as matches that end in a phrase's state.

The score is 1 for a text with a base phrase, and otherwise the largest share of a template that a chain covers.

The automaton holds the templates only, a parameter of at most MOST_WORDS words (more raise an error), so what is broadcast does not grow with
the documents. Defined cases: null, empty and wordless texts have no places, no spans and score 0; texts of any length are
read whole, one walk in time linear in the length and in the segments found; repeated rows each have their result; phrases that overlap
are all places; equal templates of different labels are both found; an empty table gives an empty result; all columns stay, and one named like the new one is replaced.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import SuffixAutomaton, words_of

SEED, GAP, SHARE = 3, 12, 0.75
MOST_WORDS = 50_000

# The contract's phrases, and public wording of licences and of their notices.
PHRASES = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]

TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies."""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("gpl-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("lgpl-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("agpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
]

RESULT = "n_words long, places array<struct<label:string,word:long>>, spans array<struct<label:string,template:int,start:long,stop:long,covered:long,share:double>>, score double"
_RESULT_PA = pa.struct([
    ("n_words", pa.int64()), ("places", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))),
    ("score", pa.float64()),
])


class LicenceAutomaton(SuffixAutomaton):
    """The automaton of templates and phrases; its states know where in templates they end, and which phrases end with them."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, seed: int = SEED):
        self.names = [label for label, _ in templates]
        self.phrases = [label for label, _ in phrases]
        items = [words_of(text) for _, text in [*templates, *phrases]]
        if sum(map(len, items)) > MOST_WORDS:
            raise ValueError(f"templates of more than {MOST_WORDS} words in all")
        super().__init__(list(enumerate(items)), seed)

    def _label(self, coded) -> None:
        n, known = len(self.length), len(self.names)
        self.coded: dict[int, list[int]] = {}
        ends: list[list] = [[] for _ in range(n)]
        own: list[list] = [[] for _ in range(n)]
        for item, codes in coded:
            at, self.coded[item] = 0, codes
            for i, c in enumerate(codes, 1):
                at = self.step[at][c]
                if item < known:
                    ends[at].append((item, i))
            if item >= known:
                own[at].append((len(codes), self.phrases[item - known]))
        # ends: (template, words up to the end, words shared) for the state's sequence and its shorter ends, longest first
        self.ends: list[tuple] = [()] * n
        self.wholes: list[tuple] = [()] * n
        below: list[set] = [set(x) for x in ends]
        order = sorted(range(1, n), key=self.length.__getitem__)
        for v in reversed(order):
            if self.link[v] > 0:
                below[self.link[v]] |= below[v]
        for v in order:
            up = self.link[v]
            here = {(item, i): min(self.length[v], i) for item, i in below[v]} if self.length[v] >= self.window else {}
            self.ends[v] = tuple(sorted([*((item, i, size) for (item, i), size in here.items()), *(x for x in self.ends[up] if x[:2] not in here)]))
            self.wholes[v] = self.wholes[up] + tuple(own[v])

    def walk(self, words: list[bytes]) -> tuple[list[tuple[str, int]], dict[int, list[tuple[int, int, int]]]]:
        """Places (label, first word) of phrases, and for each template its segments (word of the text, word of the template, words)."""
        step, link, length, seed, ends, wholes = self.step, self.link, self.length, self.window, self.ends, self.wholes
        codes = list(map(self.number.get, words))
        codes.append(None)
        places: list[tuple[str, int]] = []
        segments: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        v = matched = 0
        for i, c in enumerate(codes[:-1]):
            if c is None:
                v = matched = 0
                continue
            while v and c not in step[v]:
                v = link[v]
                matched = length[v]
            v = step[v].get(c, 0)
            matched = matched + 1 if v else 0
            if matched < 2:
                continue
            for size, label in wholes[v]:
                if size <= matched:
                    places.append((label, i + 1 - size))
            if matched >= seed:
                follows = codes[i + 1]
                for item, end, size in ends[v]:
                    codes_of = self.coded[item]
                    if end == len(codes_of) or codes_of[end] != follows:
                        size = min(size, matched)
                        segments[item].append((i + 1 - size, end - size, size))
        return places, segments

    def scan(self, words: list[bytes], gap: int = GAP, share: float = SHARE) -> tuple[list[tuple[str, int]], list[tuple], float]:
        """Places of phrases, spans (label, template, start, stop, covered, share) by their place, and the score."""
        places, segments = self.walk(words)
        spans, best = [], 0.0
        for item, parts in segments.items():
            whole = len(self.coded[item])
            for start, stop, covered in chains(parts, gap):
                best = max(best, covered / whole)
                if covered >= share * whole:
                    spans.append((self.names[item], item, start, stop, covered, covered / whole))
        return places, outermost(spans), 1.0 if places else best


def chains(segments: list[tuple[int, int, int]], gap: int = GAP) -> list[tuple[int, int, int]]:
    """Chains (first word, word after the last, words covered) of a template's segments, each segment in one chain at most.

    A segment may follow another that starts before it in both, by what of it is beyond the other, if at most gap words of the text lie between.
    """
    segments = sorted(segments)
    covered, before = [s[2] for s in segments], [-1] * len(segments)
    longest, low = max((s[2] for s in segments), default=0), 0
    for j, (word, at, size) in enumerate(segments):
        while segments[low][0] + longest + gap < word:  # these end too early for any that comes
            low += 1
        for k in range(low, j):
            w, a, n = segments[k]
            if w < word and a < at and word - (w + n) <= gap:
                new = size - max(0, w + n - word, a + n - at)
                if new > 0 and covered[k] + new > covered[j]:
                    covered[j], before[j] = covered[k] + new, k
    used: set[int] = set()
    out = []
    for j in sorted(range(len(segments)), key=lambda j: (-covered[j], j)):
        if j in used:
            continue
        chain, k = [], j
        while k >= 0 and k not in used:
            chain.append(k)
            k = before[k]
        used.update(chain)
        # what is left of a chain whose head another has taken counts from there on
        out.append((segments[chain[-1]][0], max(segments[k][0] + segments[k][2] for k in chain), covered[j] - (covered[k] if k >= 0 else 0)))
    return out


def outermost(spans: list[tuple]) -> list[tuple]:
    """Spans that lie in no span with more covered words, or as many of a template that is covered better; by start, equal ones of one label once."""
    kept: list[tuple] = []
    reach: list[tuple[int, int, float]] = []  # (stop, covered, share) of spans that may hold those to come
    for s in sorted(spans, key=lambda s: (s[2], -s[3], -s[4], -s[5], s[0], s[1])):
        reach = [r for r in reach if r[0] > s[2]]
        if not any(r[0] >= s[3] and r[1:] > (s[4], s[5]) for r in reach) and not any(k[0] == s[0] and k[2:4] == s[2:4] for k in kept[-8:]):
            kept.append(s)
        reach.append((s[3], s[4], s[5]))
    return kept


def annotate(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, column: str = "licences") -> DataFrame:
    """docs plus a struct column of n_words, places of base phrases, spans of templates, and score."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(LicenceAutomaton(templates, phrases)))  # at most MOST_WORDS words

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = pickle.loads(shared.value)
        for texts in batches:
            rows = []
            for text in texts.to_pylist():
                words = words_of(text)
                places, spans, score = automaton.scan(words)
                rows.append({
                    "n_words": len(words), "places": [{"label": x, "word": i} for x, i in places],
                    "spans": [dict(zip(("label", "template", "start", "stop", "covered", "share"), s)) for s in spans], "score": score,
                })
            yield pa.array(rows, _RESULT_PA)

    return docs.withColumn(column, F.arrow_udf(run, RESULT).asNondeterministic()("text"))


def op13_licences(spark, sf_dir) -> DataFrame:
    found = annotate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base, own = F.col("licences.places.label"), F.col("licences.spans.label")

    def listed(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return found.select(
        "doc_id", F.col("licences.n_words").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min("licences.places.word").alias("first_word"), F.array_max("licences.places.word").alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, own)).alias("labels"), F.col("licences.score").alias("score"),
    )
