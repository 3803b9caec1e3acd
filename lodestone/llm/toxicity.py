"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

A text is its sentences, a sentence its segments (words without their punctuation, and runs of single letters put together).
Segments are compared with landmark strings by the gap-weighted subsequence kernel: common subsequences of ORDER letters count
DECAY to the power of the spans they take, so inserted characters only weaken a match. A sentence's similarity to
a landmark is the best of its segments. The Nystroem map turns those similarities into features, a linear SVM
separates them, a text's margin is that of its worst sentence, and a logistic curve fitted to the margins of texts gives the score.

Landmarks, SVM and curve are learnt from labelled documents outside the held-out fold: at most about
TRAIN_DOCS of them, chosen by a hash of doc_id (the bound of a documented sample). Only texts are labelled, so the sentences are
labelled by multiple instances: every sentence of a clean text is clean, and of a toxic text the one with the highest margin is toxic,
chosen anew after each of ROUNDS fits. Landmarks are pieces of the sample's segments, chosen by how they tell the labels apart; their number
(LANDMARKS) and those of the proposals (CANDIDATES, MOST_WORDS) are sizes of the model. Every text is scored whole; words
repeat, so each worker remembers their similarities, up to CACHE_WORDS of them.

Similarities below LEAST are noise of short common subsequences and count as 0, in learning and scoring alike; a letter filter finds most
of them before any kernel is worked out.

Defined cases: null and empty texts have no segments and get the score of a text without any similarity; labels that are
null are not learnt from, and of several labels for a doc_id the largest counts; repeated rows are scored alike and count each in
learning; a null doc_id has no label; without labels of both kinds, or documents, every score is 0; a segment of more than
WINDOW letters is compared in overlapping windows; columns of any name pass through `reject` unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialise, remainder, uniform

ORDER, DECAY = 3, 0.5
LANDMARKS, CANDIDATES = 32, 3_000
#: Log odds (toxic against clean texts) that a landmark has at least.
LEAST_ODDS = 2.0
#: Occurrences, per toxic text, of words that a further landmark is part of and none before.
LEAST_SHARE = 0.01
#: Telling words from which landmarks are chosen.
MOST_WORDS = 20_000
SHORTEST, LONGEST = 4, 8
TRAIN_DOCS = 8_000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
#: Similarities below this count as none.
LEAST = 0.3
#: What this share of the clean training texts does not pass is no sign of toxicity.
CLEAN_SHARE = 0.995
#: Fits of the SVM, each with the sentences that the one before finds worst.
ROUNDS = 4
WINDOW = 32
#: Letters by which a compared window may exceed the landmark.
SLACK = 2
CACHE_WORDS = 150_000
#: Texts of about so many characters share one round of kernel sums.
ROUND_CHARS = 1_000_000

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")


def segments(text: str | None) -> set[str]:
    """What of a text is compared: letters of each word, and of runs of three or more single characters."""
    if not text:
        return set()
    low = text.lower()
    found = set()
    for w in set(low.split()):
        found.add(w if w.isalpha() else "".join(filter(str.isalpha, w)))
    for m in _SPACED.finditer(low):
        found.add("".join(filter(str.isalpha, m.group())))
    long = [w for w in found if len(w) > WINDOW]
    for w in long:
        found.discard(w)
        found.update(w[i:i + WINDOW] for i in range(0, len(w), WINDOW // 2))
    return {w for w in found if len(w) >= ORDER}


def _codes(words: list[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(words), width), pad, np.int32)
    for i, w in enumerate(words):
        out[i, :len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.int32)[:width]
    return out


def subsequence_kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Kernel of each row of s with the same row of t (letter codes; paddings must differ)."""
    rows, n = s.shape
    q = t.shape[1]
    same = [[(s[:, i] == t[:, j]).astype(np.float64) for j in range(q)] for i in range(n)]
    # kept[j]: sums over prefixes of s so far and of t up to j, by the length matched
    kept = [[np.zeros(rows) for _ in range(q + 1)] for _ in range(order)]
    kept[0] = [np.ones(rows) for _ in range(q + 1)]
    total = np.zeros(rows)
    for i in range(n):
        for j in range(q):
            total += decay * decay * same[i][j] * kept[order - 1][j]
        for m in range(order - 1, 0, -1):
            run = np.zeros(rows)
            for j in range(q):
                run = decay * (run + decay * same[i][j] * kept[m - 1][j])
                kept[m][j + 1] = decay * kept[m][j + 1] + run
    return total


class Landmarks:
    """Landmark strings and the similarity of segments to them."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        self.codes = _codes(strings, LONGEST, -2)
        own = subsequence_kernel(_codes(strings, LONGEST, -1), self.codes)
        self.own = np.maximum(own, 1e-12)
        letters = sorted({c for s in strings for c in s})
        self.bit = {c: 1 << (i % 63) for i, c in enumerate(letters)}
        self.masks = np.array([self._mask(s) for s in strings], np.int64)
        self.needed = np.ceil(np.bitwise_count(self.masks) * 0.6).astype(np.int64)
        self.row: dict[str, int] = {}
        self.known = [np.zeros(len(strings))]

    def _mask(self, s: str) -> int:
        m, bit = 0, self.bit.get
        for c in s:
            m |= bit(c, 0)
        return m

    def similarities(self, words: list[str]) -> np.ndarray:
        """Best normalised kernel between each landmark z and the word's windows of |z| to |z| + SLACK letters.

        Only words that share enough letters with z and have K(word, z) of LEAST times K(z, z) are looked at; others count 0.
        """
        out = np.zeros((len(words), len(self.strings)))
        if not words or not self.strings:
            return out
        masks = np.fromiter(map(self._mask, words), np.int64, len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((0, 6), (6, 9), (9, 13), (13, 20), (20, WINDOW)):
            at = np.flatnonzero((sizes > low) & (sizes <= high))
            for part in np.array_split(at, max(1, len(at) // 20_000)):
                shared = np.bitwise_count(masks[part][:, None] & self.masks[None, :]) >= self.needed[None, :]
                i, z = np.nonzero(shared)
                if not len(i):
                    continue
                codes = _codes([words[k] for k in part], high, -1)
                value = np.concatenate([subsequence_kernel(codes[a], self.codes[b]) for a, b in zip(np.array_split(i, 1 + len(i) // 8192), np.array_split(z, 1 + len(i) // 8192))])
                near = value >= LEAST * self.own[z]
                np.maximum.at(out, (part[i[near]], z[near]), self._windowed([words[k] for k in part[i[near]]], z[near]))
        return out

    def _windowed(self, words: list[str], marks: np.ndarray) -> np.ndarray:
        best = np.zeros(len(words))
        pairs = [
            (k, w[a:a + size], z)
            for k, (w, z) in enumerate(zip(words, marks.tolist()))
            for size in range(min(len(w), len(self.strings[z])), min(len(w), len(self.strings[z]) + SLACK) + 1)
            for a in range(len(w) - size + 1)
        ]
        for i in range(0, len(pairs), 16_384):
            at, windows, z = zip(*pairs[i:i + 16_384])
            s, z = _codes(windows, LONGEST + SLACK, -1), np.array(z)
            other = np.where(s < 0, -3, s)
            value = subsequence_kernel(s, self.codes[z]) / np.sqrt(np.maximum(subsequence_kernel(s, other), 1e-12) * self.own[z])
            np.maximum.at(best, np.array(at), value)
        return best

    def gram(self) -> np.ndarray:
        """Normalised kernel among the landmarks."""
        m = len(self.strings)
        i, j = np.divmod(np.arange(m * m), m)
        s = _codes(self.strings, LONGEST, -1)
        return (subsequence_kernel(s[i], self.codes[j]) / np.sqrt(self.own[i] * self.own[j])).reshape(m, m)

    def of_texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the similarities of its sentences, best of their segments to each landmark; different rows that are not 0."""
        found = [[segments(x) for x in _SENTENCE.split(t)] if t else [] for t in texts]
        every = set().union(*(w for sentences in found for w in sentences))
        new = list(every - self.row.keys())
        if len(self.row) + len(new) > CACHE_WORDS:
            self.row, self.known = {}, self.known[:1]
            new = list(every)
        values = self.similarities(new)
        some = values.any(axis=1)
        self.row.update(dict.fromkeys((w for w, hit in zip(new, some) if not hit), 0))
        for k in np.flatnonzero(some):
            self.row[new[k]] = len(self.known)
            self.known.append(values[k])
        out = []
        for sentences in found:
            alike = {frozenset(self.row[w] for w in words) - {0} for words in sentences} - {frozenset()}
            rows = [np.max([self.known[r] for r in rows], axis=0) for rows in alike]
            out.append(np.array(rows).reshape(-1, len(self.strings)))
        return out


def above(similarities: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Similarities as the share of the way from what clean texts reach to a full match."""
    return np.clip((similarities - floor) / (1 - floor), 0, 1)


@dataclass
class Model:
    """Everything a worker needs to score texts."""

    landmarks: list[str]
    floor: np.ndarray
    whiten: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, similarities: np.ndarray) -> np.ndarray:
        return above(similarities, self.floor) @ self.whiten @ self.weights + self.bias

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """From 0 to 1 for each text, given its sentences' similarities."""
        margin = _worst(self.margins(np.concatenate([*texts, np.zeros((1, len(self.landmarks)))])), texts)
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _worst(margins: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """The largest margin of each text's sentences; the last margin is that of a sentence without any similarity."""
    out = np.full(len(texts), margins[-1])
    np.maximum.at(out, np.repeat(np.arange(len(texts)), [len(t) for t in texts]), margins[:-1])
    return out


def _rounds(texts: pa.Array) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        s = t.as_py()
        part.append(s)
        size += len(s or "")
        if size >= ROUND_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def similarity_column(strings: list[str], column: str = "text"):
    """Arrays of the similarities of a text's sentences to the landmarks, in a row."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        marks = Landmarks(strings)
        for texts in batches:
            rows = [x.ravel().tolist() for part in _rounds(texts) for x in marks.of_texts(part)]
            yield pa.array(rows, pa.list_(pa.float64()))

    return F.arrow_udf(run, T.ArrayType(T.DoubleType()))(F.col(column))


def score_column(model: Model | None, column: str = "text"):
    """Toxicity of a text, from 0 to 1."""
    if model is None:
        return F.lit(0.0)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        marks = Landmarks(model.landmarks)
        for texts in batches:
            scores = [model.score(marks.of_texts(part)) for part in _rounds(texts)]
            yield pa.array(np.concatenate(scores) if scores else np.zeros(0))

    return F.arrow_udf(run, T.DoubleType())(F.col(column))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """Rows (doc_id, text, toxic) to learn from: labelled, not held out, about most of them at most."""
    own = labels.filter("toxic is not null").filter(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = own.count()
    if n > most:
        own = own.filter(uniform("toxicity", F.col("doc_id")) < most / n)
    # at most about `most` rows
    return materialise(docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("doc_id", "text", "toxic"), "toxic-train")


def choose_landmarks(rows: DataFrame, most: int = LANDMARKS) -> list[str]:
    """Substrings of words that set toxic training texts apart, longest first among equals, none too like another.

    Words that are telling propose the CANDIDATES substrings; those are then counted by text, exactly, and chosen one by
    one for the telling words that none chosen before is part of.
    """

    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([sorted(segments(t.as_py())) for t in texts], pa.list_(pa.string()))

    words = rows.select("toxic", F.explode(F.arrow_udf(split, T.ArrayType(T.StringType()))("text")).alias("word"))
    counted = words.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    sizes = rows.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    if not sizes["bad"] or not sizes["good"]:
        return []
    pieces = F.flatten(F.transform(
        F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length("word"))),
        lambda k: F.transform(F.sequence(F.lit(1), F.length("word") - k + 1), lambda i: F.substring(F.col("word"), i, k)),
    ))

    def odds(bad, good):
        return F.log((bad + 0.5) / (sizes["bad"] + 1.0)) - F.log((good + 0.5) / (sizes["good"] + 1.0))

    telling = counted.filter((F.length("word") >= SHORTEST) & (odds(F.col("bad"), F.col("good")) >= LEAST_ODDS))
    grams = telling.select(F.explode(F.array_distinct(pieces)).alias("gram"), "bad")
    best = grams.groupBy("gram").agg(F.sum("bad").alias("bad")).orderBy(F.desc(F.col("bad") * F.length("gram")), "gram").limit(CANDIDATES)
    candidates = [r["gram"] for r in best.collect()]
    if not candidates:
        return []

    def held(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = ahocorasick.Automaton()
        for i, g in enumerate(candidates):
            finder.add_word(g, i)
        finder.make_automaton()
        for texts in batches:
            yield pa.array([sorted({i for _, i in finder.iter(" ".join(segments(t.as_py())))}) for t in texts], pa.list_(pa.int32()))

    found = rows.select("toxic", F.arrow_udf(held, T.ArrayType(T.IntegerType()))("text").alias("found"))
    exact = found.select("toxic", F.explode("found").alias("i")).groupBy("i").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    exact = exact.select("i", "bad", odds(F.col("bad"), F.col("good")).alias("odds")).filter((F.col("odds") >= LEAST_ODDS) & (F.col("bad") >= 3))
    odds_of = {r["i"]: r["odds"] for r in exact.collect()}  # at most CANDIDATES rows
    words = {r["word"]: r["bad"] for r in telling.filter("bad >= 3").orderBy(F.desc("bad"), "word").limit(MOST_WORDS).collect()}
    within: dict[int, list[str]] = {}
    finder = ahocorasick.Automaton()
    for i in odds_of:
        finder.add_word(candidates[i], i)
    finder.make_automaton()
    for word in words if odds_of else ():
        for i in {i for _, i in finder.iter(word)}:
            within.setdefault(i, []).append(word)
    chosen: list[str] = []
    while within and len(chosen) < most:
        left = {i: sum(words[w] for w in ws if w in words) for i, ws in within.items()}
        best = min(left, key=lambda i: (-left[i] * odds_of[i] * len(candidates[i]), candidates[i]))
        if left[best] < max(3, LEAST_SHARE * sizes["bad"]):
            break
        chosen.append(candidates[best])
        for w in within.pop(best):  # words that it explains
            words.pop(w, None)
    return chosen


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model from labelled documents; None without labels of both kinds."""
    rows = training_rows(docs, labels)
    strings = choose_landmarks(rows)
    if not strings:
        return None
    # at most about TRAIN_DOCS rows, of the sentences in which anything is like a landmark
    seen = rows.select("toxic", similarity_column(strings).alias("x")).toPandas()
    texts = [np.array(x, np.float64).reshape(-1, len(strings)) for x in seen["x"]]
    toxic = seen["toxic"].to_numpy() > 0
    order = sorted(range(len(texts)), key=lambda i: (toxic[i], texts[i].tobytes()))  # whatever order the rows came in
    texts, toxic = [texts[i][np.lexsort(texts[i].T)] for i in order], toxic[order]
    most = np.array([t.max(axis=0, initial=0) for t in texts])
    floor = np.minimum(np.quantile(most[~toxic], CLEAN_SHARE, axis=0), 0.95)
    values, vectors = np.linalg.eigh(Landmarks(strings).gram())
    whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    nothing = np.zeros((1, len(strings)))
    every = above(np.concatenate([*texts, nothing]), floor)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    clean = np.append(~toxic[owner], True)
    margin = every.sum(axis=1)
    for _ in range(ROUNDS):
        worst = _most_toxic(margin[:-1], owner, toxic)
        x, y = np.concatenate([every[clean], every[worst]]) @ whiten, np.repeat([-1.0, 1.0], [clean.sum(), len(worst)])
        weights, bias = _svm(x, y)
        margin = every @ whiten @ weights + bias
    slope, shift = _curve(_worst(margin, texts), np.where(toxic, 1.0, -1.0))
    return Model(strings, floor, whiten, weights, bias, slope, shift)


def _most_toxic(margin: np.ndarray, owner: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The sentence with the largest margin of each toxic text that has any."""
    order = np.lexsort((-margin, owner))
    first = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])[:len(order)]]
    return first[toxic[owner[first]]]


def _svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, both labels of equal total cost; Newton steps on the active rows."""
    z = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y) * cost / len(y)
    penalty = np.eye(z.shape[1]) * 1e-3
    penalty[-1, -1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        active = y * (z @ w) < 1
        a, c = z[active], share[active][:, None]
        new = np.linalg.solve(penalty + a.T @ (c * a), a.T @ (c[:, 0] * y[active]))
        if np.allclose(new, w, atol=1e-9):
            break
        w = 0.5 * (w + new)
    return w[:-1], float(w[-1])


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of label against margin, with softened targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.stack([margin, np.ones_like(margin)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T @ (z * (p * (1 - p))[:, None]) + np.eye(2) * 1e-3
        step = np.linalg.solve(h, z.T @ (target - p) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def reject(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without those that score THRESHOLD or more."""
    (score,) = fresh(docs.columns, "toxicity")
    return docs.withColumn(score, score_column(model)).filter(F.col(score) < THRESHOLD).select(*docs.columns)


def op9_toxicity(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = docs.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), score_column(fit(docs, labels)).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
