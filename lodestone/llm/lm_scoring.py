"""Language-model scores by online logistic context mixing.

A text is coded bit by bit as its words, A-Z lowered, each followed by a blank, and a line feed at the end. Bit predictors keep
counts in hashed contexts of the last 1 to 4 bytes, which at the start of a word reach back to what stood before it (SIDES: whether
the word before ended a sentence, and whether it was plain ASCII), and in the word's whole prefix. Their predictions, as log
odds, are combined by weights that a gate chooses from how often the prefix and the longest hashed context were seen; weights
learn online by Newton steps, bit by bit of batches of words, from occurrences left out of their own counts. A table of outcomes by (partial byte, predicted log
odds) then refines the mix. What texts copy from each other is predicted by hashed phrases (up to the end of a sentence): for
each phrase one more bit, whether training has it in another text, is predicted by the text's own counts in three contexts (all its phrases,
the run of like ones, the last four), mixed by gated weights that learn along the text; a phrase is coded by its words or
as a copy, with the weight that this mix gives. A training text's own occurrences of a phrase are left out.

Beyond its first ORDERS bytes a word's bits do not depend on what stood before, and words that share a prefix share its bits, so the
vocabulary is walked as a trie: a prefix is worked out once however often it occurs.

Jobs: one scan turns each part of the input into its distinct words and phrases and, for each document, its packed word and
phrase numbers. The words are dealt once by their first PREFIX bytes, or more bytes for prefixes that many words share, and
written as a sorted vocabulary: each word once, with its counts and where it stands. What words of such prefixes do not tell of the bytes
that they are dealt by is counted level by level, where all that share the shorter prefix are together, and stands beside the first of them:
how words are dealt does not change what a predictor knows. Passes over the vocabulary count contexts, learn weights and score, and the last one returns packed scores to the parts, each of which adds up its documents. A word is in a part once,
so no word holds many of the rows. The hashed tables (ORDERS of 2^TABLE_BITS slots) and the weights are all that is broadcast: their
size is fixed. Vocabulary, phrases, texts and counts grow with the input and stay distributed.

Defined cases: a null text is the empty one (its end alone); without training documents the base score's counts are all 0
and the model predicts even odds; repeated rows are scored alike; a null doc_id has the remainder of the
empty string; a word longer than PIECE bytes is coded in pieces, contexts starting anew at each; the whole-prefix predictor is silent in
the first PREFIX bytes, at any size of the tables; bits_per_byte of an empty text counts its end as one byte; only the named columns are read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, remainder

FOLDS, HELD_OUT = 10, 0
#: Text bytes whose words share one dictionary.
PART_BYTES = 32_000_000
TABLE_BITS, ORDERS = 20, 4
PREFIX, DEEPER, PIECE = 4, (8, 16), 48
#: Prefixes with more words than this, and than a share of all, are dealt on by more bytes: at most HOT_MOST of them.
HOT_WORDS, HOT_MOST = 16_000, 5_000
PREDICTORS = ORDERS + 1
PREFIX_STEPS, ORDER_STEPS = 8, 4
GATES = PREFIX_STEPS * ORDER_STEPS * 8
BUCKETS, REACH = 33, 8.0
#: Curvature that the starting weights count for.
CAUTION, ALPHA = 1000.0, 0.1
#: What can stand before a word: bit 0, the end of a sentence or the start of the text; bit 1, a word beyond ASCII.
SIDES, START = 4, 1
#: A phrase ends with a word that ends so; within longer runs after a word whose hash says so, from CUT_FROM words on, and after PHRASE words.
PHRASE_ENDS, CUT_FROM, PHRASE = b".!?|", 12, 24
#: The weight of copying before a text has shown any phrase.
AGAIN = 0.1
#: Words handled at once; groups that are dealt together are kept together.
WORDS_AT_ONCE = 100_000
#: Slots of the tables that travel as one binary.
SLOTS_AT_ONCE = 1 << 16
END = b"\n"
ALMOST = 1e-6

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


# ---- words, sequences and phrases -----------------------------------------------------------------------------------


def _pack(ids: np.ndarray) -> bytes:
    """Word numbers of a document in order, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


_POWERS = np.cumprod(np.full(PHRASE, 0x9E3779B97F4A7C15, np.uint64))


def phrase_starts(ids: np.ndarray, ends: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where phrases start: after words that end a sentence, and in long runs after words that cut, or PHRASE words.

    ids: a document's word numbers without the end; ends, cuts: by number, whether a word ends a sentence, or cuts a long run.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(ends[ids[:-1]]) + 1])
    sizes = np.diff(np.append(starts, n))
    if sizes.max() <= CUT_FROM:
        return starts
    more = []
    for start, size in zip(starts[sizes > CUT_FROM].tolist(), sizes[sizes > CUT_FROM].tolist()):
        at = start
        for i in (np.flatnonzero(cuts[ids[start:start + size - 1]]) + start + 1).tolist() + [start + size]:
            while i - at > PHRASE:
                at += PHRASE
                more.append(at)
            if i - at >= CUT_FROM and i < start + size:
                at = i
                more.append(at)
    return np.sort(np.concatenate([starts, np.array(more, np.int64)]))


def phrases(ids: np.ndarray, ends: np.ndarray, cuts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes of the phrases of a document; hashes: by number, the hash of a word."""
    starts = phrase_starts(ids, ends, cuts)
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
    return np.add.reduceat(hashes[ids] * _POWERS[place], starts)


def sides(ids: np.ndarray, side: np.ndarray) -> np.ndarray:
    """For each word of a document what stands before it; side: by number, what a word is to the next one."""
    return np.concatenate([[START], side[ids[:-1]]])


_PARTS = pa.schema([
    ("part", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("seq", pa.binary()), ("phrases", pa.binary()),
    ("number", pa.int32()), ("word", pa.binary()), *((f"n{c}", pa.int64()) for c in range(SIDES)), ("sides", pa.int32()),
    ("phrase", pa.int64()), ("n", pa.int64()), ("met", pa.int64()),
])
_KINDS = {"int64": "long", "int32": "int", "bool": "boolean", "binary": "binary", "float": "float", "double": "double"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} array<{_KINDS[str(f.type.value_type)]}>" if pa.types.is_list(f.type) else f"{f.name} {_KINDS[str(f.type)]}" for f in schema)


class _Part:
    """Documents of one part of the input and what their words and phrases add up to."""

    def __init__(self, name: int):
        self.name = name
        self.docs: list[dict] = []
        self.number: dict[bytes, int] = defaultdict(count().__next__)  # by first sight
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, held_out: bool, text: str | None) -> None:
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        words = raw.split()
        words.append(END)
        ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        self.ids.append(ids)
        self.docs.append({"part": self.name, "doc_id": doc_id, "held_out": held_out, "n_tokens": len(ids), "n_bytes": len(raw), "seq": _pack(ids)})
        self.size += len(raw)

    def rows(self) -> Iterator[pa.RecordBatch]:
        words = list(self.number)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
        marks = _marks(words, hashes)
        ends, side, cuts = marks & 1 > 0, marks & 3, marks & 4 > 0
        found = [phrases(ids[:-1], ends, cuts, hashes) for ids in self.ids]
        every = np.concatenate(found)
        own, first, place = np.unique(every, return_index=True, return_inverse=True)
        order = np.argsort(first, kind="stable")  # numbers by first sight pack well
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        own, place = own[order], rank[place]
        sizes = [len(f) for f in found]
        for d, numbers in zip(self.docs, np.split(place, np.cumsum(sizes)[:-1])):
            d["phrases"] = _pack(np.diff(numbers, prepend=0))
        yield pa.RecordBatch.from_pylist(self.docs, schema=_PARTS)
        train = np.array([not d["held_out"] for d in self.docs])
        learnt = np.repeat(train, sizes).astype(float)
        counts, met = (np.zeros(SIDES * len(words), np.int64) for _ in range(2))
        for kept, sums in ((train, counts), (~train, met)):
            places = [i * SIDES + sides(i, side) for i, t in zip(self.ids, kept) if t]
            if places:
                sums += np.bincount(np.concatenate(places), minlength=len(sums))
        counts = counts.reshape(-1, SIDES)
        some = ((counts > 0) | (met.reshape(-1, SIDES) > 0)) @ (1 << np.arange(SIDES))
        yield from self._batches(len(words), {"number": np.arange(len(words)), "word": words, "sides": some} | {f"n{c}": counts[:, c] for c in range(SIDES)})
        yield from self._batches(len(own), {"number": np.arange(len(own)), "phrase": own.view(np.int64), "n": np.bincount(place, learnt, len(own)).astype(np.int64), "met": np.bincount(place, minlength=len(own))})

    def _batches(self, n: int, columns: dict) -> Iterator[pa.RecordBatch]:
        for i in range(0, n, 50_000):
            m = min(50_000, n - i)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(m, self.name)) if f.name == "part" else pa.array(columns[f.name][i:i + m], f.type) if f.name in columns else pa.nulls(m, f.type)
                for f in _PARTS
            ], schema=_PARTS)


def _marks(words: list[bytes], hashes: np.ndarray) -> np.ndarray:
    """For each word: bit 0, it ends a sentence; bit 1, it is beyond ASCII; bit 2, it cuts long runs."""
    ends = np.fromiter((w[-1] in PHRASE_ENDS for w in words), np.uint8, len(words))
    wide = np.fromiter((not w.isascii() for w in words), np.uint8, len(words))
    return ends | wide << 1 | (hashes & np.uint64(7) == 0).astype(np.uint8) << 2


def to_parts(docs: DataFrame) -> DataFrame:
    """From (doc_id, held_out, text): for each part of the input a row per document, per distinct word and per distinct phrase.

    Parts are numbered by task, so the result must be materialised before it is used twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 20
        part = _Part(name)
        for b in batches:
            for doc_id, held, text in zip(*(b.column(c) for c in ("doc_id", "held_out", "text"))):
                part.add(doc_id.as_py(), held.as_py(), text.as_py())
                if part.size >= PART_BYTES:
                    yield from part.rows()
                    name += 1
                    part = _Part(name)
        if part.docs:
            yield from part.rows()

    return docs.mapInArrow(run, _ddl(_PARTS))


# ---- the bit model --------------------------------------------------------------------------------------------------


def _stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.clip(np.log((n1 + ALPHA) / (n0 + ALPHA)), -REACH, REACH)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


class Step:
    """One bit of a level of the trie: its rows, each a prefix of words (and, near the start, what stands before them)."""

    __slots__ = ("at", "bit", "count", "deep", "node", "ones", "side", "silent", "slots", "zeros")


class Words:
    """Distinct sorted words as a trie that is walked level by level; a row stands for all words that share its prefix."""

    def __init__(self, words: list[bytes], counts: np.ndarray, sides: np.ndarray, depth: np.ndarray, coded: bool = False, shares: tuple[np.ndarray, np.ndarray] | None = None):
        """counts: words x SIDES; sides: bits of what stands before each; depth: bytes that words are dealt by, in which the words here do not tell
        a prefix's counts. shares tells them beyond the first PREFIX: for each word a row, or -1, of a table by byte, bit and outcome.
        """
        self.shares = shares
        if not coded:
            words = [w if w == END else w + b" " for w in words]
        self.more = [(i, w[a:a + PIECE]) for i, w in enumerate(words) if len(w) > PIECE for a in range(PIECE, len(w), PIECE)]
        heads = [w[:PIECE] for w in words] if self.more else words
        self.size = np.fromiter(map(len, heads), np.int64, len(heads))
        width = int(self.size.max(initial=1))
        data = np.frombuffer(b"".join(heads), np.uint8)
        row = np.repeat(np.arange(len(heads)), self.size)
        self.bytes = np.zeros((len(heads), width), np.uint8)
        self.bytes[row, np.arange(len(data)) - np.repeat(np.cumsum(self.size) - self.size, self.size)] = data
        self.counts, self.sides, self.depth = np.asarray(counts, np.float64), np.asarray(sides, np.int64), np.asarray(depth, np.int64)

    def further(self) -> tuple[Words, np.ndarray, np.ndarray]:
        """What long words go on with, as a trie of its own without whole prefixes; the words they belong to and their places there."""
        owner = np.array([i for i, _ in self.more], np.int64)
        pieces = sorted({p for _, p in self.more})
        number = {p: i for i, p in enumerate(pieces)}
        place = np.array([number[p] for _, p in self.more], np.int64)
        counts = np.zeros((len(pieces), SIDES))
        np.add.at(counts[:, 0], place, self.counts[owner].sum(axis=1))
        return Words(pieces, counts, np.ones(len(pieces)), np.full(len(pieces), PIECE), True), owner, place

    def levels(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[Step]]]:
        """By byte: its place, the words that have it, the node of each, the node above each node, and a step for each bit."""
        active, above = np.arange(len(self.size)), np.zeros(len(self.size), np.int64)
        shifts = np.arange(SIDES)
        for p in range(self.bytes.shape[1]):
            keep = self.size[active] > p
            active, above = active[keep], above[keep]
            if not len(active):
                return
            byte = self.bytes[active, p]
            new = np.ones(len(active), bool)
            new[1:] = (above[1:] != above[:-1]) | (byte[1:] != byte[:-1])
            first = np.flatnonzero(new)
            node = np.cumsum(new) - 1
            like, own, parent = active[first], byte[first].astype(np.int64), above[first]
            counts = np.add.reduceat(self.counts[active], first)
            total = counts.sum(axis=1)
            if p < ORDERS:  # what stands before the word is within reach of the contexts
                met = np.bitwise_or.reduceat(self.sides[active], first)
                at, side = np.nonzero((met[:, None] >> shifts & 1 > 0) | (counts > 0))
                count = counts[at, side]
            else:
                at, side, count = np.arange(len(first)), None, total
            context, contexts = np.zeros(len(at), np.uint64), []
            for k in range(ORDERS):
                if p > k:
                    before = self.bytes[like[at], p - 1 - k].astype(np.uint64)
                else:
                    before = (side + 1).astype(np.uint64) if p == k else np.zeros(len(at), np.uint64)
                context = context | before << np.uint64(8 * k)
                contexts.append((context + np.uint64(k + 1 << 40)) * _MIX[0])
            silent, told = self.depth[like] > p, None
            if self.shares is not None and p >= PREFIX:
                own_row = self.shares[0][like]
                told = np.flatnonzero(silent & (own_row >= 0))
                silent = silent & (own_row < 0)
            steps = []
            for b in range(8):
                s = Step()
                s.at, s.side, s.count, s.deep, s.silent = at, side, count, b, silent[at]
                s.node, s.bit = ((1 << b) | own >> 8 - b)[at], (own >> 7 - b & 1)[at]
                mixed = s.node.astype(np.uint64) * _MIX[1]
                s.slots = [((c ^ mixed) * _MIX[0] >> np.uint64(64 - TABLE_BITS)).astype(np.int64) for c in contexts]
                s.zeros = s.ones = None
                if not silent.all():
                    high = own >> 8 - b
                    fresh = np.ones(len(own), bool)
                    fresh[1:] = (parent[1:] != parent[:-1]) | (high[1:] != high[:-1])
                    group, known = np.cumsum(fresh) - 1, np.where(silent, 0.0, total)
                    ones = np.bincount(group, known * (own >> 7 - b & 1))[group]
                    zeros = np.bincount(group, known)[group] - ones
                    if told is not None and len(told):
                        zeros[told], ones[told] = self.shares[1][own_row[told], p - PREFIX, b].T
                    s.ones, s.zeros = ones[at], zeros[at]
                steps.append(s)
            yield p, active, node, parent, steps
            above = node


def count_contexts(words: Words, zeros: np.ndarray, ones: np.ndarray) -> None:
    """Add the words' occurrences to the hashed tables, ORDERS x 2^TABLE_BITS each."""
    for *_, steps in words.levels():
        for s in steps:
            for k in range(ORDERS):
                np.add.at(ones[k], s.slots[k], s.count * s.bit)
                np.add.at(zeros[k], s.slots[k], s.count * (1 - s.bit))
    if words.more:
        count_contexts(words.further()[0], zeros, ones)


def _confidence(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(1 + n) / 3, ORDER_STEPS - 1).astype(np.int8)


class Tables:
    """Log odds by slot of the hashed tables, worked out once: as counted, and with the occurrence that is predicted left out."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray, left_out: bool):
        if left_out:  # by the outcome that is left out
            odds = [_stretch(np.maximum(zeros - 1, 0), ones), _stretch(zeros, np.maximum(ones - 1, 0))]
        else:
            odds = [_stretch(zeros, ones)]
        self.left_out = left_out
        self.odds = np.stack(odds).astype(np.float32).reshape(-1)
        self.confidence = _confidence(np.maximum(zeros[-1] + ones[-1] - left_out, 0))

    def inputs(self, s: Step) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each predictor and the gate, for the rows of a step."""
        odds = np.zeros((len(s.at), PREDICTORS), np.float32)
        shift = s.bit * (ORDERS << TABLE_BITS) if self.left_out else 0
        for k in range(ORDERS):
            odds[:, k] = self.odds[s.slots[k] + (shift + (k << TABLE_BITS))]
        gate = self.confidence[s.slots[-1]].astype(np.int64) * 8 + s.deep
        if s.zeros is not None:
            n0, n1 = (np.maximum(s.zeros - (1 - s.bit), 0), np.maximum(s.ones - s.bit, 0)) if self.left_out else (s.zeros, s.ones)
            odds[:, ORDERS] = _stretch(n0, n1)
            gate += np.minimum(np.log2(1 + n0 + n1), PREFIX_STEPS - 1).astype(np.int64) * (ORDER_STEPS * 8)
        return odds, gate


class Mixer:
    """Gated weights and the refining table, with what they have learnt from."""

    def __init__(self):
        self.weights = np.full((GATES, PREDICTORS), 1.3 / PREDICTORS)
        # what the steps so far say about each gate's weights: second derivatives of the cost
        self.curve = np.tile(np.eye(PREDICTORS) * CAUTION, (GATES, 1, 1))
        centres = _squash(np.linspace(-REACH, REACH, BUCKETS))
        self.hits = np.tile(centres, (256, 1)) * 8.0
        self.seen = np.full((256, BUCKETS), 8.0)

    def mix(self, odds, gate):
        return np.clip(np.einsum("ij,ij->i", self.weights[gate], odds), -REACH, REACH)

    def _place(self, mixed):
        x = (mixed + REACH) * ((BUCKETS - 1) / (2 * REACH))
        low = np.minimum(x.astype(np.int64), BUCKETS - 2)
        return low, x - low

    def refine(self, node, mixed):
        low, share = self._place(mixed)
        rate = (self.hits / self.seen).reshape(-1)
        at = node * BUCKETS + low
        refined = rate[at] * (1 - share) + rate[at + 1] * share
        return np.clip((_squash(mixed) + refined) / 2, ALMOST, 1 - ALMOST)

    def learn(self, tables: Tables, words: Words, heads: bool = False) -> None:
        """One pass over the words, a Newton step of the weights at each bit; outcomes go to the refining table.

        Where words are dealt by a byte, those here are no fair share of what follows, so nothing is learnt; heads: they are whole.
        """
        for *_, steps in words.levels():
            for s in steps:
                c = s.count if heads else np.where(s.silent, 0, s.count)
                if not c.any():
                    continue
                odds, gate = tables.inputs(s)
                mixed = self.mix(odds, gate)
                chance = _squash(mixed)
                miss, bend = (s.bit - chance) * c, chance * (1 - chance) * c
                hit = np.flatnonzero(np.bincount(gate, c, GATES))
                slope = np.empty((len(hit), PREDICTORS))
                for k in range(PREDICTORS):
                    slope[:, k] = np.bincount(gate, miss * odds[:, k], GATES)[hit]
                    part = bend * odds[:, k]
                    for j in range(k + 1):
                        more = np.bincount(gate, part * odds[:, j], GATES)[hit]
                        self.curve[hit, k, j] += more
                        if j < k:
                            self.curve[hit, j, k] += more
                self.weights[hit] += np.linalg.solve(self.curve[hit], slope[:, :, None])[:, :, 0]
                low, share = self._place(mixed)
                for j, part in ((low, 1 - share), (low + 1, share)):
                    at, part = s.node * BUCKETS + j, c * part
                    self.hits += np.bincount(at, part * s.bit, 256 * BUCKETS).reshape(256, -1)
                    self.seen += np.bincount(at, part, 256 * BUCKETS).reshape(256, -1)
        if words.more:
            self.learn(tables, words.further()[0], True)

    def score(self, tables: Tables, words: Words) -> np.ndarray:
        """log10 probability of each word after each of SIDES; only sides that the words have been met with mean anything."""
        out, sums = np.zeros((len(words.size), SIDES)), np.zeros((1, SIDES))
        for p, active, node, parent, steps in words.levels():
            own = np.zeros(len(steps[0].at))
            for s in steps:
                chance = self.refine(s.node, self.mix(*tables.inputs(s)))
                own += np.log10(np.where(s.bit == 1, chance, 1 - chance))
            sums = sums[parent]
            if p < ORDERS:
                # a row for each node and side: sides that are absent keep what they have
                place = np.zeros(len(parent) * SIDES)
                place[steps[0].at * SIDES + steps[0].side] = own
                sums = sums + place.reshape(-1, SIDES)
            else:
                sums = sums + own[:, None]
            done = words.size[active] == p + 1
            out[active[done]] = sums[node[done]]
        if words.more:
            rest, owner, place = words.further()
            np.add.at(out, owner, self.score(tables, rest)[place, :1])
        return out


# ---- jobs -----------------------------------------------------------------------------------------------------------


def _firsts(words: pa.Array) -> np.ndarray:
    """Where runs of equal words start; words are not null."""
    differ = pc.not_equal(words.slice(1), words.slice(0, max(0, len(words) - 1))).to_numpy(zero_copy_only=False).astype(bool)
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(words)), bool), differ]))


_VOCABULARY = pa.schema([
    ("word", pa.binary()), ("depth", pa.int32()), *((f"n{c}", pa.int64()) for c in range(SIDES)), ("sides", pa.int32()),
    ("parts", pa.list_(pa.int64())), ("numbers", pa.list_(pa.int32())), ("shares", pa.binary()),
])
#: Bytes beyond PREFIX that words may be dealt by, and numbers of a table of shares: zeros and ones of each bit.
INNER = DEEPER[-1] - PREFIX
_SHARES = pa.schema([("word", pa.binary()), ("shares", pa.binary())])


_COUNT = " + ".join(f"n{c}" for c in range(SIDES))


def _dealt(words: DataFrame, rows: int) -> tuple[DataFrame, DataFrame | None]:
    """words with depth, by how many bytes they are dealt: PREFIX, or more where very many share those; and what `_shares` needs of the latter.

    A prefix is dealt on if more than rows / HOT_MOST words have it, so there are at most HOT_MOST of them. Longer prefixes are
    counted over heads: (word, rows, n, depth), the first bytes of words of hot prefixes, as they are coded, each once.
    """
    most = max(HOT_WORDS, rows // HOT_MOST)

    def hot(counted: DataFrame, size: int) -> list[bytes]:
        """At most HOT_MOST prefixes: they become a set in the expressions that look them up."""
        whole = (F.length("hot") == size) & (F.substring("hot", -1, 1) != F.lit(b" "))
        return sorted(bytes(r[0]) for r in counted.filter((F.col("rows") > most) & whole).select("hot").collect())

    def marked(frame: DataFrame, prefixes: list[bytes], size: int, depth: int) -> DataFrame:
        return frame.withColumn("depth", F.when(F.substring("word", 1, size).isin(prefixes), depth).otherwise(F.col("depth")))

    plain = words.withColumn("depth", F.lit(PREFIX))
    first = hot(words.groupBy(F.substring("word", 1, PREFIX).alias("hot")).agg(F.count("*").alias("rows")), PREFIX)
    if not first:
        return plain, None
    longest = F.substring(F.expr("concat(word, cast(' ' as binary))"), 1, DEEPER[-1])
    heads = words.filter(F.substring("word", 1, PREFIX).isin(first)).groupBy(longest.alias("word")).agg(F.count("*").alias("rows"), F.sum(F.expr(_COUNT)).alias("n"))
    heads = materialise(heads.withColumn("depth", F.lit(DEEPER[0])), "lm-heads")
    plain = marked(plain, first, PREFIX, DEEPER[0])
    for now, then in zip(DEEPER, DEEPER[1:]):
        further = hot(heads.filter(F.col("depth") == now).groupBy(F.substring("word", 1, now).alias("hot")).agg(F.sum("rows").alias("rows")), now)
        if not further:
            break
        heads, plain = marked(heads, further, now, then), marked(plain, further, now, then)
    return plain, heads


def _shares(hot: DataFrame) -> DataFrame:
    """(word, shares) for the bytes that words of hot prefixes are dealt by: how training goes on, bit by bit, among all that share what is before.

    hot: heads (word, n, depth). Level by level they are counted where all that share the level's prefix are together.
    """
    most, above, out = hot.agg(F.max("depth")).first()[0], None, None
    for low, high in zip((PREFIX, *DEEPER), DEEPER):
        if most < high:
            break
        heads = hot.filter(F.col("depth") >= high).groupBy(F.substring("word", 1, high).alias("word")).agg(F.sum("n").alias("n"), F.max("depth").alias("depth"))
        dealt = heads.repartition(F.substring("word", 1, low)).sortWithinPartitions("word")
        own = dealt.mapInArrow(_level_shares(low, high), _ddl(pa.schema([*_SHARES, ("depth", pa.int32())])))
        if above is not None:
            old = above.select(F.col("word").alias("start"), F.col("shares").alias("old"))
            own = own.join(old, F.substring("word", 1, low) == F.col("start")).select("word", "shares", "old", "depth")
            own = own.mapInArrow(_added_shares, _ddl(pa.schema([*_SHARES, ("depth", pa.int32())])))
        above = materialise(own, "lm-shares")
        done = above.filter(F.col("depth") == high).select("word", "shares")
        out = done if out is None else out.unionByName(done)
    # words are dealt by bytes without the blank behind them
    bare = F.when(F.substring("word", -1, 1) == F.lit(b" "), F.substring(F.col("word"), F.lit(1), F.octet_length("word") - 1)).otherwise(F.col("word"))
    return out.select(bare.alias("word"), "shares")


def _packed(shares: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(shares.astype("<f4").tobytes())


def _told(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<f4").reshape(INNER, 8, 2)


def _added_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, shares, old, depth) with the shares of two levels, which tell different bytes, in one."""
    for b in batches:
        both = [_packed(_told(x) + _told(y)) for x, y in zip(b.column("shares").to_pylist(), b.column("old").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(both, pa.binary()), b.column("depth")], names=["word", "shares", "depth"])


def _level_shares(low: int, high: int):
    """The function that makes the heads of one level, sorted and whole by their first `low` bytes, into rows (word, shares, depth)."""
    schema = pa.schema([*_SHARES, ("depth", pa.int32())])

    def rows(table: pa.Table) -> pa.RecordBatch:
        heads, n = table.column("word").to_pylist(), table.column("n").to_numpy()
        counts = np.zeros((len(heads), SIDES))
        counts[:, 0] = n
        words = Words(heads, counts, np.ones(len(heads)), np.full(len(heads), low), True)
        out = np.zeros((len(heads), INNER, 8, 2), np.float32)
        for p, active, node, _, steps in words.levels():
            if p >= low:
                for b, s in enumerate(steps):
                    out[active, p - PREFIX, b, 0], out[active, p - PREFIX, b, 1] = s.zeros[node], s.ones[node]
        return pa.RecordBatch.from_arrays([table.column("word").combine_chunks(), pa.array([_packed(x) for x in out], pa.binary()), table.column("depth").cast(pa.int32()).combine_chunks()], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = [w[:low] for w in b.column("word").to_pylist()]
            cut = next((i for i in range(len(keys) - 1, -1, -1) if keys[i] != keys[-1]), -1) + 1
            if held and (cut or held[-1].column("word")[-1].as_py()[:low] != keys[0]):
                yield rows(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            elif cut:
                yield rows(pa.Table.from_batches([b.slice(0, cut)]))
            held.append(b.slice(cut))
        if held:
            yield rows(pa.Table.from_batches(held))

    return run


def vocabulary(parts: DataFrame, rows: int) -> DataFrame:
    """Each word once, in order: depth, counts by side, sides, and the parts and numbers under which it stands; the first word of those
    that are dealt by more than PREFIX bytes has the shares of these."""
    words, hot = _dealt(parts.filter("word is not null").select("word", *[f"n{c}" for c in range(SIDES)], "sides", "part", "number"), rows)
    words = words.withColumn("shares", F.lit(None).cast("binary"))
    if hot is not None:
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in words.schema.fields if f.name not in ("word", "depth", "shares")]
        words = words.unionByName(_shares(hot).select("word", F.lit(DEEPER[-1]).alias("depth"), "shares", *none))
    dealt = words.repartition(F.expr("substring(word, 1, depth)")).sortWithinPartitions("word")

    def fold(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        """Complete words of the table as rows, and what may go on in the next batch."""
        word = table.column("word").combine_chunks()
        first = _firsts(word)
        n = len(first) - (not last)
        if n <= 0:
            return None, table
        end = len(table) if last else int(first[-1])
        at, done = first[:n], table.slice(0, end)
        sums = [np.add.reduceat(done.column(f"n{c}").to_numpy(), at) for c in range(SIDES)]
        met = np.bitwise_or.reduceat(done.column("sides").to_numpy(), at)
        offsets = pa.array(np.append(at, end).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, done.column(c).combine_chunks()) for c in ("part", "number")]
        depth, own = done.column("depth").to_numpy()[at], word.take(pa.array(at))
        told = [waiting.pop(w[:k], None) if k > PREFIX and waiting else None for w, k in zip(own.to_pylist(), depth.tolist())]
        return pa.RecordBatch.from_arrays([own, pa.array(depth), *map(pa.array, sums), pa.array(met), *lists, pa.array(told, pa.binary())], schema=_VOCABULARY), table.slice(end)

    # shares whose words come next: they stand before these, or beside the one word that is all they are dealt by, which is held until more is read
    waiting: dict[bytes, bytes] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for b in batches:
            heads = b.column("part").is_null()
            for w, own in zip(*(b.column(c).filter(heads) for c in ("word", "shares"))):
                waiting[w.as_py()] = own.as_py()
            table = pa.Table.from_batches([b.filter(pc.invert(heads))])
            left = table if left is None else pa.concat_tables([left, table])
            if len(left) >= 8192:
                done, left = fold(left.combine_chunks(), False)
                if done is not None:
                    yield done
        if left is not None and len(left):
            yield fold(left.combine_chunks(), True)[0]

    # one row group a file: a task reads whole groups, in order
    return materialise(dealt.mapInArrow(run, _ddl(_VOCABULARY)), "lm-vocabulary", "zstd", **{"parquet.block.size": str(1 << 30)})


def _groups(batches: Iterator[pa.RecordBatch], coded: bool = False) -> Iterator[tuple[Words, pa.Table]]:
    """The vocabulary in runs of about WORDS_AT_ONCE words that never part what is dealt together; coded: with the blanks after words."""
    held: list[pa.RecordBatch] = []
    n, key, last = 0, None, b""

    def done() -> tuple[Words, pa.Table]:
        table = pa.Table.from_batches(held)
        counts = np.stack([table.column(f"n{c}").to_numpy() for c in range(SIDES)], axis=1)
        own, depth = table.column("word").to_pylist(), table.column("depth").to_numpy()
        shares = None
        if not coded:
            packed = table.column("shares").combine_chunks()
            told = packed.is_valid().to_numpy(zero_copy_only=False)
            if told.any():
                # a word has the shares of the nearest first word before it
                row = np.where(depth > PREFIX, np.cumsum(told) - 1, -1)
                shares = row, np.stack([_told(x) for x in packed.drop_null().to_pylist()])
        return Words(own, counts, table.column("sides").to_numpy(), depth, coded, shares), table

    for b in batches:
        if not b.num_rows:
            continue
        words, depth = b.column("word"), b.column("depth")
        begin = 0
        if n and words[0].as_py() < last:  # another file
            yield done()
            held, n = [], 0
        while begin < b.num_rows:
            end = b.num_rows
            if n >= WORDS_AT_ONCE:
                end = next((i for i in range(begin, b.num_rows) if words[i].as_py()[:depth[i].as_py()] != key), b.num_rows)
            if end > begin:
                held.append(b.slice(begin, end - begin))
                n += end - begin
                last = words[end - 1].as_py()
                key = last[:depth[end - 1].as_py()]
            if end < b.num_rows:
                yield done()
                held, n = [], 0
            begin = end
    if held:
        yield done()


_KNOWN = " + ".join(f"n{c}" for c in range(SIDES)) + " > 0"


def _known(vocabulary: DataFrame) -> DataFrame:
    """Words of training texts, with what stood before them there."""
    seen = sum((F.when(F.col(f"n{c}") > 0, 1 << c).otherwise(0) for c in range(SIDES)), F.lit(0))
    return vocabulary.filter(f"{_KNOWN} or shares is not null").select("word", "depth", *[f"n{c}" for c in range(SIDES)], seen.cast("int").alias("sides"), "shares")


def _tables(known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hashed tables over all training words. A task's own travel as packed pieces, which are added up one by one."""
    pieces = ORDERS * (1 << TABLE_BITS) // SLOTS_AT_ONCE
    schema = pa.schema([("piece", pa.int32()), ("sums", pa.binary())])

    def packed(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for piece, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(own.tobytes())], pa.binary())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, ORDERS, 1 << TABLE_BITS))
        for words, _ in _groups(batches):
            count_contexts(words, sums[0], sums[1])
        by_piece = sums.reshape(2, pieces, -1)
        yield from packed({i: by_piece[:, i].astype("<f8") for i in range(pieces) if by_piece[:, i].any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, own in zip(b.column(0).to_pylist(), b.column(1)):
                one = np.frombuffer(zstandard.ZstdDecompressor().decompress(own.as_py()), "<f8").reshape(2, -1)
                sums[piece] = sums[piece] + one if piece in sums else one
        yield from packed(sums)

    out = np.zeros((2, pieces, SLOTS_AT_ONCE), np.float32)
    summed = known.mapInArrow(count, _ddl(schema)).repartition(pieces, "piece").mapInArrow(add, _ddl(schema))
    # a fixed bound: 16 bytes for each of ORDERS x 2^TABLE_BITS slots, a piece at a time
    for row in summed.toLocalIterator():
        out[:, row["piece"]] += np.frombuffer(zstandard.ZstdDecompressor().decompress(row["sums"]), "<f8").reshape(2, -1)
    return tuple(out.reshape(2, ORDERS, -1))


def train(vocabulary: DataFrame) -> tuple[Mixer, Tables]:
    """The model from the vocabulary. Every task learns online; weights are averaged by their curvature."""
    spark, known = vocabulary.sparkSession, _known(vocabulary)
    zeros, ones = _tables(known)
    release(spark)
    shared = spark.sparkContext.broadcast(Tables(zeros, ones, True))
    schema = pa.schema([("i", pa.int32()), ("x", pa.float64())])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Mixer()
        start = own.hits.copy(), own.seen.copy()
        for words, _ in _groups(batches):
            own.learn(shared.value, words)
        yield from learnt_by(own, start)

    def learnt_by(own: Mixer, start: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        own.curve -= Mixer().curve
        x = np.concatenate([own.curve.ravel(), (own.curve @ own.weights[:, :, None]).ravel(), (own.hits - start[0]).ravel(), (own.seen - start[1]).ravel()])
        used = np.flatnonzero(x)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(x[used])], schema=schema)

    def learn_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Mixer()
        start = own.hits.copy(), own.seen.copy()
        for words, _ in _groups(batches, True):
            own.learn(shared.value, words, True)
        yield from learnt_by(own, start)

    # the first PREFIX bytes of words, each string once: few, as they grow with the alphabets in use only, so that one task can walk them
    head = F.when(F.col("word") == F.lit(END), F.col("word")).otherwise(F.expr(f"substring(concat(word, cast(' ' as binary)), 1, {PREFIX})"))
    sums = [F.sum(f"n{c}").alias(f"n{c}") for c in range(SIDES)]
    heads = known.filter(_KNOWN).groupBy(head.alias("word")).agg(F.lit(PREFIX).alias("depth"), *sums, F.bit_or("sides").alias("sides"))
    heads = heads.select(*[c for c in known.columns if c != "shares"]).repartition(1).sortWithinPartitions("word").mapInArrow(learn_heads, _ddl(schema))
    # GATES x PREDICTORS x (PREDICTORS + 1) + 2 x 256 x BUCKETS rows at most
    learnt = known.mapInArrow(learn, _ddl(schema)).union(heads).groupBy("i").agg(F.sum("x").alias("x")).collect()
    shared.unpersist()
    mixer = Mixer()
    sums = np.zeros(GATES * PREDICTORS * (PREDICTORS + 1) + 512 * BUCKETS)
    for i, x in learnt:
        sums[i] = x
    curve, pull, hits, seen = np.split(sums, np.cumsum([GATES * PREDICTORS ** 2, GATES * PREDICTORS, 256 * BUCKETS]))
    # tasks count by what they have seen, the starting weights by CAUTION
    whole = curve.reshape(GATES, PREDICTORS, PREDICTORS) + mixer.curve
    pulled = pull.reshape(GATES, PREDICTORS, 1) + mixer.curve @ mixer.weights[:, :, None]
    mixer.weights = np.linalg.solve(whole, pulled)[:, :, 0]
    mixer.hits += hits.reshape(256, -1)
    mixer.seen += seen.reshape(256, -1)
    return mixer, Tables(zeros, ones, False)


def score_words(vocabulary: DataFrame, model: tuple[Mixer, Tables]) -> DataFrame:
    """(part, words): packed numbers, counts, marks and scores (log10 probabilities, as 4-byte floats) of words for their parts."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("part", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, tables = shared.value
        for words, table in _groups(batches):
            score = mixer.score(tables, words).astype("<f4")
            count = words.counts.sum(axis=1).astype(np.int64)
            own = table.column("word").to_pylist()
            marks = _marks(own, np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in own), np.uint64, len(own)))
            marks = (marks | words.sides << 3).astype(np.uint8)
            lists = table.column("parts").combine_chunks()
            at = np.repeat(np.arange(len(own)), pc.list_value_length(lists).to_numpy())
            part, number = lists.flatten().to_numpy(), table.column("numbers").combine_chunks().flatten().to_numpy()
            order = np.lexsort((number, part))
            rows = np.split(order, np.flatnonzero(np.diff(part[order])) + 1)
            packed = [_squeeze(number[r], count[at[r]], marks[at[r]], score[at[r]]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(part[[r[0] for r in rows]]), pa.array(packed, pa.binary())], schema=schema)

    return vocabulary.select("word", "depth", *[f"n{c}" for c in range(SIDES)], "sides", "parts", "numbers", "shares").mapInArrow(run, _ddl(schema))


def _planes(column: np.ndarray) -> bytes:
    return np.ascontiguousarray(column).view(np.uint8).reshape(len(column), -1).T.tobytes()


def _squeeze(number: np.ndarray, count: np.ndarray, marks: np.ndarray, score: np.ndarray) -> bytes:
    """Columns of words, compressed; of the scores those for the sides that a word has been met with."""
    met = (marks[:, None] >> 3 >> np.arange(SIDES)) & 1 > 0
    raw = len(number).to_bytes(8, "little") + _planes(np.diff(number, prepend=0).astype("<u4")) + _planes(count.astype("<u8")) + marks.tobytes() + _planes(score[met])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unsqueeze(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n, raw = int.from_bytes(raw[:8], "little"), np.frombuffer(raw, np.uint8, offset=8)

    def column(start: int, rows: int, kind: str, width: int) -> np.ndarray:
        return np.ascontiguousarray(raw[start:start + width * rows].reshape(width, rows).T).view(kind).ravel()

    number, count, marks = column(0, n, "<u4", 4), column(4 * n, n, "<u8", 8), raw[12 * n:13 * n]
    met = (marks[:, None] >> 3 >> np.arange(SIDES)) & 1 > 0
    score = np.zeros((n, SIDES), np.float32)
    score[met] = column(13 * n, int(met.sum()), "<f4", 4)
    return np.cumsum(number.astype(np.int64)), count.astype(np.int64), marks, score


_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64()),
])


def score_texts(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, held_out, text): counts, base score, the model's log10 probability and bits per byte."""
    spark = docs.sparkSession
    parts = materialise(to_parts(docs.select("doc_id", "held_out", "text")), "lm-parts", "zstd")
    every = sum((F.col(f"n{c}") for c in range(SIDES)), F.lit(0))
    rows, total, n_phrases = parts.agg(F.count("word"), F.coalesce(F.sum(every), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    words = vocabulary(parts, rows)
    release(spark)
    distinct = words.filter(_KNOWN).count()
    # dealt by phrase once: the counts and what they are joined back to share that exchange
    seen = parts.filter("phrase is not null").select("part", "number", "phrase", "n", "met").repartition("phrase")
    counted = seen.groupBy("phrase").agg(F.sum("n").alias("c"), F.sum("met").alias("met")).filter("c >= 1 and met >= 2").select("phrase", "c")
    of_phrases = seen.select("part", "number", "phrase").join(counted, "phrase").select("part", F.lit(None).cast("binary").alias("words"), "number", "c")
    of_words = score_words(words, train(words)).select("part", "words", F.lit(None).cast("int").alias("number"), F.lit(None).cast("long").alias("c"))
    release(spark)
    known = of_words.union(of_phrases).withColumnRenamed("part", "own")
    texts = parts.filter("seq is not null").select("part", "doc_id", "held_out", "n_tokens", "n_bytes", "seq", "phrases")

    def add_up(docs: pa.Table, known: pa.Table) -> pa.Table:
        return _add_up(docs, known, total, distinct, n_phrases)

    scored_texts = texts.groupBy("part").cogroup(known.groupBy("own")).applyInArrow(add_up, _ddl(_RESULT))
    return scored_texts.withColumn("train_tokens", F.lit(int(total)).cast("long"))


def _add_up(docs: pa.Table, known: pa.Table, total: int, distinct: int, n_phrases: int) -> pa.Table:
    """Rows of the result for the documents of a part, from what is known of its words and phrases."""
    number, c, marks, score = (np.concatenate(x) for x in zip(*(_unsqueeze(x.as_py()) for x in known.column("words") if x.is_valid)))
    order = np.argsort(number)
    c, marks, score = c[order], marks[order], score[order].astype(np.float64)
    ends, side, cuts = marks & 1 > 0, marks & 3, marks & 4 > 0
    base = np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
    copied = known.filter(known.column("number").is_valid())
    known_numbers = copied.column("number").to_numpy()
    times = np.zeros(int(known_numbers.max(initial=-1)) + 2, np.int64)  # the last stands for all others
    times[known_numbers] = copied.column("c").to_numpy()
    n_known, base_score, last, by_words, counts = [], [], [], [], []
    for seq, own, held in zip(docs.column("seq"), docs.column("phrases"), docs.column("held_out")):
        ids, numbers = _unpack(seq.as_py()), np.cumsum(_unpack(own.as_py()).astype(np.int32), dtype=np.int64)
        count = times[np.minimum(numbers, len(times) - 1)]
        if not held.as_py() and len(numbers):  # a training text's own occurrences are left out
            _, place, again = np.unique(numbers, return_inverse=True, return_counts=True)
            count = np.maximum(count - again[place], 0)
        n_known.append(int((c[ids] > 0).sum()))
        base_score.append(float(base[ids].sum()))
        scores = score[ids, sides(ids, side)]
        last.append(float(scores[-1]))
        starts = phrase_starts(ids[:-1], ends, cuts)
        by_words.append(np.add.reduceat(scores[:-1], starts) if len(starts) else np.zeros(0))
        counts.append(count)
    model = np.array(last) + copy_scores(by_words, counts, n_phrases)
    bits = -model * math.log2(10) / np.maximum(docs.column("n_bytes").to_numpy(), 1)
    return pa.table([docs.column("doc_id"), docs.column("held_out"), docs.column("n_tokens"), pa.array(n_known, pa.int64()), pa.array(base_score, pa.float64()), pa.array(model), pa.array(bits)], schema=_RESULT)


#: Contexts of the bit "this phrase is a copy": all before; the run of like ones (up to 7, by kind); the last four.
_RUNS, _LAST = 16, 16
COPY_CONTEXTS = 1 + _RUNS + _LAST
COPY_RATE, COPY_FADE = 0.02, 0.95


def copy_scores(by_words: list[np.ndarray], counts: list[np.ndarray], total: int) -> np.ndarray:
    """log10 probability of each text's phrases: by words or as a copy of one of the total phrases of training.

    by_words, counts: for each text, its phrases' log10 probabilities by words and how often training has them elsewhere.
    The weight of copying is one bit predictor more: counts in three contexts along the text, mixed by gated weights that
    learn online. Texts advance together, phrase by phrase; each has a state of its own.
    """
    sizes = np.fromiter(map(len, by_words), np.int64, len(by_words))
    order = np.argsort(-sizes, kind="stable")
    out, n = np.zeros(len(sizes)), len(sizes)
    prior = math.log(AGAIN / (1 - AGAIN))
    hits, seen = np.full((n, COPY_CONTEXTS), 0.5 * AGAIN), np.full((n, COPY_CONTEXTS), 0.5)
    weights = np.full((n, 4, 3), 0.4)
    run, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[order]
    words, count = (np.concatenate(x) if x else np.zeros(0) for x in (by_words, counts))
    falling, alive = -sizes[order], n
    for t in range(int(sizes.max(initial=0))):
        alive = int(np.searchsorted(falling[:alive], -t))  # texts with more than t phrases
        rows = np.arange(alive)
        at = starts[:alive] + t
        bit = (count[at] > 0).astype(np.float64)
        where = np.stack([np.zeros(alive, np.int64), 1 + run[:alive], 1 + _RUNS + last[:alive]], axis=1)
        h, s = hits[rows[:, None], where], seen[rows[:, None], where]
        odds = np.clip(np.log(h / (s - h)), -REACH, REACH)
        gate = np.full(alive, min(t.bit_length(), 3))
        w = weights[rows, gate]
        mixed = prior * (1 - w.sum(axis=1)) + (w * odds).sum(axis=1)
        chance = np.clip(_squash(mixed), 0.002, 0.998)
        weights[rows, gate] = w + COPY_RATE * (bit - chance)[:, None] * (odds - prior)
        hits[rows[:, None], where] = COPY_FADE * h + bit[:, None] + (1 - COPY_FADE) * 0.5 * AGAIN
        seen[rows[:, None], where] = COPY_FADE * s + 1 + (1 - COPY_FADE) * 0.5
        kind = run[:alive] >= 8
        run[:alive] = np.where(bit == kind, np.minimum(run[:alive] % 8 + 1, 7), 0) + 8 * bit.astype(np.int64)
        last[:alive] = (last[:alive] << 1 | bit.astype(np.int64)) & (_LAST - 1)
        copy = np.where(bit > 0, np.log(np.maximum(count[at], 1) * chance / max(total, 1)), -np.inf)
        out[order[:alive]] += np.logaddexp(words[at] * math.log(10) + np.log(1 - chance), copy) / math.log(10)
    return out


def op1_lm_score(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_texts(docs.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
