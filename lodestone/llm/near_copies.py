"""SimHash near copies by five-word shingles at an exact Jaccard similarity of 0.8 or more: fingerprints find and filter candidates, texts decide.

A text is its words (ASCII case and white space folded); equal texts are one node, so groups of copies do not multiply. A node has a SimHash
of BITS bits over its distinct shingles, whose first 64 are its fingerprint. Nodes whose fingerprints are equal or, by the anchors of
simhash.py, differ by three bits or fewer become candidates. At a similarity of 0.8 fingerprints differ by about 10 of 64 bits, which no
anchors cover, so nodes also meet by MinHash bands: BANDS of WIDTH values, of which all but 1 in 14,000 such pairs share one. Where they
meet, the Hamming distance of their SimHashes says which become candidates, and a candidate is linked only if the shingle sets of its two texts
say so.

Candidates come in rounds, so that large groups make no square of pairs: first all pairs of small groups, and in large ones
each member with the group's hub, the one nearest to its commonest bits. Further rounds take a hub among those that are not in the
group's largest component yet. After HUB_ROUNDS of them, or one that links nothing, large groups that still hold different components
get the shingle sets of their members and decide all pairs of different components where they meet, each in the first band that it shares; only
a forest of links leaves them, never the pairs that were looked at. What the last round adds is thus never capped.
Pairs are decided by sets of 64-bit shingle hashes.

Defined cases: null, empty and wordless texts are copies of each other; fewer than five words make one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..policy import POLICY
from .common import materialise

BANDS, WIDTH = 24, 5
VALUES = BANDS * WIDTH
#: Bits of a SimHash, and how many of them near copies may differ in. At a similarity of 0.8 a bit differs by a chance of 0.151, in the
#: smallest sets (four shingles of five) 0.188; this is five standard deviations above that.
BITS, FAR = 1024, 256
#: Groups of at most so many members give all their pairs at once.
SMALL = 8
#: Rounds in which each large group has one hub.
HUB_ROUNDS = 3
#: Shingles, or members of a group, that are worked on at once: bounds memory.
CHUNK = 1 << 11

_draw = np.random.default_rng(20)
MIX = _draw.integers(0, 1 << 64, (VALUES, 1), np.uint64)
ODD = _draw.integers(0, 1 << 64, (VALUES, 1), np.uint64) | np.uint64(1)
WIDE = _draw.integers(0, 1 << 64, BITS // 64, np.uint64)
WIDE[0] = 0


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, k: int = POLICY.shingle_words) -> set[bytes]:
    ws = words(text)
    return {b" ".join(ws[i:i + k]) for i in range(max(len(ws) - k + 1, 1))} if ws else set()


def jaccard(a: str | None, b: str | None) -> float:
    x, y = shingles(a), shingles(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 1.0


def _hashes(found: set[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in found), np.uint64, len(found))


def minhash(hashes: np.ndarray) -> np.ndarray:
    """The VALUES MinHash values of the shingles' hashes, of which there are some."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), CHUNK):
        np.minimum(least, ((hashes[i:i + CHUNK] ^ MIX) * ODD).min(axis=1), out=least)
    return least


def wide_simhash(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of BITS bits as 64-bit words: the majority of the hashes' own bits, and of theirs mixed anew for each further word."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), CHUNK):
        x = hashes[i:i + CHUNK, None] ^ WIDE
        mixed = x[:, 1:]
        mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x[:, 1:] = mixed ^ mixed >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)


def signed(column: str = "text"):
    """digest of the words and, of a text that has some, bands, sketch (its SimHash) and fp (the first 64 bits) of a text column."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for t in texts:
                t = t.as_py()
                ws = words(t)
                bands, sketch, fp = [], b"", None
                if ws:
                    hashes = _hashes(shingles(t))
                    bits = wide_simhash(hashes)
                    sketch, fp = bits.tobytes(), int(bits.view(np.int64)[0])
                    bands = [xxhash.xxh64_intdigest(v.tobytes(), b) - (1 << 63) for b, v in enumerate(minhash(hashes).reshape(BANDS, WIDTH))]
                out.append({"digest": blake2b(b" ".join(ws), digest_size=16).digest(), "bands": bands, "sketch": sketch, "fp": fp})
            yield pa.array(out, pa.struct([("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary()), ("fp", pa.int64())]))

    return F.arrow_udf(run, "digest binary, bands array<long>, sketch binary, fp long")(F.col(column))


def _apart(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Hamming distances."""
    return np.bitwise_count(sketches ^ one).sum(axis=-1, dtype=np.int64)


def _hub(sketches: np.ndarray, labels: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The hub of a large group, with the members of other labels that may be near it."""
    names, place, sizes = np.unique(labels, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return
    # at first every member has a label of its own, later the largest component is done
    left = np.flatnonzero(place != sizes.argmax()) if sizes.max() > 1 else np.arange(len(labels))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(left), CHUNK):
        ones += np.unpackbits(sketches[left[i:i + CHUNK]].view(np.uint8), axis=1).sum(axis=0, dtype=np.uint16)
    hub = left[_apart(sketches[left], np.packbits(ones * 2 > len(left)).view(np.uint64)).argmin()]
    yield hub, np.flatnonzero((labels != labels[hub]) & (_apart(sketches, sketches[hub]) <= FAR))


def _near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingle hashes are at the similarity or more."""
    if min(len(a), len(b)) < POLICY.similarity_threshold * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= POLICY.similarity_threshold * (len(a) + len(b) - both)


def _linked(band: int, sketches: np.ndarray, labels: np.ndarray, bands: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """A forest of links between members of a large group that have different labels; a pair is decided in the first band that it shares."""
    labels = labels.copy()
    for i in range(len(labels) - 1):
        other = i + 1 + np.flatnonzero(labels[i + 1:] != labels[i])
        other = other[_apart(sketches[other], sketches[i]) <= FAR]
        other = other[bands[i][(bands[other] == bands[i]).argmax(axis=1)] == band]
        for j in other:
            if labels[j] != labels[i] and _near(sets[i], sets[j]):
                labels[labels == labels[j]] = labels[i]
                yield i, j


def _by_band(rows: DataFrame, columns: list[str], found) -> DataFrame:
    """Pairs (a, b), a < b, that found gives for the whole bands of a few rows (band, node, ...) at a time, dealt by band."""
    dealt = rows.select("band", "node", *columns).repartition("band").sortWithinPartitions("band", "node")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        keys, nodes = table.column(0).to_numpy(), table.column(1).to_numpy()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        x, y = found(keys, nodes, first, np.diff(np.append(first, len(keys))), table)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last band, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut or (held and held[-1].column(0)[-1].as_py() != keys[0]):
                yield whole([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield whole(held)

    return dealt.mapInArrow(run, "a long, b long")


def _sketches(table: pa.Table, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), np.uint64).reshape(-1, BITS // 64)


def candidates(crowd: DataFrame, step: str) -> DataFrame:
    """Pairs (a, b), a < b, of rows (band, node, sketch, label) that share a band: those of the "first" round, or of a further "hub"."""

    def found(keys, nodes, first, sizes, table):
        sketches, labels = _sketches(table, "sketch"), table.column("label").to_numpy()
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if step == "first":
            ends = np.repeat(first + sizes, sizes)
            at = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
            for lag in range(1, SMALL):
                at = at[at + lag < ends[at]]
                near = at[_apart(sketches[at], sketches[at + lag]) <= FAR]
                a.append(nodes[near])
                b.append(nodes[near + lag])
        for i in np.flatnonzero(sizes > SMALL):
            part = slice(first[i], first[i] + sizes[i])
            for one, others in _hub(sketches[part], labels[part]):
                a.append(np.full(len(others), nodes[part][one]))
                b.append(nodes[part][others])
        return np.concatenate(a), np.concatenate(b)

    return _by_band(crowd, ["sketch", "label"], found).distinct()


def decided(crowd: DataFrame) -> DataFrame:
    """Links (a, b), a < b, of rows (band, node, sketch, label, bands, s) of large groups: between each two labels that near copies join, a path of links."""

    def found(keys, nodes, first, sizes, table):
        sketches, labels = _sketches(table, "sketch"), table.column("label").to_numpy()
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        sets = [x.values.to_numpy() for x in table.column("s")]
        pairs = [np.empty((0, 2), np.int64)]
        for i, n in zip(first, sizes):
            part = slice(i, i + n)
            pairs += [np.array([(i + x, i + y)]) for x, y in _linked(keys[i], sketches[part], labels[part], bands[part], sets[part])]
        x, y = np.concatenate(pairs).T
        return nodes[x], nodes[y]

    return _by_band(crowd, ["sketch", "label", "bands", "s"], found).distinct()


def hashed_shingles(column: str = "text"):
    """Hashes of a text's shingles, each once."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([[xxhash.xxh64_intdigest(s, 7) - (1 << 63) for s in shingles(t.as_py())] for t in texts], pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<long>")(F.col(column))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets of shingles, by (node, s), are at the similarity or more."""
    left = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    near = both >= POLICY.similarity_threshold * (F.size("sa") + F.size("sb") - both)
    return pairs.join(left, "a").join(right, "b").filter(near).select("a", "b")


def links(nodes: DataFrame, texts: DataFrame, close: DataFrame, components) -> DataFrame:
    """Pairs (a, b) that connect all near copies among nodes (node, bands, sketch); texts gives (node, text), close pairs (a, b) by their fingerprints."""
    dealt = nodes.select(F.explode("bands").alias("band"), "node")
    met = dealt.withColumn("n", F.count("*").over(Window.partitionBy("band"))).filter("n > 1")
    crowd = materialise(met.join(nodes.select("node", "sketch"), "node"), "crowd")
    tried = materialise(candidates(crowd.withColumn("label", F.col("node")), "first").union(close.select("a", "b")).distinct(), "candidates")
    # shingles of those that meet anyone at all
    meeting = crowd.select("node").union(close.select(F.explode(F.array("a", "b")))).distinct()
    sets = materialise(texts.join(meeting, "node", "left_semi").select("node", hashed_shingles().alias("s")), "shingles")
    large = crowd.filter(F.col("n") > SMALL)
    found = materialise(verified(tried, sets), "links")
    if large.isEmpty():
        return found

    def labelled() -> DataFrame:
        return large.join(components(found), "node", "left").select("band", "node", "sketch", F.coalesce("label", "node").alias("label"))

    for _ in range(HUB_ROUNDS - 1):
        fresh = materialise(candidates(labelled(), "hub").join(tried, ["a", "b"], "left_anti"), "candidates")
        more = materialise(verified(fresh, sets), "links")
        tried = tried.unionAll(fresh)
        if more.isEmpty():
            break
        found = found.unionAll(more)
    rows = materialise(labelled(), "labelled")
    split = rows.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("band")
    last = rows.join(split, "band", "left_semi").join(nodes.select("node", "bands"), "node").join(sets, "node")
    return found.unionAll(materialise(decided(last), "links"))
