"""SimHash near-duplicates by anchor-point covering.

A text's fingerprint takes the majority of the XXH64 (seed 42) bits of its word shingles. Two fingerprints at
MAX_BITS = 3 or fewer differing bits differ by at most 1 bit in one of their halves. In each half the anchors are the
codewords of the perfect Hamming code on 31 bits, whose covering radius is 1: each fingerprint is replicated to every
anchor within radius + 1 = 2 bits (16 at most), so any two linked fingerprints meet at an anchor of one half,
where they are compared. Replication is at most 32 rows of two longs for a distinct fingerprint, whatever the input.

Equal fingerprints are one row throughout, so groups of copies do not multiply. At an anchor only a spanning forest
of its links is emitted, which keeps all connections and never all pairs.

Defined cases: null, empty and wordless texts have fingerprint zero and link like any other; fewer words than the shingle
length make one shingle; a null doc_id is never a component's id unless all its ids are null;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import near_copies
from .common import materialise

SHINGLE, MAX_BITS, SEED = 3, 3, 42
#: Shingles whose bits are unpacked at once: bounds memory on very long texts.
CHUNK = 1 << 15
#: Anchors with at most so many fingerprints are compared by shifts of the sorted rows.
SMALL = 8


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    n = len(words) - k + 1
    hashes = np.fromiter((digest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[k - 1:])), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        part = hashes[i:i + CHUNK]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(column: str = "text", shingle: int = SHINGLE):
    """The fingerprint of a text column as a signed long."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64))

    return F.arrow_udf(run, T.LongType())(F.col(column))


def _flips() -> list[list[int]]:
    """By syndrome of a 31-bit word: what to flip to reach each codeword within 2 bits."""
    table = [[0]]
    for s in range(1, 32):
        pairs = [(i, i ^ s) for i in range(1, 32) if i < i ^ s]
        table.append([1 << (s - 1), *((1 << (i - 1)) | (1 << (j - 1)) for i, j in pairs)])
    return table


def anchors(fp: str = "fp"):
    """All anchors of a fingerprint: the half in bit 31, the codeword below."""
    flips = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in _flips()])

    def of(half: int):
        word = F.shiftrightunsigned(F.col(fp), 32 * half).bitwiseAND(F.lit(0x7FFFFFFF))
        syndrome = F.lit(0)
        for b in range(5):
            mask = sum(1 << (p - 1) for p in range(1, 32) if p >> b & 1)
            syndrome = syndrome + F.bit_count(word.bitwiseAND(F.lit(mask).cast("long"))).bitwiseAND(F.lit(1)) * (1 << b)
        return F.transform(F.element_at(flips, syndrome + 1), lambda m: word.bitwiseXOR(m).bitwiseOR(F.lit(half << 31).cast("long")))

    return F.concat(of(0), of(1))


def _bits(x: np.ndarray) -> np.ndarray:
    """Ones among the 64 bits; of signed numbers numpy would count those of the absolute value."""
    return np.bitwise_count(x.view(np.uint64))


def _forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints; memory in proportion to their number."""
    out, left = [], fps
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = _bits(left ^ at) <= bits
            if near.any():
                found = left[near]
                out += [(at, x) for x in found]
                front += list(found)
                left = left[~near]
    return out


def links(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Rows (a, b), a < b, that connect all of the distinct fingerprints fp at bits or fewer differing bits."""
    if not 0 <= bits <= 3:
        raise ValueError("one of two halves differs in at most one bit only up to 3 bits")
    dealt = distinct.select(F.explode(anchors()).alias("anchor"), "fp").repartition("anchor").sortWithinPartitions("anchor", "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def edges(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(first, len(keys)))
        ends = np.repeat(first + sizes, sizes)
        small = np.repeat(sizes <= SMALL, sizes)
        at, a, b = np.flatnonzero(small), [], []
        for lag in range(1, SMALL):
            at = at[at + lag < ends[at]]
            near = at[_bits(fps[at] ^ fps[at + lag]) <= bits]
            a.append(fps[near])
            b.append(fps[near + lag])
        for i in np.flatnonzero(sizes > SMALL):
            if pairs := _forest(fps[first[i]:first[i] + sizes[i]], bits):
                x, y = np.array(pairs, np.int64).T
                a.append(np.minimum(x, y))
                b.append(np.maximum(x, y))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the last anchor, which may go on
        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut or (held and held[-1][0][-1] != keys[0]):
                done = [*held, (keys[:cut], fps[:cut])]
                yield edges(np.concatenate([k for k, _ in done]), np.concatenate([f for _, f in done]))
                held = []
            held.append((keys[cut:], fps[cut:]))
        if held:
            yield edges(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, label) for each node of pairs (a, b): the smallest node that can be reached.

    Each round takes the least label among neighbours and then the label of that label, so distances shrink
    geometrically; rounds are written to the shared folder.
    """
    both = materialise(pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))), "pairs")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        moved = materialise(lower.join(jump, "via").select("node", "old", F.least("via", "far").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.filter("label < old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """Rows (doc_id, fp, component_id), one per row of docs (doc_id, text)."""
    marked = materialise(docs.select("doc_id", fingerprints(shingle=shingle).alias("fp")), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labels = components(links(distinct, bits)).withColumnRenamed("node", "fp")
    rooted = distinct.join(labels, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    rooted = materialise(rooted, "roots")
    least = rooted.groupBy("label").agg(F.min("first").alias("component_id"))
    named = materialise(rooted.join(least, "label").select("fp", "component_id"), "members")
    return marked.join(named, "fp")


def close(nodes: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b), a < b, of nodes (node, fp): each with the first of its fingerprint, and the first ones of fingerprints that links joins."""
    known = nodes.filter("fp is not null")
    first = materialise(known.groupBy("fp").agg(F.min("node").alias("first")), "distinct")
    same = known.join(first, "fp").filter("node > first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    ends = links(first.select("fp"), bits)
    for end in ("a", "b"):
        ends = ends.join(first.select(F.col("fp").alias(end), F.col("first").alias(f"node_{end}")), end)
    near = ends.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    return materialise(same.unionByName(near), "close")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of near copies: that with the smallest doc_id, a null one last.

    Rows are told apart by a key of their own, as a doc_id may be null or repeated; rows of one doc_id go by their text's digest.
    """
    key = F.monotonically_increasing_id()
    rows = materialise(docs.select(F.struct("*").alias("doc"), key.alias("row"), near_copies.signed().alias("sig")), "rows")
    order = F.struct(F.col("doc.doc_id").isNull().alias("unnumbered"), F.col("doc.doc_id").alias("doc_id"), F.col("sig.digest").alias("digest"), "row")
    told = rows.select(F.col("sig.digest").alias("digest"), "row", order.alias("order"), "sig")
    parts = [F.any_value(f"sig.{c}").alias(c) for c in ("bands", "sketch", "fp")]
    nodes = materialise(told.groupBy("digest").agg(F.min("order").alias("first"), *parts).withColumn("node", key), "nodes")
    # sort-merge joins at any size: the rows grow with the input
    texts = rows.select("row", F.col("doc.text").alias("text")).hint("merge").join(nodes.select(F.col("first.row").alias("row"), "node"), "row").select("node", "text")
    labels = components(near_copies.links(nodes.select("node", "bands", "sketch"), texts, close(nodes.select("node", "fp")), components))
    rooted = nodes.select("node", "first").join(labels, "node", "left").groupBy(F.coalesce("label", "node")).agg(F.min("first").alias("first"))
    kept = materialise(rooted.select(F.col("first.row").alias("row")), "kept")
    return rows.hint("merge").join(kept, "row", "left_semi").select("doc.*")


def op8_simhash(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
