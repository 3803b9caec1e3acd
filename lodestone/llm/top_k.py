"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors become integers, floor(256 x). They are dealt evenly into blocks of about BLOCK vectors; a block is one row of the index table,
written once: its vectors and, for each dimension, postings in descending order of quantised impact (LEVELS levels).
The index is never shuffled again: queries go to it, at most about QUERIES_AT_ONCE broadcast at a time, and each task
takes the blocks that it reads one after another.

For a query and a block, posting segments are taken in descending order of their contribution,
round by round. After a round, unseen contributions are below the round's threshold, which bounds every candidate from above;
rescoring the leaders exactly gives the k-th best score from below, and so does the k-th best of the blocks that the task has done.
Only what that proves out is dropped; the walk stops when at most ENOUGH times k candidates are left or all segments are read, and the
rest are rescored exactly. The best k of all blocks are ranked at the end.

Defined cases: null vectors, and those with a null or non-finite component, take no part, nor do rows with a null vec_id; shorter
vectors count as padded with zeros; a query does not meet rows with its own vec_id; repeated rows are all candidates, and
repeated query rows with equal vectors count once; scores are exact while they and their sums fit 63 bits; columns other than vec_id and
embedding are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

K = 5
SCALE = 256
BLOCK, QUERIES_AT_ONCE = 8192, 16_384
LEVELS = 256
EVERY = 50
#: Thresholds of the rounds as shares of the largest contribution.
ROUNDS = (0.4, 0.2, 0.1, 0.05, 0.02, 0.0)
#: The walk stops once at most so many times k candidates may still be members.
ENOUGH = 4
#: Whole numbers that doubles hold exactly.
EXACT = float(1 << 53)


def whole_numbers(embeddings: DataFrame) -> DataFrame:
    """Rows (vec_id, v) that take part, v being integers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))).alias("v"))


def _matrix(lists, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        out[i, :len(x)] = x
    return out


def postings(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each dimension, the vectors by descending level of impact, and those levels."""
    low = int(vectors.min())
    level = (vectors - low) // _step(vectors)
    order = np.argsort(-level, axis=0, kind="stable").T
    return order.astype("<u2"), np.take_along_axis(level.T, order, axis=1).astype(np.uint8)


def _step(vectors: np.ndarray) -> int:
    return max(1, -(-(int(vectors.max()) - int(vectors.min()) + 1) // LEVELS))


class ImpactIndex:
    """Postings of one block: for each dimension, vectors by descending quantised impact."""

    def __init__(self, vectors: np.ndarray, order: np.ndarray | None = None, level: np.ndarray | None = None):
        if order is None:
            order, level = postings(vectors)
        self.vectors, self.vectors_as_doubles = vectors, vectors.astype(np.float64)
        n, self.width = vectors.shape
        self.low, self.step = int(vectors.min()), _step(vectors)
        self.order = order.astype(np.int64)  # width x n
        # the least value of each posting's level, as doubles
        self.floors = self.low + level * float(self.step)
        self.most = float(max(abs(self.low), abs(int(vectors.max())))) + self.step
        self.read = 0
        # upto[d, l]: postings of dimension d at level l or more
        counts = np.zeros((self.width, LEVELS + 1), np.int64)
        for d in range(self.width):
            counts[d, :LEVELS] = np.bincount(level[d], minlength=LEVELS)
        self.upto = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]

    def search(self, q: np.ndarray, banned: np.ndarray, ids: np.ndarray, k: int, least: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (row, score) of the block that reach the score least: higher scores first, then smaller ids."""
        n = len(self.vectors)
        up = q > 0
        used = np.flatnonzero(q)
        top = self.low + (LEVELS - 1) * self.step + self.step - 1
        largest = float(np.max(np.where(up[used], q[used] * top, q[used] * self.low), initial=0))
        sums, seen = np.zeros(n), np.zeros(n)
        # one sum holds contributions and, below UNIT, how many there were, where doubles hold both exactly
        unit = 1 << self.width.bit_length()
        reach = float(np.abs(q).sum()) * self.most
        packed = (reach + 1) * unit < EXACT
        exact = self.vectors_as_doubles if reach < EXACT else self.vectors
        done = np.zeros(self.width, np.int64)  # postings read: from the top where q > 0, else from the bottom
        alive = np.flatnonzero(~banned)
        for share in (*ROUNDS, None):
            if len(alive) <= ENOUGH * k or not len(used):
                break
            if share is None:
                upto = np.full(self.width, n, np.int64)
                bound = None
            else:
                bound = largest * share
                edge = np.where(up, np.ceil((bound / np.where(q == 0, 1, q) - self.low - self.step + 1) / self.step), np.floor((bound / np.where(q == 0, 1, q) - self.low) / self.step))
                edge = np.clip(edge, -1, LEVELS).astype(np.int64)
                rows = np.arange(self.width)
                upto = np.where(up, self.upto[rows, np.clip(edge, 0, LEVELS)], n - self.upto[rows, np.clip(edge + 1, 0, LEVELS)])
                upto = np.maximum(upto, done)
            taken = np.maximum(upto - done, 0)
            taken[q == 0] = 0
            total = int(taken.sum())
            self.read += total
            at, gains, end = np.empty(total, np.int64), np.empty(total), 0
            for d in np.flatnonzero(taken):
                a, b = done[d], upto[d]
                s = slice(a, b) if up[d] else slice(n - b, n - a)
                begin, end = end, end + b - a
                at[begin:end] = self.order[d, s]
                np.multiply(self.floors[d, s], float(q[d]), out=gains[begin:end])
                if up[d] and self.step > 1:
                    gains[begin:end] += float(q[d] * (self.step - 1))
            done = upto
            if packed:
                gains *= unit
                gains += 1
                sums += np.bincount(at, gains, n)
                seen = np.mod(sums, unit)
                acc = (sums - seen) / unit
            else:
                sums += np.bincount(at, gains, n)
                seen += np.bincount(at, minlength=n)
                acc = sums
            leaders = alive[np.argpartition(-acc[alive], min(4 * k, len(alive) - 1))[:4 * k]]
            floor = max(least, np.sort(exact[leaders] @ q)[-k] if len(leaders) >= k else -np.inf)
            ceiling = acc[alive] + (0 if bound is None else (len(used) - seen[alive]) * bound)
            alive = alive[ceiling >= floor - (0 if packed else reach * 1e-9)]  # beyond what doubles hold exactly, sums are rounded
        scores = exact[alive] @ q
        best = np.lexsort((ids[alive], -scores))[:k]
        return [(int(alive[i]), int(scores[i])) for i in best]


def build_index(rows: DataFrame, width: int, blocks: int) -> DataFrame:
    """The index table from (vec_id, v), materialised: a row per block of ids, vectors and postings, each as bytes."""
    dealt = rows.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy().astype(np.int64)
        vectors = _matrix(table.column("v").to_pylist(), width)
        order, level = postings(vectors)
        return pa.table({"ids": [ids.tobytes()], "vectors": [vectors.tobytes()], "postings": [order.tobytes()], "levels": [level.tobytes()]})

    # one row group a block, so that each can be a task's
    return materialise(dealt.groupBy("block").applyInArrow(pack, "ids binary, vectors binary, postings binary, levels binary"), "impact-index", **{"parquet.block.size": str(1 << 20)})


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row of queries, both (vec_id, embedding)."""
    spark = embeddings.sparkSession
    rows = materialise(whole_numbers(embeddings), "vectors")
    asked = materialise(whole_numbers(queries).distinct().withColumn("number", F.monotonically_increasing_id()), "queries")
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(width or 0, 1)
    index = build_index(rows, width, max(1, -(-n // BLOCK)))
    packs = max(1, -(-asked.count() // QUERIES_AT_ONCE))
    schema = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    found = None
    for pack in range(packs):
        # about QUERIES_AT_ONCE rows of width numbers: a bounded broadcast, whatever the number of queries
        own = asked.filter(F.pmod("number", F.lit(packs)) == pack).select("vec_id", "number", "v").collect()
        held = spark.sparkContext.broadcast((np.array([r[0] for r in own], np.int64), np.array([r[1] for r in own], np.int64), _matrix([r[2] for r in own], width)))
        part = materialise(index.mapInArrow(_searcher(held, width, k, schema), "query_id long, query long, vec_id long, score long"), "found")
        held.destroy()
        found = part if found is None else found.unionAll(part)
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _searcher(held, width: int, k: int, schema: pa.Schema):
    """The function that takes the queries held to the blocks of a task, one block after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, numbers, queries = held.value
        best = np.full((len(queries), k), -np.inf)  # the best scores so far, ascending
        for batch in batches:
            for i in range(batch.num_rows):
                ids, vectors, order, level = (batch.column(c)[i].as_py() for c in range(4))
                ids = np.frombuffer(ids, np.int64)
                vectors = np.frombuffer(vectors, np.int64).reshape(-1, width)
                block = ImpactIndex(vectors, np.frombuffer(order, "<u2").reshape(width, -1), np.frombuffer(level, np.uint8).reshape(width, -1))
                found = []
                for j, q in enumerate(queries):
                    some = block.search(q, ids == query_ids[j], ids, k, best[j, 0])
                    if some:
                        best[j] = np.sort(np.concatenate([best[j], [s for _, s in some]]))[-k:]
                        found += [(query_ids[j], numbers[j], ids[r], s) for r, s in some]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 4, schema=schema)

    return run


def op2_top_k(spark, sf_dir) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


OP2_SQL = """
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM kept q JOIN kept c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 5
"""
