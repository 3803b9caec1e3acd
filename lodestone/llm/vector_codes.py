"""Product codes of vectors, each part's nearest codebook entry being found by a vantage-point tree.

Vectors become integers, floor(256 x), and are cut into PARTS equal consecutive parts. A part position's codebook starts as that
part of the ENTRIES vectors with the smallest vec_ids; each of ROUNDS rounds gives every part to its nearest entry (squared Euclidean
distance, ties to the lower index) and moves each entry to its parts' componentwise floor(sum / count), unused entries staying.

A task builds one tree per part position over the codebook's entries: a node holds a vantage entry and, for its inner and outer half,
the least and greatest distance from it, rounded outwards to whole numbers. A batch of parts walks the tree together: each part goes to
the half that its own distance points to first, and to the other unless the triangle inequality, on distances rounded against
pruning, puts all of it strictly farther than the best so far. Equal distances are thus always seen, and every comparison that
decides is one of integers. Tasks send sums per entry, so a round moves PARTS x ENTRIES rows a task, and the driver holds one codebook.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; shorter vectors, those of no
components too, count as padded with zeros, and lengths that PARTS does not divide as padded to the next that it does; null vec_ids come last in the order that
starts the codebook, and rows of equal vec_ids are ordered by vector; fewer rows than ENTRIES make a smaller codebook; repeated
rows count as often as they occur; an empty table has an empty codebook and result; `encode` keeps all columns of its input, and names
the columns that it adds as asked (a clash raises an error); distances are exact while sums of squares fit 62 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, small_or_split

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: A node of at most so many entries is not divided.
LEAF = 6


def matrix(lists: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold vectors that take part, and those vectors as integers, padded to dims."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(lists.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = lists.is_valid().to_numpy(zero_copy_only=False).copy()
    finite = np.isfinite(flat)
    kept[row[~finite]] = False
    out = np.zeros((len(sizes), dims), np.int64)
    out[row[finite], column[finite]] = np.floor(SCALE * flat[finite]).astype(np.int64)
    return kept, out[kept]


def roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers below and above the square roots: exact ones where the root is whole."""
    low = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    low -= low * low > squares
    low += (low + 1) * (low + 1) <= squares
    return low, low + (low * low < squares)


class VantageTree:
    """Nearest entries of one codebook by branch and bound."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.top = self._node(np.arange(len(entries)))
        self.seen = 0  # distances computed

    def _squares(self, points: np.ndarray, entry: int) -> np.ndarray:
        gap = points - self.entries[entry]
        return np.einsum("ij,ij->i", gap, gap)

    def _node(self, ids: np.ndarray):
        if len(ids) <= LEAF:
            return ids
        # the entry farthest from the others' middle sees them at the most different distances
        own = self.entries[ids]
        far = int(np.argmax(((own * len(ids) - own.sum(0)).astype(np.float64) ** 2).sum(1)))
        vantage, rest = int(ids[far]), np.delete(ids, far)
        squares = self._squares(self.entries[rest], vantage)
        order = np.argsort(squares, kind="stable")
        rest, squares = rest[order], squares[order]
        half = len(rest) // 2
        low, high = roots(squares)
        children = [(low[part].min(), high[part].max(), self._node(rest[part])) for part in (slice(0, half), slice(half, None))]
        return vantage, squares[half], children

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point the index of its nearest entry, the lower of equal ones, and the squared distance."""
        best = np.full(len(points), np.iinfo(np.int64).max)
        index = np.full(len(points), len(self.entries))

        def offer(rows: np.ndarray, entry: int, squares: np.ndarray) -> None:
            better = (squares < best[rows]) | ((squares == best[rows]) & (entry < index[rows]))
            best[rows[better]], index[rows[better]] = squares[better], entry

        def visit(node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if isinstance(node, np.ndarray):
                for entry in node:
                    offer(rows, entry, self._squares(points[rows], entry))
                self.seen += len(rows) * len(node)
                return
            vantage, border, children = node
            squares = self._squares(points[rows], vantage)
            self.seen += len(rows)
            offer(rows, vantage, squares)
            low, high = roots(squares)
            bounds = [np.maximum(np.maximum(low - outer, inner - high), 0) ** 2 for inner, outer, _ in children]
            inside = squares < border
            for own in (0, 1):  # the half that a point's distance points to, then the other
                for child, group in ((own, inside), (1 - own, ~inside)):
                    visit(children[child][2], rows[group & (bounds[child] <= best[rows])])

        visit(self.top, np.arange(len(points)))
        return index, best


def _parts(vectors: np.ndarray) -> np.ndarray:
    return vectors.reshape(len(vectors), PARTS, vectors.shape[1] // PARTS)


def _taking_part(embeddings: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embeddings.filter(F.col("embedding").isNotNull()).filter(finite)


def first_codebooks(embeddings: DataFrame, entries: int = ENTRIES) -> np.ndarray:
    """PARTS x entries x width: the parts of the rows with the smallest vec_ids."""
    kept = _taking_part(embeddings)
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 1
    rows = [r[0] for r in kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()]  # as many as a codebook has
    _, vectors = matrix(pa.array(rows, pa.list_(pa.float64())), -(-longest // PARTS) * PARTS)
    return _parts(vectors).transpose(1, 0, 2).copy()


def _sums(books: np.ndarray):
    parts, entries, width = books.shape
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), *((f"s{k}", pa.int64()) for k in range(width))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [VantageTree(book) for book in books]
        count, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for b in batches:
            _, vectors = matrix(b.column("embedding"), parts * width)
            cut = _parts(vectors)
            for p, tree in enumerate(trees):
                index, _ = tree.nearest(cut[:, p])
                np.add.at(count[p], index, 1)
                np.add.at(total[p], index, cut[:, p])
        part, entry = np.nonzero(count)
        columns = [part.astype(np.int32), entry.astype(np.int32), count[part, entry], *total[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run, ", ".join(["part int", "entry int", "n long", *(f"s{k} long" for k in range(width))])


def train(embeddings: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after the rounds: PARTS x entries x width integers."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    books = first_codebooks(embeddings, entries)
    if not books.size:
        return books
    for _ in range(rounds):
        run, schema = _sums(books)
        width = books.shape[2]
        summed = embeddings.select("embedding").mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(width)))
        for r in summed.collect():  # PARTS x entries rows
            books[r["part"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return books


def encode(embeddings: DataFrame, books: np.ndarray, code: str = "code", error: str = "error") -> DataFrame:
    """The rows that take part with their code and its squared distance, summed over parts."""
    taken = {c.lower() for c in embeddings.columns} & {code.lower(), error.lower()}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are there already: name the new ones otherwise")
    schema = T.StructType([*embeddings.schema.fields, T.StructField(code, T.StringType()), T.StructField(error, T.LongType())])
    if not books.size:
        return embeddings.sparkSession.createDataFrame([], schema)
    at = embeddings.columns.index("embedding")
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [VantageTree(book) for book in books]
        for b in batches:
            kept, vectors = matrix(b.column(at), parts * width)
            cut = _parts(vectors)
            found = [tree.nearest(cut[:, p]) for p, tree in enumerate(trees)]
            codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            rest = b.filter(pa.array(kept))
            columns = [*rest.columns, pa.array([row.tobytes().hex() for row in codes], pa.string()), pa.array(sum(square for _, square in found), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, code, error])

    return embeddings.mapInArrow(run, schema)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def op12_vector_codes(spark, sf_dir) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    books = train(embeddings)
    coded = materialise(encode(embeddings, books).drop("embedding"), "codes")
    labels = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    return small_or_split(coded, labels, "label").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _assign(k: int) -> str:
    """SQL: each part's nearest entry of codebook k, and the codebook that follows."""
    return f"""
near{k} AS (
  SELECT rid, p, least % 64 AS e, least // 64 AS d
  FROM (
    SELECT rid, p, min(d * 64 + e) AS least
    FROM (SELECT c.rid, c.p, b.e, CAST(sum((c.x - b.x) * (c.x - b.x)) AS BIGINT) AS d FROM cells c JOIN book{k} b ON c.p = b.p AND c.k = b.k GROUP BY c.rid, c.p, b.e)
    GROUP BY rid, p)
), book{k + 1} AS (
  SELECT b.p, b.e, b.k, coalesce(m.x, b.x) AS x
  FROM book{k} b LEFT JOIN (
    SELECT p, e, k, CAST((s - ((s % n) + n) % n) / n AS BIGINT) AS x
    FROM (SELECT c.p, a.e, c.k, CAST(sum(c.x) AS BIGINT) AS s, count(*) AS n FROM cells c JOIN near{k} a ON c.rid = a.rid AND c.p = a.p GROUP BY c.p, a.e, c.k)
  ) m ON b.p = m.p AND b.e = m.e AND b.k = m.k
)"""


OP12_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rid, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS (
  SELECT rid, (i - 1) // (len(v) // 16) AS p, (i - 1) % (len(v) // 16) AS k, v[i] AS x FROM kept, unnest(generate_series(1, len(v))) AS s(i)
), book0 AS (SELECT p, rid AS e, k, x FROM cells WHERE rid < 64
),{_assign(0)},{_assign(1)},{_assign(2)},
codes AS (SELECT rid, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY rid),
labels AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM kept JOIN codes USING (rid) GROUP BY label)
SELECT k.vec_id, c.code, c.error, l.label_error, (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, k)) FROM book2) AS codebooks_sha256
FROM kept k JOIN codes c USING (rid) JOIN labels l ON k.label IS NOT DISTINCT FROM l.label
"""
