"""Minimax contiguous sharding.

Atomic groups (equal texts) are ordered by a hash of their text. The smallest capacity for which a greedy walk
needs at most n shards is found by binary search, and the order is cut there. The driver sees only sums over
hash ranges: 2^16 ranges at first; ranges in which a cut may fall are split further until no cut touches
a range of several groups, so the capacity is exact for the atomic groups without listing them. Where one group
is so large that the capacity leaves slack, the cuts are moved towards equal sizes within it.

Defined cases: null and empty texts have size 1 and form one group; repeated rows each take a slot; texts
whose hashes collide share a group; null and repeated doc_ids spread like any others; an empty table gives an empty result;
columns named like those that are added are replaced, all others are returned unchanged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise

SHARDS = 8
TOP_BITS, STEP_BITS = 16, 8
#: Ranges in which rows of a shard are numbered; each is one task's window at most.
SLOT_RANGES = 1024


def text_bytes(column: str = "text"):
    return (F.coalesce(F.octet_length(F.col(column)), F.lit(0)) + 1).cast("long")


class Ranges:
    """Ordered hash ranges with sums; atomic ones hold a single group."""

    def __init__(self, rows):
        rows = sorted(rows)
        self.low = [r[0] for r in rows]
        self.shift = [r[1] for r in rows]
        self.size = np.array([r[2] for r in rows], dtype=np.int64)
        self.atomic = np.array([r[3] == 1 for r in rows], dtype=bool)
        self.ends = np.concatenate([[0], np.cumsum(self.size)])

    def walk(self, capacity: int, n: int, split: bool) -> list[int]:
        """Ends of the n shards of a greedy walk. split: a shard may end anywhere in a range of several groups."""
        at, out, total = 0, [], int(self.ends[-1])
        for _ in range(n):
            reach = min(at + capacity, total)
            i = int(np.searchsorted(self.ends, reach, side="right")) - 1
            at = reach if split and i < len(self.size) and not self.atomic[i] else max(int(self.ends[i]), at)
            out.append(at)
        return out

    def least(self, low: int, high: int, n: int, split: bool) -> int:
        total = int(self.ends[-1])
        while low < high:
            middle = (low + high) // 2
            if self.walk(middle, n, split)[-1] >= total:
                high = middle
            else:
                low = middle + 1
        return low

    def open_ranges(self, low: int, high: int, n: int) -> list[int]:
        """Ranges of several groups that a cut for any capacity in low..high may touch."""
        found = set()
        for a, b in zip(self.walk(low, n, False), self.walk(high, n, True)):
            i = max(0, int(np.searchsorted(self.ends, a, side="right")) - 1)
            j = int(np.searchsorted(self.ends, b, side="left"))
            found.update(k for k in range(i, min(j + 1, len(self.size))) if not self.atomic[k])
        return sorted(found)

    def level(self, capacity: int, n: int) -> list[int]:
        """Indexes of the ranges at which shards 1..n-1 begin: near equal sizes, none above the capacity."""
        total, latest = int(self.ends[-1]), [int(self.ends[-1])]
        for _ in range(n):  # from the end: where the last k shards may begin at the earliest
            latest.append(int(self.ends[np.searchsorted(self.ends, latest[-1] - capacity, side="left")]) if latest[-1] > capacity else 0)
        begin, at = [], 0
        for k in range(1, n):
            most = int(self.ends[np.searchsorted(self.ends, min(at + capacity, total), side="right") - 1])
            wish = at + (total - at) / (n - k + 1)
            i = int(np.searchsorted(self.ends, wish))
            if i > 0 and (i == len(self.ends) or abs(self.ends[i - 1] - wish) <= abs(self.ends[i] - wish)):
                i -= 1
            at = min(max(int(self.ends[i]), latest[n - k], at), most)
            begin.append(int(np.searchsorted(self.ends, at)))
        return begin


def summarise(groups: DataFrame, shift: int, within: DataFrame | None = None) -> list[tuple]:
    """(lowest hash, shift, size, groups, largest group) of each range of hashes that agree above shift bits."""
    prefix = F.shiftright("h", shift)
    out = groups.groupBy(prefix.alias("p")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("size").alias("most"))
    return [(int(r["p"]) << shift, shift, int(r["size"]), int(r["n"]), int(r["most"])) for r in out.collect()]


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """(first hashes of shards 1.., capacity) for groups (h, size) in order of h. Driver memory: the ranges' sums."""
    rows = summarise(groups, 64 - TOP_BITS)
    if not rows:
        return [], 0
    largest = max(r[4] for r in rows)
    while True:
        ranges = Ranges(rows)
        total = int(ranges.ends[-1])
        least = max(largest, -(-total // shards))
        high = ranges.least(max(least, int(ranges.size.max())), total, shards, False)
        low = ranges.least(least, high, shards, True)
        touched = [] if low == high else ranges.open_ranges(low, high, shards)
        if not touched:
            break
        split = {(ranges.low[i], ranges.shift[i]) for i in touched}
        rows = [r for r in rows if (r[0], r[1]) not in split]
        for shift in sorted({s for _, s in split}):
            prefixes = [low_hash >> shift for low_hash, s in split if s == shift]
            rows += summarise(groups.filter(F.shiftright("h", shift).isin(prefixes)), max(0, shift - STEP_BITS))
    low_hashes = [*ranges.low, None]
    return [low_hashes[i] for i in ranges.level(high, shards)], high


def shard(docs: DataFrame, shards: int = SHARDS, keep: list[str] | None = None, with_hash: bool = True) -> DataFrame:
    """docs (or the columns to keep, doc_id among them) plus size, text_hash, text_crc32, shard and slot (its place in the shard, from 0), which replace columns of these names.
    Without with_hash no text_hash is added, and one that docs has stays.

    Rows are numbered within hash ranges of a shard. They are dealt to the ranges by a row number of the table that is written
    first, so equal rows spread over all ranges like any others.
    """
    wanted = ("size", "text_hash", "text_crc32", "shard", "slot")
    size, text_hash, crc, number, slot = fresh(docs.columns, *wanted)
    row, slot_range, start, place = fresh([*docs.columns, size, text_hash, crc, number, slot], "row", "slot_range", "start", "place")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({size: text_bytes(), text_hash: F.xxhash64(text), crc: F.crc32(text.cast("binary")), row: F.monotonically_increasing_id()})
    kept = [c for c in docs.columns if keep is None or c in keep]
    keyed = materialise(keyed.select(*kept, size, text_hash, crc, row), "shard-rows")
    groups = materialise(keyed.groupBy(F.col(text_hash).alias("h")).agg(F.sum(size).alias("size")), "shard-groups")
    cuts, _ = minimax_cuts(groups, shards)
    at = F.lit(0)
    for c in cuts:
        at = at + (F.lit(0) if c is None else (F.col(text_hash) >= F.lit(c)).cast("int"))
    placed = keyed.withColumns({number: at.cast("int"), slot_range: F.pmod(F.xxhash64(row), F.lit(SLOT_RANGES)).cast("int")})
    counts = placed.groupBy(number, slot_range).agg(F.count("*").alias("rows"))
    before = Window.partitionBy(number).orderBy(slot_range).rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(counts.select(number, slot_range, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(start)), "shard-starts")
    own = Window.partitionBy(number, slot_range).orderBy("doc_id", crc, text_hash, row)
    ranked = placed.withColumn(place, F.row_number().over(own) - 1)
    # at most shards * SLOT_RANGES rows
    numbered = ranked.join(F.broadcast(starts), [number, slot_range]).withColumn(slot, (F.col(start) + F.col(place)).cast("long"))
    added = {w: n for w, n in zip(wanted, (size, text_hash, crc, number, slot)) if with_hash or w != "text_hash"}
    return numbered.select(*[c for c in kept if c.lower() not in added], *[F.col(n).alias(w) for w, n in added.items()])


def op10_shard(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs, keep=["doc_id"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
