"""Benchmark decontamination by a generalised suffix automaton.

Normalised items (A-Z lowered; words are runs of digits, a-z and non-ASCII bytes) are put in one suffix automaton over
word numbers. Each document is streamed through it once, keeping the length of the longest match that ends at each
word: where that is at least WINDOW words, all matched words are hit, and the automaton's state tells which
items hold the last WINDOW of them. An item shorter than WINDOW is hit only as a whole.

An automaton is broadcast, so its size is bounded: items, equal ones taken together, long ones in overlapping pieces of PIECE_WORDS words that keep every window
whole, are dealt by hash into shards of about SHARD_WORDS words at most. Executors build a shard's automaton and write it as
one row; with several shards the documents are scanned once for each, one automaton being broadcast and released after the
other, and what the scans find is merged by row.

Defined cases: null and wordless texts have no words and no hits; null and wordless items match nothing;
repeated item_ids count once; a null item_id is not listed but its windows hit; an empty benchmark hits
nothing; a text of any length is read in time linear in its length; `remove` returns all columns of its input, whatever
their names, and `annotate` replaces a column that is named like the one it adds.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise

WINDOW = 10
#: About the most words of one broadcast automaton, and of a piece of an item in it.
SHARD_WORDS, PIECE_WORDS = 100_000, 2_000
#: A document is dropped if more than this share of its words is hit; otherwise only the hit spans go.
MAX_COVERAGE = 0.3

_WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
_FOLD = bytes(x if x in _WORD_BYTES else 0x20 for x in bytes(range(256)).lower())

RESULT = "n_words long, n_hit long, items array<long>, spans array<struct<start:long,stop:long>>, clean string"
_RESULT_PA = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("clean", pa.string()),
])


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of items, each a list of words."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: list[list[int]] = []  # what the numbers of items stand for, where they do not stand for themselves
        self.number: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = [(item, [self.number.setdefault(w, len(self.number)) for w in ws]) for item, ws in items if ws]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.shortest = min([window, *(len(c) for _, c in coded)])
        self._label(coded)

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int) -> int:
        """The state for the longest word sequence of p followed by c, cloned off if q stands for longer ones too."""
        q = self.step[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.step[last]:
            return self._split(last, c)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p != -1 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p != -1:
            self.link[new] = self._split(p, c)
        return new

    def _label(self, coded) -> None:
        """holders: for each state, the items with the window that ends a match there; wholes: short items by length."""
        n, w = len(self.length), self.window
        own: list[set] = [set() for _ in range(n)]
        shorts: list[list] = [[] for _ in range(n)]
        for item, codes in coded:
            at = 0
            for i, c in enumerate(codes, 1):
                at = self.step[at][c]
                if i >= w:
                    own[at].add(item)
            if len(codes) < w:
                shorts[at].append((len(codes), item))
        for v in sorted(range(1, n), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0 and self.length[self.link[v]] >= w:
                own[self.link[v]] |= own[v]
        self.holders: list[frozenset] = [frozenset()] * n
        self.wholes: list[tuple] = [()] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[v]
            # the state whose sequences include the last w words of a match at v
            self.holders[v] = self.holders[up] if up > 0 and self.length[up] >= w else frozenset(own[v])
            self.wholes[v] = self.wholes[up] + tuple(sorted(shorts[v]))

    def match(self, words: list[bytes]) -> tuple[set, list[list[int]]]:
        """Items with an occurring window, and the hit words as disjoint ascending spans [start, stop)."""
        number, step, link, length, w = self.number.get, self.step, self.link, self.length, self.window
        codes = list(map(number, words))
        items: set = set()
        spans: list[list[int]] = []
        n, i, least = len(codes), 0, self.shortest

        def hit(start: int, stop: int) -> None:
            while spans and spans[-1][1] >= start:
                start = min(start, spans[-1][0])
                stop = max(stop, spans.pop()[1])
            spans.append([start, stop])

        while i + least <= n:
            if codes[i + least - 1] is None:  # no match of the least length covers this word
                i += least
                continue
            back = i + least - 1
            while back >= i and codes[back] is not None:
                back -= 1
            if back >= i:
                i = back + 1
                continue
            v = matched = 0
            while i < n and (c := codes[i]) is not None:
                while v and c not in step[v]:
                    v = link[v]
                    matched = length[v]
                if c in step[v]:
                    v = step[v][c]
                    matched += 1
                if matched >= w:
                    hit(i - matched + 1, i + 1)
                    items |= self.holders[v]
                if self.wholes[v]:
                    for size, item in self.wholes[v]:
                        if size <= matched:
                            hit(i - size + 1, i + 1)
                            items.add(item)
                i += 1
        return items, spans


def _items(benchmark: DataFrame, window: int) -> DataFrame:
    """Rows (item_id, words, n) of items, words being joined by blanks; a long item is several that overlap by a window less one word."""
    size = max(PIECE_WORDS, 2 * window)
    schema = pa.schema([("item_id", pa.int64()), ("words", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column("item_id").to_pylist(), b.column("item").to_pylist()):
                ws = words_of(text)
                rows += [(item, b" ".join(ws[i:i + size]), len(ws[i:i + size])) for i in range(0, max(len(ws) - window + 1, 1), size - window + 1) if ws]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item")).filter("item is not null")
    return texts.mapInArrow(run, "item_id long, words binary, n long")


def automata(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (shard, automaton): the pickled automaton of each shard of the items, built by a task of its own. Equal items are one, with all of their ids."""
    ids = F.array_sort(F.collect_set("item_id")).alias("ids")  # of equal texts, in a benchmark
    items = materialise(_items(benchmark, window).groupBy("words").agg(F.max("n").alias("n"), ids), "items")
    shards = 1 + 2 * int(items.agg(F.sum("n")).first()[0] or 0) // SHARD_WORDS

    def build(table: pa.Table) -> pa.Table:
        own = sorted(zip(table.column("words").to_pylist(), table.column("ids").to_pylist()))
        built = SuffixAutomaton([(k, ws.split(b" ")) for k, (ws, _) in enumerate(own)], window)
        built.ids = [ids for _, ids in own]
        return pa.table({"shard": table.column("shard").slice(0, 1), "automaton": pa.array([pickle.dumps(built)], pa.binary())})

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("words"), F.lit(shards)).cast("int"))
    return materialise(dealt.groupBy("shard").applyInArrow(build, "shard int, automaton binary"), "automata")


def _scan(shared, clean: bool):
    """The function that one automaton's pass applies to batches of texts."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = pickle.loads(shared.value)
        for texts in batches:
            rows = []
            for text in texts.to_pylist():
                ws = words_of(text)
                found, spans = automaton.match(ws)
                rows.append(_row(text, len(ws), {x for k in found for x in automaton.ids[k]}, spans, clean))
            yield pa.array(rows, _RESULT_PA)

    return run


def _row(text: str | None, n: int, items: set, spans: list[list[int]], clean: bool) -> dict:
    return {
        "n_words": n, "n_hit": sum(b - a for a, b in spans),
        "items": sorted(x for x in items if x is not None), "spans": [{"start": a, "stop": b} for a, b in spans],
        "clean": without_spans(text, spans) if clean and spans else None,
    }


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, column: str = "leak", clean: bool = False) -> DataFrame:
    """docs plus a struct column of n_words, n_hit, items (ids found) and spans (hit words, [start, stop)).

    clean: also the text without the spans, where there are any.
    """
    spark = docs.sparkSession
    built = automata(benchmark, window)
    shards = sorted(r[0] for r in built.select("shard").collect())  # as many numbers as passes

    def shared(k: int | None):
        # one automaton, of about SHARD_WORDS words at most
        return spark.sparkContext.broadcast(pickle.dumps(SuffixAutomaton([], window)) if k is None else bytes(built.filter(F.col("shard") == k).first()["automaton"]))

    if len(shards) <= 1:
        # as nondeterministic the scan is not repeated for a filter on what it finds
        scan = F.arrow_udf(_scan(shared(shards[0] if shards else None), clean), RESULT).asNondeterministic()
        return docs.withColumn(column, scan("text"))
    (row, found) = fresh(docs.columns + [column], "row", "found")
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    parts = None
    for k in shards:
        own = shared(k)
        hits = rows.select(row, F.arrow_udf(_scan(own, False), RESULT)("text").alias("hit")).filter("hit.n_hit > 0").select(row, "hit.items", "hit.spans")
        hits = materialise(hits, "hits")
        own.destroy()
        parts = hits if parts is None else parts.unionAll(hits)
    # as many lists in a row as passes have hit it
    merged = parts.groupBy(row).agg(F.struct(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans")).alias(found))

    def finish(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, hits in batches:
            out = []
            for text, hit in zip(texts.to_pylist(), hits.to_pylist()):
                spans = _merged([[s["start"], s["stop"]] for s in hit["spans"]]) if hit else []
                out.append(_row(text, len(words_of(text)), set(hit["items"]) if hit else set(), spans, clean))
            yield pa.array(out, _RESULT_PA)

    joined = rows.join(merged, row, "left")
    return joined.withColumn(column, F.arrow_udf(finish, RESULT)("text", found)).select(*[c for c in docs.columns if c != column], column)


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def without_spans(text: str, spans: list[list[int]]) -> str:
    """The text without the bytes from the first to the last word of each span."""
    raw = text.encode("utf-8", "surrogatepass")
    folded, at, k, cut, last = raw.translate(_FOLD), 0, 0, [], 0
    for first, end in spans:
        start = stop = 0
        while k < end:
            while folded[at] == 0x20:
                at += 1
            begin, at = at, folded.find(b" ", at)
            if at < 0:
                at = len(folded)
            if k == first:
                start = begin
            k, stop = k + 1, at
        cut.append(raw[last:start])
        last = stop
    return b"".join([*cut, raw[last:]]).decode("utf-8", "surrogatepass")


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """docs without hit spans; a document of which more than max_coverage is hit goes as a whole."""
    (leak,) = fresh(docs.columns, "leak")
    found = annotate(docs, benchmark, window, leak, clean=True).filter(F.col(f"{leak}.n_hit") <= F.col(f"{leak}.n_words") * F.lit(max_coverage))
    text = F.col(f"{leak}.clean")
    new = {"text": F.coalesce(text, F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.char_length(text).cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return found.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def op4_decontaminate(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = annotate(docs, benchmark)
    ids = F.array_join(F.array_sort(F.transform("leak.items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", F.col("leak.n_words").alias("n_words"), F.col("leak.n_hit").alias("n_hit"), F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("leak.n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark WHERE text IS NOT NULL)
), windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(ws[p : p + least(len(ws), 10) - 1], ' ') AS gram
  FROM item_words, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS s(p) WHERE len(ws) > 0
), doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents
), sizes AS (SELECT DISTINCT size FROM windows
), grams AS (
  SELECT doc_id, p, size, array_to_string(ws[p : p + size - 1], ' ') AS gram
  FROM doc_words, sizes, unnest(generate_series(1, len(ws) - size + 1)) AS s(p)
), found AS (
  SELECT g.doc_id, g.p, g.size, w.item_id FROM grams g JOIN windows w ON g.size = w.size AND g.gram = w.gram
), hits AS (
  SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM found, unnest(generate_series(0, size - 1)) AS s(k) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.listed, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hits h USING (doc_id) LEFT JOIN ids i USING (doc_id)
"""
