"""Spelling variants grouped by forward and reversed sorted dictionaries.

Words that differ by one inserted, deleted or replaced code point leave a half of the shorter one intact: its first floor(m / 2) code
points at the start of both, or its last m - floor(m / 2) at their end, m being its length. So each word stands in a forward dictionary,
sorted by first half, and in a reversed one, sorted by last half read backwards; in either once as the shorter (or equal) and once as the longer
word. A block is a run of entries that share m and the half; ranges of whole blocks go to tasks, which scan them in order.

A block of more than HOT words is first subdivided: the code points not yet known to be equal are halved again, and a word goes to the
block of a longer common start and to that of a longer common end, until no block is larger or one code point is left open (then the
alphabet bounds it). Inside a task blocks are divided in the same way down to a few words, which are verified. A pair has one place
where its words first differ, and that place says in which of two blocks it counts: each pair is met once, and what leaves a task is
not pairs but, for each word, how many near words it met and the best of them.

Defined cases: a null or empty text holds no words; a null doc_id counts as the empty text in the checksum; texts of any length are
read whole; equal rows count as often as they occur; ties of the best near word go to the smallest in code-point order; words
without near words stay; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_or_split

#: Words have at least so many code points and occurrences; a form has at least so many times its word's occurrences.
LEAST, TWICE, TIMES = 7, 2, 10
#: One run in SLIP, by its checksum, has lost a code point.
SLIP = 31
#: Blocks of more words are subdivided over tasks, and those of more than FEW inside a task.
HOT, FEW = 4000, 4
#: Entries that a task's table of sums holds before they are sent on.
HELD = 200_000

_RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST)


def words_of(doc_id: int | None, text: str | None) -> Counter:
    """The words of a document, long enough ones, and how often they occur."""
    runs = _RUN.findall(text) if text else ()
    if not runs:
        return Counter()
    # all code points are below 256, and lower() of bytes knows A to Z only
    runs = Counter(" ".join(runs).encode("latin-1").lower().decode("latin-1").split(" "))
    start, checksum = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode())), zlib.crc32
    out: Counter = Counter()
    for run, n in runs.items():
        h = checksum(run.encode(), start)
        if h % SLIP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < LEAST:
                continue
        out[run] += n
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (word, n) of the words that occur at least TWICE times."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=schema)
            held.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for word, n in words_of(doc_id, text).items():
                    held[word] += n
                if len(held) > HELD:
                    yield sent()
        yield sent()

    found = docs.select("doc_id", "text").filter("text is not null").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= TWICE)


def _entry(m: Column, a: Column, b: Column) -> Column:
    """Entry of a block: the first a and the last b code points (read backwards) that its words share."""
    word = F.col("word")
    key = F.concat(F.substring(word, F.lit(1), a), F.lit("|"), F.reverse(F.substring(word, F.char_length(word) - b + 1, b)))
    return F.struct(m.alias("m"), a.alias("a"), b.alias("b"), key.alias("key"))


def entries(words: DataFrame) -> DataFrame:
    """Rows (m, a, b, key, word, n) of the forward (b = 0) and the reversed dictionary (a = 0)."""
    size, none = F.char_length("word"), F.lit(0)
    both = [_entry(m, *share) for m in (size, size - 1) for share in ((F.floor(m / 2).cast("int"), none), (none, m - F.floor(m / 2).cast("int")))]
    found = words.withColumn("entry", F.explode(F.array(*both))).select("entry.*", "word", "n")
    return found.filter(F.col("m") >= LEAST)


def _divided(rows: DataFrame) -> DataFrame:
    """Rows of blocks that are too large, each once in the block of a longer start and once in that of a longer end."""
    m, a, b = F.col("m"), F.col("a"), F.col("b")
    cut = a + F.floor((m - a - b) / 2).cast("int")
    return rows.withColumn("entry", F.explode(F.array(_entry(m, cut, b), _entry(m, a, m - cut)))).select("entry.*", "word", "n")


def blocks(words: DataFrame, hot: int = HOT) -> DataFrame:
    """The entries of both dictionaries in blocks of at most about hot words."""
    done, rows = None, entries(words)
    block = F.concat_ws("|", "m", "a", "b", "key")
    while True:
        counted = rows.groupBy(block.alias("block")).agg(F.count("*").alias("size")).filter(F.col("size") > hot)
        large = materialise(counted.select("block", F.lit(True).alias("large")), "large-blocks")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        open_points = F.col("m") - F.col("a") - F.col("b")
        marked = materialise(small_or_split(rows.withColumn("block", block), large, "block").withColumn("large", F.coalesce("large", F.lit(False)) & (open_points > 1)).drop("block"), "entries")
        kept, rows = marked.filter(~F.col("large")).drop("large"), _divided(marked.filter("large"))
        done = kept if done is None else done.unionByName(kept)
        if marked.filter("large").isEmpty():
            return done


class Near:
    """Counts of near words and the best of them, over blocks."""

    def __init__(self):
        self.found: dict[str, list] = {}

    def _link(self, u: tuple, v: tuple) -> None:
        for (word, _), (other, n) in ((u, v), (v, u)):
            have = self.found.get(word)
            if have is None:
                self.found[word] = [1, n, other]
                continue
            have[0] += 1
            if n > have[1] or n == have[1] and other < have[2]:
                have[1], have[2] = n, other

    def _verify(self, u: tuple, v: tuple, m: int, a: int, end: int) -> None:
        """Link u, of m code points, to v, of m or m + 1, if they are near and first differ before end."""
        x, y, p = u[0], v[0], a
        while p < m and x[p] == y[p]:
            p += 1
        if p < end and x[p + (len(y) == m):] == y[p + 1:]:
            self._link(u, v)

    def block(self, short: list, long: list, m: int, a: int, b: int) -> None:
        """Pairs of two short words, or a short and a long one, all of which share their first a and last b code points."""
        if not short or len(short) + len(long) < 2:
            return
        end, open_points = m - b if b else m + 1, m - a - b
        if len(short) + len(long) <= FEW:
            for i, u in enumerate(short):
                for v in short[i + 1:]:
                    self._verify(u, v, m, a, end)
                for v in long:
                    self._verify(u, v, m, a, end)
        elif open_points <= 1:  # words that differ in one code point at most: what is compared is near, or a long one's two candidates
            at = {}
            for i, u in enumerate(short):
                at[u[0][a]] = u
                for v in short[i + 1:]:
                    self._verify(u, v, m, a, end)
            for v in long:
                for c in {v[0][a], v[0][a + 1]}:
                    if c in at:
                        self._verify(at[c], v, m, a, end)
        else:
            cut = a + open_points // 2
            for side in (0, 1):
                parts: dict[str, tuple[list, list]] = {}
                for kind, words in enumerate((short, long)):
                    for u in words:
                        size = m + kind
                        parts.setdefault(u[0][a:cut] if not side else u[0][size - (m - cut):size - b], ([], []))[kind].append(u)
                for own_short, own_long in parts.values():
                    self.block(own_short, own_long, m, *((cut, b) if not side else (a, m - cut)))

    def rows(self, schema: pa.Schema) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([
            pa.array(self.found.keys(), pa.string()),
            *(pa.array([x[k] for x in self.found.values()], schema[k + 1].type) for k in range(3)),
        ], schema=schema)
        self.found = {}
        return out


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """Rows (word, n_near, best_n, best) of the words that have near words."""
    schema = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Near()

        def listed():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("m", "a", "b", "key", "word", "n")))

        for (m, a, b, _), rows in groupby(listed(), key=lambda r: r[:4]):
            sides: tuple[list, list] = ([], [])
            for *_, word, n in rows:  # a block, so no more than about hot words
                sides[len(word) - m].append((word, n))
            near.block(*sides, m, a, b)
            if len(near.found) > HELD:
                yield near.rows(schema)
        yield near.rows(schema)

    dictionary = blocks(words, hot).repartitionByRange("m", "a", "b", "key").sortWithinPartitions("m", "a", "b", "key", "word")
    met = dictionary.mapInArrow(run, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return met.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("first")).select("word", "n_near", (-F.col("first.less")).alias("best_n"), "first.best")


def roots(links: DataFrame) -> DataFrame:
    """Rows (word, root) for rows (word, form): where following forms ends, by doubling jumps; a form is TIMES more frequent, so chains are short."""
    at = materialise(links.select("word", F.col("form").alias("root")), "links")
    while True:
        on = at.select(F.col("word").alias("mid"), F.col("root").alias("end"))
        jumped = at.join(on, F.col("root") == F.col("mid"), "left")
        jumped = materialise(jumped.select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")), "links")
        at = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            return at


def group_variants(words: DataFrame, times: int = TIMES, hot: int = HOT) -> DataFrame:
    """words (word, n) with form, root, n_near and form_n."""
    words = materialise(words, "words")
    form = F.when(F.col("best_n") >= times * F.col("n"), F.col("best"))
    known = words.join(near_words(words, hot), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n"))
    known = materialise(known, "forms")
    ends = roots(known.filter("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir) -> DataFrame:
    return group_variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP11_SQL = rf"""
WITH RECURSIVE step AS (
  SELECT i AS byte, CAST(i AS BIGINT) AS c, 0 AS k FROM unnest(generate_series(0, 255)) AS s(i)
  UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8
), checksums AS (SELECT list(c ORDER BY byte) AS t FROM step WHERE k = 8
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
  WHERE length(run) >= {LEAST} GROUP BY 1, 2
), keyed AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS k FROM runs
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(generate_series(1, length(k) // 2), lambda i: CAST('0x' || substr(k, 2 * i - 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM keyed, checksums
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {LEAST} GROUP BY 1 HAVING sum(n) >= {TWICE}
), shorter AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, unnest(generate_series(0, length(word) - 1)) AS s(i)
), near AS (
  SELECT a.word AS u, b.word AS v FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON s.rest = w.word UNION SELECT w.word, s.word FROM shorter s JOIN words w ON s.rest = w.word
), best AS (SELECT u, count(*) AS n_near, max(w.n) AS most, min(CASE WHEN w.n = top THEN v END) AS form FROM (SELECT u, v, max(x.n) OVER (PARTITION BY u) AS top FROM near JOIN words x ON x.word = v) JOIN words w ON w.word = v GROUP BY u
), forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {TIMES} * n THEN form END AS form, CASE WHEN most >= {TIMES} * n THEN most END AS form_n FROM words LEFT JOIN best ON u = word
), walk AS (
  SELECT word, form AS spot, 1 AS far FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT walk.word, forms.form, far + 1 FROM walk JOIN forms ON forms.word = walk.spot WHERE forms.form IS NOT NULL
), ends AS (SELECT word, arg_max(spot, far) AS root FROM walk GROUP BY 1)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n FROM forms f LEFT JOIN ends e USING (word)
"""
