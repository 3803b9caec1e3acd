"""Exact token counts by prefix dynamic programming.

Byte-pair tokens of a prefix follow from those of shorter prefixes: the last token of the prefix ending at i is the
one token t ending there whose pairing with the last token of the prefix before it would stay as it is if the pair
were encoded alone. So one pass over a piece of text (what the pre-tokeniser splits it into) stores the exact count for each of
its prefixes. Pieces repeat a lot; each worker keeps their stored counts, up to CACHE_PIECES of them.

`prefix_table` puts the pieces together into the count at every prefix of a text; truncation (`truncated`, `kept_chars`) and budgets are
answered from stored counts and encode nothing again. A prefix may end where the pre-tokeniser would split it otherwise than the whole
text: trailing white space is one piece, a contraction may be cut short, and part of a special token is plain text. Each has
its own rule in `_cuts`. Counts need not grow with the prefix, so the longest prefix within a budget is the last one, not
the one before the first that passes it.

Defined cases: null counts as the empty text (0 tokens), and truncated it stays null; strings of special tokens in a text count as
those tokens, as the library does by default; pieces of any length take time linear in it; repeated rows count alike; an empty table gives
an empty result; only the named column is read.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1024
#: Bound on a worker's remembered pieces, each of at most CACHE_CHARS.
CACHE_PIECES, CACHE_CHARS = 400_000, 32

#: Pieces of three letters that the pre-tokeniser splits if they are cut short.
CONTRACTIONS = ("'re", "'ve", "'ll")
#: How the byte-level pre-tokeniser splits text (fixed value of the vocabulary's format).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space as that pattern has it; str.isspace() counts some separators more.
_LEADING = regex.compile(r"\s*")


def _spaces(piece: str) -> int:
    """Characters of white space that a piece starts with."""
    return _LEADING.match(piece).end()


def _is_blank(piece: str) -> bool:
    return _spaces(piece) == len(piece)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, other bytes for 256 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Totals(dict):
    """Token count by piece, worked out on first sight; what its prefixes count is kept beside it."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter
        self.prefixes: dict[str, list[int]] = {}

    def __missing__(self, piece: str) -> int:
        counts = self.counter.char_counts(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
                self.prefixes.clear()
            self[piece] = counts[-1]
            self.prefixes[piece] = array("H", counts)
        return counts[-1]

    def stored(self, piece: str) -> list[int]:
        """Counts of the piece's prefixes, by characters."""
        known = self.prefixes.get(piece)
        if known is None:
            if self[piece] >= 0 and piece in self.prefixes:
                return self.prefixes[piece]
            known = self.counter.char_counts(piece)
        return known


class PrefixCounter:
    """Counts of a byte-level BPE vocabulary in the tokenizers library's JSON."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = (spec["model"]["type"], (spec["pre_tokenizer"] or {}).get("type"), spec["normalizer"], bool((spec["pre_tokenizer"] or {}).get("add_prefix_space")))
        if kind != ("BPE", "ByteLevel", None, False):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {kind}")
        letter = _byte_letters()
        self.vocab = {bytes(letter[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in letter for c in token)}
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.special_first = {s[0] for s in special}
        self.special_texts = special
        for s in special:
            self.vocab.pop(s.encode(), None)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (bytes(letter[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merge[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.bytes_of = {i: b for b, i in self.vocab.items()}
        self.longest = max(map(len, self.vocab))
        self.fits: dict[tuple[int, int], bool] = {}
        self.totals = _Totals(self)
        self.split, self.each_piece = regex.compile(PIECES).findall, regex.compile(PIECES).finditer

    def encode_alone(self, raw: bytes) -> list[int]:
        """Tokens of a short piece by merging, lowest rank first."""
        ids = [self.vocab[raw[i:i + 1]] for i in range(len(raw))]
        while len(ids) > 1:
            rank, at = min((self.merge.get((ids[i], ids[i + 1]), (1 << 60,))[0], i) for i in range(len(ids) - 1))
            if rank == 1 << 60:
                break
            ids[at:at + 2] = [self.merge[ids[at], ids[at + 1]][1]]
        return ids

    def _fits(self, before: int, token: int) -> bool:
        """Whether token stays as it is after the token before it (-1: at the start)."""
        key = (before, token)
        known = self.fits.get(key)
        if known is None:
            raw = self.bytes_of[token]
            known = self.encode_alone(raw) == [token] if before < 0 else self.encode_alone(self.bytes_of[before] + raw) == [before, token]
            if len(self.fits) >= 2_000_000:
                self.fits.clear()
            self.fits[key] = known
        return known

    def prefix_counts(self, raw: bytes) -> list[int]:
        """counts[i]: tokens of the first i bytes of one piece."""
        n = len(raw)
        last, counts, token_at, longest, fits = [-1] * (n + 1), [0] * (n + 1), self.vocab.get, self.longest, self.fits.get
        for i in range(1, n + 1):
            for j in range(i - longest if i > longest else 0, i):
                token = token_at(raw[j:i])
                if token is not None:
                    before = last[j]
                    ok = fits((before, token))
                    if ok is None:
                        ok = self._fits(before, token)
                    if ok:
                        last[i] = token
                        counts[i] = counts[j] + 1
                        break
        return counts

    def char_counts(self, piece: str) -> list[int]:
        """counts[i]: tokens of the first i characters of one piece."""
        counts = self.prefix_counts(piece.encode("utf-8", "surrogatepass"))
        if piece.isascii():
            return counts
        out, size = [0], 0
        for c in piece:
            size += 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
            out.append(counts[size])
        return out

    def _has_special(self, text: str) -> bool:
        return any(s in text for s in self.special_texts)

    def parts(self, text: str) -> tuple[list[str], int]:
        """The text between special tokens, and how many of those it holds."""
        if not self._has_special(text):
            return [text], 0
        return self.special.split(text), len(self.special.findall(text))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts, n = self.parts(text)
        total = self.totals.__getitem__
        return n + sum(sum(map(total, self.split(p))) for p in parts)

    def _cuts(self, text: str) -> Iterator[tuple[int, int, list[int]]]:
        """(start, tokens before it, counts by characters from there on) in order; later ones hold where they overlap."""
        before = at = 0
        for special in [*(self.special.finditer(text) if self._has_special(text) else ()), None]:
            end = len(text) if special is None else special.start()
            start = last = at
            blank = None  # where the white space that ends here starts, and the tokens before it
            for m in self.each_piece(text, at, end):
                piece = m.group()
                total, last = self.totals[piece], start
                size = len(piece)
                yield start + 1, before, self.totals.stored(piece)[1:]
                spaces = _spaces(piece)
                if spaces:
                    if blank is None:
                        blank = start, before
                    # what ends in white space counts it as one piece
                    run = text[blank[0]:start + spaces]
                    if len(run) > 1 or spaces < size:
                        counts = self.totals.stored(run)
                        yield start, blank[1], counts[start - blank[0]:len(run) + 1]
                        if spaces < size:
                            yield start + spaces + 1, before, self.totals.stored(piece)[spaces + 1:]
                elif size == 3 and piece in CONTRACTIONS:
                    yield start + 2, before, [self.totals["'"] + self.totals[piece[1]]]
                    yield start + 3, before, [total]
                if spaces < size:
                    blank = None
                before += total
                start += size
            if blank is not None:
                before = blank[1] + self.totals[text[blank[0]:end]]
            if special is not None:
                name = special.group()
                back = blank[0] if blank is not None else last if start > at else at
                had = before - (self.totals[text[back:end]] if back < end else 0)
                for k in range(1, len(name)):
                    yield end + k, had, [sum(map(self.totals.__getitem__, self.split(text[back:end + k])))]
                before += 1
                at = end + len(name)
                yield at, before, [0]

    def counts(self, text: str | None, budget: int | None = None) -> list[int]:
        """counts[i]: tokens of the first i characters of the text; with a budget, up to where no further prefix is within it."""
        out = [0]
        for start, before, own in self._cuts(text or ""):
            if budget is not None and before > budget + 1:
                break
            out[start:start + len(own)] = [before + x for x in own]
        return out

    def longest_prefix(self, text: str | None, budget: int) -> int:
        """Characters of the longest prefix of at most budget tokens."""
        counts = self.counts(text, budget)
        return next(i for i in range(len(counts) - 1, -1, -1) if counts[i] <= budget or i == 0)


    def count_and_cut(self, text: str | None, budget: int) -> tuple[int, int]:
        """Tokens of the text, and characters of its longest prefix within the budget: only pieces about the budget are looked into."""
        if not text or self._has_special(text):
            return self.count(text), self.longest_prefix(text, budget)
        pieces = self.split(text)
        totals = list(map(self.totals.__getitem__, pieces))
        n = sum(totals)
        if n <= budget:
            return n, len(text)
        sums = list(accumulate(totals[:budget + 1]))  # a piece has a token at least
        low = high = bisect_right(sums, budget)
        # from a piece that no white space joins to what is before it, to one that ends any
        low -= 2
        while low > 0 and (_is_blank(pieces[low]) or _is_blank(pieces[low - 1])):
            low -= 1
        while high < len(pieces) - 1 and _is_blank(pieces[high]):
            high += 1
        low = max(low, 0)
        start = sum(map(len, pieces[:low]))
        near = "".join(pieces[low:high + 2])
        return n, start + self.longest_prefix(near, budget - (sums[low - 1] if low else 0))


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    """One per worker process and vocabulary."""
    return PrefixCounter(path)


def _mapped(of: Callable[[PrefixCounter, str | None], object], kind: pa.DataType, column: str, ddl: str, path: str | None):
    path = path or default_path()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter(path)
        for texts in batches:
            yield pa.array([of(own, t.as_py()) for t in texts], kind)

    return F.arrow_udf(run, ddl)(F.col(column))


def token_count(column: str = "text", path: str | None = None):
    """Tokens of a text column, as a long."""
    return _mapped(PrefixCounter.count, pa.int64(), column, "long", path)


def prefix_table(column: str = "text", path: str | None = None):
    """The stored answers for a text: tokens of its first 0, 1, 2, … characters."""
    return _mapped(PrefixCounter.counts, pa.list_(pa.int32()), column, "array<int>", path)


def truncated(column: str = "text", budget: int = LIMIT, path: str | None = None):
    """The longest prefix of a text of at most budget tokens; null stays null."""
    return _mapped(lambda own, t: None if t is None else t[:own.longest_prefix(t, budget)], pa.string(), column, "string", path)


def counted(column: str = "text", budget: int = LIMIT, path: str | None = None):
    """Struct of n_tokens and kept_chars, the characters of the longest prefix within the budget."""
    kind = pa.struct([("n_tokens", pa.int64()), ("kept_chars", pa.int64())])
    return _mapped(lambda own, t: dict(zip(("n_tokens", "kept_chars"), own.count_and_cut(t, budget))), kind, column, "n_tokens long, kept_chars long", path)


def op7_token_counts(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), counted().alias("found"))
    tokens = F.col("found.n_tokens")
    return found.select("doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > LIMIT).alias("over_limit"), F.col("found.kept_chars").alias("kept_chars"))
