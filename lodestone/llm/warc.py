"""WARC archives as a chunked record table.

A page's payload becomes rows (record, chunk number) of at most CHUNK_BYTES bytes: a generator hands them on one at a time, feeds
each to an incremental SHA-256, and every row carries the digest of the payload up to its end, so the last one has that of the
whole and no task copies a whole record. Each row is one WARC 1.1 record: the first holds the HTTP head, further ones are the
standard's continuation segments, so the rows written as gzipped text files are proper archives. Reading streams the
records of a file in order, feeds each chunk to an incremental SHA-256, and checks it against the payload digest.

Payloads are deduplicated by digest: of equal payloads of at least DEDUP_BYTES bytes the smallest page_id is the response
and the others are revisit records without payload. Only (record, page_id, digest) rows are shuffled to find them, pre-aggregated
by digest; the at most HOT_MOST digests that more than a share of the pages have are broadcast, the others joined by digest.

A payload is cut inside any "WARC/1.1" line that it holds, so the reader's record separator cannot occur in a block.

Defined cases: a null html is an empty payload; pages whose page_id ties for the smallest of a digest are all responses;
a null page_id is never referred to (if all are null, all are responses); repeated rows are records of their own; control characters in
a url are dropped; columns other than page_id, url and html are not read; an empty table writes and reads back an empty archive.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir

CHUNK_BYTES = 64 * 1024
DEDUP_BYTES = 100
#: A digest of more than this many pages, and than a share of all, is broadcast: at most HOT_MOST of them.
HOT_PAGES, HOT_MOST = 10_000, 1_000
#: Bytes of chunks that are handed on together.
BATCH_BYTES = 4 << 20
VERSION = "WARC/1.1"
SEPARATOR = f"\r\n\r\n{VERSION}\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def revisits(digests: DataFrame) -> DataFrame:
    """From (record, page_id, digest, size): rows (record, refers_to) of the records that revisit another page."""
    large = digests.filter(F.col("size") >= DEDUP_BYTES).select("record", "page_id", "digest")
    shared = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    shared = materialise(shared, "digests")
    most = max(HOT_PAGES, digests.count() // HOT_MOST)
    hot = F.broadcast(shared.filter(F.col("n") > most).drop("n"))  # at most HOT_MOST rows
    rest = shared.filter(F.col("n") <= most).drop("n")
    found = large.join(hot, "digest").unionByName(large.join(hot, "digest", "left_anti").join(rest, "digest"))
    return found.filter(~F.col("page_id").eqNullSafe(F.col("first"))).select("record", F.col("first").alias("refers_to"))


def _pieces(payload: memoryview) -> Iterator[bytes]:
    """The payload in order, in pieces of at most CHUNK_BYTES that hold no record's first line; one empty piece if it is empty."""
    at, marker = 0, f"{VERSION}\r\n".encode()
    while True:
        piece = bytes(payload[at:at + CHUNK_BYTES])
        inside = piece.find(marker)
        if inside >= 0:
            piece = piece[:inside + 4]
        yield piece
        at += len(piece)
        if at >= len(payload):
            return


_CHUNKS = pa.schema([
    ("record", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()),
    ("size", pa.int64()), ("digest", pa.string()), ("data", pa.binary()),
])


def chunk_table(pages: DataFrame) -> DataFrame:
    """From (page_id, url, html) a row per chunk: record (a number of its own), chunk from 0, and size and digest of the payload so far.

    Records are numbered by task, so the result must be materialised before it is used twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, rows, held = TaskContext.get().partitionId() << 33, [], 0
        for b in batches:
            text = b.column("html")
            text = text.cast(pa.large_binary())
            ends, data = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8), text.buffers()[2]
            view = memoryview(data if data is not None else b"")
            for i, (page_id, url) in enumerate(zip(b.column("page_id").to_pylist(), b.column("url").to_pylist())):
                payload = view[ends[i]:ends[i + 1]]
                sha, size = hashlib.sha256(), 0
                for chunk, piece in enumerate(_pieces(payload)):
                    sha.update(piece)
                    size += len(piece)
                    rows.append((record, page_id, url, chunk, size == len(payload), size, sha.hexdigest(), piece))
                    held += len(piece) + 200
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CHUNKS)], schema=_CHUNKS)
                        rows, held = [], 0
                record += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CHUNKS)], schema=_CHUNKS)

    return pages.select("page_id", "url", "html").mapInArrow(run, "record long, page_id long, url string, chunk int, last boolean, size long, digest string, data binary")


def _record_rows(chunks: DataFrame) -> DataFrame:
    """One WARC record per chunk, as the text of a line that the writer ends with CR LF."""
    first, last = F.col("chunk") == 0, F.col("chunk") == F.col("chunks") - 1
    record = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))
    head = F.when(first, F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n"))).otherwise(F.lit(""))
    kind = F.when(~first, "continuation").when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")

    def line(name, value, when=None):
        text = F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
        return text if when is None else F.when(when, text).otherwise(F.lit(""))

    segmented = F.col("chunks") > 1
    header = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.when(first, record).otherwise(F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), F.col("chunk") + 1, F.lit(">")))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", ""), F.lit(""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")), first),
        line("WARC-Profile", F.lit(PROFILE), first & F.col("refers_to").isNotNull()),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")), first & F.col("refers_to").isNotNull()),
        line("WARC-Segment-Origin-ID", record, ~first),
        line("WARC-Segment-Number", (F.col("chunk") + 1).cast("string"), segmented),
        line("WARC-Segment-Total-Length", F.col("size").cast("string"), segmented & last),
        line("Content-Type", F.lit("application/http;msgtype=response"), first),
        line("Content-Length", (F.length(F.col("data")) + F.length(head)).cast("string")),
        F.lit("\r\n"),
        head,
    )
    return chunks.select(F.concat(header.cast("binary"), F.col("data"), F.lit("\r\n").cast("binary")).cast("string").alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a WARC record for each row of pages (page_id, url, html) to gzipped archives under path."""
    chunks = materialise(chunk_table(pages), "chunks", "zstd")
    whole = chunks.filter("last").select("record", "page_id", "digest", "size", (F.col("chunk") + 1).alias("chunks"))
    typed = whole.join(materialise(revisits(whole), "revisits"), "record", "left").drop("page_id")
    # dealt by record once, which the join keeps: a record's chunks are one task's, in order
    dealt = chunks.drop("last", "size", "digest").repartition("record")
    rows = dealt.join(typed, "record").filter("chunk = 0 or refers_to is null")
    again = F.col("refers_to").isNotNull()
    rows = rows.withColumns({"data": F.when(again, F.lit(b"")).otherwise(F.col("data")), "chunks": F.when(again, 1).otherwise(F.col("chunks"))})
    _record_rows(rows.sortWithinPartitions("record", "chunk")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for row in head.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = row.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


class _Reader:
    """Puts the records of a stream together, one chunk at a time."""

    def __init__(self):
        self.open: dict | None = None
        self.sha = None
        self.done: list[dict] = []

    def add(self, block: bytes) -> None:
        head, _, content = block.partition(b"\r\n\r\n")
        fields = _fields(head)
        content = content[:int(fields["content-length"])]
        if len(content) != int(fields["content-length"]):
            raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
        if fields["warc-type"] == "continuation":
            if self.open is None or fields["warc-segment-origin-id"] != self.open["id"] or int(fields["warc-segment-number"]) != self.open["segment"] + 1:
                raise ValueError(f"segment {fields.get('warc-record-id')} does not follow its record")
            self.open["segment"] += 1
        else:
            self.close()
            http, _, content = content.partition(b"\r\n\r\n")
            self.open = {
                "id": fields["warc-record-id"], "type": fields["warc-type"], "digest": fields["warc-payload-digest"].removeprefix("sha256:"),
                "refers_to": fields.get("warc-refers-to"), "length": int(_fields(http)["content-length"]), "segment": 1, "bytes": 0,
            }
            self.sha = hashlib.sha256()
        self.sha.update(content)
        self.open["bytes"] += len(content)

    def close(self) -> None:
        if self.open is None:
            return
        if self.open["type"] == "response" and (self.open["bytes"] != self.open["length"] or self.sha.hexdigest() != self.open["digest"]):
            raise ValueError(f"payload of {self.open['id']} differs from its digest")
        self.done.append(self.open)
        self.open = None

    def take(self) -> list[dict]:
        rows, self.done = self.done, []
        return rows


def _number(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return None if text in ("", "null") else int(text)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record group: page_id, payload_bytes, payload_digest, record_type, refers_to. Payloads are verified on the way."""
    blocks = spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("value").cast("binary").alias("block"))
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    first = f"{VERSION}\r\n".encode()

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([
            {"page_id": _number(r["id"]), "payload_bytes": r["length"], "payload_digest": r["digest"], "record_type": r["type"], "refers_to": _number(r["refers_to"])}
            for r in rows
        ], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for b in batches:
            for block in b.column(0):
                raw = block.as_py()
                if raw.strip():
                    reader.add(raw.removeprefix(first))
            yield batch(reader.take())
        reader.close()
        yield batch(reader.take())

    return blocks.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op3_warc(spark, sf_dir) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return read_archives(spark, path)


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""
