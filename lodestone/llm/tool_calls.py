"""Chat formatting: tool calls linked to their results.

Events are calls, results and plain messages of conversations. Results are hash-joined to calls by identifier (within the
conversation; the hashed side has one row an identifier), arguments are validated against the tool's schema, every event is serialised as canonical JSON, and events are
ordered topologically: a result comes after its call, a call after the results of the calls that it depends on.

Both sides of a join are first added up by identifier, so repeated identifiers make no pairs. Levels are found in rounds: chains of
calls with one dependency each are followed by jumps that double, and calls with several are placed once all of those are, as
many rounds as such calls depend on each other in a row. Places in a conversation are numbered
within (level, BUCKET turns) and shifted by the sums before; those are taken over LEVELS levels at once and then inside of them, so a
conversation of any length and depth fills no single task.

Canonical JSON: keys in order of code points, no white space, shortest escapes, no escapes for non-ASCII letters.

Defined cases: a call without a result is unanswered, one whose identifier another call has too is ambiguous; a result without
a call is an orphan, and of several results of a call those with the smallest turn are linked, others are extra;
calls on or behind a cycle of dependencies have no level and come last; dependencies on calls that do not exist count for nothing;
arguments that are no JSON or hold a key twice are invalid and kept as a string, those of an unknown tool are invalid; half
surrogates stay escaped; null texts are JSON nulls; a null conv_id is a conversation of its own; a null identifier links to nothing; repeated rows are
events of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BUCKET = 1024
#: Levels whose places are summed up together.
LEVELS = 256
#: The tool that a user's turn stands for in the query, and its schema.
TOOL = "ask"
MOST_LETTERS = 300
SCHEMAS = {
    TOOL: {
        "type": "object",
        "required": ["text", "turn"],
        "properties": {"text": {"type": "string", "minLength": 1, "maxLength": MOST_LETTERS}, "turn": {"type": "integer", "minimum": 0}},
        "additionalProperties": False,
    }
}

_HALF = re.compile("[\ud800-\udfff]")
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float), "null": type(None)}


def _whole(text: str) -> str:
    """Half surrogates, which UTF-8 cannot hold, as escapes."""
    return _HALF.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def canonical(value) -> str:
    return _whole(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def faults(value, schema: dict, at: str = "") -> Iterator[str]:
    """What of a value breaks the schema: type, enum, bounds, lengths, required and further properties, items."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(isinstance(value, _KINDS[k]) and (k == "boolean" or not isinstance(value, bool)) for k in kinds):
            yield f"{at or '/'}: not of type {' or '.join(kinds)}"
            return
    if "enum" in schema and value not in schema["enum"]:
        yield f"{at or '/'}: not one of the listed values"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            yield f"{at}: below {schema['minimum']}"
        if value > schema.get("maximum", value):
            yield f"{at}: above {schema['maximum']}"
    for kind, low, high in ((str, "minLength", "maxLength"), (list, "minItems", "maxItems")):
        if isinstance(value, kind):
            if len(value) < schema.get(low, 0):
                yield f"{at}: shorter than {schema[low]}"
            if len(value) > schema.get(high, len(value)):
                yield f"{at}: longer than {schema[high]}"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            yield from faults(x, schema["items"], f"{at}/{i}")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        for k in schema.get("required", ()):
            if k not in value:
                yield f"{at}/{k}: missing"
        for k in sorted(value):
            if k in own:
                yield from faults(value[k], own[k], f"{at}/{k}")
            elif schema.get("additionalProperties") is False:
                yield f"{at}/{k}: not allowed"


def _once(pairs: list[tuple]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("a key occurs twice")
    return dict(pairs)


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def formatted(kind: str, role: str | None, call_id: str | None, name: str | None, body: str | None, schemas: dict) -> tuple[str, list[str]]:
    """The canonical JSON of an event, and the faults of a call's arguments."""
    if kind == "result":
        return canonical({"content": body, "id": call_id, "type": "result"}), []
    if kind != "call":
        return canonical({"content": body, "role": role, "type": "message"}), []
    try:
        arguments = json.loads(body or "", object_pairs_hook=_once, parse_constant=_no_constant)
        found = list(faults(arguments, schemas[name])) if name in schemas else [f"{name}: unknown tool"]
        return canonical({"arguments": arguments, "id": call_id, "name": name, "type": "call"}), found
    except (ValueError, RecursionError):
        return canonical({"arguments": body, "id": call_id, "name": name, "type": "call"}), ["/: not JSON"]


def format_events(events: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """events (conv_id, turn, role, kind, call_id, name, after, body) plus json, json_sha256, json_bytes and errors (null unless a call)."""
    kind = pa.struct([("json", pa.string()), ("json_sha256", pa.string()), ("json_bytes", pa.int64()), ("errors", pa.string())])

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            rows = []
            for event in zip(*(c.to_pylist() for c in columns)):
                text, found = formatted(*event, schemas)
                raw = text.encode()
                rows.append({"json": text, "json_sha256": hashlib.sha256(raw).hexdigest(), "json_bytes": len(raw), "errors": _whole("; ".join(found)) if event[0] == "call" else None})
            yield pa.array(rows, kind)

    made = F.arrow_udf(run, "json string, json_sha256 string, json_bytes long, errors string")
    return events.withColumn("_made", made("kind", "role", "call_id", "name", "body")).select(*events.columns, "_made.*")


def _key():
    """The identifier within its conversation; null where there is none."""
    return F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(":"), F.col("call_id"))


def levels(calls: DataFrame, depends: DataFrame) -> DataFrame:
    """(key, level) of calls (key, weight): 0, or the largest of level + weight over the calls that it depends on.

    depends: rows (key, on), both keys of calls. Calls on or behind a cycle are left out.
    """
    edges = depends.join(calls.select(F.col("key").alias("on"), F.col("weight").alias("dist")), "on").select("key", "on", "dist")
    edges = materialise(edges.join(edges.groupBy("key").agg(F.count("*").alias("n")), "key"), "edges")
    roots = calls.select("key").join(edges.select("key").distinct(), "key", "left_anti").select("key", F.lit(0).alias("level"))
    # a call with one dependency lies dist above it; jumps of jumps reach the start of a chain
    jumps = materialise(edges.filter("n = 1").select("key", F.col("on").alias("at"), "dist"), "jumps")
    chained = jumps.count()
    for _ in range(chained.bit_length() + 1):
        via = jumps.select(F.col("key").alias("at"), F.col("at").alias("far"), F.col("dist").alias("more"))
        moved = materialise(jumps.join(via, "at", "left").select("key", F.coalesce("far", "at").alias("at"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), "far"), "jumps")
        jumps = moved.drop("far")
        if moved.filter("far is not null").isEmpty():
            break
    jumps = jumps.join(edges.filter("n = 1").select(F.col("key").alias("at")), "at", "left_anti").select("key", "at", "dist")  # others run in circles
    placed = parts = materialise(roots, "placed")
    several = edges.filter("n > 1").select("key", F.col("on").alias("_on"), F.col("dist").alias("_dist"))
    ends = jumps.select(F.col("key").alias("_on"), "at", "dist")
    waiting = several.join(ends, "_on", "left").select("key", F.coalesce("at", "_on").alias("on"), (F.col("_dist") + F.coalesce("dist", F.lit(0))).alias("dist"), F.lit(None).cast("int").alias("after"))
    waiting = materialise(waiting, "waiting")
    while not placed.isEmpty() and not waiting.isEmpty():
        met = waiting.join(placed.select(F.col("key").alias("on"), "level"), "on", "left")
        waiting = materialise(met.select("key", "on", "dist", F.coalesce("after", F.col("level") + F.col("dist")).cast("int").alias("after")), "waiting")
        ready = waiting.groupBy("key").agg(F.count_if(F.col("after").isNull()).alias("n"), F.max("after").alias("level")).filter("n = 0")
        placed = materialise(ready.select("key", "level"), "placed")
        parts = parts.unionByName(placed)
        waiting = materialise(waiting.join(placed.select("key"), "key", "left_anti"), "waiting")
    return parts.unionByName(jumps.join(parts.withColumnRenamed("key", "at"), "at").select("key", (F.col("level") + F.col("dist")).cast("int").alias("level")))


def link(events: DataFrame) -> DataFrame:
    """events (conv_id, turn, kind, call_id, after and others, no texts) plus status, level and place (in the conversation, from 0)."""
    # rows without an identifier are dealt by turn: as nulls they would all meet in one task
    keyed = materialise(events.withColumns({"_key": _key(), "_deal": F.coalesce(_key(), F.xxhash64("conv_id", "turn").cast("string"))}), "events")
    by_id = keyed.filter("_key is not null").groupBy(F.col("_key").alias("_id")).agg(
        F.count_if(F.col("kind") == "call").alias("_calls"),
        F.count_if(F.col("kind") == "result").alias("_results"),
        F.min(F.when(F.col("kind") == "result", F.col("turn"))).alias("_first"),
    )
    by_id = materialise(by_id, "identifiers")
    calls = by_id.filter("_calls > 0").select(F.col("_id").alias("key"), F.when(F.col("_results") > 0, 2).otherwise(1).alias("weight"))
    before = keyed.filter("kind = 'call' and _key is not null").select("conv_id", F.col("_key").alias("key"), F.explode("after").alias("call_id"))
    depends = before.select("key", _key().alias("on")).filter("on is not null").distinct().join(calls.select(F.col("key").alias("on")), "on", "left_semi")
    known = by_id.join(levels(calls, depends), by_id["_id"] == F.col("key"), "left").drop("key")
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    calls_of = F.coalesce("_calls", F.lit(0))
    status = (
        F.when(call & (calls_of > 1), "ambiguous").when(call & (F.coalesce("_results", F.lit(0)) == 0), "unanswered").when(call, "linked")
        .when(result & (calls_of == 0), "orphan").when(result & (F.col("turn") > F.col("_first")), "extra").when(result, "linked").otherwise("message")
    )
    level = F.when(call & F.col("_key").isNull(), 0).when(call, F.col("level")).when(result & (calls_of > 0), F.col("level") + 1).otherwise(0)
    linked = keyed.join(known.hint("shuffle_hash"), keyed["_deal"] == known["_id"], "left").withColumn("_status", status).withColumn("level", level.cast("int"))
    linked = materialise(linked.select(*events.columns, F.col("_status").alias("status"), "level", F.floor(F.col("turn") / BUCKET).alias("_bucket")), "linked")
    # what stands before a place in two steps: whole ranges of levels, and levels and buckets in their range
    ranged = linked.groupBy("conv_id", "level", "_bucket").agg(F.count("*").alias("_n")).withColumn("_range", F.floor(F.col("level") / LEVELS))
    ranged = materialise(ranged, "places")
    whole = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("_range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("conv_id", "_range").agg(F.sum("_n").alias("_of_range"))
    ranges = ranges.select(F.col("conv_id").alias("_c"), F.col("_range").alias("_r"), F.coalesce(F.sum("_of_range").over(whole), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("conv_id", "_range").orderBy(F.asc_nulls_last("level"), F.asc_nulls_last("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    counts = counts.join(ranges, counts["conv_id"].eqNullSafe(ranges["_c"]) & counts["_range"].eqNullSafe(ranges["_r"]))
    starts = counts.select(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "level", "_bucket")], (F.col("_before") + F.col("_inside")).alias("_start"))
    own = Window.partitionBy("conv_id", "level", "_bucket").orderBy("turn", "kind", "call_id")
    ranked = linked.withColumn("_place", F.row_number().over(own) - 1)
    on = [ranked[c].eqNullSafe(starts[f"_{c}"]) for c in ("conv_id", "level", "_bucket")]
    return ranked.join(starts, on).withColumn("place", (F.col("_start") + F.col("_place")).cast("long")).select(*events.columns, "status", "level", "place")


def turns_as_events(conversations: DataFrame) -> DataFrame:
    """Conversations of (conv_id, turn, role, text) read as events: a user's turn calls TOOL after the user's turn before it, an
    assistant's turn is the result of the last user's turn before it, other turns are messages."""
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("_bucket", F.floor(F.col("turn") / BUCKET))
    asked = F.when(F.col("role") == "user", F.col("turn"))
    last = conversations.filter("role = 'user'").groupBy("conv_id", F.floor(F.col("turn") / BUCKET).alias("_bucket")).agg(F.max("turn").alias("_last"))
    buckets = conversations.select("conv_id", F.floor(F.col("turn") / BUCKET).alias("_bucket")).distinct()
    earlier = Window.partitionBy("_conv").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.join(last, buckets["conv_id"].eqNullSafe(last["conv_id"]) & (buckets["_bucket"] == last["_bucket"]), "left").select(
        buckets["conv_id"].alias("_conv"), buckets["_bucket"].alias("_at"), F.last("_last", True).over(earlier.partitionBy(buckets["conv_id"]).orderBy(buckets["_bucket"])).alias("_carried"),
    ).filter("_carried is not null")
    within = Window.partitionBy("conv_id", "_bucket").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("_prior", F.max(asked).over(within))
    on = own["conv_id"].eqNullSafe(carried["_conv"]) & (own["_bucket"] == carried["_at"])
    both = own.join(carried, on, "left").withColumn("_prior", F.coalesce("_prior", "_carried"))

    def id_of(turn):
        return F.concat(F.lit("call-"), turn.cast("string"))

    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    body = F.when(user, F.to_json(F.struct("text", "turn"), {"ignoreNullFields": "false"})).otherwise(F.col("text"))
    return both.select(
        "conv_id", "turn", "role",
        F.when(user, "call").when(assistant, "result").otherwise("message").alias("kind"),
        F.when(user, id_of(F.col("turn"))).when(assistant, id_of(F.col("_prior"))).alias("call_id"),
        F.when(user, TOOL).alias("name"),
        F.when(user & F.col("_prior").isNotNull(), F.array(id_of(F.col("_prior")))).otherwise(F.array().cast("array<string>")).alias("after"),
        body.alias("body"),
    )


def op6_tool_calls(spark, sf_dir) -> DataFrame:
    """Every turn: its kind, identifier, link, level and place, the faults of its arguments, and its canonical JSON's digest and length."""
    made = format_events(turns_as_events(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))
    linked = link(made.drop("json", "body", "name", "role"))
    return linked.select("conv_id", "turn", "kind", "call_id", "status", "level", "place", "errors", "json_sha256", "json_bytes")


OP6_SQL = f"""
WITH prior AS (
  SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM conversations
), events AS (
  SELECT conv_id, turn, role, text, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN 'call-' || turn WHEN 'assistant' THEN 'call-' || p END AS call_id
  FROM prior
), ids AS (
  SELECT conv_id, call_id, count(*) FILTER (kind = 'call') AS calls, count(*) FILTER (kind = 'result') AS results, min(turn) FILTER (kind = 'result') AS first_turn,
    min(turn) FILTER (kind = 'call') AS call_turn
  FROM events WHERE call_id IS NOT NULL GROUP BY 1, 2
), levels AS (
  SELECT *, coalesce(sum(CASE WHEN results > 0 THEN 2 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY call_turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS level
  FROM ids WHERE calls > 0
), joined AS (
  SELECT e.*, CASE e.kind WHEN 'call' THEN l.level WHEN 'result' THEN coalesce(l.level + 1, 0) ELSE 0 END AS lv,
    CASE WHEN e.kind = 'call' AND l.calls > 1 THEN 'ambiguous' WHEN e.kind = 'call' AND l.results = 0 THEN 'unanswered' WHEN e.kind = 'call' THEN 'linked'
      WHEN e.kind = 'result' AND l.calls IS NULL THEN 'orphan' WHEN e.kind = 'result' AND e.turn > l.first_turn THEN 'extra' WHEN e.kind = 'result' THEN 'linked' ELSE 'message' END AS status,
    CASE e.kind
      WHEN 'call' THEN '{{"arguments":{{"text":' || CAST(to_json(e.text) AS VARCHAR) || ',"turn":' || e.turn || '}},"id":"' || e.call_id || '","name":"{TOOL}","type":"call"}}'
      WHEN 'result' THEN '{{"content":' || CAST(to_json(e.text) AS VARCHAR) || ',"id":' || coalesce('"' || e.call_id || '"', 'null') || ',"type":"result"}}'
      ELSE '{{"content":' || CAST(to_json(e.text) AS VARCHAR) || ',"role":"' || e.role || '","type":"message"}}' END AS doc
  FROM events e LEFT JOIN levels l USING (conv_id, call_id)
)
SELECT conv_id, turn, kind, call_id, status, CAST(lv AS INTEGER) AS level,
  row_number() OVER (PARTITION BY conv_id ORDER BY lv, turn, kind, call_id) - 1 AS place,
  CASE WHEN kind = 'call' THEN CASE WHEN length(text) < 1 THEN '/text: shorter than 1' WHEN length(text) > {MOST_LETTERS} THEN '/text: longer than {MOST_LETTERS}' ELSE '' END END AS errors,
  sha256(doc) AS json_sha256, CAST(octet_length(encode(doc)) AS BIGINT) AS json_bytes
FROM joined
"""
