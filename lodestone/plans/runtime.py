"""Runs, attempts and health as aggregates and windows over the event ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ledger
from ..policy import POLICY
from ..sources.tables import table
from .presence import SEEN, generations, sightings
from .registry import query

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def n_if(when):
    return F.count(F.when(F.expr(when) if isinstance(when, str) else when, 1))


@query(f"SELECT CAST(ts AS DATE) AS run, count(*) AS requests, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed, count(DISTINCT {K}) AS discovered, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS saved, round(sum(CAST(round(value * 100) AS BIGINT)) / 100.0, 2) AS cost FROM events GROUP BY 1")
def run_counters(spark, d):
    """Counters of each day's run; cost is summed in whole cents, so the order of rows never shows."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    cost = F.round(F.sum(F.round(F.col("value") * 100).cast("long")) / 100.0, 2)
    return e.groupBy(F.to_date("ts").alias("run")).agg(F.count("*").alias("requests"), n_if("event_type = 'error'").alias("failed"), F.countDistinct(k).alias("discovered"), n_if("event_type = 'purchase'").alias("saved"), cost.alias("cost"))


#: A group's outcome, and a run's status over the outcomes of its groups: no run ends while work or processing is pending; then a wish to cancel
#: decides, whatever has succeeded before; a group that was never needed says nothing.
_OUTCOME = """CASE WHEN n_ok > 0 AND n_err = 0 THEN 'SATISFIED' WHEN n_ok > 0 THEN 'SATISFIED_PARTIAL' WHEN n_err > 0 THEN 'FAILED' WHEN n_denied > 0 THEN 'POLICY_DENIED' ELSE 'SKIPPED_NOT_NEEDED' END"""
_RUN = """CASE WHEN pending > 0 THEN 'RUNNING' WHEN cancelled > 0 THEN 'CANCELLED' WHEN satisfied + partial + failed = 0 OR partial + failed = 0 THEN 'SUCCEEDED' WHEN partial > 0 OR satisfied > 0 THEN 'PARTIAL' ELSE 'FAILED' END"""
_COUNTS = {
    "n_ok": "event_type IN ('click', 'purchase', 'view')", "n_err": "event_type = 'error'", "n_denied": "event_type = 'signup' AND {k} % 2 = 0", "n_cancel": "event_type = 'signup' AND {k} = 7", "n_pending": "event_type = 'view' AND {k} = 13"}


@query(f"""SELECT run, {_RUN} AS status, CASE WHEN pending > 0 THEN 'PENDING' ELSE 'DONE' END AS processing, n_groups, satisfied, partial, failed FROM (
  SELECT run, count(*) AS n_groups, count(CASE WHEN outcome = 'SATISFIED' THEN 1 END) AS satisfied, count(CASE WHEN outcome = 'SATISFIED_PARTIAL' THEN 1 END) AS partial, count(CASE WHEN outcome IN ('FAILED', 'POLICY_DENIED') THEN 1 END) AS failed,
    CAST(sum(n_cancel) AS BIGINT) AS cancelled, CAST(sum(n_pending) AS BIGINT) AS pending FROM (SELECT *, {_OUTCOME} AS outcome FROM (
    SELECT date_trunc('hour', ts) AS run, user_id, {', '.join(f"count(CASE WHEN {c.format(k=K)} THEN 1 END) AS {n}" for n, c in _COUNTS.items())} FROM events GROUP BY 1, 2)) GROUP BY 1)""")
def run_status(spark, d):
    """Each hour's run by the truth table over its groups (a user's hour), and beside it whether its evidence is processed."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    g = e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("run"), "user_id").agg(*[n_if(c.format(k="k")).alias(n) for n, c in _COUNTS.items()])
    outcome = F.expr(_OUTCOME)
    runs = g.withColumn("outcome", outcome).groupBy("run").agg(
        F.count("*").alias("n_groups"), n_if("outcome = 'SATISFIED'").alias("satisfied"), n_if("outcome = 'SATISFIED_PARTIAL'").alias("partial"), n_if("outcome in ('FAILED', 'POLICY_DENIED')").alias("failed"),
        F.sum("n_cancel").alias("cancelled"), F.sum("n_pending").alias("pending"))
    return runs.select("run", F.expr(_RUN).alias("status"), F.when(F.col("pending") > 0, "PENDING").otherwise("DONE").alias("processing"), "n_groups", "satisfied", "partial", "failed")


@query("""SELECT l_orderkey AS group_id, CASE WHEN best IS NOT NULL THEN 'SATISFIED' WHEN partial IS NOT NULL THEN 'SATISFIED_PARTIAL' ELSE 'FAILED' END AS outcome, coalesce(best, partial) AS winning_rank, ranks - coalesce(best, partial, ranks) AS not_needed FROM (
  SELECT l_orderkey, min(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN l_linenumber END) AS best, min(CASE WHEN l_returnflag = 'N' THEN l_linenumber END) AS partial, max(l_linenumber) AS ranks FROM lineitem GROUP BY 1)""")
def fallback_activation(spark, d):
    """The lowest rank that satisfies a group wins; ranks after it are never activated."""
    def least(when):
        return F.min(F.when(F.expr(when), F.col("l_linenumber")))

    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(least("l_returnflag = 'N' and l_linestatus = 'F'").alias("best"), least("l_returnflag = 'N'").alias("partial"), F.max("l_linenumber").alias("ranks"))
    outcome = F.when(F.col("best").isNotNull(), "SATISFIED").when(F.col("partial").isNotNull(), "SATISFIED_PARTIAL").otherwise("FAILED")
    return g.select(F.col("l_orderkey").alias("group_id"), outcome.alias("outcome"), F.coalesce("best", "partial").alias("winning_rank"), (F.col("ranks") - F.coalesce("best", "partial", "ranks")).alias("not_needed"))


_HEALTH = "CASE WHEN attempts < 3 THEN 'UNKNOWN' WHEN failures * 2 > attempts THEN 'BROKEN' WHEN failures * 4 > attempts THEN 'DEGRADED' ELSE 'HEALTHY' END"
BINDINGS = "(SELECT user_id AS binding_id, count(*) AS attempts, count(CASE WHEN event_type = 'error' THEN 1 END) AS failures, max(CASE WHEN event_type <> 'error' THEN ts END) AS last_success FROM events GROUP BY 1)"


def bindings(spark, d) -> DataFrame:
    last = F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("last_success")
    b = table(spark, d, "events").groupBy(F.col("user_id").alias("binding_id")).agg(F.count("*").alias("attempts"), n_if("event_type = 'error'").alias("failures"), last)
    return b.withColumn("state", F.expr(_HEALTH))


@query(f"SELECT *, {_HEALTH} AS state FROM {BINDINGS}")
def binding_health(spark, d):
    """Health from attempts; too few of them are UNKNOWN, and an empty result alone is never BROKEN."""
    return bindings(spark, d)


@query(f"""SELECT source_id, n_bindings, CASE WHEN healthy = n_bindings THEN 'HEALTHY' WHEN healthy > 0 THEN 'HEALTHY_WITH_DEGRADED_FALLBACK' WHEN degraded > 0 THEN 'DEGRADED' WHEN unknown = n_bindings THEN 'UNKNOWN' ELSE 'UNAVAILABLE' END AS state FROM (
  SELECT binding_id % 20 AS source_id, count(*) AS n_bindings, count(CASE WHEN state = 'HEALTHY' THEN 1 END) AS healthy, count(CASE WHEN state = 'DEGRADED' THEN 1 END) AS degraded, count(CASE WHEN state = 'UNKNOWN' THEN 1 END) AS unknown FROM (SELECT *, {_HEALTH} AS state FROM {BINDINGS}) GROUP BY 1)""")
def source_rollup(spark, d):
    s = bindings(spark, d).groupBy((F.col("binding_id") % 20).alias("source_id")).agg(F.count("*").alias("n_bindings"), n_if("state = 'HEALTHY'").alias("h"), n_if("state = 'DEGRADED'").alias("g"), n_if("state = 'UNKNOWN'").alias("u"))
    state = F.when(F.col("h") == F.col("n_bindings"), "HEALTHY").when(F.col("h") > 0, "HEALTHY_WITH_DEGRADED_FALLBACK").when(F.col("g") > 0, "DEGRADED").when(F.col("u") == F.col("n_bindings"), "UNKNOWN").otherwise("UNAVAILABLE")
    return s.select("source_id", "n_bindings", state.alias("state"))


#: Kinds of failure (fixed names), whether trying again may help, what they do to the source's health, and the dimension of health that they speak about.
#: What befalls the host, the worker or the user's own wish says nothing about a source.
_KINDS = [
    ("DNS_ERROR", True, "MAJOR", "CONNECTIVITY"), ("CONNECT_ERROR", True, "MINOR", "CONNECTIVITY"), ("TLS_ERROR", False, "MAJOR", "CONNECTIVITY"), ("TIMEOUT", True, "MINOR", "CONNECTIVITY"), ("HTTP_4XX", False, "MINOR", "CONTENT_VALIDITY"),
    ("HTTP_5XX", True, "MINOR", "CONNECTIVITY"), ("RATE_LIMIT", True, "MINOR", "RATE_LIMIT"), ("BLOCKED", False, "MAJOR", "CONTENT_VALIDITY"), ("CHALLENGE", False, "MAJOR", "CONTENT_VALIDITY"), ("AUTH_REQUIRED", False, "MAJOR", "AUTH"),
    ("CONSENT_INTERSTITIAL", False, "MINOR", "CONTENT_VALIDITY"), ("PARSE_MARKER_MISSING", False, "MAJOR", "EXTRACTION"), ("PARSE_EMPTY", False, "MINOR", "EXTRACTION"), ("PAGINATION_LOOP", False, "MINOR", "NAVIGATION"), ("DUPLICATE_PAGE", False, "MINOR", "NAVIGATION"),
    ("SOURCE_CHANGED", False, "MAJOR", "EXTRACTION"), ("INVALID_JOB_RECORD", False, "MINOR", "DATA_QUALITY"), ("NORMALIZATION_ERROR", False, "MINOR", "DATA_QUALITY"), ("BROWSER_CRASH", True, "NONE", None), ("WORKER_CRASH", True, "NONE", None), ("LEASE_LOST", True, "NONE", None),
    ("CANCELLED", False, "NONE", None), ("POLICY_REJECTED", False, "NONE", None),
]
FAILURES = [(i, *row) for i, row in enumerate(_KINDS)]
DIMENSIONS = ("CONNECTIVITY", "AUTH", "CONTENT_VALIDITY", "NAVIGATION", "EXTRACTION", "RATE_LIMIT", "DATA_QUALITY")
_FAILURES = "(VALUES " + ", ".join(f"({i}, '{n}', {str(r).lower()}, '{m}', {repr(x) if x else 'NULL'})" for i, n, r, m, x in FAILURES) + ") f(code, kind, retryable, impact, dimension)"


def failures(spark, d) -> DataFrame:
    """Failed events with what their kind says: a fixed table of as many rows as there are kinds."""
    kinds = spark.createDataFrame(FAILURES, "code long, kind string, retryable boolean, impact string, dimension string")
    e = table(spark, d, "events").filter("event_type = 'error'").select("user_id", (F.get_json_object("props", "$.k").cast("long") % len(FAILURES)).alias("code"))
    return e.join(F.broadcast(kinds), "code")


@query(f"SELECT kind, retryable, impact, count(*) AS n FROM events JOIN {_FAILURES} ON {K} % {len(FAILURES)} = code WHERE event_type = 'error' GROUP BY 1, 2, 3")
def failure_impact(spark, d):
    """Failures by kind; those of the host or the worker say nothing about a source."""
    return failures(spark, d).groupBy("kind", "retryable", "impact").agg(F.count("*").alias("n"))


_DIMENSION = "CASE WHEN attempts < 3 THEN 'UNKNOWN' WHEN failed * 4 > attempts THEN 'BROKEN' WHEN failed > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END"
#: The scalar state is the first that holds: what the user can mend, what waiting mends, then the worst dimension.
_OVERALL = {"NEEDS_LOGIN": "AUTH", "CHALLENGED": "CONTENT_VALIDITY", "RATE_LIMITED": "RATE_LIMIT"}
_SCALAR = "CASE WHEN attempts < 3 THEN 'UNKNOWN' " + " ".join(f"WHEN {d.lower()} = 'BROKEN' THEN '{s}'" for s, d in _OVERALL.items()) + " WHEN 'BROKEN' IN ({0}) AND {1} * 2 > attempts THEN 'BROKEN' WHEN 'BROKEN' IN ({0}) OR 'DEGRADED' IN ({0}) THEN 'DEGRADED' ELSE 'HEALTHY' END"
_SCALAR = _SCALAR.format(", ".join(x.lower() for x in DIMENSIONS), "failed_in_all")


@query(f"""WITH a AS (SELECT user_id AS binding_id, count(*) AS attempts FROM events GROUP BY 1), f AS (SELECT user_id AS binding_id, {', '.join(f"count(CASE WHEN dimension = '{x}' THEN 1 END) AS f_{x.lower()}" for x in DIMENSIONS)} FROM events JOIN {_FAILURES} ON {K} % {len(FAILURES)} = code WHERE event_type = 'error' GROUP BY 1),
s AS (SELECT binding_id, attempts, {' + '.join(f'coalesce(f_{x.lower()}, 0)' for x in DIMENSIONS)} AS failed_in_all, {', '.join(_DIMENSION.replace('failed', f'coalesce(f_{x.lower()}, 0)') + f' AS {x.lower()}' for x in DIMENSIONS)} FROM a LEFT JOIN f USING (binding_id))
SELECT binding_id, {_SCALAR} AS overall, {', '.join(x.lower() for x in DIMENSIONS)} FROM s""")
def health_dimensions(spark, d):
    """Seven dimensions of each binding's health, so that drift of a parser is not taken for a fault of the network, and the scalar state over them."""
    attempts = table(spark, d, "events").groupBy(F.col("user_id").alias("binding_id")).agg(F.count("*").alias("attempts"))
    failed = failures(spark, d).groupBy(F.col("user_id").alias("binding_id")).agg(*[n_if(F.col("dimension") == x).alias(f"f_{x.lower()}") for x in DIMENSIONS])
    rows = attempts.join(failed, "binding_id", "left").fillna(0, [f"f_{x.lower()}" for x in DIMENSIONS])
    rows = rows.withColumn("failed_in_all", F.expr(" + ".join(f"f_{x.lower()}" for x in DIMENSIONS)))
    rows = rows.withColumns({x.lower(): F.expr(_DIMENSION.replace("failed", f"f_{x.lower()}")) for x in DIMENSIONS})
    return rows.select("binding_id", F.expr(_SCALAR).alias("overall"), *[x.lower() for x in DIMENSIONS])


#: What answers a block, from waiting to the user; there is no step around it.
RESPONSES = {"TIMEOUT": "LOWER_LOAD", "RATE_LIMIT": "HONOUR_RETRY_AFTER", "BLOCKED": "COOL_DOWN", "CHALLENGE": "USER_ACTION", "AUTH_REQUIRED": "USER_LOGIN", "SOURCE_CHANGED": "REVIEW"}
_RESPONSE = "CASE " + " ".join(f"WHEN kind = '{k}' THEN '{v}'" for k, v in RESPONSES.items()) + " ELSE 'NONE' END"


@query(f"SELECT user_id AS source_id, response, count(*) AS n FROM (SELECT user_id, {_RESPONSE} AS response FROM events JOIN {_FAILURES} ON {K} % {len(FAILURES)} = code WHERE event_type = 'error') GROUP BY 1, 2")
def block_ladder(spark, d):
    """What answers a block: waiting, less load, review or the user; there is no way around it."""
    return failures(spark, d).groupBy(F.col("user_id").alias("source_id"), F.expr(_RESPONSE).alias("response")).agg(F.count("*").alias("n"))


TYPES = ("click", "error", "purchase", "signup", "view")


@query("SELECT CAST(ts AS DATE) AS day, " + ", ".join(f"count(CASE WHEN event_type = '{t}' THEN 1 END) AS \"{t}\"" for t in TYPES) + " FROM events GROUP BY 1")
def queue_depth(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(*[n_if(F.col("event_type") == t).alias(t) for t in TYPES])


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY 1, 2")
def rate_window(spark, d):
    """Requests in tumbling hours; streaming.windows has the same over a stream."""
    g = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "most")


@query("""SELECT user_id AS source_id, hour, count(CASE WHEN place <= 2 THEN 1 END) AS admitted, count(CASE WHEN place > 2 THEN 1 END) AS deferred FROM (
  SELECT user_id, date_trunc('hour', ts) AS hour, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_id) AS place FROM events) GROUP BY 1, 2""")
def capacity_admission(spark, d):
    """Priority, then age, up to the cap of a source's hour."""
    e = table(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    placed = e.withColumn("place", F.row_number().over(Window.partitionBy("user_id", "hour").orderBy(rank, "event_id")))
    return placed.groupBy(F.col("user_id").alias("source_id"), "hour").agg(n_if("place <= 2").alias("admitted"), n_if("place > 2").alias("deferred"))


@query("SELECT event_id, user_id, ts, old_end FROM (SELECT *, max(ts + to_microseconds(CAST(round(value * 1000) AS BIGINT) * 60000)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old_end FROM events) WHERE ts < old_end")
def lease_overlap_audit(spark, d):
    """Claims that begin while an earlier lease of the same request still runs."""
    end = F.col("ts") + F.make_dt_interval(secs=F.round(F.col("value") * 1000).cast("long").cast("decimal(18,6)") * F.lit(60).cast("decimal(6,0)") / F.lit(1000).cast("decimal(6,0)"))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "events").withColumn("old_end", F.max(end).over(w)).filter("ts < old_end").select("event_id", "user_id", "ts", "old_end")


@query(f"""SELECT event_id, attempt, delay_seconds, ts + to_seconds(delay_seconds) AS next_retry FROM (SELECT event_id, ts, attempt, least(3600, 30 * CAST(pow(2, least(attempt, 12) - 1) AS BIGINT)) + event_id % 7 AS delay_seconds FROM (
  SELECT event_id, ts, row_number() OVER (PARTITION BY user_id, {K} ORDER BY event_id) AS attempt FROM events WHERE event_type = 'error')) WHERE attempt <= 3""")
def retry_backoff(spark, d):
    """Doubling delays with a cap, spread by the identity of the attempt; beyond the budget there is no retry."""
    w = Window.partitionBy("user_id", F.get_json_object("props", "$.k").cast("long")).orderBy("event_id")
    e = table(spark, d, "events").filter("event_type = 'error'").select("event_id", "ts", F.row_number().over(w).cast("long").alias("attempt")).filter(F.col("attempt") <= POLICY.max_attempts)
    delay = F.least(F.lit(POLICY.backoff_cap_seconds), POLICY.backoff_base_seconds * F.pow(F.lit(2), F.col("attempt") - 1).cast("long")) + F.col("event_id") % 7
    return e.withColumn("delay_seconds", delay.cast("long")).select("event_id", "attempt", "delay_seconds", (F.col("ts") + F.make_dt_interval(secs=F.col("delay_seconds").cast("decimal(18,6)"))).alias("next_retry"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def processing_obligations(spark, d):
    """Accepted observations that nothing has processed yet."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query(f"""SELECT user_id AS source_id, count(*) AS pages, count(CASE WHEN k = old THEN 1 END) AS same_as_before, count(CASE WHEN seen > 1 THEN 1 END) AS seen_before, coalesce(bool_or(k = old OR seen > 3), false) AS loop FROM (
  SELECT user_id, k, lag(k) OVER (PARTITION BY user_id ORDER BY event_id) AS old, row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) AS seen FROM (SELECT *, {K} AS k FROM events)) GROUP BY 1""")
def cursor_loops(spark, d):
    """Cursors that stand still or come back."""
    e = table(spark, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    own = Window.partitionBy("user_id").orderBy("event_id")
    e = e.withColumn("old", F.lag("k").over(own)).withColumn("seen", F.row_number().over(Window.partitionBy("user_id", "k").orderBy("event_id")))
    loop = F.coalesce(F.max((F.col("k") == F.col("old")) | (F.col("seen") > 3)), F.lit(False))
    return e.groupBy(F.col("user_id").alias("source_id")).agg(F.count("*").alias("pages"), n_if("k = old").alias("same_as_before"), n_if("seen > 1").alias("seen_before"), loop.alias("loop"))


@query(f"""SELECT source_id, min(event_id) AS stop_at FROM (SELECT source_id, event_id, count(*) OVER (PARTITION BY source_id, island ORDER BY event_id) - CASE WHEN island > 0 THEN 1 ELSE 0 END AS run FROM (
  SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY event_id) AS island FROM (
    SELECT source_id, event_id, row_number() OVER (PARTITION BY source_id, k ORDER BY event_id) = 1 AS fresh FROM {SEEN}))) WHERE run >= 3 GROUP BY 1""")
def stop_policy(spark, d):
    """Where a source has shown nothing new for three pages running: the stop policy ends the walk there."""
    e = sightings(spark, d).select("source_id", "k", "event_id")
    e = e.withColumn("fresh", F.row_number().over(Window.partitionBy("source_id", "k").orderBy("event_id")) == 1)
    counted = ledger.streak(e, ["source_id"], ["event_id"], F.col("fresh"), "run")
    return counted.filter("run >= 3").groupBy("source_id").agg(F.min("event_id").alias("stop_at"))


@query("""SELECT user_id AS source_id, day, min(event_id) AS exhausted_at, count(*) AS rows_over FROM (
  SELECT user_id, CAST(ts AS DATE) AS day, event_id, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS spent FROM events) WHERE spent > 5000 GROUP BY 1, 2""")
def budget_exhaustion(spark, d):
    """The event at which a source's daily budget ran out."""
    e = table(spark, d, "events").select("user_id", "event_id", F.to_date("ts").alias("day"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    w = Window.partitionBy("user_id", "day").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("spent", F.sum("cents").over(w)).filter("spent > 5000").groupBy(F.col("user_id").alias("source_id"), "day").agg(F.min("event_id").alias("exhausted_at"), F.count("*").alias("rows_over"))


@query(f"SELECT user_id AS source_id, max(event_id) AS checkpoint, arg_max({K}, event_id) AS cursor, count(*) AS compatible FROM events WHERE {K} % 3 = 1 GROUP BY 1")
def cursor_resume(spark, d):
    """The latest checkpoint of a compatible cursor version; others are refused, not guessed at."""
    e = table(spark, d, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).filter("k % 3 = 1")
    return e.groupBy(F.col("user_id").alias("source_id")).agg(F.max("event_id").alias("checkpoint"), F.max_by("k", "event_id").alias("cursor"), F.count("*").alias("compatible"))


#: from, to: transitions that are legal (fixed values of the state machine).
LEGAL = [("signup", "view"), ("signup", "click"), ("view", "click"), ("view", "view"), ("click", "purchase"), ("click", "view"), ("error", "view"), ("view", "error"), ("click", "error")]


@query(f"""SELECT old, event_type, n, t.a IS NOT NULL AS legal FROM (SELECT old, event_type, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM events) WHERE old IS NOT NULL GROUP BY 1, 2)
LEFT JOIN (VALUES {', '.join(map(str, LEGAL))}) t(a, b) ON t.a = old AND t.b = event_type""")
def health_transitions(spark, d):
    """Counted transitions against the table of legal ones."""
    old = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    n = table(spark, d, "events").select("event_type", old.alias("old")).filter("old is not null").groupBy("old", "event_type").agg(F.count("*").alias("n"))
    legal = spark.createDataFrame(LEGAL, "old string, event_type string").withColumn("legal", F.lit(True))
    return n.join(F.broadcast(legal), ["old", "event_type"], "left").select("old", "event_type", "n", F.coalesce("legal", F.lit(False)).alias("legal"))


@query(f"SELECT user_id AS source_id, {K} AS k, first_end, count(*) AS after_end FROM (SELECT *, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id, {K}) AS first_end FROM events) WHERE event_id > first_end GROUP BY 1, 2, 3")
def terminal_absorbing(spark, d):
    """Requests on which anything happened after their terminal state."""
    e = table(spark, d, "events").select("event_id", "event_type", F.col("user_id").alias("source_id"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    end = e.filter("event_type = 'purchase'").groupBy("source_id", "k").agg(F.min("event_id").alias("first_end"))
    return e.join(end, ["source_id", "k"]).filter("event_id > first_end").groupBy("source_id", "k", "first_end").agg(F.count("*").alias("after_end"))


@query(f"""SELECT source_id, count(*) AS n, round(avg(CASE WHEN occurrence = 1 THEN 1.0 ELSE 0.0 END), 6) AS new_share, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS failed_share, round(avg(CASE WHEN occurrence > 1 AND old_type = event_type THEN 1.0 ELSE 0.0 END), 6) AS unchanged_share FROM (
  SELECT source_id, event_type, row_number() OVER w AS occurrence, lag(event_type) OVER w AS old_type FROM {SEEN} WINDOW w AS (PARTITION BY source_id, k ORDER BY event_id)) GROUP BY 1""")
def cadence_inputs(spark, d):
    """What decides how often a source is asked: shares of new, failed and unchanged results."""
    w = Window.partitionBy("source_id", "k").orderBy("event_id")
    e = sightings(spark, d).select("source_id", "event_type", F.row_number().over(w).alias("occurrence"), F.lag("event_type").over(w).alias("old_type"))

    def share(when):
        return F.round(F.avg(F.when(F.expr(when), 1.0).otherwise(0.0)), 6)

    return e.groupBy("source_id").agg(F.count("*").alias("n"), share("occurrence = 1").alias("new_share"), share("event_type = 'error'").alias("failed_share"), share("occurrence > 1 and old_type = event_type").alias("unchanged_share"))


@query("SELECT event_id, user_id AS stream, CASE WHEN ts < old THEN 'BACKWARD' ELSE 'FORWARD' END AS jump FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM events) WHERE ts < old OR ts > old + INTERVAL 20 HOUR")
def clock_anomaly(spark, d):
    """Jumps of a stream's clock that end the ownership of what it had claimed."""
    e = table(spark, d, "events").withColumn("old", F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id")))
    far = F.col("ts") > F.col("old") + F.expr("INTERVAL 20 HOURS")
    return e.filter((F.col("ts") < F.col("old")) | far).select("event_id", F.col("user_id").alias("stream"), F.when(F.col("ts") < F.col("old"), "BACKWARD").otherwise("FORWARD").alias("jump"))


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS peak FROM events GROUP BY 1")
def resource_percentiles(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.max("value").alias("peak"))


REVISIONS = "(SELECT o_custkey AS binding_id, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS revision FROM orders)"


def revisions(spark, d) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("binding_id"), "o_orderkey", "o_totalprice", F.row_number().over(w).cast("long").alias("revision"))


@query("SELECT o_custkey AS binding_id, count(*) AS revision, arg_max(o_totalprice, {'d': o_orderdate, 'k': o_orderkey}) AS config FROM orders GROUP BY 1")
def revision_current(spark, d):
    """The current revision of each binding: a maximum, not a sort."""
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("binding_id")).agg(F.count("*").alias("revision"), F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("config"))


@query(f"SELECT l.l_orderkey AS run_id, l.l_linenumber AS request, r.revision AS pinned, c.latest - r.revision AS behind FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) l JOIN {REVISIONS} r ON r.o_orderkey = l.l_orderkey JOIN (SELECT binding_id, max(revision) AS latest FROM {REVISIONS} GROUP BY 1) c USING (binding_id)")
def revision_pinned(spark, d):
    """A request keeps the revision that its run pinned, however many came after."""
    r = revisions(spark, d)
    latest = r.groupBy("binding_id").agg(F.max("revision").alias("latest"))
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("request")).distinct()
    pinned = r.join(latest, "binding_id").select("o_orderkey", F.col("revision").alias("pinned"), (F.col("latest") - F.col("revision")).alias("behind"))
    return l.join(pinned, F.col("run_id") == F.col("o_orderkey")).select("run_id", "request", "pinned", "behind")


#: source, first moment of its quarantine (fixed values).
QUARANTINE = [(3, "2024-01-05"), (8, "2024-01-10"), (17, "2024-01-02")]
_QUARANTINE = "(VALUES " + ", ".join(f"({s}, TIMESTAMP '{t}')" for s, t in QUARANTINE) + ") q(source_id, since)"


@query(f"SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN ts >= since THEN 'DENIED_QUARANTINE' WHEN event_type = 'signup' AND {K} > 90 THEN 'DENIED_PERMISSION' ELSE 'ACCEPTED' END AS verdict FROM events LEFT JOIN {_QUARANTINE} ON user_id = source_id) GROUP BY 1")
def plan_policy(spark, d):
    """The current quarantine overrides whatever a plan has pinned."""
    q = spark.createDataFrame(QUARANTINE, "source_id long, since string").select("source_id", F.col("since").cast("timestamp_ntz").alias("since"))
    e = table(spark, d, "events").join(F.broadcast(q), F.col("user_id") == F.col("source_id"), "left")
    verdict = F.when(F.col("ts") >= F.col("since"), "DENIED_QUARANTINE").when((F.col("event_type") == "signup") & (F.get_json_object("props", "$.k").cast("long") > 90), "DENIED_PERMISSION").otherwise("ACCEPTED")
    return e.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT event_id, ts, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 100")
def recent_events(spark, d):
    """The tail of the ledger."""
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type").orderBy(F.desc("event_id")).limit(100)


@query(f"SELECT source_id, generation, count(*) AS accepted, count(CASE WHEN event_id > cut THEN 1 END) AS after_cancel, count(CASE WHEN event_id <= cut THEN 1 END) AS still_processed FROM (SELECT *, min(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY source_id, generation) AS cut FROM {SEEN}) WHERE cut IS NOT NULL GROUP BY 1, 2")
def cancel_drain(spark, d):
    """What was accepted before a cancellation is still processed."""
    e = sightings(spark, d)
    cut = e.filter("event_type = 'signup'").groupBy("source_id", "generation").agg(F.min("event_id").alias("cut"))
    return e.join(cut, ["source_id", "generation"]).groupBy("source_id", "generation").agg(F.count("*").alias("accepted"), n_if("event_id > cut").alias("after_cancel"), n_if("event_id <= cut").alias("still_processed"))


@query(f"SELECT source_id, count(*) AS generations, count(CASE WHEN complete THEN 1 END) AS complete, max(CASE WHEN complete THEN generation END) AS last_complete FROM (SELECT source_id, generation, NOT bool_or(event_type = 'error') AS complete FROM {SEEN} GROUP BY 1, 2) GROUP BY 1")
def coverage_rollup(spark, d):
    g = generations(sightings(spark, d))
    done = F.col("n_errors") == 0
    return g.groupBy("source_id").agg(F.count("*").alias("generations"), F.count(F.when(done, 1)).alias("complete"), F.max(F.when(done, F.col("generation"))).alias("last_complete"))
