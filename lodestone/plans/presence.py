"""Presence over time: coverage generations, absence, availability, change classes and reposts.

A generation is a source's day of events; it is complete unless one of its events failed. Only complete generations say
that something was missing, and what failed is no sighting. Every state follows evidence time, never the order in which rows arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import coverage
from ..operators.ledger import written
from ..policy import POLICY
from ..sources.tables import table
from .registry import query

SEEN = "(SELECT event_id, ts, user_id AS source_id, CAST(ts AS DATE) AS generation, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


def sightings(spark, d) -> DataFrame:
    """Events as sightings of identity k by a source, in the generation of their day."""
    e = table(spark, d, "events")
    return e.select("event_id", "ts", F.col("user_id").alias("source_id"), F.to_date("ts").alias("generation"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


def accepted(seen: DataFrame) -> DataFrame:
    """Sightings proper: an event that failed shows nothing."""
    return seen.filter("event_type <> 'error'")


def flagged(seen: DataFrame) -> DataFrame:
    """(source_id, generation, complete) of all generations."""
    return generations(seen).select("source_id", "generation", (F.col("n_errors") == 0).alias("complete"))


def generations(seen: DataFrame) -> DataFrame:
    failed = F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0))
    return seen.groupBy("source_id", "generation").agg(F.countDistinct("k").alias("n_seen"), F.count("*").alias("n_pages"), failed.alias("n_errors"))


@query(f"SELECT source_id, generation, count(DISTINCT k) AS n_seen, count(*) AS n_pages, count(CASE WHEN event_type = 'error' THEN 1 END) = 0 AS complete FROM {SEEN} GROUP BY 1, 2")
def coverage_generations(spark, d):
    """Pages of a generation united; the barrier: complete only if nothing in it failed."""
    return generations(sightings(spark, d)).select("source_id", "generation", "n_seen", "n_pages", (F.col("n_errors") == 0).alias("complete"))


@query(f"SELECT source_id, generation, count(*) AS kept, count(CASE WHEN event_type = 'error' THEN 1 END) AS n_errors FROM {SEEN} GROUP BY 1, 2 HAVING bool_or(event_type = 'error')")
def partial_coverage(spark, d):
    """Partial generations keep what they saw and are barred from absence."""
    return generations(sightings(spark, d)).filter("n_errors > 0").select("source_id", "generation", F.col("n_pages").alias("kept"), "n_errors")


@query(f"""WITH s AS {SEEN}, g AS (SELECT source_id, generation FROM s GROUP BY 1, 2 HAVING NOT bool_or(event_type = 'error')),
l AS (SELECT source_id, max(generation) AS generation FROM g GROUP BY 1)
SELECT DISTINCT s.source_id, s.k, l.generation FROM s JOIN l ON s.source_id = l.source_id AND s.generation < l.generation
WHERE s.event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM s t WHERE t.source_id = s.source_id AND t.k = s.k AND t.generation = l.generation)""")
def absence_candidates(spark, d):
    """Identities that a source has shown before and that its last complete generation lacks."""
    seen = sightings(spark, d)
    last = generations(seen).filter("n_errors = 0").groupBy("source_id").agg(F.max("generation").alias("last"))
    # one row for each identity: its first sighting, and whether the last complete generation has it
    shown = accepted(seen).join(last, "source_id").groupBy("source_id", "k", "last").agg(F.min("generation").alias("first"), F.max((F.col("generation") == F.col("last")).cast("int")).alias("there"))
    return shown.filter("first < last and there = 0").select("source_id", "k", F.col("last").alias("generation"))


def state_of(misses: DataFrame) -> DataFrame:
    state = F.when(F.col("misses") == 0, "ACTIVE").when(F.col("misses") < POLICY.expire_after_misses, "UNCERTAIN").otherwise("EXPIRED")
    return misses.withColumn("state", state)


def presence(seen: DataFrame) -> DataFrame:
    """(source_id, k, last_seen, misses, state): misses are complete generations of the source after the last sighting."""
    return state_of(coverage.misses_since(accepted(seen), flagged(seen)))


PRESENCE_SQL = f"""WITH s AS {SEEN}, g AS (SELECT source_id, generation FROM s GROUP BY 1, 2 HAVING NOT bool_or(event_type = 'error')),
i AS (SELECT source_id, k, max(generation) AS last_seen FROM s WHERE event_type <> 'error' GROUP BY 1, 2),
m AS (SELECT i.source_id, i.k, i.last_seen, count(g.generation) AS misses FROM i LEFT JOIN g ON g.source_id = i.source_id AND g.generation > i.last_seen GROUP BY 1, 2, 3)
SELECT source_id, k, last_seen, misses, CASE WHEN misses = 0 THEN 'ACTIVE' WHEN misses < {POLICY.expire_after_misses} THEN 'UNCERTAIN' ELSE 'EXPIRED' END AS state FROM m"""


@query(PRESENCE_SQL)
def presence_state(spark, d):
    return presence(sightings(spark, d))


@query(PRESENCE_SQL)
def replay_idempotent(spark, d):
    """Generations applied in three batches, the later half before the earlier, and then once more: the ledger of what was applied leaves nothing of the third."""
    seen = written(sightings(spark, d), "sightings")
    whole = flagged(seen)
    half = F.to_date(F.lit("2024-01-16"))
    last = done = None
    for part in (F.col("generation") >= half, F.col("generation") < half, F.col("generation") >= half):
        last, done = coverage.applied(last, done, accepted(seen).filter(part), whole.filter(part))
    return state_of(coverage.misses_since(last, done))


#: How far a source's word reaches, what it declares, and when its run was invalidated: functions of its number, as a binding's contract would say.
_CONTRACT = "CASE WHEN source_id % 5 = 0 THEN 'NON_AUTHORITATIVE_QUERY' WHEN source_id % 5 = 1 THEN 'AUTHORITATIVE_DECLARED_SCOPE' ELSE 'AUTHORITATIVE_FULL_SOURCE' END"


@query(f"""WITH g AS (SELECT source_id, generation, count(CASE WHEN event_type = 'error' THEN 1 END) > 0 AS failed, bool_or(event_type = 'error' AND k % 10 = 0) AS challenged, bool_or(event_type = 'signup' AND k % 10 = 1) AS cancelled, count(*) > 8 AS exhausted,
  arg_max(event_type, event_id) IN ('signup', 'purchase') AS terminal, bool_or(event_type = 'view' AND k % 10 = 2) AS pending, {_CONTRACT} AS authority FROM {SEEN} GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN cancelled THEN 'CANCELLED' WHEN failed AND NOT terminal THEN 'FAILED' WHEN exhausted THEN 'BUDGET_EXHAUSTED' WHEN failed OR pending THEN 'PARTIAL' WHEN terminal THEN 'COMPLETE' ELSE 'UNKNOWN' END AS state FROM g)
SELECT source_id, generation, state, authority, CASE WHEN state <> 'COMPLETE' THEN 'NOT_COMPLETE' WHEN authority = 'NON_AUTHORITATIVE_QUERY' THEN 'NO_AUTHORITY' WHEN source_id % 7 = 0 THEN 'INFERENCE_OFF' WHEN authority = 'AUTHORITATIVE_DECLARED_SCOPE' AND source_id % 3 = 0 THEN 'OTHER_SCOPE' WHEN challenged THEN 'INVALIDATED' END AS barred FROM c""")
def absence_admissibility(spark, d):
    """Each generation through the barrier and the five conditions: its state, and the first thing that bars it from speaking of absence."""
    seen = sightings(spark, d)

    def some(condition):
        return F.max(F.expr(condition))

    g = seen.groupBy("source_id", "generation").agg(
        some("event_type = 'error'").alias("failed"), some("event_type = 'error' and k % 10 = 0").alias("challenged"), some("event_type = 'signup' and k % 10 = 1").alias("cancelled"), (F.count("*") > 8).alias("exhausted"),
        F.max_by("event_type", "event_id").isin("signup", "purchase").alias("terminal"), some("event_type = 'view' and k % 10 = 2").alias("pending"))
    named = g.withColumn("authority", F.expr(_CONTRACT)).withColumn("state", coverage.completion(F.col("failed"), F.col("cancelled"), F.col("exhausted"), F.col("terminal"), F.col("pending")))
    in_scope = (F.col("authority") != "AUTHORITATIVE_DECLARED_SCOPE") | (F.col("source_id") % 3 != 0)
    return named.select("source_id", "generation", "state", "authority", coverage.inadmissible(F.col("state"), F.col("authority"), F.col("source_id") % 7 != 0, in_scope, F.col("challenged")).alias("barred"))


@query(f"""WITH s AS {SEEN}, i AS (SELECT source_id, k, min(event_type) AS scope_key, max(generation) AS last_seen FROM s WHERE event_type <> 'error' GROUP BY 1, 2),
c AS (SELECT source_id, generation FROM s GROUP BY 1, 2 HAVING NOT bool_or(event_type = 'error')),
g AS (SELECT DISTINCT s.source_id, s.event_type AS scope_key, s.generation FROM s JOIN c USING (source_id, generation))
SELECT i.source_id, i.k, i.scope_key, count(g.generation) AS misses FROM i LEFT JOIN g ON g.source_id = i.source_id AND g.scope_key = i.scope_key AND g.generation > i.last_seen GROUP BY 1, 2, 3""")
def scope_membership(spark, d):
    """A miss counts only in generations that cover the identity's recorded scope."""
    seen = sightings(spark, d)
    whole = generations(seen).filter("n_errors = 0").select("source_id", "generation")
    covered = seen.join(whole, ["source_id", "generation"], "left_semi").groupBy("source_id", F.col("event_type").alias("scope_key")).agg(F.collect_set("generation").alias("days"))
    known = seen.filter("event_type <> 'error'").groupBy("source_id", "k").agg(F.min("event_type").alias("scope_key"), F.max("generation").alias("last_seen"))
    missed = F.when(F.col("days").isNull(), 0).otherwise(F.size(F.filter("days", lambda day: day > F.col("last_seen"))))
    return known.join(covered, ["source_id", "scope_key"], "left").select("source_id", "k", "scope_key", missed.cast("long").alias("misses"))


@query(f"""WITH s AS {SEEN}, a AS (SELECT DISTINCT source_id, generation, k FROM s WHERE event_id % 2 = 0), b AS (SELECT DISTINCT source_id, generation, k FROM s WHERE event_id % 2 = 1)
SELECT coalesce(a.source_id, b.source_id) AS source_id, coalesce(a.generation, b.generation) AS generation, count(*) AS n_union, count(CASE WHEN a.k = b.k THEN 1 END) AS n_both
FROM a FULL JOIN b ON a.source_id = b.source_id AND a.generation = b.generation AND a.k = b.k GROUP BY 1, 2""")
def page_union(spark, d):
    """Two pages of a generation united: what both list counts once."""
    pages = sightings(spark, d).groupBy("source_id", "generation", "k").agg(F.countDistinct(F.pmod("event_id", F.lit(2))).alias("pages"))
    return pages.groupBy("source_id", "generation").agg(F.count("*").alias("n_union"), F.count(F.when(F.col("pages") > 1, 1)).alias("n_both"))


STATE = "CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'CLOSED' WHEN l_linestatus = 'O' THEN 'ACTIVE' ELSE 'EXPIRED' END"


def evidence(spark, d) -> DataFrame:
    """Source presences of jobs as dated evidence."""
    state = F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R"), "CLOSED").when(F.col("l_linestatus") == "O", "ACTIVE").otherwise("EXPIRED")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("job_id"), F.col("l_suppkey").alias("source_id"), F.col("l_shipdate").alias("at"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), state.alias("state"))


@query(f"""WITH e AS (SELECT l_partkey AS job_id, l_suppkey AS source_id, l_shipdate AS seen_at, {STATE} AS state, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, {STATE} DESC) AS rn FROM lineitem),
p AS (SELECT *, source_id % 4 < 3 AS trusted FROM e WHERE rn = 1), t AS (SELECT max(seen_at) AS today FROM e),
j AS (SELECT job_id, max(CASE WHEN trusted AND state = 'CLOSED' THEN seen_at END) AS closed_at, max(CASE WHEN trusted AND state = 'ACTIVE' THEN seen_at END) AS active_at, count(CASE WHEN trusted THEN 1 END) AS n_trusted, count(CASE WHEN trusted AND state = 'EXPIRED' THEN 1 END) AS n_expired FROM p GROUP BY 1)
SELECT job_id, CASE WHEN closed_at IS NOT NULL AND (active_at IS NULL OR closed_at > active_at) THEN 'CLOSED' WHEN active_at >= today - INTERVAL {POLICY.presence_fresh_days} DAY THEN 'ACTIVE' WHEN n_trusted > 0 AND n_trusted = n_expired THEN 'EXPIRED' ELSE 'UNCERTAIN' END AS state,
  closed_at IS NOT NULL AND active_at IS NOT NULL AS conflict FROM j, t""")
def availability(spark, d):
    """The state of a job over its sources: untrusted sources never close it, the newest trusted evidence decides."""
    e = evidence(spark, d)
    own = e.groupBy("job_id", "source_id").agg(F.max(F.struct("at", "o", "n", "state")).alias("e")).select("job_id", (F.col("source_id") % 4 < 3).alias("trusted"), "e.at", "e.state")
    today = e.agg(F.max("at").alias("today"))  # one row

    def last(state):
        return F.max(F.when(F.col("trusted") & (F.col("state") == state), F.col("at")))

    j = own.groupBy("job_id").agg(last("CLOSED").alias("closed_at"), last("ACTIVE").alias("active_at"), F.count(F.when(F.col("trusted"), 1)).alias("n_trusted"), F.count(F.when(F.col("trusted") & (F.col("state") == "EXPIRED"), 1)).alias("n_expired"))
    closed = F.col("closed_at").isNotNull() & (F.col("active_at").isNull() | (F.col("closed_at") > F.col("active_at")))
    fresh = F.col("active_at") >= F.col("today") - F.expr(f"INTERVAL {POLICY.presence_fresh_days} DAYS")
    state = F.when(closed, "CLOSED").when(fresh, "ACTIVE").when((F.col("n_trusted") > 0) & (F.col("n_trusted") == F.col("n_expired")), "EXPIRED").otherwise("UNCERTAIN")
    return j.join(F.broadcast(today)).select("job_id", state.alias("state"), (F.col("closed_at").isNotNull() & F.col("active_at").isNotNull()).alias("conflict"))


@query(f"SELECT job_id, state, seen_at AS evidence_at FROM (SELECT l_partkey AS job_id, {STATE} AS state, l_shipdate AS seen_at, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, {STATE} DESC) AS rn FROM lineitem) WHERE rn = 1")
def evidence_order_projection(spark, d):
    """Older evidence never overwrites newer, whatever order it comes in: a maximum, so partial aggregates do."""
    best = evidence(spark, d).groupBy("job_id").agg(F.max(F.struct("at", "o", "n", "source_id", "state")).alias("e"))
    return best.select("job_id", "e.state", F.col("e.at").alias("evidence_at"))


CHANGES = """SELECT CASE WHEN old IS NULL THEN 'NEW' WHEN old = new THEN 'UNCHANGED' WHEN old.q = new.q AND old.p = new.p THEN 'COSMETIC' WHEN old.q <> new.q AND old.p <> new.p THEN 'MATERIAL' ELSE 'CONTENT' END AS class, count(*) AS n
FROM (SELECT new, lag(new) OVER (PARTITION BY job_id ORDER BY seen_at, o, n, s, new.q, new.p, new.d) AS old FROM (SELECT l_partkey AS job_id, l_shipdate AS seen_at, l_orderkey AS o, l_linenumber AS n, l_suppkey AS s, {'q': floor(l_quantity / 10), 'p': floor(l_extendedprice / 20000), 'd': l_discount} AS new FROM lineitem)) GROUP BY 1"""


@query(CHANGES)
def change_classes(spark, d):
    """Each version of a job against the one before."""
    new = F.struct(F.floor(F.col("l_quantity") / 10).alias("q"), F.floor(F.col("l_extendedprice") / 20000).alias("p"), F.col("l_discount").alias("d"))
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("job_id"), F.col("l_shipdate").alias("at"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"), new.alias("new"))
    w = Window.partitionBy("job_id").orderBy("at", "o", "n", "s", "new")
    same_q, same_p = F.col("old.q") == F.col("new.q"), F.col("old.p") == F.col("new.p")
    cls = F.when(F.col("old").isNull(), "NEW").when(F.col("old") == F.col("new"), "UNCHANGED").when(same_q & same_p, "COSMETIC").when(~same_q & ~same_p, "MATERIAL").otherwise("CONTENT")
    return rows.withColumn("old", F.lag("new").over(w)).groupBy(cls.alias("class")).agg(F.count("*").alias("n"))


@query("""SELECT source_id, month, n, n_changed, n_changed >= 0.5 * n AND n >= 5 AS template_change FROM (
  SELECT source_id, month, count(*) AS n, count(CASE WHEN old IS DISTINCT FROM new AND old IS NOT NULL THEN 1 END) AS n_changed FROM (
    SELECT l_suppkey AS source_id, date_trunc('month', l_shipdate) AS month, l_linestatus AS new, lag(l_linestatus) OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_linestatus) AS old FROM lineitem) GROUP BY 1, 2)""")
def template_change(spark, d):
    """A source of which half of the pages change at once has a new template, not new content."""
    w = Window.partitionBy("l_suppkey", "l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_linestatus")
    rows = table(spark, d, "lineitem").withColumn("old", F.lag("l_linestatus").over(w))
    changed = F.count(F.when(F.col("old").isNotNull() & (F.col("old") != F.col("l_linestatus")), 1))
    g = rows.groupBy(F.col("l_suppkey").alias("source_id"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"), changed.alias("n_changed"))
    return g.withColumn("template_change", (F.col("n_changed") >= POLICY.template_change_share * F.col("n")) & (F.col("n") >= 5))


@query(f"""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'NON_AUTHORITATIVE' WHEN old_at IS NULL THEN 'NO_REPRESENTATION' WHEN old_type <> event_type THEN 'VARIANT_DIFFERS' WHEN ts - old_at <= INTERVAL 7 DAY THEN 'MEMBERS_SEEN' ELSE 'REFETCH' END AS verdict
  FROM (SELECT event_type, ts, lag(ts) OVER w AS old_at, lag(event_type) OVER w AS old_type FROM {SEEN} WINDOW w AS (PARTITION BY source_id, k ORDER BY event_id))) GROUP BY 1""")
def revalidation_304(spark, d):
    """Whether an unchanged answer may stand for the retained page: only for the same variant, and not too old."""
    w = Window.partitionBy("source_id", "k").orderBy("event_id")
    e = sightings(spark, d).select("event_type", "ts", F.lag("ts").over(w).alias("old_at"), F.lag("event_type").over(w).alias("old_type"))
    recent = F.col("ts") <= F.col("old_at") + F.expr("INTERVAL 7 DAYS")
    verdict = F.when(F.col("event_type") == "error", "NON_AUTHORITATIVE").when(F.col("old_at").isNull(), "NO_REPRESENTATION").when(F.col("old_type") != F.col("event_type"), "VARIANT_DIFFERS").when(recent, "MEMBERS_SEEN").otherwise("REFETCH")
    return e.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query(f"""SELECT job_id, source_id, old_at AS closed_at, seen_at AS reopened_at FROM (SELECT *, lag(seen_at) OVER w AS old_at, lag(state) OVER w AS old_state FROM (SELECT l_partkey AS job_id, l_suppkey AS source_id, l_shipdate AS seen_at, l_orderkey AS o, l_linenumber AS n, {STATE} AS state FROM lineitem)
  WINDOW w AS (PARTITION BY job_id, source_id ORDER BY seen_at, o, n, state)) WHERE old_state = 'CLOSED' AND state = 'ACTIVE'""")
def repost_links(spark, d):
    """A job that a source closed and later shows again is linked to its earlier posting, not merged into it."""
    w = Window.partitionBy("job_id", "source_id").orderBy("at", "o", "n", "state")
    e = evidence(spark, d).select("*", F.lag("at").over(w).alias("closed_at"), F.lag("state").over(w).alias("old"))
    return e.filter("old = 'CLOSED' and state = 'ACTIVE'").select("job_id", "source_id", "closed_at", F.col("at").alias("reopened_at"))


@query(f"""WITH s AS {SEEN}, g AS (SELECT source_id, generation, NOT bool_or(event_type = 'error') AS complete FROM s GROUP BY 1, 2), i AS (SELECT source_id, k, min(generation) AS first FROM s WHERE event_type <> 'error' GROUP BY 1, 2),
r AS (SELECT i.source_id, i.k, g.generation, g.complete, x.k IS NOT NULL AS seen FROM i JOIN g ON g.source_id = i.source_id AND g.generation >= i.first
  LEFT JOIN (SELECT DISTINCT source_id, k, generation FROM s WHERE event_type <> 'error') x ON x.source_id = i.source_id AND x.k = i.k AND x.generation = g.generation),
n AS (SELECT *, sum(CASE WHEN seen THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, k ORDER BY generation) AS run FROM r),
m AS (SELECT *, sum(CASE WHEN complete AND NOT seen THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, k, run ORDER BY generation) AS misses FROM n)
SELECT source_id, generation, k, CAST(misses AS BIGINT) AS misses FROM m WHERE complete AND NOT seen AND misses = {POLICY.expire_after_misses}""")
def consecutive_misses(spark, d):
    """The complete generation in which an identity was missing for the third time running, by differences of numbers."""
    seen = sightings(spark, d)
    return coverage.nth_misses(accepted(seen), flagged(seen), POLICY.expire_after_misses)
