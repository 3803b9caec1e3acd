"""Eligibility, scores, inbox rules and their versions. Profiles and decision tables are data; every job meets every profile by explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .registry import query
from .workflow import ACTIONS, K, actions

#: Profiles: id, least score, wanted word of the type, least level, least pay (hard), preferred pay (soft).
PROFILES = [(0, 20, "ECONOMY", 5, 900.0, 950.0), (1, 10, "PROMO", 10, 0.0, 1000.0), (2, 0, "STANDARD", 1, 905.0, 1200.0)]
_P = "(VALUES " + ", ".join(f"({i}, {s}, '{w}', {lv}, CAST({h} AS DOUBLE), CAST({p} AS DOUBLE))" for i, s, w, lv, h, p in PROFILES) + ") p(profile_id, min_score, word, min_level, hard_pay, soft_pay)"
PAY = "CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END"


def pairs(spark, d) -> DataFrame:
    """Every job with every profile: profiles are a literal array, so nothing is joined or shuffled."""
    names = ("profile_id", "min_score", "word", "min_level", "hard_pay", "soft_pay")
    profiles = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(p, names)]) for p in PROFILES])
    pay = F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice"))
    jobs = table(spark, d, "part").select(F.col("p_partkey").alias("job_id"), "p_type", "p_size", "p_brand", pay.alias("pay"))
    return jobs.select("*", F.explode(profiles).alias("p")).select("job_id", "p_type", "p_size", "p_brand", "pay", "p.*")


#: Rules: name, points, SQL condition on a pair.
RULES = [
    ("type", 20, "p_type = word"), ("level", 15, "p_size >= min_level"), ("pay", 10, "pay >= soft_pay"), ("brand", 8, "p_brand LIKE '%1'"),
    ("unknown_pay", -8, "pay IS NULL"), ("junior", -12, "p_size < 3"),
]
_SCORE = " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for _, n, c in RULES)
_LIST = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{r}:{n}' END" for r, n, c in RULES) + "], lambda x: x IS NOT NULL), ',')"
JOBS = f"(SELECT p_partkey AS job_id, p_type, p_size, p_brand, {PAY} AS pay, p.* FROM part, {_P})"


def score() -> Column:
    return F.expr(_SCORE)


@query(f"SELECT profile_id, p_type, count(*) AS n FROM {JOBS} GROUP BY 1, 2")
def job_profile_matrix(spark, d):
    return pairs(spark, d).groupBy("profile_id", "p_type").agg(F.count("*").alias("n"))


@query(f"SELECT job_id, profile_id, CAST({_SCORE} AS BIGINT) AS score, {_LIST} AS contributions FROM {JOBS}")
def score_breakdown(spark, d):
    """Additive points with what each rule gave, in the order of the rules."""
    hits = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(f"{r}:{n}")) for r, n, c in RULES]))
    return pairs(spark, d).select("job_id", "profile_id", score().cast("long").alias("score"), F.array_join(hits, ",").alias("contributions"))


@query(f"SELECT profile_id, count(*) AS n, count(CASE WHEN pay IS NULL OR pay >= hard_pay THEN 1 END) AS kept, count(CASE WHEN pay < hard_pay THEN 1 END) AS excluded, count(CASE WHEN pay IS NULL THEN 1 END) AS unknown_kept, count(CASE WHEN pay >= soft_pay THEN 1 END) AS preferred FROM {JOBS} GROUP BY 1")
def hard_vs_soft_filter(spark, d):
    """Unknown pay lowers a score and never excludes; a preference never excludes either."""
    def n(when):
        return F.count(F.when(F.expr(when), 1))

    return pairs(spark, d).groupBy("profile_id").agg(F.count("*").alias("n"), n("pay IS NULL OR pay >= hard_pay").alias("kept"), n("pay < hard_pay").alias("excluded"), n("pay IS NULL").alias("unknown_kept"), n("pay >= soft_pay").alias("preferred"))


#: Evaluations of a later revision of a profile give so many points more for the same job.
EDIT_POINTS = 5


@query(f"""WITH r AS (SELECT profile_id, 1 + count(event_id) % 3 AS current FROM (SELECT CAST(i AS INTEGER) AS profile_id FROM unnest(generate_series(0, {len(PROFILES) - 1})) AS s(i)) p LEFT JOIN events ON user_id % 5 = profile_id AND event_type = 'signup' GROUP BY 1)
SELECT j.job_id, j.profile_id, r.current AS revision, CAST({_SCORE} + {EDIT_POINTS} * (r.current - 1) AS BIGINT) AS score, r.current - 1 AS n_older FROM {JOBS} j JOIN r ON r.profile_id = j.profile_id""")
def score_versions(spark, d):
    """A profile's edits (signups of its users) add evaluations of the new revision; those of older ones stay beside them, and the ledger says which is current."""
    edits = table(spark, d, "events").filter("event_type = 'signup'").groupBy((F.col("user_id") % 5).cast("int").alias("profile_id")).agg(F.count("*").alias("n"))
    profiles = spark.createDataFrame([(p[0],) for p in PROFILES], "profile_id int")
    current = profiles.join(edits, "profile_id", "left").select("profile_id", (1 + F.coalesce("n", F.lit(0)) % 3).alias("current"))
    # dealt by job, so that no task that reads a file holds all of its keys; sums are of fixed width, so nothing is sorted
    dealt = pairs(spark, d).select("job_id", "profile_id", score().alias("score")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "job_id")
    rows = dealt.join(F.broadcast(current), "profile_id")  # as many rows as profiles
    ledger = rows.withColumn("revision", F.explode(F.sequence(F.lit(1).cast("long"), F.col("current"))))
    evaluated = ledger.withColumn("score", (F.col("score") + EDIT_POINTS * (F.col("revision") - 1)).cast("long"))
    newest = evaluated.groupBy("job_id", "profile_id").agg(F.max("revision").alias("newest"), F.max_by("score", "revision").alias("score"), (F.count("*") - 1).alias("n_older"))
    return newest.select("job_id", "profile_id", F.col("newest").alias("revision"), "score", "n_older")


#: Rules of eligibility, versioned: what a profile says of regions, and the hours from UTC that it can work in.
ELIGIBILITY_VERSION = 2
_ELIGIBILITY = [(0, ["EUROPE", "AMERICA"], [], -1, 3), (1, [], ["ASIA"], 5, 10), (2, [], [], None, None)]
_ELIGIBILITY_SQL = "(VALUES " + ", ".join(f"({i}, {a}, {b}, {lo if lo is not None else 'CAST(NULL AS INTEGER)'}, {hi if hi is not None else 'CAST(NULL AS INTEGER)'})" for i, a, b, lo, hi in _ELIGIBILITY).replace("[]", "CAST([] AS VARCHAR[])") + ") p(profile_id, allowed, excluded, low, high)"
#: Hours that a place is away from a profile's; beyond FAR_HOURS that speaks against it.
FAR_HOURS = 6
_AWAY = "greatest(low - utc, utc - high, 0)"
_VERDICT = {
    "contains_excluded": ("INELIGIBLE", "REGION_EXCLUDED", 1.0), "contains_allowed": ("ELIGIBLE", "REGION_LISTED", 1.0), "low IS NULL": ("UNCLEAR", "NO_EVIDENCE", 0.0),
    f"{_AWAY} = 0": ("LIKELY", "TIMEZONE_OVERLAP", 0.6), f"{_AWAY} >= {FAR_HOURS}": ("UNLIKELY", "TIMEZONE_FAR", 0.6),
}


def _verdict(part: int, has: str) -> str:
    cases = " ".join(f"WHEN {c.replace('contains_excluded', has.format('excluded')).replace('contains_allowed', has.format('allowed'))} THEN {v[part]!r}" for c, v in _VERDICT.items())
    return f"CASE {cases} ELSE {('UNCLEAR', 'TIMEZONE_NEAR', 0.3)[part]!r} END"


@query(f"""SELECT profile_id, {_verdict(0, 'list_contains({}, r_name)')} AS verdict, {_verdict(1, 'list_contains({}, r_name)')} AS reason, CAST({_verdict(2, 'list_contains({}, r_name)')} AS DOUBLE) AS confidence, {ELIGIBILITY_VERSION} AS rule_version, count(*) AS n
FROM (SELECT r_name, CAST(n_nationkey % 24 - 11 AS INTEGER) AS utc FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), {_ELIGIBILITY_SQL} GROUP BY 1, 2, 3, 4""")
def eligibility_verdict(spark, d):
    """Exclusion, then inclusion, then the weak evidence of time zones, each with a reason, confidence and the version of the rules; without evidence a verdict is UNCLEAR."""
    places = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed dimensions of a few rows
    rules = F.explode(F.array(*[F.struct(F.lit(i).alias("profile_id"), F.lit(a).cast("array<string>").alias("allowed"), F.lit(b).cast("array<string>").alias("excluded"), F.lit(lo).cast("int").alias("low"), F.lit(hi).cast("int").alias("high")) for i, a, b, lo, hi in _ELIGIBILITY]))
    rows = table(spark, d, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", (F.col("n_nationkey") % 24 - 11).cast("int").alias("utc"), rules.alias("p")).select("r_name", "utc", "p.*")
    verdict, reason, confidence = (F.expr(_verdict(part, "array_contains({}, r_name)")) for part in range(3))
    return rows.groupBy("profile_id", verdict.alias("verdict"), reason.alias("reason"), confidence.cast("double").alias("confidence")).agg(F.count("*").alias("n")).withColumn("rule_version", F.lit(ELIGIBILITY_VERSION))


DISPOSITION = "CASE last_action WHEN 'click' THEN 'SHORTLISTED' WHEN 'error' THEN 'DISMISSED' WHEN 'view' THEN 'SNOOZED' WHEN 'purchase' THEN 'ARCHIVED' ELSE 'NONE' END"
LATEST = f"(SELECT job_id, profile AS profile_id, arg_max(event_type, event_id) AS last_action, max(event_id) AS event_id, max(ts) AS last_at FROM {ACTIONS} GROUP BY 1, 2)"


def dispositions(spark, d) -> DataFrame:
    a = actions(spark, d).groupBy("job_id", F.col("profile").cast("int").alias("profile_id")).agg(F.max_by("event_type", "event_id").alias("last_action"), F.max("event_id").alias("event_id"), F.max("ts").alias("last_at"))
    return a.select("job_id", "profile_id", F.expr(DISPOSITION).alias("disposition"), "event_id", "last_at")


#: Days that a snooze lasts.
SNOOZE_DAYS = 7


@query(f"""SELECT job_id, profile_id, CAST(score AS BIGINT) AS score, disposition FROM (
  SELECT j.job_id, j.profile_id, min_score, {_SCORE} AS score, coalesce({DISPOSITION}, 'NONE') AS disposition, p_size, last_at FROM {JOBS} j LEFT JOIN {LATEST} a ON a.job_id = j.job_id AND a.profile_id = j.profile_id)
WHERE score >= min_score AND p_size >= 3 AND disposition NOT IN ('DISMISSED', 'ARCHIVED') AND (disposition <> 'SNOOZED' OR last_at <= (SELECT max(ts) FROM events) - INTERVAL {SNOOZE_DAYS} DAY)""")
def inbox_predicate(spark, d):
    """The five conjuncts: score, eligibility, not dismissed, not archived, no unexpired snooze."""
    rows = pairs(spark, d).select("job_id", "profile_id", "min_score", "p_size", score().alias("score")).filter("score >= min_score and p_size >= 3")
    own = rows.join(dispositions(spark, d), ["job_id", "profile_id"], "left").withColumn("disposition", F.coalesce("disposition", F.lit("NONE")))
    now = table(spark, d, "events").agg(F.max("ts").alias("now"))  # one row
    expired = F.col("last_at") <= F.col("now") - F.expr(f"INTERVAL {SNOOZE_DAYS} DAYS")
    kept = own.join(F.broadcast(now)).filter(F.col("disposition").isin("NONE", "SHORTLISTED") | ((F.col("disposition") == "SNOOZED") & expired))
    return kept.select("job_id", "profile_id", F.col("score").cast("long").alias("score"), "disposition")


#: disposition found, trigger: what an event does (fixed values of the transition table). EMIT needs the inbox predicate and counts once for its key.
DECISIONS = [
    *[(found, "ORDINARY", "EMIT") for found in ("NONE", "SHORTLISTED")], *[(found, "SNOOZE_EXPIRY", "NOT_APPLICABLE") for found in ("NONE", "SHORTLISTED")], *[(found, "PROFILE_ELIGIBLE", "EMIT_FIRST") for found in ("NONE", "SHORTLISTED")],
    ("SNOOZED", "ORDINARY", "COALESCE"), ("SNOOZED", "SNOOZE_EXPIRY", "EMIT_EXPIRY"), ("SNOOZED", "PROFILE_ELIGIBLE", "SUPPRESS"),
    ("DISMISSED", "ORDINARY", "SUPPRESS"), ("DISMISSED", "SNOOZE_EXPIRY", "NOT_APPLICABLE"), ("DISMISSED", "PROFILE_ELIGIBLE", "SUPPRESS"),
    ("ARCHIVED", "ORDINARY", "SUPPRESS"), ("ARCHIVED", "SNOOZE_EXPIRY", "NOT_APPLICABLE"), ("ARCHIVED", "PROFILE_ELIGIBLE", "SUPPRESS"),
]
#: A day before is the snooze's end: the first event a day or more after a snooze is its expiry; a signup is a new revision of the profile.
TRIGGER = "CASE WHEN last_action = 'view' AND waited THEN 'SNOOZE_EXPIRY' WHEN event_type = 'signup' THEN 'PROFILE_ELIGIBLE' ELSE 'ORDINARY' END"
#: What identifies a trigger beside job, profile and kind: the snooze that ends, the profile's revision, or the day's content.
OCCURRENCE = "CASE trigger_kind WHEN 'SNOOZE_EXPIRY' THEN 's' || last_id WHEN 'PROFILE_ELIGIBLE' THEN 'p' ELSE 'd' || day END"
PASSES = "value >= 10"
_BEFORE = f"""(SELECT *, lag(event_type) OVER w AS last_action, lag(event_id) OVER w AS last_id, ts >= lag(ts) OVER w + INTERVAL 1 DAY AS waited, CAST(CAST(ts AS DATE) AS VARCHAR) AS day
  FROM (SELECT event_id, ts, event_type, value, {K} AS job_id, user_id % 5 AS profile FROM events) WINDOW w AS (PARTITION BY job_id, profile ORDER BY event_id))"""


@query(f"""SELECT disposition, trigger_kind, emit, count(*) AS n, count(DISTINCT CASE WHEN starts_with(emit, 'EMIT') AND {PASSES} THEN job_id || ':' || profile || ':' || {OCCURRENCE} END) AS n_emitted
FROM (SELECT *, {DISPOSITION} AS disposition, {TRIGGER} AS trigger_kind FROM {_BEFORE}) JOIN (VALUES {', '.join(map(str, DECISIONS))}) t(disposition, trigger_kind, emit) USING (disposition, trigger_kind) GROUP BY 1, 2, 3""")
def inbox_decision_table(spark, d):
    """Each event meets the table with the disposition that it finds; the table is joined, not coded, and an event that comes again emits nothing more."""
    w = Window.partitionBy("job_id", "profile").orderBy("event_id")
    own = table(spark, d, "events").select("event_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("job_id"), (F.col("user_id") % 5).alias("profile"))
    waited = F.col("ts") >= F.lag("ts").over(w) + F.expr("INTERVAL 1 DAY")
    found = own.select("*", F.lag("event_type").over(w).alias("last_action"), F.lag("event_id").over(w).alias("last_id"), waited.alias("waited"), F.to_date("ts").cast("string").alias("day"))
    rules = spark.createDataFrame(DECISIONS, "disposition string, trigger_kind string, emit string")
    rows = found.withColumn("disposition", F.expr(DISPOSITION)).withColumn("trigger_kind", F.expr(TRIGGER)).join(F.broadcast(rules), ["disposition", "trigger_kind"])
    key = F.when(F.col("emit").startswith("EMIT") & F.expr(PASSES), F.concat_ws(":", "job_id", "profile", F.expr(OCCURRENCE)))
    return rows.groupBy("disposition", "trigger_kind", "emit").agg(F.count("*").alias("n"), F.countDistinct(key).alias("n_emitted"))


@query(f"""SELECT event_type, verdict, count(*) AS n FROM (SELECT event_type, CASE WHEN expected IS NULL THEN 'NO_TOKEN' WHEN expected = revision THEN 'ACCEPTED' ELSE 'STALE' END AS verdict FROM (
  SELECT *, last_value(CASE WHEN event_type = 'view' THEN revision END IGNORE NULLS) OVER (PARTITION BY job_id, profile ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS expected FROM (
    SELECT *, coalesce(sum(CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS revision FROM {ACTIONS})) WHERE event_type IN ('click', 'purchase')) GROUP BY 1, 2""")
def optimistic_updates(spark, d):
    """A view hands out the job's revision; an update is accepted only if nobody has updated the job since."""
    before = Window.partitionBy("job_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("job_id", "profile").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    update = F.col("event_type").isin("click", "purchase")
    rows = actions(spark, d).withColumn("revision", F.coalesce(F.sum(update.cast("int")).over(before), F.lit(0)))
    rows = rows.withColumn("expected", F.last(F.when(F.col("event_type") == "view", F.col("revision")), ignorenulls=True).over(own)).filter(update)
    verdict = F.when(F.col("expected").isNull(), "NO_TOKEN").when(F.col("expected") == F.col("revision"), "ACCEPTED").otherwise("STALE")
    return rows.groupBy("event_type", verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL 14 DAY AS due_at, date_diff('day', o_orderdate + INTERVAL 14 DAY, TIMESTAMP '1998-01-01') AS days_late FROM orders WHERE o_orderstatus = 'O' AND o_orderdate + INTERVAL 14 DAY <= TIMESTAMP '1998-01-01'")
def next_actions_due(spark, d):
    """Open applications whose next action was due by a date; the comparison reaches the scan."""
    late = table(spark, d, "orders").filter("o_orderstatus = 'O' and o_orderdate <= timestamp_ntz'1997-12-18'")
    due = F.col("o_orderdate") + F.expr("INTERVAL 14 DAYS")
    return late.select("o_orderkey", "o_custkey", due.alias("due_at"), F.datediff(F.lit("1998-01-01").cast("date"), due).cast("long").alias("days_late"))


@query("SELECT conv_id AS application_id, max(turn) AS last_turn, arg_max(role, turn) AS state, count(*) AS n_events FROM conversations GROUP BY 1")
def application_latest(spark, d):
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("application_id")).agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("state"), F.count("*").alias("n_events"))


BLOCKED = "HOUSEHOLD"


@query(f"SELECT c_custkey, count(o_orderkey) AS roles, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS open_roles, max(o_orderdate) AS last_posting FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment <> '{BLOCKED}' GROUP BY 1")
def company_rollup(spark, d):
    """Roles by company, without those on the blocklist; orders are summed before they meet companies."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("roles"), F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("open_roles"), F.max("o_orderdate").alias("last_posting"))
    c = table(spark, d, "customer").filter(F.col("c_mktsegment") != BLOCKED).select("c_custkey")
    zero = F.lit(0).cast("long")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("roles", zero).alias("roles"), F.coalesce("open_roles", zero).alias("open_roles"), "last_posting")


ALLOWED = {0: ["EUROPE", "AMERICA"], 1: ["ASIA"], 2: ["AFRICA", "ASIA", "MIDDLE EAST"]}


@query("""WITH s AS (SELECT o.o_custkey % 100 AS company, list_sort(list(DISTINCT r_name)) AS regions FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT company, profile_id, CAST(len(list_intersect(regions, allowed)) AS INTEGER) AS n_common, len(list_intersect(regions, allowed)) > 0 AS overlap, CAST(len(regions) AS INTEGER) AS n_regions FROM s, (VALUES (0, ['EUROPE', 'AMERICA']), (1, ['ASIA']), (2, ['AFRICA', 'ASIA', 'MIDDLE EAST'])) p(profile_id, allowed)""")
def location_sets(spark, d):
    """Sets of regions against allow-lists: how much they share, never which comes first."""
    places = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    sets = o.groupBy((F.col("o_custkey") % 100).alias("company")).agg(F.collect_set("r_name").alias("regions"))
    profiles = F.array(*[F.struct(F.lit(i).alias("profile_id"), F.array(*map(F.lit, a)).alias("allowed")) for i, a in ALLOWED.items()])
    both = F.size(F.array_intersect("regions", "p.allowed"))
    return sets.select("*", F.explode(profiles).alias("p")).select("company", "p.profile_id", both.alias("n_common"), (both > 0).alias("overlap"), F.size("regions").alias("n_regions"))


@query("SELECT p_partkey AS job_id, greatest(0, least(low + 9, 17) - greatest(low, 8)) AS shared_hours, greatest(0, least(low + 9, 17) - greatest(low, 8)) >= 4 AS compatible FROM (SELECT p_partkey, p_size % 24 - 3 AS low FROM part)")
def timezone_overlap(spark, d):
    """Working hours of a job, shifted by its zone, against a profile's own hours."""
    low = F.col("p_size") % 24 - 3
    shared = F.greatest(F.lit(0), F.least(low + 9, F.lit(17)) - F.greatest(low, F.lit(8)))
    return table(spark, d, "part").select(F.col("p_partkey").alias("job_id"), shared.alias("shared_hours"), (shared >= 4).alias("compatible"))


@query(f"SELECT job_id, CAST({_SCORE} AS BIGINT) AS score, CAST(row_number() OVER (ORDER BY {_SCORE} DESC, job_id) AS INTEGER) AS place FROM {JOBS} WHERE profile_id = 0 ORDER BY place LIMIT 100")
def inbox_order(spark, d):
    """The first hundred of an inbox: ordered and cut at once, so that no full sort is needed."""
    top = pairs(spark, d).filter("profile_id = 0").select("job_id", score().cast("long").alias("score")).orderBy(F.desc("score"), "job_id").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "job_id")))  # at most 100 rows


@query(f"SELECT job_id, profile_id, pay, p_size FROM {JOBS} WHERE profile_id = 1 AND (pay BETWEEN 950 AND 1100 OR pay IS NULL) AND p_type <> 'PROMO' AND p_size BETWEEN 10 AND 40")
def structured_filter(spark, d):
    """Pay, type and level as filters beside any search; unknown pay passes."""
    return pairs(spark, d).filter("profile_id = 1 and (pay between 950 and 1100 or pay is null) and p_type <> 'PROMO' and p_size between 10 and 40").select("job_id", "profile_id", "pay", "p_size")
