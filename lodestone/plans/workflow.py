"""Inbox, scores, applications and feedback."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.tables import table
from .registry import query

NORM = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
PROFILE_LANGS = ("en", "de")


@query(f"""WITH c AS (
  SELECT sha256({NORM}) AS content_hash, min(doc_id) AS doc_id, count(*) AS n_obs, count(DISTINCT source) AS n_src, arg_min(lang, doc_id) AS lang, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1
), s AS (
  SELECT *, CASE WHEN lang IN ('en', 'de') THEN 20 ELSE 0 END + CASE WHEN n_chars >= 500 THEN 8 ELSE 0 END - CASE WHEN n_chars < 50 THEN 12 ELSE 0 END + 5 * greatest(n_src - 1, 0) AS score FROM c
)
SELECT doc_id, content_hash, n_obs, n_src, CAST(score AS BIGINT) AS score FROM s WHERE score >= 20 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)""")
def flagship_inbox(spark, d):
    """Documents to inbox: canonical copies by content hash, scored by rules, without dismissed ones."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", tx.content_hash(F.col("text")).alias("content_hash"))
    canonical = docs.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_obs"), F.countDistinct("source").alias("n_src"), F.min_by("lang", "doc_id").alias("lang"), F.min_by("n_chars", "doc_id").alias("n_chars"))

    def points(when, n):
        return F.when(when, n).otherwise(0)

    score = points(F.col("lang").isin(*PROFILE_LANGS), 20) + points(F.col("n_chars") >= 500, 8) - points(F.col("n_chars") < 50, 12) + F.greatest(F.col("n_src") - 1, F.lit(0)) * 5
    dismissed = table(spark, d, "labels").filter("toxic = 1").select("doc_id")
    scored = canonical.withColumn("score", score.cast("long")).filter("score >= 20").join(dismissed, "doc_id", "left_anti")
    return scored.select("doc_id", "content_hash", "n_obs", "n_src", "score").orderBy(F.desc("score"), "doc_id")


K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def actions(spark, d):
    """Events as user actions: the job is the number in props, the profile one of five."""
    e = table(spark, d, "events")
    return e.select("event_id", "ts", "event_type", F.get_json_object("props", "$.k").cast("long").alias("job_id"), (F.col("user_id") % 5).alias("profile"))


ACTIONS = f"(SELECT event_id, ts, event_type, {K} AS job_id, user_id % 5 AS profile FROM events)"


@query(f"SELECT job_id, profile, arg_max(event_type, event_id) AS last_action, max(event_id) AS event_id FROM {ACTIONS} GROUP BY 1, 2")
def profile_state_latest(spark, d):
    """The last action for each job and profile, in the order of the ledger."""
    return actions(spark, d).groupBy("job_id", "profile").agg(F.max_by("event_type", "event_id").alias("last_action"), F.max("event_id").alias("event_id"))


@query(f"SELECT job_id, profile, min(ts) AS first_at FROM {ACTIONS} WHERE event_type IN ('signup', 'purchase') GROUP BY 1, 2")
def first_eligible(spark, d):
    return actions(spark, d).filter(F.col("event_type").isin("signup", "purchase")).groupBy("job_id", "profile").agg(F.min("ts").alias("first_at"))


@query(f"SELECT event_id, job_id, profile, row_number() OVER (PARTITION BY job_id, profile ORDER BY event_id) AS occurrence FROM {ACTIONS} WHERE event_type = 'view'")
def snooze_occurrence(spark, d):
    """A later snooze is an occurrence of its own."""
    w = Window.partitionBy("job_id", "profile").orderBy("event_id")
    return actions(spark, d).filter("event_type = 'view'").select("event_id", "job_id", "profile", F.row_number().over(w).cast("long").alias("occurrence"))


@query(f"SELECT job_id, profile, event_type, CAST(ts AS DATE) AS day FROM {ACTIONS} GROUP BY ALL")
def inbox_event_dedupe(spark, d):
    """Delivering every event twice adds nothing: keys of (job, profile, trigger, day) are distinct."""
    twice = actions(spark, d).unionByName(actions(spark, d))
    return twice.select("job_id", "profile", "event_type", F.to_date("ts").alias("day")).distinct()


@query("SELECT c_mktsegment, o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS companies FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def applications_pipeline(spark, d):
    o, c = table(spark, d, "orders").select("o_custkey", "o_orderstatus"), table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("companies"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def application_closed_while_active(spark, d):
    """Open applications with a closed listing."""
    gone = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").filter("o_orderstatus = 'O'").select("o_orderkey").join(gone, "o_orderkey", "left_semi")


@query("SELECT d.source, count(*) AS n, CAST(sum(l.quality) AS BIGINT) AS good, CAST(sum(l.toxic) AS BIGINT) AS dismissed FROM labels l JOIN documents d USING (doc_id) GROUP BY 1")
def feedback_summary(spark, d):
    l, docs = table(spark, d, "labels"), table(spark, d, "documents").select("doc_id", "source")
    return l.join(docs, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("good"), F.sum("toxic").cast("long").alias("dismissed"))


@query("SELECT l_linestatus, o_orderstatus, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def application_vs_listing(spark, d):
    """Applications keep their own state beside that of the listing."""
    o, l = table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), table(spark, d, "lineitem").select("l_orderkey", "l_linestatus")
    return o.join(l, o["o_orderkey"] == l["l_orderkey"]).groupBy("l_linestatus", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def outcome_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
