"""Queries that follow a rule through all of its cases: ranks of fallbacks, revalidation, stop rules, loops, cooldowns, company signals, contacts and feedback."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import url as ux
from ..operators import companies, coverage
from ..sources.tables import table
from .acquisition import PATH, H
from .presence import SEEN, accepted, flagged, sightings, state_of
from .registry import query
from .workflow import K

_RANK = "CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'SATISFIED' WHEN l_returnflag = 'N' THEN 'SATISFIED_PARTIAL' WHEN l_returnflag = 'R' THEN 'FAILED' WHEN l_tax > 0.04 THEN 'POLICY_DENIED' ELSE 'CANCELLED' END"


@query(f"""WITH r AS (SELECT l_orderkey, l_linenumber, min({_RANK}) AS own FROM lineitem GROUP BY 1, 2), w AS (SELECT l_orderkey, coalesce(min(CASE WHEN own = 'SATISFIED' THEN l_linenumber END), min(CASE WHEN own = 'SATISFIED_PARTIAL' THEN l_linenumber END), max(l_linenumber)) AS last FROM r GROUP BY 1)
SELECT l_orderkey AS group_id, l_linenumber AS fallback_rank, CASE WHEN l_linenumber > last THEN 'SKIPPED_NOT_NEEDED' ELSE own END AS outcome FROM r JOIN w USING (l_orderkey)""")
def fallback_ranks(spark, d):
    """Each rank of a group with its outcome: ranks run in order until one satisfies, or the first partial one where none does; later ones are not needed."""
    r = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.expr(_RANK)).alias("own"))

    def least(outcome):
        return F.min(F.when(F.col("own") == outcome, F.col("l_linenumber")))

    last = r.groupBy("l_orderkey").agg(F.coalesce(least("SATISFIED"), least("SATISFIED_PARTIAL"), F.max("l_linenumber")).alias("last"))
    outcome = F.when(F.col("l_linenumber") > F.col("last"), "SKIPPED_NOT_NEEDED").otherwise(F.col("own"))
    return r.join(last, "l_orderkey").select(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("fallback_rank"), outcome.alias("outcome"))


#: Days that a retained representation stands for; its request variant changes every ten days.
RETAINED_DAYS, VARIANT_DAYS = 7, 10
_VARIANT = "date_diff('day', DATE '2024-01-01', generation) // " + str(VARIANT_DAYS)


@query(f"""WITH s AS {SEEN}, g AS (SELECT source_id, generation, NOT bool_or(event_type = 'error') AS complete, bool_and(event_type = 'view') AS unchanged FROM s GROUP BY 1, 2),
f AS (SELECT source_id, generation, complete, unchanged, max(CASE WHEN complete AND NOT unchanged THEN generation END) OVER (PARTITION BY source_id ORDER BY generation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept FROM g),
v AS (SELECT *, unchanged AND kept IS NOT NULL AND date_diff('day', kept, generation) <= {RETAINED_DAYS} AND {_VARIANT} = {_VARIANT.replace('generation', 'kept')} AS resolved FROM f),
m AS (SELECT DISTINCT source_id, k, generation FROM s WHERE event_type <> 'error' UNION SELECT v.source_id, s.k, v.generation FROM v JOIN s ON s.source_id = v.source_id AND s.generation = v.kept WHERE v.resolved),
c AS (SELECT source_id, generation FROM v WHERE complete AND (NOT unchanged OR resolved)), i AS (SELECT source_id, k, max(generation) AS last_seen FROM m GROUP BY 1, 2),
x AS (SELECT i.source_id, i.k, i.last_seen, count(c.generation) AS misses FROM i LEFT JOIN c ON c.source_id = i.source_id AND c.generation > i.last_seen GROUP BY 1, 2, 3)
SELECT source_id, k, last_seen, misses, CASE WHEN misses = 0 THEN 'ACTIVE' WHEN misses < 3 THEN 'UNCERTAIN' ELSE 'EXPIRED' END AS state FROM x""")
def revalidated_presence(spark, d):
    """Presence where a day of views only is an unchanged answer: the members of the retained generation count as seen then, if it is young and of the
    same request variant; otherwise the day proves nothing absent."""
    seen = sightings(spark, d)
    g = flagged(seen)
    views = seen.groupBy("source_id", "generation").agg(F.min(F.col("event_type") == "view").alias("unchanged"))
    before = Window.partitionBy("source_id").orderBy("generation").rowsBetween(Window.unboundedPreceding, -1)  # a source's generations
    kept = F.max(F.when(F.col("complete") & ~F.col("unchanged"), F.col("generation"))).over(before)
    told = g.join(views, ["source_id", "generation"]).withColumn("kept", kept)

    def variant(day):
        return F.floor(F.datediff(day, F.lit("2024-01-01")) / VARIANT_DAYS)

    resolved = F.col("unchanged") & F.col("kept").isNotNull() & (F.datediff("generation", "kept") <= RETAINED_DAYS) & (variant("generation") == variant("kept"))
    told = told.withColumn("resolved", F.coalesce(resolved, F.lit(False)))
    members = accepted(seen).select("source_id", "k", "generation").distinct()
    retained = told.filter("resolved").select("source_id", F.col("generation").alias("now"), F.col("kept").alias("generation")).join(members, ["source_id", "generation"]).select("source_id", "k", F.col("now").alias("generation"))
    whole = told.select("source_id", "generation", (F.col("complete") & (~F.col("unchanged") | F.col("resolved"))).alias("complete"))
    return state_of(coverage.misses_since(members.unionByName(retained), whole))


@query(f"""SELECT source_id, k, min(ts) AS first_seen, max(ts) AS last_seen, max(CASE WHEN event_type = 'view' THEN ts END) AS last_verified, max(CASE WHEN old IS NULL OR old <> event_type THEN ts END) AS last_changed, count(CASE WHEN old <> event_type THEN 1 END) AS n_changes
FROM (SELECT *, lag(event_type) OVER (PARTITION BY source_id, k ORDER BY event_id) AS old FROM {SEEN} WHERE event_type <> 'error') GROUP BY 1, 2""")
def seen_times(spark, d):
    """When an identity was first and last seen, last verified, and last changed; failures are none of these."""
    e = accepted(sightings(spark, d)).withColumn("old", F.lag("event_type").over(Window.partitionBy("source_id", "k").orderBy("event_id")))
    changed = F.col("old").isNull() | (F.col("old") != F.col("event_type"))
    return e.groupBy("source_id", "k").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("last_verified"),
        F.max(F.when(changed, F.col("ts"))).alias("last_changed"), F.count(F.when(F.col("old") != F.col("event_type"), 1)).alias("n_changes"))


#: Pages running without records, without anything new, or equal to the page before, that end a walk.
STREAKS = {"EMPTY": 2, "NO_NEW": 3, "DUPLICATE": 2}
_PAGE = "event_type IN ('error', 'signup')"


@query(f"""WITH p AS (SELECT user_id AS source_id, event_id, {_PAGE} AS empty, row_number() OVER (PARTITION BY user_id, {K} ORDER BY event_id) > 1 AS old, {K} % 10 IS NOT DISTINCT FROM lag({K} % 10) OVER (PARTITION BY user_id ORDER BY event_id) AS same FROM events),
i AS (SELECT *, sum(CASE WHEN empty THEN 0 ELSE 1 END) OVER w AS ie, sum(CASE WHEN old THEN 0 ELSE 1 END) OVER w AS io, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER w AS id FROM p WINDOW w AS (PARTITION BY source_id ORDER BY event_id)),
r AS (SELECT source_id, event_id, sum(CASE WHEN empty THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, ie ORDER BY event_id) AS re, sum(CASE WHEN old THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, io ORDER BY event_id) AS ro, sum(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, id ORDER BY event_id) AS rd FROM i),
s AS (SELECT source_id, min(CASE WHEN re >= {STREAKS['EMPTY']} THEN event_id END) AS e, min(CASE WHEN ro >= {STREAKS['NO_NEW']} THEN event_id END) AS o, min(CASE WHEN rd >= {STREAKS['DUPLICATE']} THEN event_id END) AS d FROM r GROUP BY 1)
SELECT source_id, least(e, o, d) AS stop_at, CASE least(e, o, d) WHEN e THEN 'EMPTY' WHEN o THEN 'NO_NEW' WHEN d THEN 'DUPLICATE' END AS rule FROM s WHERE least(e, o, d) IS NOT NULL""")
def stop_rules(spark, d):
    """Where a source's walk ends, and by which of three streaks: empty pages, pages without anything new, pages equal to the one before."""
    own = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    e = e.withColumns({"EMPTY": F.expr(_PAGE), "NO_NEW": F.row_number().over(Window.partitionBy("user_id", "k").orderBy("event_id")) > 1, "DUPLICATE": (F.col("k") % 10).eqNullSafe(F.lag(F.col("k") % 10).over(own))})
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("_place", F.row_number().over(own))
    for name in STREAKS:  # pages since the last one that breaks the streak
        e = e.withColumn(f"_{name}", F.col("_place") - F.coalesce(F.max(F.when(~F.col(name), F.col("_place"))).over(upto), F.lit(0)))
    first = e.groupBy(F.col("user_id").alias("source_id")).agg(*[F.min(F.when(F.col(f"_{n}") >= most, F.col("event_id"))).alias(n) for n, most in STREAKS.items()])
    stop = F.least(*STREAKS)
    rule = F.coalesce(*[F.when(F.col(n) == stop, n) for n in STREAKS])
    return first.filter(stop.isNotNull()).select("source_id", stop.alias("stop_at"), rule.alias("rule"))


#: How long a source's answer asks to wait, in seconds: told by every third failure.
_ASKED = "CASE WHEN {k} % 3 = 0 THEN {k} % 50 * 60 ELSE 0 END"


@query(f"""WITH e AS (SELECT event_id, user_id, ts, {K} AS k, event_type FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) AS attempt FROM e WHERE event_type = 'error'),
w AS (SELECT event_id, user_id, ts, greatest(least(3600, 30 * CAST(pow(2, least(attempt, 12) - 1) AS BIGINT)), {_ASKED.format(k='k')}) AS wait FROM f),
c AS (SELECT e.event_id, e.user_id, e.ts, e.event_type, max(w.ts + to_seconds(w.wait)) OVER (PARTITION BY e.user_id ORDER BY e.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM e LEFT JOIN w USING (event_id))
SELECT user_id AS source_id, count(CASE WHEN event_type = 'error' THEN 1 END) AS failures, count(CASE WHEN ts < until THEN 1 END) AS too_early, max(until) AS last_until FROM c GROUP BY 1""")
def source_cooldown(spark, d):
    """Cooldowns of sources as their ledger has them, whatever restarts: the longer of the doubling delay and what the answer asked for; requests inside one are counted."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    attempt = F.row_number().over(Window.partitionBy("user_id", "k", "event_type").orderBy("event_id"))
    delay = F.least(F.lit(3600), 30 * F.pow(F.lit(2), F.least(F.col("attempt"), F.lit(12)) - 1).cast("long"))
    wait = F.greatest(delay, F.expr(_ASKED.format(k="k")))
    until = F.when(F.col("event_type") == "error", F.col("ts") + F.make_dt_interval(secs=wait.cast("decimal(18,6)")))
    told = e.withColumn("attempt", attempt).withColumn("own", until)
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumn("until", F.max("own").over(before))
    return told.groupBy(F.col("user_id").alias("source_id")).agg(F.count(F.when(F.col("event_type") == "error", 1)).alias("failures"), F.count(F.when(F.col("ts") < F.col("until"), 1)).alias("too_early"), F.max("until").alias("last_until"))


_SIGNALS = f"""SELECT page_id % 400 AS company_id, 'DOMAIN' AS kind, regexp_extract(lower({H}), '([^.]+\\.[^.]+\\.[^.]+)$', 1) AS value FROM pages UNION ALL SELECT page_id % 400, 'CAREERS_URL', lower({H}) || regexp_extract({PATH}, '^(/[^/]+/[0-9]{{2}})', 1) FROM pages WHERE regexp_matches({PATH}, '^/[^/]+/[0-9]{{2}}')
  UNION ALL SELECT c_custkey, 'NAME', lower(c_mktsegment) || ' ' || (c_custkey // 5) FROM customer UNION ALL SELECT c_custkey, 'APPLICATION_HOST', 'apply' || (c_custkey % 4) || '.example' FROM customer
  UNION ALL SELECT s_suppkey, 'STRUCTURED_ID', CAST(s_suppkey // 2 AS VARCHAR) FROM supplier UNION ALL SELECT o_custkey, 'ATS_BOARD', 'board' || (o_orderkey // 40) FROM orders WHERE o_orderkey % 20 = 0"""


@query(f"""WITH RECURSIVE s AS (SELECT DISTINCT company_id, kind, value FROM ({_SIGNALS}) WHERE value <> ''), u AS (SELECT * FROM s WHERE kind IN {companies.STRONG} UNION ALL SELECT a.company_id, 'NAME+HOST', a.value || chr(1) || b.value FROM s a JOIN s b USING (company_id) WHERE a.kind = 'NAME' AND b.kind = 'APPLICATION_HOST'),
c AS (SELECT kind, value, min(company_id) AS a, count(*) AS n FROM u GROUP BY 1, 2), e AS (SELECT c.a, u.company_id AS b, u.kind FROM u JOIN c USING (kind, value) WHERE n > 1 AND (n <= {companies.SHARED} OR kind = 'NAME+HOST') AND u.company_id <> c.a),
y AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS root FROM y UNION SELECT y.b, r.root FROM r JOIN y ON r.node = y.a), l AS (SELECT node, min(root) AS root FROM r GROUP BY 1),
k AS (SELECT company_id, count(DISTINCT kind) AS n_kinds FROM (SELECT a AS company_id, kind FROM e UNION ALL SELECT b, kind FROM e) GROUP BY 1)
SELECT x.company_id, coalesce(l.root, x.company_id) AS root, coalesce(k.n_kinds, 0) AS n_kinds FROM (SELECT DISTINCT company_id FROM s) x LEFT JOIN l ON l.node = x.company_id LEFT JOIN k USING (company_id)""")
def company_signals(spark, d):
    """Companies joined by six kinds of signals from pages, customers, suppliers and orders; weak ones only together, and what many share joins nobody."""
    pages = table(spark, d, "pages").select((F.col("page_id") % 400).alias("company_id"), ux.host(F.col("url")).alias("host"), ux.path(F.col("url")).alias("path"))
    deep = F.regexp_extract("path", "^(/[^/]+/[0-9]{2})", 1)
    customers = table(spark, d, "customer")
    key = F.col("c_custkey")
    signals = [
        pages.select("company_id", F.lit("DOMAIN").alias("kind"), F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("value")), pages.filter(deep != "").select("company_id", F.lit("CAREERS_URL").alias("kind"), F.concat("host", deep).alias("value")),
        customers.select(key.alias("company_id"), F.lit("NAME").alias("kind"), F.concat(F.lower("c_mktsegment"), F.lit(" "), F.floor(key / 5).cast("string")).alias("value")),
        customers.select(key.alias("company_id"), F.lit("APPLICATION_HOST").alias("kind"), F.concat(F.lit("apply"), (key % 4).cast("string"), F.lit(".example")).alias("value")),
        table(spark, d, "supplier").select(F.col("s_suppkey").alias("company_id"), F.lit("STRUCTURED_ID").alias("kind"), F.floor(F.col("s_suppkey") / 2).cast("string").alias("value")),
        table(spark, d, "orders").filter("o_orderkey % 20 = 0").select(F.col("o_custkey").alias("company_id"), F.lit("ATS_BOARD").alias("kind"), F.concat(F.lit("board"), F.floor(F.col("o_orderkey") / 40).cast("string")).alias("value")),
    ]
    out = signals[0]
    for s in signals[1:]:
        out = out.unionByName(s)
    return companies.resolved(out.filter("value <> ''"))


_MAIL = tx.EMAIL.replace("'", "''")


@query(f"""WITH f AS (SELECT lower(unnest(regexp_extract_all(text, '{_MAIL}'))) AS email, 1 AS rank, 'LISTING' AS provenance, doc_id AS spot FROM documents UNION ALL SELECT lower(unnest(regexp_extract_all(html, '{_MAIL}'))), CASE WHEN regexp_matches(url, '(?i)(career|contact|jobs)') THEN 2 ELSE 3 END, 'PAGE', page_id FROM pages
  UNION ALL SELECT lower(unnest(regexp_extract_all(text, '{_MAIL}'))), 4, 'CONVERSATION', conv_id FROM conversations)
SELECT domain, email, CAST(rank AS INTEGER) AS rank, provenance, spot AS found_in, n FROM (SELECT *, split_part(email, '@', 2) AS domain, row_number() OVER (PARTITION BY split_part(email, '@', 2) ORDER BY rank, email, spot) AS best, count(*) OVER (PARTITION BY split_part(email, '@', 2)) AS n FROM f) WHERE best = 1""")
def contact_sources(spark, d):
    """The best contact of a domain by where it is written: the listing itself, a careers or contact page, another page, a conversation; with where it was found. None is inferred."""
    def found(rows, text, rank, provenance, at):
        mails = F.explode(F.regexp_extract_all(text, F.lit(tx.EMAIL), F.lit(0)))
        return rows.select(mails.alias("email"), rank.cast("int").alias("rank"), F.lit(provenance).alias("provenance"), F.col(at).alias("at")).withColumn("email", F.lower("email"))

    page_rank = F.when(F.col("url").rlike("(?i)(career|contact|jobs)"), 2).otherwise(3)
    every = found(table(spark, d, "documents"), "text", F.lit(1), "LISTING", "doc_id").unionByName(found(table(spark, d, "pages"), "html", page_rank, "PAGE", "page_id")).unionByName(found(table(spark, d, "conversations"), "text", F.lit(4), "CONVERSATION", "conv_id"))
    best = every.groupBy(F.split_part("email", F.lit("@"), F.lit(2)).alias("domain")).agg(F.min(F.struct("rank", "email", "at", "provenance")).alias("b"), F.count("*").alias("n"))
    return best.select("domain", "b.email", "b.rank", "b.provenance", F.col("b.at").alias("found_in"), "n")


#: Labels that a suggestion needs, and the share of them that must be dismissals.
SUPPORT, DISMISSED = 10, 0.2


@query(f"""SELECT source, lang, n, dismissed, round(CAST(dismissed AS DOUBLE) / n, 6) AS share, CASE WHEN n < {SUPPORT} THEN 'TOO_FEW' WHEN dismissed >= n * {DISMISSED} THEN 'SUGGEST_EXCLUDE' ELSE 'KEEP' END AS suggestion, false AS applied
FROM (SELECT source, lang, count(*) AS n, count(CASE WHEN toxic = 1 THEN 1 END) AS dismissed FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2)""")
def suggested_rules(spark, d):
    """What feedback suggests for a source and language: with enough of it, and never applied by itself."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    g = table(spark, d, "labels").join(docs, "doc_id").groupBy("source", "lang").agg(F.count("*").alias("n"), F.count(F.when(F.col("toxic") == 1, 1)).alias("dismissed"))
    suggestion = F.when(F.col("n") < SUPPORT, "TOO_FEW").when(F.col("dismissed") >= F.col("n") * DISMISSED, "SUGGEST_EXCLUDE").otherwise("KEEP")
    return g.select("source", "lang", "n", "dismissed", F.round(F.col("dismissed") / F.col("n"), 6).alias("share"), suggestion.alias("suggestion"), F.lit(False).alias("applied"))
