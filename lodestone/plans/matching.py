"""Queries over identity: the ledger of six stages and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import url as ux
from ..operators import ledger, matching
from ..operators.ledger import written
from ..policy import POLICY
from ..sources.tables import table
from .acquisition import CANON_SQL
from .registry import query

#: Words of a text that stand for its title.
TITLE_WORDS = 3


def observations(spark, d) -> DataFrame:
    """Documents as observations of jobs. A language is a company, half of its sources are a place and a source of their own, a text's length is
    the id there and with the provider that it names; the page of the same number is where one applies, or else an address
    that the length gives; the order of the same number tells the creation, its last shipment the day they were seen."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", F.col("n_chars").alias("n"), (F.regexp_extract("source", "([0-9]+)", 1).cast("int") % 2).cast("string").alias("half"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_replace(ux.canonical(F.col("url")), r"\?.*$", "").alias("page_url"))
    day = lambda c: F.datediff(c, F.lit("1990-01-01"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (day("o_orderdate") % 120).alias("created_day"))
    seen = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg((day(F.max("l_shipdate")) % 120 + F.when(F.count("*") > 6, 400).otherwise(0)).alias("seen_day"))
    rows = docs.join(pages, "doc_id", "left").join(orders, "doc_id", "left").join(seen, "doc_id", "left")
    title = F.array_join(F.slice(F.split(tx.normalised(F.coalesce("text", F.lit(""))), " "), 1, TITLE_WORDS), " ")
    number = F.col("n").cast("string")
    made = F.when(F.col("n") % 5 == 0, F.concat(F.lit("https://"), "lang", F.lit(".example/jobs/"), number))
    return rows.select(
        F.col("doc_id").alias("job_id"), F.concat_ws("-", "lang", "half").alias("source_id"), number.alias("source_job_id"), F.when(F.col("n") % 3 > 0, F.concat(F.lit("ats"), (F.col("n") % 3).cast("string"))).alias("origin_provider"),
        F.col("lang").alias("origin_board"), number.alias("origin_job_id"), F.coalesce("page_url", made).alias("apply_url"), F.col("lang").alias("company"), title.alias("title"), F.array("half").alias("places"), "created_day", "seen_day", "text")


_OBSERVED = f"""p AS (SELECT page_id AS doc_id, regexp_replace(canon_url, '\\?.*$', '') AS page_url FROM ({CANON_SQL})),
l AS (SELECT l_orderkey AS doc_id, date_diff('day', DATE '1990-01-01', CAST(max(l_shipdate) AS DATE)) % 120 + CASE WHEN count(*) > 6 THEN 400 ELSE 0 END AS seen_day FROM lineitem GROUP BY 1),
o AS (SELECT job_id, lang || '-' || place AS source_id, number AS source_job_id, CASE WHEN n % 3 > 0 THEN 'ats' || (n % 3) END AS origin_provider, lang AS origin_board, number AS origin_job_id,
  coalesce(page_url, CASE WHEN n % 5 = 0 THEN 'https://' || lang || '.example/jobs/' || number END) AS apply_url, lang AS company, array_to_string(string_split(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))), ' ')[1:{TITLE_WORDS}], ' ') AS title,
  place, created_day, seen_day, text FROM (
  SELECT d.doc_id AS job_id, d.lang, d.n_chars AS n, CAST(d.n_chars AS VARCHAR) AS number, CAST(CAST(regexp_extract(d.source, '([0-9]+)', 1) AS INTEGER) % 2 AS VARCHAR) AS place, d.text, p.page_url, l.seen_day,
    date_diff('day', DATE '1990-01-01', CAST(r.o_orderdate AS DATE)) % 120 AS created_day FROM documents d LEFT JOIN p USING (doc_id) LEFT JOIN orders r ON r.o_orderkey = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id))"""


def _alike(a: str, b: str) -> str:
    words = "list_distinct(list_filter(string_split({}, ' '), lambda w: w <> ''))"
    x, y = words.format(f"coalesce({a}, '')"), words.format(f"coalesce({b}, '')")
    return f"CASE WHEN len({x}) + len({y}) = 0 THEN 1.0 ELSE len(list_intersect({x}, {y})) / CAST(len(list_distinct(list_concat({x}, {y}))) AS DOUBLE) END"


def _guard(f: str, others: list[str]) -> str:
    both = " AND ".join(f"x.{c} IS NOT NULL AND {f}.{c} IS NOT NULL" for c in others)
    differ = " OR ".join(f"x.{c} <> {f}.{c}" for c in others)
    return f"""array_to_string(list_filter([CASE WHEN abs(x.seen_day - {f}.seen_day) > {POLICY.id_reuse_gap_days} AND {_alike('x.title', f + '.title')} < {matching.SAME_TITLE} THEN 'LONG_GAP' END,
  CASE WHEN x.company <> {f}.company OR {_alike('x.title', f + '.title')} < {matching.SAME_TITLE} THEN 'TITLE_COMPANY' END, CASE WHEN x.recycles AND {_alike('x.title', f + '.title')} < 1 THEN 'PROVIDER_RECYCLES' END,
  CASE WHEN abs(x.created_day - {f}.created_day) > {POLICY.match_window_days} THEN 'CREATED_APART' END, CASE WHEN {both} AND ({differ}) THEN 'OTHER_ORIGIN' END], lambda c: c IS NOT NULL), ',')"""


def _by_id(n: int, provider: str, keys: list[str], others: list[str]) -> str:
    """SQL of stage n: rows k{n} (kept, absorbed, stage, decision, score, reason, guard)."""
    key, known = ", ".join(keys), " AND ".join(f"{k} IS NOT NULL AND {k} <> ''" for k in keys)
    same = " AND ".join(f"f.{k} = x.{k}" for k in keys)
    reason = ("SAME_NATIVE_ID", "SAME_ORIGIN_ID")[n - 1]
    return f"""
i{n} AS (SELECT o.*, coalesce(r.reused >= {matching.RECYCLED_IDS} AND r.reused >= r.ids * {matching.RECYCLED_SHARE}, false) AS recycles FROM o LEFT JOIN (
  SELECT {provider}, count(CASE WHEN jobs > 1 THEN 1 END) AS reused, count(*) AS ids FROM (SELECT {key}, count(*) AS n, count(DISTINCT {{'c': company, 't': title}}) AS jobs FROM o WHERE {known} GROUP BY {key}) WHERE n > 1 GROUP BY 1) r USING ({provider}) WHERE {known}),
f{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY coalesce(seen_day, {1 << 30}), job_id) AS rn FROM i{n}) WHERE rn = 1),
c{n} AS (SELECT x.*, f.job_id AS f_job, {_alike('x.title', 'f.title')} AS likeness, {_guard('f', others)} AS fired FROM i{n} x JOIN f{n} f ON {same}),
s{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key}, company, title ORDER BY coalesce(seen_day, {1 << 30}), job_id) AS rn FROM c{n} WHERE fired <> '') WHERE rn = 1),
a{n} AS (SELECT x.*, f.job_id AS s_job, {_guard('f', others)} AS again FROM c{n} x JOIN s{n} f ON {same} AND f.company = x.company AND f.title = x.title WHERE x.fired <> ''),
k{n} AS (SELECT f_job AS kept, job_id AS absorbed, {n} AS stage, 'MERGE' AS decision, 1.0 AS score, '{reason}' AS reason, '' AS guard FROM c{n} WHERE fired = '' AND f_job <> job_id
  UNION ALL SELECT f_job, job_id, 6, 'REVIEW', likeness, 'ID_REUSED', fired FROM a{n} WHERE s_job = job_id
  UNION ALL SELECT s_job, job_id, CASE WHEN again = '' THEN {n} ELSE 6 END, CASE WHEN again = '' THEN 'MERGE' ELSE 'REVIEW' END, 1.0, CASE WHEN again = '' THEN '{reason}' ELSE 'ID_REUSED' END, again FROM a{n} WHERE s_job <> job_id)"""


_W, _K = POLICY.match_window_days, POLICY.shingle_words
_NORM_TEXT = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
_ORIGIN = ["origin_provider", "origin_board", "origin_job_id"]
LEDGER_SQL = f"""
WITH {_OBSERVED},{_by_id(1, 'source_id', ['source_id', 'source_job_id'], _ORIGIN)},{_by_id(2, 'origin_provider', _ORIGIN, ['source_id', 'source_job_id'])},
k3 AS (SELECT root AS kept, job_id AS absorbed, 3 AS stage, 'MERGE' AS decision, 1.0 AS score, 'SAME_APPLY_URL' AS reason, '' AS guard FROM (SELECT job_id, min(job_id) OVER (PARTITION BY apply_url) AS root FROM o WHERE apply_url IS NOT NULL) WHERE root <> job_id),
t AS (SELECT * FROM o WHERE company IS NOT NULL AND title IS NOT NULL AND seen_day IS NOT NULL),
w AS (SELECT *, list_filter(string_split({_NORM_TEXT}, ' '), lambda x: x <> '') AS ws FROM t WHERE text IS NOT NULL),
g AS (SELECT DISTINCT job_id, company, title, place, seen_day, array_to_string(ws[i : i + {_K - 1}], ' ') AS gram FROM w, unnest(generate_series(1, greatest(len(ws) - {_K - 1}, 1))) AS s(i) WHERE len(ws) > 0),
m AS (SELECT *, min(job_id) OVER (PARTITION BY company, title, place, grams) AS root, seen_day // {_W} AS span FROM (SELECT job_id, company, title, place, seen_day, list_sort(list(gram)) AS grams FROM g GROUP BY ALL)),
sp AS (SELECT company, title, place, root, span, arg_min(job_id, {{'d': seen_day, 'j': job_id}}) AS f_job, min(seen_day) AS f_day, max(seen_day) AS l_day, any_value(grams) AS grams FROM m GROUP BY ALL),
k4 AS (SELECT f_job AS kept, m.job_id AS absorbed, 4 AS stage, 'MERGE' AS decision, 1.0 AS score, 'SAME_CONTENT' AS reason, '' AS guard FROM m JOIN sp USING (root, span) WHERE f_job <> m.job_id
  UNION ALL SELECT b_job, f_job, 4, 'MERGE', 1.0, 'SAME_CONTENT', '' FROM (SELECT *, lag(f_job) OVER q AS b_job, lag(l_day) OVER q AS b_day FROM sp WINDOW q AS (PARTITION BY root ORDER BY span)) WHERE f_day - b_day <= {_W}
  UNION ALL SELECT least(a_job, b_job), greatest(a_job, b_job), 4, 'MERGE', j, 'SIMILAR_CONTENT', '' FROM (
    SELECT a.f_job AS a_job, b.f_job AS b_job, round(CAST(len(list_intersect(a.grams, b.grams)) AS DOUBLE) / len(list_distinct(list_concat(a.grams, b.grams))), 6) AS j
    FROM sp a JOIN sp b ON a.root < b.root AND a.company = b.company AND a.title = b.title AND a.place IS NOT DISTINCT FROM b.place AND abs(a.span - b.span) <= 1 AND a.f_day - b.l_day <= {_W} AND b.f_day - a.l_day <= {_W}) WHERE j >= {POLICY.similarity_threshold}
  UNION ALL SELECT lead, f_job, 6, 'REVIEW', 0.0, 'CONTENT_DIFFERS', '' FROM (SELECT *, first_value(f_job) OVER (PARTITION BY company, title, place, span ORDER BY f_day, f_job) AS lead FROM sp) WHERE lead <> f_job),
k5 AS (SELECT root AS kept, job_id AS absorbed, 5 AS stage, 'CLUSTER' AS decision, 0.0 AS score, 'PLACES_DISAGREE' AS reason, '' AS guard FROM (SELECT *, min(job_id) OVER (PARTITION BY company, title) AS root FROM (SELECT company, title, place, min(job_id) AS job_id FROM t GROUP BY ALL)) WHERE root <> job_id),
every AS (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3 UNION ALL SELECT * FROM k4 UNION ALL SELECT * FROM k5)
SELECT kept AS kept_job_id, absorbed AS absorbed_job_id, stage, decision, round(CAST(score AS DOUBLE), 6) AS match_score, reason AS reason_code, guard FROM (
  SELECT *, row_number() OVER (PARTITION BY least(kept, absorbed), greatest(kept, absorbed) ORDER BY stage, score DESC, reason, guard, kept) AS best FROM every) WHERE best = 1
"""


@query(LEDGER_SQL)
def match_ledger(spark, d):
    """All six stages as one ledger, each pair by its strongest stage, with what the guard had against it."""
    found = matching.staged(written(observations(spark, d), "observations"))
    return found.select("kept_job_id", "absorbed_job_id", "stage", "decision", F.round("match_score", 6).alias("match_score"), "reason_code", "guard")


@query(f"""WITH RECURSIVE every_row AS ({LEDGER_SQL}), e AS (SELECT kept_job_id AS a, absorbed_job_id AS b FROM every_row WHERE decision = 'MERGE' UNION SELECT absorbed_job_id, kept_job_id FROM every_row WHERE decision = 'MERGE'),
r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a)
SELECT root AS canonical_id, count(*) AS n_jobs, max(node) AS last_job FROM (SELECT node, min(root) AS root FROM r GROUP BY 1) GROUP BY 1""")
def canonical_jobs(spark, d):
    """Jobs that all the ledger's merges make one, under their least id."""
    found = written(matching.staged(written(observations(spark, d), "observations")).drop("evidence_json"), "ledger")
    labels = ledger.closure(matching.merge_edges(found))
    return labels.groupBy(F.col("root").alias("canonical_id")).agg(F.count("*").alias("n_jobs"), F.max("node").alias("last_job"))
