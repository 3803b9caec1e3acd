"""Exports, manifests, retention, constraints, imports, schedules and the staged identity match."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import url as ux
from ..operators import ledger, schedules
from ..operators.ledger import written
from ..operators.ranks import running
from ..operators.recipes import compiled
from ..policy import POLICY
from ..sources.tables import table
from .identity import NORM
from .registry import query

SCHEMA_VERSION = 1


@query("""SELECT c_custkey, CASE WHEN regexp_matches(cell, '^[=+\\-@\\t\\r]') THEN '''' || cell ELSE cell END AS cell, regexp_matches(cell, '^[=+\\-@\\t\\r]') AS neutralised
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '=' || c_name WHEN 1 THEN '-2+3' WHEN 2 THEN '@' || c_mktsegment ELSE c_name END AS cell FROM customer)""")
def csv_safe_projection(spark, d):
    """Cells that a spreadsheet would run get an apostrophe; hostile ones are made here, the tables hold none."""
    kind = F.col("c_custkey") % 4
    cell = F.when(kind == 0, F.concat(F.lit("="), "c_name")).when(kind == 1, "-2+3").when(kind == 2, F.concat(F.lit("@"), "c_mktsegment")).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", cell.alias("cell")).select("c_custkey", tx.csv_safe(F.col("cell")).alias("cell"), F.col("cell").rlike(tx.FORMULA_START).alias("neutralised"))


@query("SELECT c_custkey, to_json({'c_custkey': c_custkey, 'c_name': c_name, 'segment': c_mktsegment, 'nation': c_nationkey}) AS record FROM customer")
def json_export(spark, d):
    """One JSON object a row, fields in the order of the schema."""
    return table(spark, d, "customer").select("c_custkey", F.to_json(F.struct("c_custkey", "c_name", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))).alias("record"))


@query(f"SELECT {SCHEMA_VERSION} AS schema_version, 'applications' AS scope, 'o_orderstatus = O' AS filters, CAST(NULL AS BIGINT) AS row_limit, count(*) AS row_count, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders WHERE o_orderstatus = 'O'")
def export_manifest(spark, d):
    """What an export says of itself; no limit is written as none, not left out."""
    o = table(spark, d, "orders").filter("o_orderstatus = 'O'").agg(F.count("*").alias("row_count"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))
    return o.select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit("applications").alias("scope"), F.lit("o_orderstatus = O").alias("filters"), F.lit(None).cast("long").alias("row_limit"), "row_count", "first_key", "last_key")


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 250")
def export_limit(spark, d):
    """An explicit limit, over a total order."""
    return table(spark, d, "orders").filter("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(250).select("o_orderkey", "o_custkey", "o_orderdate")


#: Tables of a diagnostics bundle, and tables that never go into one.
INCLUDED, EXCLUDED = ("events", "orders", "pages"), ("conversations", "documents", "labels")


@query(" UNION ALL ".join([f"SELECT '{t}' AS item, true AS included, count(*) AS n FROM {t}" for t in INCLUDED] + [f"SELECT '{t}', false, CAST(NULL AS BIGINT)" for t in EXCLUDED]))
def diagnostics_bundle(spark, d):
    """The bundle's manifest: what is in it, with counts, and what is left out by rule."""
    rows = [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("item"), F.lit(True).alias("included"), "n") for t in INCLUDED]
    rows.append(spark.createDataFrame([(t, False, None) for t in EXCLUDED], "item string, included boolean, n long"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("""WITH was AS (SELECT o_orderpriority AS path, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS checksum FROM orders GROUP BY 1), now AS (SELECT o_orderpriority AS path, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS checksum FROM orders WHERE NOT (o_orderpriority = '5-LOW') AND o_orderkey <> 7 GROUP BY 1)
SELECT coalesce(was.path, now.path) AS path, CASE WHEN now.path IS NULL THEN 'MISSING' WHEN was.path IS NULL THEN 'UNEXPECTED' ELSE 'DIFFERS' END AS problem FROM was FULL JOIN now ON was.path = now.path WHERE was.n IS DISTINCT FROM now.n OR was.checksum IS DISTINCT FROM now.checksum""")
def backup_verify(spark, d):
    """A backup's manifest against what is there; the second has lost a part and one row."""
    o = table(spark, d, "orders")

    def manifest(df, prefix):
        return df.groupBy(F.col("o_orderpriority").alias("path")).agg(F.count("*").alias(f"{prefix}_n"), F.sum("o_orderkey").alias(f"{prefix}_sum"))

    both = manifest(o, "was").join(manifest(o.filter("o_orderpriority <> '5-LOW' and o_orderkey <> 7"), "now"), "path", "full_outer")
    problem = F.when(F.col("now_n").isNull(), "MISSING").when(F.col("was_n").isNull(), "UNEXPECTED").otherwise("DIFFERS")
    return both.filter(~(F.col("was_n").eqNullSafe(F.col("now_n")) & F.col("was_sum").eqNullSafe(F.col("now_sum")))).select("path", problem.alias("problem"))


_VERSIONS = f"""SELECT doc_id, source, strlen(text) AS bytes, sha256({NORM}) AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS version, coalesce(l.toxic = 0 AND l.quality = 1, false) AS marked FROM documents d LEFT JOIN labels l USING (doc_id)"""


def versions(spark, d):
    """Documents as versions of what their source shows, newest first, with those that a user has marked."""
    marked = table(spark, d, "labels").select("doc_id", ((F.col("toxic") == 0) & (F.col("quality") == 1)).alias("marked"))
    docs = table(spark, d, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("bytes"), tx.content_hash(F.col("text")).alias("h"))
    return running(docs.join(marked, "doc_id", "left").withColumn("marked", F.coalesce("marked", F.lit(False))), ["source"], [-F.col("doc_id")], rank="version")


@query(f"SELECT doc_id, source, version, version <= CASE WHEN marked THEN 10 ELSE {POLICY.retention_versions} END AS keep FROM ({_VERSIONS})")
def retention(spark, d):
    """The newest versions of a source stay, more of those that a user has marked; a source of any number of versions spans many tasks."""
    most = F.when(F.col("marked"), 10).otherwise(POLICY.retention_versions)
    return versions(spark, d).select("doc_id", "source", "version", (F.col("version") <= most).alias("keep"))


#: What the store may hold beside the current representations, in bytes for each document of the table.
BUDGET_PER_DOCUMENT = 100


@query(f"""WITH v AS (SELECT *, h IS DISTINCT FROM lag(h) OVER (PARTITION BY source ORDER BY version) AS changed FROM ({_VERSIONS})),
m AS (SELECT *, sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY version) AS meaning FROM v),
c AS (SELECT *, CASE WHEN version = 1 THEN 0 WHEN meaning = 2 AND changed THEN 1 WHEN marked THEN 2 ELSE 3 END AS class FROM m),
r AS (SELECT *, sum(CASE WHEN class = 0 THEN 0 ELSE coalesce(bytes, 0) END) OVER (ORDER BY class, version, doc_id) AS used FROM c)
SELECT doc_id, class, CAST(used AS BIGINT) AS used, class = 0 OR used <= (SELECT count(*) * {BUDGET_PER_DOCUMENT} FROM documents) AS keep FROM r""")
def retention_budget(spark, d):
    """What stays under a disk budget: every source's current version whatever it takes, then previous meaningful ones, then marked history, then the rest, until the budget is used."""
    # the newest version of each text of a source: its second is the previous meaningful revision; texts that come back are seen by their order
    seen = written(versions(spark, d), "versions")
    nearest = seen.select(F.col("source").alias("s"), (F.col("version") + 1).alias("next"), F.col("h").alias("newer"))
    beside = seen.join(nearest, F.col("source").eqNullSafe(F.col("s")) & (F.col("version") == F.col("next")), "left").drop("s", "next")
    changed = (F.col("version") == 1) | ~F.col("h").eqNullSafe(F.col("newer"))
    first = beside.filter(changed & (F.col("version") > 1)).groupBy("source").agg(F.min("version").alias("previous"))
    ranked = beside.join(first.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    kind = F.when(F.col("version") == 1, 0).when(F.col("version") == F.col("previous"), 1).when(F.col("marked"), 2).otherwise(3)
    classed = ranked.select("doc_id", "version", "bytes", kind.alias("class"))
    used = running(classed, [], [F.col("class"), F.col("version"), F.col("doc_id")], sums={"used": F.when(F.col("class") > 0, F.col("bytes"))})
    budget = table(spark, d, "documents").count() * BUDGET_PER_DOCUMENT
    return used.select("doc_id", "class", "used", ((F.col("class") == 0) | (F.col("used") <= budget)).alias("keep"))


UNIQUE = [("lineitem", ("l_orderkey", "l_linenumber")), ("events", ("event_id",)), ("documents", ("doc_id",)), ("orders", ("o_orderkey",)), ("conversations", ("conv_id", "turn"))]


@query(" UNION ALL ".join(f"SELECT '{t}' AS relation, '{','.join(k)}' AS key, count(*) AS violating_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows FROM (SELECT count(*) AS n FROM {t} GROUP BY {', '.join(k)} HAVING count(*) > 1)" for t, k in UNIQUE))
def constraint_uniqueness(spark, d):
    """Keys that should be unique and are not."""
    out = None
    for name, keys in UNIQUE:
        v = ledger.violations(table(spark, d, name), list(keys)).agg(F.count("*").alias("violating_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("surplus_rows"))
        v = v.select(F.lit(name).alias("relation"), F.lit(",".join(keys)).alias("key"), "violating_keys", "surplus_rows")
        out = v if out is None else out.unionByName(v)
    return out


FOREIGN = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id"), ("orders", "o_orderkey", "lineitem", "l_orderkey")]


@query(" UNION ALL ".join(f"SELECT '{c}.{ck}' AS child, '{p}.{pk}' AS parent, count(*) AS orphans FROM {c} WHERE {ck} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} x WHERE x.{pk} = {c}.{ck})" for c, ck, p, pk in FOREIGN))
def fk_check(spark, d):
    """Rows without the row that they refer to; a null key refers to nothing."""
    out = None
    for child, ck, parent, pk in FOREIGN:
        rows = ledger.orphans(table(spark, d, child).select(ck), table(spark, d, parent).select(pk), ck, pk)
        n = rows.agg(F.count("*").alias("orphans")).select(F.lit(f"{child}.{ck}").alias("child"), F.lit(f"{parent}.{pk}").alias("parent"), "orphans")
        out = n if out is None else out.unionByName(n)
    return out


DOMAINS = [("orders", "o_orderstatus", ("F", "O")), ("lineitem", "l_returnflag", ("A", "N", "R")), ("events", "event_type", ("click", "purchase", "signup", "view"))]


@query(" UNION ALL ".join(f"SELECT '{t}.{c}' AS field, {c} AS value, count(*) AS n FROM {t} WHERE {c} NOT IN {v} GROUP BY 2" for t, c, v in DOMAINS))
def domain_check(spark, d):
    """Values outside of a closed vocabulary; here two vocabularies leave one value out each, so that there is something to find."""
    out = None
    for name, column, values in DOMAINS:
        n = table(spark, d, name).filter(~F.col(column).isin(*values)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).select(F.lit(f"{name}.{column}").alias("field"), "value", "n")
        out = n if out is None else out.unionByName(n)
    return out


#: Most bytes and levels of an imported document.
IMPORT_BYTES, IMPORT_DEPTH = 4000, 6


@query(f"""SELECT doc_id, CASE WHEN bytes > {IMPORT_BYTES} THEN 'TOO_LARGE' WHEN kind = 2 THEN 'NOT_JSON' WHEN depth > {IMPORT_DEPTH} THEN 'TOO_DEEP' ELSE 'ACCEPTED' END AS verdict FROM (
  SELECT doc_id, doc_id % 4 AS kind, CASE doc_id % 4 WHEN 0 THEN 3 WHEN 1 THEN doc_id % 10 + 1 ELSE 2 END AS depth,
    CASE doc_id % 4 WHEN 0 THEN 43 + length(CAST(doc_id AS VARCHAR)) WHEN 1 THEN 2 * (doc_id % 10 + 1) + 1 WHEN 2 THEN 8 + n_chars ELSE n_chars + 10 END AS bytes FROM documents)""")
def import_limits(spark, d):
    """Imported documents are data under limits of bytes, form and depth, judged before anything reads them; made of the documents, and the SQL knows how.

    Side by side objects are no depth, nor are brackets in strings; arrays nest as objects do, and a document may be an array.
    """
    kind, deep = F.col("doc_id") % 4, (F.col("doc_id") % 10 + 1).cast("int")
    side = F.concat(F.lit('{"a":{},"b":{"c":["{{[[", "\\"}"]},"d":{},"id":'), F.col("doc_id").cast("string"), F.lit("}"))
    doc = F.when(kind == 0, side).when(kind == 1, F.concat(F.repeat(F.lit("["), deep), F.lit("1"), F.repeat(F.lit("]"), deep))).when(kind == 2, F.concat(F.lit('{"id": "'), F.repeat(F.lit("x"), F.col("n_chars").cast("int"))))
    doc = doc.otherwise(F.concat(F.lit('[{"i":"'), F.repeat(F.lit("y"), F.col("n_chars").cast("int")), F.lit('"}')))
    doc = F.when(kind == 3, F.concat(doc, F.lit("]"))).otherwise(doc)
    verdict = F.when(F.octet_length("doc") > IMPORT_BYTES, "TOO_LARGE").when(F.try_parse_json("doc").isNull(), "NOT_JSON").when(tx.json_depth(F.col("doc")) > IMPORT_DEPTH, "TOO_DEEP").otherwise("ACCEPTED")
    return table(spark, d, "documents").select("doc_id", doc.alias("doc")).select("doc_id", verdict.alias("verdict"))


@query("""SELECT page_id, final_url, scheme, body_bytes, body_sha256, content_type, CAST(len(links) AS INTEGER) AS n_links FROM (SELECT page_id, url AS final_url, split_part(url, ':', 1) AS scheme, strlen(html) AS body_bytes, sha256(html) AS body_sha256,
  CASE WHEN contains(lower(substr(html, 1, 200)), '<!doctype html') OR contains(lower(substr(html, 1, 200)), '<html') THEN 'text/html' ELSE 'application/octet-stream' END AS content_type, regexp_extract_all(html, 'href=') AS links FROM pages)""")
def fetch_result_scan(spark, d):
    """Fetched pages in one shape, whichever way they were fetched."""
    head = F.lower(F.substring("html", 1, 200))
    kind = F.when(head.contains("<!doctype html") | head.contains("<html"), "text/html").otherwise("application/octet-stream")
    return table(spark, d, "pages").select("page_id", F.col("url").alias("final_url"), F.split_part("url", F.lit(":"), F.lit(1)).alias("scheme"), F.octet_length("html").cast("long").alias("body_bytes"), F.sha2(F.col("html").cast("binary"), 256).alias("body_sha256"), kind.alias("content_type"), F.size(F.regexp_extract_all("html", F.lit("href="), F.lit(0))).alias("n_links"))


@query("SELECT p_brand AS feed, p_partkey AS entry, p_name || ' & ' || p_type AS title, CAST(floor(p_retailprice) AS BIGINT) AS pay FROM part")
def feed_scan(spark, d):
    """XML feeds, one for each company, made of the jobs and read back entry by entry."""
    p = table(spark, d, "part")
    entry = F.concat(F.lit("<entry><id>"), F.col("p_partkey").cast("string"), F.lit("</id><title>"), "p_name", F.lit(" &amp; "), "p_type", F.lit("</title><pay>"), F.floor("p_retailprice").cast("string"), F.lit("</pay></entry>"))
    # a feed is as long as the page that a source serves: at most 50 entries here
    feeds = p.groupBy("p_brand", (F.col("p_partkey") / 50).cast("long").alias("page")).agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), ""), F.lit("</feed>")).alias("xml"))
    parts = F.arrays_zip(F.xpath("xml", F.lit("/feed/entry/id/text()")).alias("entry"), F.xpath("xml", F.lit("/feed/entry/title/text()")).alias("title"), F.xpath("xml", F.lit("/feed/entry/pay/text()")).alias("pay"))
    return feeds.select(F.col("p_brand").alias("feed"), F.explode(parts).alias("e")).select("feed", F.col("e.entry").cast("long").alias("entry"), "e.title", F.col("e.pay").cast("long").alias("pay"))


#: Zones of the plans, in turn.
ZONES = ("America/New_York", "Europe/Berlin", "Asia/Kolkata", "America/Sao_Paulo")


def planned(spark, d):
    """Orders as occurrences of their customer's plan: a quarter of an hour of their night, in the customer's zone."""
    zone = F.element_at(F.array(*[F.lit(z) for z in ZONES]), (F.col("o_custkey") % len(ZONES) + 1).cast("int"))
    local = F.timestamp_add("MINUTE", F.col("o_orderkey") % 16 * 15, F.date_trunc("DAY", "o_orderdate").cast("timestamp_ntz"))
    return table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("plan_id"), zone.alias("zone"), local.alias("local_time"))


_PLANNED = f"""SELECT o_orderkey, o_custkey AS plan_id, {list(ZONES)}[o_custkey % {len(ZONES)} + 1] AS zone, date_trunc('day', o_orderdate) + to_minutes(CAST(o_orderkey % 16 * 15 AS BIGINT)) AS local_time FROM orders"""
#: The twin looks for all minutes of the day around that show a local time, or the first minute that shows a later one.
_RESOLVED = f"""SELECT o_orderkey, plan_id, zone, local_time, CASE WHEN n = 0 THEN 'GAP' WHEN n > 1 THEN 'FOLD' ELSE 'PLAIN' END AS kind, CASE WHEN n = 0 THEN later ELSE same END AS utc FROM (
  SELECT o_orderkey, plan_id, zone, local_time, count(CASE WHEN shown = local_time THEN 1 END) AS n, min(CASE WHEN shown = local_time THEN moment END) AS same, min(CASE WHEN shown > local_time THEN moment END) AS later
  FROM (SELECT *, timezone(zone, timezone('UTC', moment)) AS shown FROM (SELECT *, local_time + to_minutes(m) AS moment FROM ({_PLANNED}), unnest(generate_series(-720, 720, 15)) AS s(m))) GROUP BY ALL)"""


@query(f"""SELECT o_orderkey, zone, strftime(utc, '%Y-%m-%d %H:%M:%S') AS next_utc, kind, CAST(date_diff('minute', utc, timezone(zone, timezone('UTC', utc))) AS INTEGER) AS offset_minutes,
  sha256(plan_id || chr(1) || zone || chr(1) || strftime(local_time, '%Y-%m-%dT%H:%M:%S')) AS occurrence_id FROM ({_RESOLVED})""")
def schedule_dst(spark, d):
    """Local times as moments: one that a spring gap skips means the first moment behind it, one that an autumn repeats means the first, and the record says so."""
    found = planned(spark, d).withColumn("r", schedules.resolved(F.col("local_time"), F.col("zone")))
    return found.select("o_orderkey", "zone", F.date_format("r.utc", "yyyy-MM-dd HH:mm:ss").alias("next_utc"), "r.kind", "r.offset_minutes", schedules.occurrence_id(F.col("plan_id"), F.col("zone"), F.col("local_time")).alias("occurrence_id"))


@query(f"""SELECT plan_id, o_orderkey, CASE WHEN row_number() OVER (PARTITION BY plan_id ORDER BY utc DESC, oid) <= 2 THEN 'RUN' ELSE 'SKIPPED' END AS action FROM (
  SELECT plan_id, min(o_orderkey) AS o_orderkey, oid, min(utc) AS utc FROM (SELECT *, sha256(plan_id || chr(1) || zone || chr(1) || strftime(local_time, '%Y-%m-%dT%H:%M:%S')) AS oid FROM ({_RESOLVED}))
  WHERE utc > TIMESTAMP '1994-01-01' AND utc <= TIMESTAMP '1996-01-01' AND oid NOT IN (SELECT sha256(o_custkey || chr(1) || z || chr(1) || strftime(t, '%Y-%m-%dT%H:%M:%S')) FROM (
    SELECT o_custkey, zone AS z, local_time AS t FROM orders JOIN ({_PLANNED}) USING (o_orderkey) WHERE o_orderstatus = 'F')) GROUP BY plan_id, oid)""")
def schedule_catch_up(spark, d):
    """After two years asleep, each plan runs its two newest occurrences that were not delivered before, and records the others as skipped."""
    found = planned(spark, d).withColumn("due", schedules.resolved(F.col("local_time"), F.col("zone"))["utc"]).withColumn("occurrence_id", schedules.occurrence_id(F.col("plan_id"), F.col("zone"), F.col("local_time")))
    found = written(found, "occurrences")
    once = found.groupBy("plan_id", "occurrence_id").agg(F.min("o_orderkey").alias("o_orderkey"), F.min("due").alias("due"))
    delivered = found.join(table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey", "left_semi")
    ends = [F.lit(f"{year}-01-01 00:00:00").cast("timestamp_ntz") for year in (1994, 1996)]
    return schedules.catch_up(once, delivered, *ends, most=2).select("plan_id", "o_orderkey", "action")


@query("SELECT user_id AS plan_id, count(*) AS missed, max(event_id) AS caught_up FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-15' GROUP BY 1")
def missed_runs(spark, d):
    """What came due while the host slept becomes one run of each plan, the latest."""
    asleep = table(spark, d, "events").filter("ts >= timestamp_ntz'2024-01-10' and ts < timestamp_ntz'2024-01-15'")
    return asleep.groupBy(F.col("user_id").alias("plan_id")).agg(F.count("*").alias("missed"), F.max("event_id").alias("caught_up"))


_STAGED = """WITH j AS (SELECT o_orderkey AS k, o_custkey AS company, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS title, o_orderstatus AS place FROM orders),
s AS (SELECT company, title, place, day, min(k) AS root, count(*) AS n FROM j GROUP BY ALL),
c AS (SELECT company, title, day, count(*) AS places, min(root) AS root FROM s GROUP BY ALL)"""


@query(f"""{_STAGED} SELECT s.root AS job_id, s.n AS n_same, CASE WHEN c.places > 1 AND s.root <> c.root THEN 'CLUSTER' WHEN s.n > 1 THEN 'MERGE' ELSE 'ALONE' END AS decision, CASE WHEN c.places > 1 AND s.root <> c.root THEN 5 WHEN s.n > 1 THEN 4 END AS stage, c.root AS cluster_id
FROM s JOIN c ON s.company = c.company AND s.title = c.title AND s.day = c.day""")
def staged_match(spark, d):
    """Stages 4 and 5: equal company, title, place and day merge; where only the place differs, they are clustered. A row per class, no pairs."""
    j = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("company"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("place"))
    same = j.groupBy("company", "title", "place", "day").agg(F.min("k").alias("root"), F.count("*").alias("n"))
    cluster = same.groupBy("company", "title", "day").agg(F.count("*").alias("places"), F.min("root").alias("cluster_id"))
    apart = (F.col("places") > 1) & (F.col("root") != F.col("cluster_id"))
    both = same.join(cluster, ["company", "title", "day"])
    decision = F.when(apart, "CLUSTER").when(F.col("n") > 1, "MERGE").otherwise("ALONE")
    return both.select(F.col("root").alias("job_id"), F.col("n").alias("n_same"), decision.alias("decision"), F.when(apart, 5).when(F.col("n") > 1, 4).alias("stage"), "cluster_id")


@query("""SELECT h AS canonical_key, count(*) AS n_jobs, array_to_string(list_sort(list(DISTINCT CASE WHEN toxic = 1 THEN 'DISMISSED' WHEN quality = 1 THEN 'SHORTLISTED' ELSE 'NONE' END)), ',') AS dispositions, count(DISTINCT CASE WHEN toxic = 1 THEN 'D' WHEN quality = 1 THEN 'S' ELSE 'N' END) > 1 AS conflict
FROM (SELECT sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS h, toxic, quality FROM documents JOIN labels USING (doc_id)) GROUP BY 1""")
def conflicting_dispositions(spark, d):
    """A merge keeps every disposition of what it joins; conflicts are shown, not resolved."""
    rows = table(spark, d, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("h")).join(table(spark, d, "labels"), "doc_id")
    kind = F.when(F.col("toxic") == 1, "DISMISSED").when(F.col("quality") == 1, "SHORTLISTED").otherwise("NONE")
    g = rows.groupBy(F.col("h").alias("canonical_key")).agg(F.count("*").alias("n_jobs"), F.array_sort(F.collect_set(kind)).alias("k"))
    return g.select("canonical_key", "n_jobs", F.array_join("k", ",").alias("dispositions"), (F.size("k") > 1).alias("conflict"))


_LINKS = r"""regexp_extract_all(html, '<a href="([^"]*)"', 1)"""


@query(f"""WITH l AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) AS scheme, unnest({_LINKS}) AS href FROM pages)
SELECT target, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, CASE WHEN starts_with(href, '//') THEN scheme || href WHEN regexp_matches(href, '^/\\.{{1,2}}([?#]|$)') THEN origin || '/' || regexp_extract(href, '^/\\.+(.*)$', 1) ELSE origin || href END AS target FROM l) GROUP BY 1""")
def link_targets(spark, d):
    """All links of pages, resolved against the page that each stands on, with how many links and pages name a target."""
    hrefs = table(spark, d, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    found = hrefs.select("page_id", ux.resolved(F.col("url"), F.col("href")).alias("target"))
    return found.groupBy("target").agg(F.count("*").alias("n_links"), F.countDistinct("page_id").alias("n_pages"))


RECIPE = {"version": 1, "fields": {
    "title": [{"kind": "meta", "name": "og:title"}, {"kind": "tag", "name": "h1"}, {"kind": "tag", "name": "title"}],
    "language": [{"kind": "attribute", "tag": "html", "name": "lang"}],
    "first_link": [{"kind": "attribute", "tag": "a", "name": "href"}],
    "pay": [{"kind": "json_ld", "path": "baseSalary"}],
}}


@query("""SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?i)<h1[^>]*>([^<]*)</h1>', 1)), ''), nullif(trim(regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1)), '')) AS title,
  nullif(trim(regexp_extract(html, '(?i)<html[^>]* lang="([^"]*)"', 1)), '') AS language, nullif(trim(regexp_extract(html, '(?i)<a [^>]*href="([^"]*)"', 1)), '') AS first_link, CAST(NULL AS VARCHAR) AS pay FROM pages""")
def recipe_extract(spark, d):
    """A recipe of data, compiled to the columns of one scan."""
    return table(spark, d, "pages").select("page_id", *compiled(RECIPE))


_LADDER = "CASE WHEN regexp_matches(email, '^(jobs|careers|hr|recruit)') THEN 1 WHEN regexp_matches(email, '^(info|contact|office)') THEN 2 ELSE 3 END"


@query(f"""SELECT domain, arg_min(email, {{'r': rank, 'e': email}}) AS email, min(rank) AS rank, count(*) AS n FROM (SELECT DISTINCT email, split_part(email, '@', 2) AS domain, {_LADDER} AS rank FROM (
  SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}'))) AS email FROM documents)) GROUP BY 1""")
def contact_ladder(spark, d):
    """The best contact of each domain by a ladder of kinds; only addresses that are written somewhere, none inferred."""
    found = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(tx.EMAIL), F.lit(0))).alias("email")).select(F.lower("email").alias("email")).distinct()
    rank = F.when(F.col("email").rlike("^(jobs|careers|hr|recruit)"), 1).when(F.col("email").rlike("^(info|contact|office)"), 2).otherwise(3)
    ranked = found.select("email", F.split_part("email", F.lit("@"), F.lit(2)).alias("domain"), rank.alias("rank"))
    return ranked.groupBy("domain").agg(F.min_by("email", F.struct("rank", "email")).alias("email"), F.min("rank").alias("rank"), F.count("*").alias("n"))
