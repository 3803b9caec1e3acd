"""Queries over what pages say and how that changes: content, facts, change classes, robots decisions, and revisions of recipes and manifests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import url as ux
from ..operators import content, revisions, robots
from ..operators.ledger import written
from ..operators.recipes import extract_all
from ..sources.tables import table
from .acquisition import H
from .locators import _ENTRY, _decoded, trees
from .presence import STATE
from .registry import query

_BODY = "regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1) || ' ' || regexp_extract(html, '(?s)<article>(.*)</article>', 1)"
_PLAIN = f"trim(regexp_replace({_decoded(f"regexp_replace(regexp_replace({_BODY}, '</?(?:{'|'.join(content.PARTING)})(?:\\s[^>]*)?>', ' ', 'g'), '<[^>]*>', '', 'g')")}, '\\s+', ' ', 'g'))"
_VOTES = ", ".join(f"len(list_filter(ws, lambda w: w IN ({', '.join(repr(w) for w in words)}))) AS n_{lang}" for lang, words in content.PROFILES.items())
_MOST = f"greatest({', '.join(f'n_{x}' for x in content.PROFILES)})"


@query(f"""WITH t AS (SELECT page_id, regexp_extract(html, '<article><h1>([^<]*)</h1>', 1) AS h1, {_PLAIN} AS text FROM pages), v AS (SELECT page_id, h1, text, {_VOTES} FROM (SELECT *, regexp_split_to_array(lower(text), '[^\\p{{L}}]+') AS ws FROM t)),
m AS (SELECT *, {_MOST} AS most, {' + '.join(f'CASE WHEN n_{x} = {_MOST} THEN 1 ELSE 0 END' for x in content.PROFILES)} AS ties FROM v)
SELECT page_id, nullif(trim(regexp_replace({_decoded('h1')}, '\\s+', ' ', 'g')), '') AS heading, sha256(text) AS text_hash, CAST(length(text) AS INTEGER) AS n_chars, CASE WHEN most > 0 AND ties = 1 THEN CASE {' '.join(f"WHEN n_{x} = most THEN '{x}'" for x in content.PROFILES)} END END AS lang,
  CASE WHEN most > 0 AND ties = 1 THEN round(CAST(most AS DOUBLE) / ({' + '.join(f'n_{x}' for x in content.PROFILES)}), 6) ELSE 0.0 END AS confidence FROM m""")
def page_content(spark, d):
    """Cleaned content of pages: the heading as Markdown has it, plain text by its hash, and the language that its words vote for."""
    rows = trees(spark, d).select("page_id", F.explode(F.array(F.struct(content.markdown(F.col("page")).alias("md"), content.plain(F.col("page")).alias("text")))).alias("c"))  # worked out once
    told = rows.select("page_id", "c.*", F.explode(F.array(content.language(F.col("c.text")))).alias("l"))
    heading = F.nullif(F.trim(F.regexp_extract("md", r"(?m)^# (.*)$", 1)), F.lit(""))
    return told.select("page_id", heading.alias("heading"), F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"), F.length("text").alias("n_chars"), "l.lang", "l.confidence")


def _rule_sql(rule: tuple) -> str:
    rule_id, version, kind, value, pattern, confidence = rule
    quoted = pattern.replace("'", "''")
    return f"SELECT doc_id, '{rule_id}' AS rule_id, {version} AS rule_version, '{kind}' AS fact_type, '{value}' AS value, CAST({confidence} AS DOUBLE) AS confidence, regexp_extract(text, '{quoted}', 0) AS evidence_text, text FROM documents"


@query(f"""SELECT doc_id, rule_id, rule_version, fact_type, value, confidence, sha256(evidence_text) AS evidence_hash, CAST(strpos(text, evidence_text) - 1 AS INTEGER) AS evidence_start, CAST(strpos(text, evidence_text) - 1 + length(evidence_text) AS INTEGER) AS evidence_end
FROM ({' UNION ALL '.join(map(_rule_sql, content.RULES))}) WHERE evidence_text <> ''""")
def document_facts(spark, d):
    """Facts with the span that shows them and the version of the rule that found them; a fixed rule table becomes the expressions of one scan."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(content.facts(F.col("text"))).alias("f")).select("doc_id", "f.*")
    return rows.select("doc_id", "rule_id", "rule_version", "fact_type", "value", "confidence", F.sha2(F.col("evidence_text").cast("binary"), 256).alias("evidence_hash"), "evidence_start", "evidence_end")


_FIELDS = "{'title': l_returnflag, 'salary': floor(l_extendedprice / 20000), 'location': round(l_tax * 100), 'apply_url': l_discount > 0.05, 'content': floor(l_quantity / 10), 'body': l_quantity, 'state': " + STATE + "}"
_FLAGS = {"template": "l_orderkey % 97 = 0", "drift": "l_orderkey % 89 = 0"}


def _listed_sql() -> str:
    own = "NOT ({template}) AND NOT ({drift})".format(**_FLAGS)
    was, now = "o.state = 'CLOSED'", "n.state = 'CLOSED'"
    some = {"JOB_CLOSED": f"{now} AND NOT ({was})", "JOB_REOPENED": f"{was} AND NOT ({now}) AND NOT repost", "REPOST_DETECTED": f"{was} AND NOT ({now}) AND repost", "PAGE_TEMPLATE_CHANGED": _FLAGS["template"], "EXTRACTION_DRIFT": f"{_FLAGS['drift']} AND NOT ({_FLAGS['template']})"}
    some |= {f"{f.upper()}_CHANGED": f"o.{f} IS DISTINCT FROM n.{f} AND {own}" for f in ("title", "salary", "location", "apply_url", "content")}
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in some.items()) + "], lambda c: c IS NOT NULL)"


@query(f"""SELECT CASE WHEN o IS NULL THEN 'NEW' WHEN len(known) > 0 THEN array_to_string(known, ',') WHEN o.body IS DISTINCT FROM n.body THEN 'UNKNOWN_CHANGE' ELSE 'UNCHANGED' END AS classes, count(*) AS n FROM (SELECT o, n, {_listed_sql()} AS known FROM (
  SELECT n, lag(n) OVER w AS o, l_orderkey, date_diff('day', lag(l_shipdate) OVER w, l_shipdate) > 180 AS repost FROM (SELECT l_partkey, l_suppkey, l_shipdate, l_orderkey, l_linenumber, {_FIELDS} AS n FROM lineitem) WINDOW w AS (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber))) GROUP BY 1""")
def change_classes_listed(spark, d):
    """Every version of a posting against the one before it, with all of the classes that it falls into."""
    state = F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R"), "CLOSED").when(F.col("l_linestatus") == "O", "ACTIVE").otherwise("EXPIRED")
    fields = {"title": F.col("l_returnflag"), "salary": F.floor(F.col("l_extendedprice") / 20000), "location": F.round(F.col("l_tax") * 100), "apply_url": F.col("l_discount") > 0.05, "content": F.floor(F.col("l_quantity") / 10), "body": F.col("l_quantity"), "state": state}
    w = Window.partitionBy("l_partkey", "l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    rows = table(spark, d, "lineitem").withColumn("new", F.struct(*[c.alias(n) for n, c in fields.items()]))
    rows = rows.select("new", F.lag("new").over(w).alias("old"), "l_orderkey", (F.datediff("l_shipdate", F.lag("l_shipdate").over(w)) > 180).alias("repost"))
    classes = content.change_classes(F.col("old"), F.col("new"), F.expr(_FLAGS["template"]), F.expr(_FLAGS["drift"]), F.col("repost"))
    return rows.groupBy(F.coalesce(F.array_join(classes, ","), F.lit("NEW")).alias("classes")).agg(F.count("*").alias("n"))


_STAR, _NAMED = "User-agent: *\nDisallow: /fr/\nAllow: /fr/1\nDisallow: /*.html$ # old pages\n", "User-Agent: Other\nUser-agent: Lodestone\nDisallow: /en/9\nAllow: /en/99\n\nUser-agent: *\nDisallow: /\n"
_TAIL = "regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$', 1)"


@query(f"""SELECT page_id, CASE WHEN kind = 0 THEN 'NO_RULES' WHEN rule IS NULL OR rule IN ('/fr/1', '/en/99') THEN 'ALLOWED' ELSE 'DISALLOWED' END AS robots_decision, rule AS robots_rule FROM (
  SELECT page_id, kind, CASE WHEN kind = 1 AND regexp_matches(way, '\\.html$') THEN '/*.html$' WHEN kind = 1 AND starts_with(way, '/fr/1') THEN '/fr/1' WHEN kind = 1 AND starts_with(way, '/fr/') THEN '/fr/' WHEN kind = 2 AND starts_with(way, '/en/99') THEN '/en/99' WHEN kind = 2 AND starts_with(way, '/en/9') THEN '/en/9' END AS rule
  FROM (SELECT page_id, length(lower({H})) % 3 AS kind, {_TAIL} AS way FROM pages))""")
def robots_decisions(spark, d):
    """Each page's robots decision with the rule that made it: by its host's group for this agent, or for all; hosts have a file of one kind or another, or none."""
    pages = table(spark, d, "pages").select("page_id", "url")
    hosts = pages.select(ux.host(F.col("url")).alias("host")).distinct().withColumn("kind", F.length("host") % 3)
    files = hosts.filter("kind > 0").select("host", F.when(F.col("kind") == 1, _STAR).otherwise(_NAMED).alias("body"))
    return robots.decisions(pages, robots.parsed(files), "lodestone").select("page_id", "robots_decision", "robots_rule")


def _list_recipe(cards: str, title: str) -> dict:
    return {"version": 2, "card_locators": [{"kind": "css", "value": cards}], "fields": {"title": {"required": True, "locators": [{"kind": "relative_css", "value": title}]}, "job_url": {"locators": [{"kind": "href_pattern", "value": "/"}]}}}


#: Candidates for the recipe in force ("nav li", "a"): one that reads the same in another way, one that finds no title, and one that reads other cards too.
CANDIDATES = {"same": _list_recipe("ul > li:has(a)", "a[href]"), "no_title": _list_recipe("nav li", "h2"), "more": _list_recipe("nav li, article", "a, h1")}


@query(f"""WITH p AS (SELECT len(regexp_extract_all(html, '{_ENTRY}', 2)) AS n, page_id % 10 = 0 AS fixture, len(list_filter(regexp_extract_all(html, '{_ENTRY}', 2), lambda t: trim(t) <> '')) AS titled FROM pages),
s AS (SELECT CAST(sum(n) AS BIGINT) AS cards, CAST(sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS seconds, CAST(sum(CASE WHEN fixture THEN n ELSE 0 END) AS BIGINT) AS fixtures, count(*) AS pages, CAST(sum(titled) AS BIGINT) AS titled FROM p)
SELECT 'same' AS candidate, fixtures AS n_fixtures, fixtures AS n_passed, CAST(0 AS BIGINT) AS n_lost, CAST(0 AS BIGINT) AS n_gained, CAST(0 AS BIGINT) AS n_differs, 'ACTIVATE' AS decision FROM s
UNION ALL SELECT 'no_title', fixtures, 0, 0, 0, titled, 'REJECT' FROM s UNION ALL SELECT 'more', fixtures, fixtures, 0, pages, 0, 'ACTIVATE' FROM s""")
def recipe_promotion(spark, d):
    """Candidates of a recipe against fixtures and against what the recipe in force reads: only one that passes all and loses nothing is activated."""
    # every page is read as a tree once, for the recipe in force and all candidates together
    recipes = {"active": _list_recipe("nav li", "a"), **CANDIDATES}
    read = written(extract_all(table(spark, d, "pages"), recipes).filter("card is not null").select("recipe", "page_id", "card", "title", "job_url"), "outputs")
    active = read.filter("recipe = 'active'").drop("recipe")
    fixtures = active.filter("page_id % 10 = 0")
    out = None
    for name in CANDIDATES:
        candidate = read.filter(F.col("recipe") == name).drop("recipe")
        own = revisions.verdict(fixtures, active, candidate, ["page_id", "card"], ["title", "job_url"]).select(F.lit(name).alias("candidate"), "*")
        out = own if out is None else out.unionByName(own)
    return out


#: Fields of an adapter's manifest and the values that they may have (fixed names).
MANIFEST = {
    "id": ("string", None), "version": ("string", None), "adapter_api_version": ("string", ("1",)), "capabilities": ("list", ("discover", "listing_parse", "detail_parse", "incremental")), "supported_execution_classes": ("list", ("HTTP", "BROWSER")),
    "supported_auth_modes": ("list", ("NONE", "COOKIE", "TOKEN")), "cost_class": ("string", ("LIGHT", "HEAVY")), "cursor_schema_version": ("number", None),
}


@query("""SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'MISSING:version' WHEN 2 THEN 'VALUE:capabilities' WHEN 3 THEN 'TYPE:cursor_schema_version' WHEN 4 THEN 'UNKNOWN:rotate_proxy_on_block' WHEN 5 THEN 'NOT_JSON' ELSE 'TYPE:supported_auth_modes,VALUE:cost_class' END AS problems FROM supplier""")
def adapter_manifests(spark, d):
    """Manifests of adapters against their schema, made of the suppliers with faults of each kind; the SQL knows the faults."""
    kind, key = F.col("s_suppkey") % 7, F.col("s_suppkey").cast("string")
    parts = [
        F.concat(F.lit('"id":"a'), key, F.lit('"')), F.when(kind != 1, F.lit('"version":"1.2.0"')), F.lit('"adapter_api_version":"1"'), F.when(kind == 2, F.lit('"capabilities":["discover","hack"]')).otherwise(F.lit('"capabilities":["discover","detail_parse"]')),
        F.lit('"supported_execution_classes":["HTTP"]'), F.when(kind == 6, F.lit('"supported_auth_modes":"NONE"')).otherwise(F.lit('"supported_auth_modes":["NONE"]')), F.when(kind == 6, F.lit('"cost_class":"FREE"')).otherwise(F.lit('"cost_class":"LIGHT"')),
        F.when(kind == 3, F.lit('"cursor_schema_version":"two"')).otherwise(F.lit('"cursor_schema_version":2')), F.when(kind == 4, F.lit('"rotate_proxy_on_block":true')),
    ]
    text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.when(kind == 5, "").otherwise("}"))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(revisions.problems(text, MANIFEST), ",").alias("problems"))


@query("""SELECT o_custkey AS name, arg_max(o_orderkey, o_orderkey) AS revision, max(o_orderkey) AS since FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""")
def revision_pointer(spark, d):
    """The revision of each customer's plan that is in force: activated and not rolled back since; a rolled back one gives way to the one before it."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("revision"), (F.col("o_orderstatus") == "F").alias("bad"))
    activated = o.select((F.col("revision") * 2).alias("event_id"), "name", F.lit("ACTIVATE").alias("kind"), "revision")
    back = o.filter("bad").select((F.col("revision") * 2 + 1).alias("event_id"), "name", F.lit("ROLLBACK").alias("kind"), "revision")
    held = revisions.pointer(activated.unionByName(back))
    return held.select("name", "revision", (F.col("since") / 2).cast("long").alias("since"))
