"""Queries over documents and entities: hashes, duplicates, merges, facts, salaries, eligibility inputs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ledger, merges
from ..operators.ledger import written
from ..operators.near import near_pairs
from ..policy import POLICY
from ..sources.tables import table
from .registry import query

NORM = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


@query(f"SELECT doc_id, sha256({NORM}) AS normalized_content_hash, sha256(text) AS body_hash FROM documents")
def content_hash(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.content_hash(t).alias("normalized_content_hash"), tx.body_hash(t).alias("body_hash"))


@query(f"SELECT sha256({NORM}) AS hash, count(*) AS n, min(doc_id) AS first_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, d):
    g = table(spark, d, "documents").groupBy(tx.content_hash(F.col("text")).alias("hash"))
    return g.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")).filter("n > 1")


NEAR_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({NORM}, '[^ ]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p : p + 4], ' ') AS g FROM w, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS t(p) WHERE len(ws) > 0),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY gs) AS root FROM (SELECT doc_id, list_sort(list(g)) AS gs FROM s GROUP BY 1)),
r AS (SELECT s.* FROM s JOIN c USING (doc_id) WHERE doc_id = root),
n AS (SELECT doc_id, count(*) AS k FROM r GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT a AS doc_a, b AS doc_b, round(CAST(c AS DOUBLE) / (x.k + y.k - c), 6) AS jaccard FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
WHERE CAST(c AS DOUBLE) / (x.k + y.k - c) >= 0.8
UNION ALL SELECT root, doc_id, 1.0 FROM c WHERE doc_id <> root
"""


@query(NEAR_SQL)
def near_duplicates(spark, d):
    """Pairs at a five-word Jaccard of 0.8 or more between representatives, and each other document beside its representative, at 1.

    Documents with equal sets of shingles are one class; its least doc_id stands for it.
    """
    return near_pairs(table(spark, d, "documents").select("doc_id", "text"), POLICY.shingle_words, POLICY.similarity_threshold)


HASHED = f"SELECT doc_id, source, sha256({NORM}) AS h, min(doc_id) OVER (PARTITION BY sha256({NORM})) AS root FROM documents"


def _edges(spark, d):
    """Each exact copy beside the least document of its hash, as merge evidence."""
    docs = table(spark, d, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("h"))
    least = docs.groupBy("h").agg(F.min("doc_id").alias("a"))
    return docs.join(least, "h").filter("doc_id > a").select("a", F.col("doc_id").alias("b"))


@query(f"SELECT doc_id AS node, root FROM ({HASHED}) x WHERE EXISTS (SELECT 1 FROM ({HASHED}) y WHERE y.root = x.root AND y.doc_id <> x.doc_id)")
def duplicate_components(spark, d):
    return ledger.closure(_edges(spark, d))


CHAIN_SQL = """
WITH RECURSIVE e AS (SELECT vec_id AS a, vec_id + label + 1 AS b FROM embeddings WHERE vec_id + label + 1 <= (SELECT max(vec_id) FROM embeddings)),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS root FROM s UNION SELECT s.b, r.root FROM r JOIN s ON r.node = s.a)
SELECT node, min(root) AS root FROM r GROUP BY 1
"""


@query(CHAIN_SQL)
def merge_closure(spark, d):
    """Transitive merge chains over an evidence graph of all rows, against a recursive query."""
    v = table(spark, d, "embeddings")
    top = v.agg(F.max("vec_id").alias("top"))
    e = v.select(F.col("vec_id").alias("a"), (F.col("vec_id") + F.col("label") + 1).alias("b")).join(F.broadcast(top), F.col("b") <= F.col("top")).select("a", "b")
    return ledger.closure(e)


@query(f"SELECT root AS kept_job_id, doc_id AS absorbed_job_id, 1 AS stage, 'NORMALIZED_CONTENT' AS reason_code FROM ({HASHED}) WHERE doc_id <> root")
def merge_ledger(spark, d):
    return _edges(spark, d).select(F.col("a").alias("kept_job_id"), F.col("b").alias("absorbed_job_id"), F.lit(1).alias("stage"), F.lit("NORMALIZED_CONTENT").alias("reason_code"))


@query(f"SELECT doc_id AS job_id, CASE WHEN doc_id <> root AND doc_id % 2 = 0 THEN doc_id ELSE root END AS canonical_id FROM ({HASHED})")
def merge_undo_view(spark, d):
    """Undo appends: merges of even ids are undone, and the view is worked out again; rows keep their own id."""
    labels = merges.components_as_of(merge_events(spark, d), 2)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("job_id"))
    return docs.join(labels, docs["job_id"] == labels["node"], "left").select("job_id", F.coalesce("root", "job_id").alias("canonical_id"))


def merge_events(spark, d):
    """A history of merges: at 1 each copy joins the least document of its text, at 2 those of even ids are undone, at 3 each tenth id's is done again."""
    edges = written(_edges(spark, d), "edges")
    merged = edges.select((F.col("b") * 4 + 1).alias("event_id"), F.lit(1).alias("at"), F.lit("MERGE").alias("kind"), F.col("a").alias("kept"), F.col("b").alias("absorbed"))
    again = [(2, "UNDO", 2), (3, "REDO", 10)]
    for at, kind, n in again:
        merged = merged.unionByName(edges.filter(F.col("b") % n == 0).select((F.col("b") * 4 + at).alias("event_id"), F.lit(at).alias("at"), F.lit(kind).alias("kind"), F.col("a").alias("kept"), F.col("b").alias("absorbed")))
    return merged


_HELD = f"SELECT doc_id, root, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE root END AS r2, CASE WHEN doc_id % 2 = 0 AND doc_id % 10 <> 0 THEN doc_id ELSE root END AS r3 FROM ({HASHED})"


@query(f"""SELECT doc_id AS owner, CASE WHEN toxic = 1 THEN 'DISMISSED' WHEN quality = 1 THEN 'SHORTLISTED' ELSE 'NONE' END AS value, CASE WHEN doc_id % 4 <= 1 THEN root END AS shown_1, CASE WHEN doc_id % 4 <= 2 THEN r2 END AS shown_2, r3 AS shown_3 FROM labels JOIN ({_HELD}) USING (doc_id)""")
def dependents_as_of(spark, d):
    """Dispositions made at different times, with the job that shows them after the merge, after the undo, and after it is done again; null before they were made."""
    events = merge_events(spark, d)
    value = F.when(F.col("toxic") == 1, "DISMISSED").when(F.col("quality") == 1, "SHORTLISTED").otherwise("NONE")
    docs = table(spark, d, "documents").select("doc_id")
    made = table(spark, d, "labels").join(docs, "doc_id", "left_semi").select(F.col("doc_id").alias("owner"), (F.col("doc_id") % 4).cast("int").alias("made_at"), value.alias("value"))
    labels, out = merges.components_as_of(events, 1), made.select("owner", "value")
    for at in (1, 2, 3):
        if at > 1:
            labels = merges.components_after(labels, events, at - 1, at)
        out = out.join(merges.owned_as_of(made, labels, at).select("owner", F.col("shown_on").alias(f"shown_{at}")), "owner", "left")
    return out


@query(f"""SELECT kept, absorbed, 1 AS merged_at, CASE WHEN absorbed % 2 = 0 AND absorbed % 10 <> 0 THEN 2 END AS undone_at FROM (SELECT root AS kept, doc_id AS absorbed FROM ({HASHED}) WHERE root <> doc_id)""")
def merge_history(spark, d):
    """The ledger of merges as it is read: when each was made, and since when it is undone."""
    return merges.undone(merge_events(spark, d), 3)


@query("SELECT l_partkey AS job_id, l_suppkey AS source_id, l_shipdate AS evidence_at FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey % 4, l_shipdate DESC, l_suppkey, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def canonical_provenance(spark, d):
    """Source quality first, then the newest evidence, then the least id: one minimum, which partial aggregates take."""
    order = F.struct((F.col("l_suppkey") % 4).alias("ladder"), (-F.unix_micros(F.col("l_shipdate").cast("timestamp"))).alias("age"), "l_suppkey", "l_orderkey", "l_linenumber")
    best = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min_by(F.struct("l_suppkey", "l_shipdate"), order).alias("b"))
    return best.select(F.col("l_partkey").alias("job_id"), F.col("b.l_suppkey").alias("source_id"), F.col("b.l_shipdate").alias("evidence_at"))


SEEN = "(SELECT DISTINCT l_partkey, l_suppkey, l_shipdate FROM lineitem)"


@query(f"""SELECT l_partkey AS job_id, l_suppkey AS source_id, l_shipdate AS seen_at, CAST(sum(brk) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate) AS BIGINT) AS generation
FROM (SELECT *, CASE WHEN date_diff('day', lag(l_shipdate) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate), l_shipdate) > 365 THEN 1 ELSE 0 END AS brk FROM {SEEN})""")
def id_reuse_guard(spark, d):
    """A reappearance after a long closed interval starts a new identity generation."""
    seen = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate").distinct()
    w = Window.partitionBy("l_partkey", "l_suppkey").orderBy("l_shipdate")
    gap = F.datediff("l_shipdate", F.lag("l_shipdate").over(w))
    broken = seen.withColumn("brk", F.when(gap > POLICY.id_reuse_gap_days, 1).otherwise(0))
    return broken.select(F.col("l_partkey").alias("job_id"), F.col("l_suppkey").alias("source_id"), F.col("l_shipdate").alias("seen_at"), F.sum("brk").over(w).alias("generation"))


FACTS = [("licence", "licensed under"), ("pipe_table", " | "), ("question", "?"), ("email", "@")]
_FACTS = ", ".join(f"('{a}', '{b}')" for a, b in FACTS)


@query(f"SELECT doc_id, rule_id, CAST(strpos(lower(text), pattern) AS INTEGER) AS evidence_start FROM documents, (VALUES {_FACTS}) r(rule_id, pattern) WHERE strpos(lower(text), pattern) > 0")
def fact_extraction(spark, d):
    """A fixed rule table becomes one array expression: one scan, no cross join."""
    low = F.lower("text")
    hits = F.filter(F.array(*[F.struct(F.lit(r).alias("rule_id"), F.instr(low, p).alias("evidence_start")) for r, p in FACTS]), lambda h: h["evidence_start"] > 0)
    return table(spark, d, "documents").select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.rule_id", "h.evidence_start")


STOP = {"de": ["der", "die", "und"], "en": ["the", "of", "and"], "es": ["que", "los", "el"], "fr": ["le", "et", "les"]}


def _among(words):
    return lambda w: w.isin(words)


def _vote_sql():
    return ", ".join(f"len(list_filter(ws, lambda w: w IN ({', '.join(repr(x) for x in v)}))) AS n_{k}" for k, v in STOP.items())


@query(f"""SELECT lang, CASE WHEN greatest(n_de, n_en, n_es, n_fr) = 0 THEN 'unknown' WHEN n_de = greatest(n_de, n_en, n_es, n_fr) THEN 'de' WHEN n_en = greatest(n_en, n_es, n_fr) AND n_en >= n_de THEN 'en'
  WHEN n_es = greatest(n_de, n_en, n_es, n_fr) THEN 'es' ELSE 'fr' END AS predicted, count(*) AS n
FROM (SELECT lang, {_vote_sql()} FROM (SELECT lang, string_split({NORM}, ' ') AS ws FROM documents)) GROUP BY 1, 2""")
def language_vote(spark, d):
    """Stop words vote; ties go to the first language in order."""
    ws = F.split(tx.normalised(F.col("text")), " ")
    votes = table(spark, d, "documents").select("lang", *[F.size(F.filter(ws, _among(v))).alias(f"n_{k}") for k, v in STOP.items()])
    most = F.greatest("n_de", "n_en", "n_es", "n_fr")
    pick = F.when(most == 0, "unknown").when(F.col("n_de") == most, "de").when(F.col("n_en") == most, "en").when(F.col("n_es") == most, "es").otherwise("fr")
    return votes.groupBy("lang", pick.alias("predicted")).agg(F.count("*").alias("n"))


#: Periods as they are written, and how many of each make a year (fixed values).
PERIODS = [("hour", 2080), ("day", 260), ("week", 52), ("month", 12), ("year", 1)]
_LOW, _HIGH = "CAST(floor(p_retailprice) AS BIGINT) * 10", "CAST(floor(p_retailprice) AS BIGINT) * 10 + p_size"
_FACTOR = "CASE p_partkey % 5 " + " ".join(f"WHEN {i} THEN {n}" for i, (_, n) in enumerate(PERIODS)) + " END"


def pay_texts(spark, d):
    """Pay as job pages write it: ranges or single amounts, separators, thousands as k, currency before or behind, several periods."""
    low, high = F.floor("p_retailprice") * 10, F.floor("p_retailprice") * 10 + F.col("p_size")
    amount = [F.format_number(low, 0), low.cast("string"), F.concat(F.format_string("%.2f", low / 1000.0), F.lit("k"))]
    first = F.when(F.col("p_partkey") % 3 == 0, amount[0]).when(F.col("p_partkey") % 3 == 1, amount[1]).otherwise(amount[2])
    span = F.when((F.col("p_partkey") % 3 != 2) & (F.col("p_size") % 2 == 0), F.concat(first, F.lit(" - "), high.cast("string"))).otherwise(first)
    period = F.element_at(F.array(*[F.lit(p) for p, _ in PERIODS]), (F.col("p_partkey") % len(PERIODS) + 1).cast("int"))
    currency = F.when(F.col("p_size") % 3 == 0, "EUR").when(F.col("p_size") % 3 == 1, "$").otherwise("£")
    text = F.when(F.col("p_size") % 5 == 0, F.concat(span, F.lit(" "), currency)).otherwise(F.concat(currency, F.lit(" "), span))
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 11 == 0, "competitive").otherwise(F.concat(text, F.lit(" per "), period)).alias("salary_text"))


@query(f"""SELECT p_partkey, salary_min, salary_max, currency, period, salary_max * factor AS annual_max FROM (SELECT p_partkey, {_FACTOR} AS factor,
  {_LOW} AS salary_min, CASE WHEN p_partkey % 3 <> 2 AND p_size % 2 = 0 THEN {_HIGH} ELSE {_LOW} END AS salary_max, CASE p_size % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' ELSE 'GBP' END AS currency, ['HOUR', 'DAY', 'WEEK', 'MONTH', 'YEAR'][p_partkey % 5 + 1] AS period FROM part WHERE p_partkey % 11 <> 0)
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 11 = 0""")
def salary_parse(spark, d):
    """Amounts, currency and period out of pay texts, and the year's pay; a text without an amount stays unknown. The SQL knows the numbers, not the texts."""
    t = F.col("salary_text")
    number = r"([0-9][0-9,.]*k?)"

    def amount(found):
        plain = F.regexp_replace(found, "[,k]", "").cast("double")
        return F.when(found != "", F.round(F.when(found.endswith("k"), plain * 1000).otherwise(plain)).cast("long"))

    low = amount(F.regexp_extract(t, number, 1))
    high = amount(F.regexp_extract(t, r"- " + number, 1))
    currency = F.when(t.rlike(r"EUR|€"), "EUR").when(t.rlike(r"USD|\$"), "USD").when(t.rlike("GBP|£"), "GBP")
    period = F.upper(F.nullif(F.regexp_extract(t, "per ([a-z]+)", 1), F.lit("")))
    factor = F.create_map(*[F.lit(x) for p, n in PERIODS for x in (p.upper(), n)])
    parsed = pay_texts(spark, d).select("p_partkey", low.alias("salary_min"), F.coalesce(high, low).alias("salary_max"), currency.alias("currency"), period.alias("period"))
    return parsed.withColumn("annual_max", F.col("salary_max") * F.try_element_at(factor, F.col("period")))


@query("""WITH fx(rate_date, version, rate) AS (VALUES (TIMESTAMP '1994-01-01', 'v1', 1.1), (TIMESTAMP '1996-01-01', 'v2', 1.2), (TIMESTAMP '1998-07-01', 'v3', 1.3), (TIMESTAMP '2000-01-01', 'v4', 1.4))
SELECT o_orderkey, version, round(o_totalprice * CAST(rate AS DOUBLE), 4) AS annual_ref FROM (SELECT o.o_orderkey, o.o_totalprice, fx.version, fx.rate, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY fx.rate_date DESC) AS rn FROM orders o JOIN fx ON fx.rate_date <= o.o_orderdate) WHERE rn = 1""")
def salary_annual_fx(spark, d):
    """The rate in force at each date: intervals of a small rate table make the as-of join a broadcast range join."""
    fx = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ '1994-01-01', 'v1', 1.1D), (TIMESTAMP_NTZ '1996-01-01', 'v2', 1.2D), (TIMESTAMP_NTZ '1998-07-01', 'v3', 1.3D), (TIMESTAMP_NTZ '2000-01-01', 'v4', 1.4D) t(rate_date, version, rate)")
    spans = fx.withColumn("until", F.lead("rate_date").over(Window.orderBy("rate_date")))  # a handful of rates
    o = table(spark, d, "orders")
    on = (o["o_orderdate"] >= spans["rate_date"]) & (spans["until"].isNull() | (o["o_orderdate"] < spans["until"]))
    return o.join(F.broadcast(spans), on).select("o_orderkey", "version", F.round(F.col("o_totalprice") * F.col("rate"), 4).alias("annual_ref"))


@query("SELECT p_brand, count(*) AS n, count(pay) AS known, count(*) - count(pay) AS unknown, min(pay) AS least FROM (SELECT p_brand, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS pay FROM part) GROUP BY 1")
def salary_unknown_state(spark, d):
    """Unknown pay stays unknown: neither zero nor left out."""
    p = table(spark, d, "part").select("p_brand", F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("pay"))
    return p.groupBy("p_brand").agg(F.count("*").alias("n"), F.count("pay").alias("known"), (F.count("*") - F.count("pay")).alias("unknown"), F.min("pay").alias("least"))


@query("""SELECT company, count(*) AS n, min(kind || ':' || CAST(id AS VARCHAR)) AS first_member FROM (
  SELECT 'c' AS kind, c_custkey AS id, trim(regexp_replace(regexp_replace(regexp_replace(lower(c_name || ' Inc.'), '[^a-z0-9 ]', ' ', 'g'), '\\b(inc|ltd|llc|gmbh|corp)\\b', '', 'g'), ' +', ' ', 'g')) AS company FROM customer
  UNION ALL SELECT 's', s_suppkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(replace(s_name, 'Supplier', 'Customer') || ' GmbH'), '[^a-z0-9 ]', ' ', 'g'), '\\b(inc|ltd|llc|gmbh|corp)\\b', '', 'g'), ' +', ' ', 'g')) FROM supplier) GROUP BY 1 HAVING count(*) > 1""")
def company_resolution(spark, d):
    c = table(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(" Inc.")).alias("name"))
    s = table(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.concat(F.regexp_replace("s_name", "Supplier", "Customer"), F.lit(" GmbH")).alias("name"))
    both = c.union(s).select(tx.normalised_name(F.col("name")).alias("company"), F.concat_ws(":", "kind", F.col("id").cast("string")).alias("member"))
    return both.groupBy("company").agg(F.count("*").alias("n"), F.min("member").alias("first_member")).filter("n > 1")


@query("SELECT s_suppkey, n_name AS country, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE r_name END AS region, s_suppkey % 3 = 0 AS remote, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey % 12 AS INTEGER) END AS utc_offset FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def location_parse(spark, d):
    """Country, region, remote and offset out of texts such as "Remote - NATION_3, ASIA (UTC+5)"; a part that is not written is unknown."""
    places = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed dimensions of a few rows
    s = table(spark, d, "supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey"))
    none = F.lit("")
    written = F.concat(
        F.when(F.col("s_suppkey") % 3 == 0, "Remote - ").otherwise(none), "n_name", F.when(F.col("s_suppkey") % 4 == 0, none).otherwise(F.concat(F.lit(", "), "r_name")),
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" (UTC+"), (F.col("s_suppkey") % 12).cast("string"), F.lit(")"))).otherwise(none),
    )
    t = F.col("location_text")

    def part(pattern):
        return F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))

    return s.select("s_suppkey", written.alias("location_text")).select(
        "s_suppkey", part(r"^(?i:remote\s*-\s*)?([^,(]+?)\s*(?:[,(]|$)").alias("country"), part(r",\s*([^(]+?)\s*(?:\(|$)").alias("region"),
        t.rlike(r"(?i)\bremote\b").alias("remote"), part(r"UTC([+-][0-9]{1,2})").cast("int").alias("utc_offset"))


@query("SELECT sha256(CAST(user_id AS VARCHAR) || chr(1) || event_type || chr(1) || (props->>'$.k')) AS request_key, count(*) AS n FROM events GROUP BY 1")
def request_keys(spark, d):
    return table(spark, d, "events").groupBy(tx.key_of(F.col("user_id"), F.col("event_type"), F.get_json_object("props", "$.k")).alias("request_key")).agg(F.count("*").alias("n"))


@query(f"""WITH g AS (SELECT l_partkey AS job_id, l_suppkey AS source_id, l_shipdate AS seen_at, CAST(sum(brk) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate) AS BIGINT) AS generation
  FROM (SELECT *, CASE WHEN date_diff('day', lag(l_shipdate) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate), l_shipdate) > 365 THEN 1 ELSE 0 END AS brk FROM {SEEN})),
s AS (SELECT job_id, source_id, generation, min(seen_at) AS since, max(seen_at) AS until, max(generation) OVER (PARTITION BY job_id, source_id) AS current FROM g GROUP BY 1, 2, 3)
SELECT l_orderkey, l_linenumber, s.source_id, s.job_id, s.generation, s.generation = s.current AS is_current, p_brand AS company FROM lineitem JOIN s ON l_partkey = s.job_id AND l_suppkey = s.source_id AND l_shipdate BETWEEN s.since AND s.until JOIN part ON l_partkey = p_partkey""")
def identity_join(spark, d):
    """Each observation with the job that its source's id meant then: joined on source, native id and the generation of that id in whose time it falls."""
    seen = id_reuse_guard(spark, d).groupBy("job_id", "source_id", "generation").agg(F.min("seen_at").alias("since"), F.max("seen_at").alias("until"))
    current = F.max("generation").over(Window.partitionBy("job_id", "source_id"))  # generations of one id
    sources = seen.withColumn("is_current", F.col("generation") == current)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", F.col("l_partkey").alias("job_id"), F.col("l_suppkey").alias("source_id"))
    found = rows.join(sources, ["job_id", "source_id"]).filter((F.col("l_shipdate") >= F.col("since")) & (F.col("l_shipdate") <= F.col("until")))
    named = found.join(table(spark, d, "part").select(F.col("p_partkey").alias("job_id"), F.col("p_brand").alias("company")), "job_id")
    return named.select("l_orderkey", "l_linenumber", "source_id", "job_id", "generation", "is_current", "company")


@query("SELECT a.o_orderkey AS order_a, b.o_orderkey AS order_b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(date_diff('day', a.o_orderdate, b.o_orderdate)) <= 45 AND abs(a.o_totalprice - b.o_totalprice) <= 0.05 * greatest(a.o_totalprice, b.o_totalprice)")
def soft_match(spark, d):
    """Equal company, dates within the window, close pay. Dates are binned by the window so the equi-join key is narrow."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", F.floor(F.datediff("o_orderdate", F.lit("1990-01-01")) / POLICY.match_window_days).alias("bin"))
    b = o.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    near = (F.abs(F.datediff("a.o_orderdate", "b.o_orderdate")) <= POLICY.match_window_days) & (F.abs(F.col("a.o_totalprice") - F.col("b.o_totalprice")) <= 0.05 * F.greatest("a.o_totalprice", "b.o_totalprice"))
    return o.alias("a").join(b.alias("b"), ["o_custkey", "bin"]).filter("a.o_orderkey < b.o_orderkey").filter(near).select(F.col("a.o_orderkey").alias("order_a"), F.col("b.o_orderkey").alias("order_b"))


@query("SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'))) AS email FROM documents")
def contact_extract(spark, d):
    """Verbatim matches only; no address is ever inferred."""
    return table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(tx.EMAIL), F.lit(0)))).alias("email"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def redaction_sql(text: str) -> str:
    for pattern, kept in tx.REDACTIONS:
        text = f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(tx.replacement(kept, chr(92)))}, 'g')"
    return text


@query(f"SELECT doc_id, regexp_matches(text, {_quoted(tx.EMAIL)}) AS had_email, regexp_matches(text, {_quoted(tx.SECRET)}) AS had_secret, sha256({redaction_sql('text')}) AS redacted_hash FROM documents")
def redaction(spark, d):
    """Addresses, credentials in URLs and headers, and secret fields and parameters, replaced before anything is kept."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.has_email(t).alias("had_email"), tx.has_secret(t).alias("had_secret"), F.sha2(tx.redacted(t).cast("binary"), 256).alias("redacted_hash"))


@query("""SELECT conv_id, turn, '{"role":' || to_json(role) || ',"headers":{"Authorization":"[secret]","Set-Cookie":"[secret]","n":' || turn || '},"steps":[{"password":"[secret]","access_token":"[secret]","note":"see https://h.example/?api_key=[secret]&n=' || turn || '"},'
  || '{"api_key":"[secret]"}],"raw":"{\\"token\\":\\"[secret]\\",\\"turn\\":' || turn || '}","path":"/home/[user]/x"}' AS redacted FROM conversations""")
def redaction_json(spark, d):
    """Documents with secrets in headers, arrays, objects, URLs, paths and embedded JSON, made of the conversations; the SQL says what must be left."""
    turn = F.col("turn")
    headers = F.struct(F.concat(F.lit("Bearer "), F.col("conv_id").cast("string")).alias("Authorization"), F.array(F.concat(F.lit("sid="), turn.cast("string")), F.lit("a=b; Path=/")).alias("Set-Cookie"), turn.alias("n"))
    secret = F.struct(
        F.struct(F.concat("role", F.lit('"x]')).alias("inner"), F.array(turn).alias("list")).alias("password"), turn.alias("access_token"), F.concat(F.lit("see https://h.example/?api_key=k"), F.col("conv_id").cast("string"), F.lit("&n="), turn.cast("string")).alias("note"))
    steps = F.array(F.to_json(secret), F.lit('{"api_key":["a","}b",{"c":"d"}]}'))
    raw = F.to_json(F.struct(F.array(F.lit("a"), F.lit("b")).alias("token"), turn.alias("turn")))
    parts = [F.lit('{"role":'), _json(F.col("role")), F.lit(',"headers":'), F.to_json(headers), F.lit(',\n "steps" : ['), F.array_join(steps, " , "), F.lit('],"raw":'), _json(raw), F.lit(',"path":"/home/'), F.concat(F.lit("u"), turn.cast("string")), F.lit('/x"}')]
    return table(spark, d, "conversations").select("conv_id", "turn", tx.redacted_json(F.concat(*parts)).alias("redacted"))


def _json(text):
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
