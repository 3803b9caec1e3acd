"""Queries over what is stored: deliveries that are appended once, exports and backups that are compared by content, and places of texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import places, store
from ..operators.ledger import shared_folder
from ..sources.tables import table
from .registry import query


@query("""SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(CASE WHEN event_id % 3 = 0 THEN 1 END) AS first_batch, round(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100, 2) AS total FROM events GROUP BY 1""")
def ledger_appends(spark, d):
    """Events delivered in overlapping batches, one of them twice and one cut before its manifest: the ledger holds each once."""
    e = table(spark, d, "events")
    rows = e.select("event_id", F.to_date("ts").alias("day"), "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), F.lit(0).alias("batch"))
    own = store.Ledger(spark, f"{shared_folder(spark)}/events-{uuid.uuid4().hex}", "event_id long, day date, event_type string, cents long, batch int", ["event_id"])
    parts = [rows.filter("event_id % 3 = 0"), rows.filter("event_id % 3 <= 1"), rows.filter("event_id % 3 <= 1"), rows]
    own.append(rows.filter("event_id % 3 = 2"), commit=False)
    for i, part in enumerate(parts, 1):
        own.append(part.withColumn("batch", F.lit(i)))
    g = own.read().groupBy("day").agg(F.count("*").alias("n"), F.count(F.when(F.col("batch") == 1, 1)).alias("first_batch"), F.sum("cents").alias("cents"))
    return g.select("day", "n", "first_batch", F.round(F.col("cents") / 100, 2).alias("total"))


#: Rows of one file of a backup.
FILE_ROWS = 1000
_LINE = "o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' || CAST(round(o_totalprice * 100) AS BIGINT) || '|' || strftime(o_orderdate, '%Y-%m-%d')"
_FILES = f"SELECT 'part=' || (o_orderkey // {FILE_ROWS}) AS path, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, sha256(string_agg(line || chr(10), '' ORDER BY o_orderkey)) AS sha256 FROM (SELECT o_orderkey, {_LINE} AS line FROM orders {{}}) GROUP BY o_orderkey // {FILE_ROWS}"


def backup(spark, rows, label: str):
    """Orders as lines of text, a file for each range of keys, and the manifest of what lies there."""
    line = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    lines = rows.select((F.col("o_orderkey") / FILE_ROWS).cast("long").alias("part"), "o_orderkey", line.alias("value"))
    folder = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    lines.repartition("part").sortWithinPartitions("part", "o_orderkey").select("part", "value").write.partitionBy("part").text(folder)
    files = store.files_of(spark, folder)
    return files.withColumn("path", F.regexp_extract("path", "^([^/]+)/", 1))


@query(_FILES.format(""))
def backup_manifest(spark, d):
    """A backup's generation: every file with its size and the hash of its bytes, as they were read back."""
    return backup(spark, table(spark, d, "orders"), "backup")


@query(f"""WITH was AS ({_FILES.format("WHERE o_orderkey // 1000 % 5 <> 4")}), now AS (SELECT 'part=' || (o_orderkey // {FILE_ROWS}) AS path, sha256(string_agg(line || chr(10), '' ORDER BY o_orderkey)) AS sha256 FROM (
  SELECT o_orderkey, {_LINE.replace("o_orderstatus", "CASE WHEN o_orderkey % 3000 = 7 THEN 'X' ELSE o_orderstatus END")} AS line FROM orders WHERE o_orderkey // 1000 % 4 <> 1) GROUP BY o_orderkey // {FILE_ROWS})
SELECT coalesce(was.path, now.path) AS path, CASE WHEN now.path IS NULL THEN 'MISSING' WHEN was.path IS NULL THEN 'UNEXPECTED' ELSE 'DIFFERS' END AS problem FROM was FULL JOIN now USING (path) WHERE was.sha256 IS DISTINCT FROM now.sha256""")
def backup_compare(spark, d):
    """A manifest against a folder that has lost files, has some that nobody listed, and holds altered rows in others of equal size."""
    o = table(spark, d, "orders")
    block = F.floor(F.col("o_orderkey") / 1000)
    was = backup(spark, o.filter(block % 5 != 4), "was")
    altered = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3000 == 7, "X").otherwise(F.col("o_orderstatus")))
    return store.compared(was, backup(spark, altered.filter(block % 4 != 1), "now"))


@query("SELECT 'customers' AS scope, fmt AS format, count(*) AS row_count, CAST(NULL AS BIGINT) AS row_limit, CAST(0 AS BIGINT) AS problems, count(CASE WHEN c_custkey % 4 = 0 THEN 1 END) AS neutralised FROM customer, (VALUES ('csv')) f(fmt) GROUP BY fmt UNION ALL SELECT 'customers', 'json', least(count(*), 50), 50, 0, 0 FROM customer")
def export_verified(spark, d):
    """Exports read back: as many rows as their manifest says, files as it lists them, and no cell that a spreadsheet would run."""
    name = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("=1+"), "c_name")).otherwise(F.col("c_name"))
    rows = table(spark, d, "customer").select("c_custkey", name.alias("name"), "c_mktsegment")
    out = []
    for fmt, limit in (("csv", None), ("json", 50)):
        folder = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
        manifest = store.export(rows, folder, fmt, "customers", "2024-01-31T00:00:00Z", limit=limit, order=[F.col("c_custkey")])
        back = spark.read.schema("c_custkey long, name string, c_mktsegment string")
        back = back.option("header", "true").option("escape", '"').csv(f"{folder}/data") if fmt == "csv" else back.json(f"{folder}/data")
        problems = store.verified(spark, folder).count()
        g = back.agg(F.count("*").alias("row_count"), F.count(F.when(F.col("name").startswith("'="), 1)).alias("neutralised"))
        same = F.when(F.col("row_count") == manifest["row_count"], F.lit(problems)).otherwise(F.lit(problems + 1))
        out.append(g.select(F.lit("customers").alias("scope"), F.lit(fmt).alias("format"), "row_count", F.lit(limit).cast("long").alias("row_limit"), same.cast("long").alias("problems"), "neutralised"))
    return out[0].unionByName(out[1])


def gazetteer(spark, d):
    """Countries and regions of the tables, and cities that are called after them: a bay and a port of every country, and a Springfield in each of a region's."""
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed dimensions of a few rows
    country = F.replace("n_name", F.lit("_"), F.lit(" "))
    rows = [
        n.select((F.col("n_nationkey") * 10).alias("place_id"), country.alias("name"), country.alias("country"), F.col("r_name").alias("region")),
        n.select((F.col("n_nationkey") * 10 + 1).alias("place_id"), F.concat(country, F.lit(" Bay")).alias("name"), country.alias("country"), F.col("r_name").alias("region")),
        n.select((F.col("n_nationkey") * 10 + 2).alias("place_id"), F.concat(F.lit("Port "), country).alias("name"), country.alias("country"), F.col("r_name").alias("region")),
        n.filter("n_nationkey < 10").select((F.col("n_nationkey") * 10 + 3).alias("place_id"), F.lit("Springfield").alias("name"), country.alias("country"), F.col("r_name").alias("region")),
        table(spark, d, "region").select((F.col("r_regionkey") + 1000).alias("place_id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("country"), F.col("r_name").alias("region")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("""SELECT c_custkey, CASE kind WHEN 0 THEN CAST(c AS VARCHAR) || ':NATION ' || k || ',' || (c + 1) || ':NATION ' || k || ' Bay' WHEN 1 THEN (c + 2) || ':Port NATION ' || k WHEN 2 THEN '3:Springfield,13:Springfield,23:Springfield,33:Springfield,43:Springfield,53:Springfield,63:Springfield,73:Springfield,83:Springfield,93:Springfield'
  WHEN 3 THEN (k % 10 * 10) || ':NATION ' || (k % 10) || ',' || (k % 10 * 10 + 3) || ':Springfield' ELSE '' END AS places, kind = 1 OR kind = 4 AS remote, kind = 2 AS ambiguous, CAST(CASE kind WHEN 1 THEN -330 WHEN 4 THEN c_custkey % 12 * 60 END AS INTEGER) AS offset_low, CAST(CASE kind WHEN 1 THEN 120 WHEN 4 THEN c_custkey % 12 * 60 END AS INTEGER) AS offset_high
FROM (SELECT c_custkey, c_custkey % 5 AS kind, c_nationkey AS k, c_nationkey * 10 AS c FROM customer)""")
def place_mentions(spark, d):
    """Texts that name nested, overlapping, ambiguous and no places, made of the customers: several places a text, by longest names. The SQL knows what was written."""
    kind, k = F.col("c_custkey") % 5, F.col("c_nationkey").cast("string")
    texts = F.when(kind == 0, F.concat(F.lit("Offices in nation "), k, F.lit(" bay; head office: NATION_"), k, F.lit("."))).when(kind == 1, F.concat(F.lit("Remote, or at Port Nation "), k, F.lit(" (UTC+2, UTC -5:30)")))
    texts = texts.when(kind == 2, "SPRINGFIELD").when(kind == 3, F.concat(F.lit("Springfield, Nation-"), (F.col("c_nationkey") % 10).cast("string"))).otherwise(F.concat(F.lit("Work from home; GMT+"), (F.col("c_custkey") % 12).cast("string")))
    rows = table(spark, d, "customer").select("c_custkey", texts.alias("text"))
    found = places.mentions(rows, "c_custkey", "text", gazetteer(spark, d)).groupBy("c_custkey").agg(F.array_sort(F.collect_set(F.struct("place_id", "name"))).alias("p"), F.max("ambiguous").alias("ambiguous"))
    listed = F.array_join(F.transform("p", lambda x: F.concat(x["place_id"].cast("string"), F.lit(":"), x["name"])), ",")
    span = places.offsets(F.col("text"))
    both = rows.join(found, "c_custkey", "left")
    return both.select("c_custkey", F.coalesce(listed, F.lit("")).alias("places"), places.remote(F.col("text")).alias("remote"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), span["low"].alias("offset_low"), span["high"].alias("offset_high"))
