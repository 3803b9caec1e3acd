"""Places of texts: the longest names of a gazetteer that a text holds, joined by their tokens.

A name and a text are runs of letters and digits in lower case, and a comma, bracket or the like is a token too, so that a name does not reach over it. Every run of a text's tokens as long as some name has is looked up in the
gazetteer by one hash join; of what is found, the leftmost name counts first, and of names that start there the longest, and what
overlaps it no more. A name that several places bear is settled by another place of the same text in whose country or region one of
them lies; otherwise all of them stay, as ambiguous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import let

#: Words that say that work is done from anywhere, and how offsets from UTC are written (fixed patterns).
REMOTE = r"(?i)\b(remote|home office|work from home|anywhere)\b"
OFFSET = r"(?i)\b(?:utc|gmt)\s*([+-]\s*[0-9]{1,2})(?::?([0-9]{2}))?"


def tokens(text: Column) -> Column:
    """Runs of letters, marks and digits, in lower case, and the marks that part one name from another."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}]+|[,;:()/!?|\n]"), F.lit(0))


def named(gazetteer: DataFrame) -> DataFrame:
    """Rows (place_id, name, country, region) with the name's tokens as one text (gram) and their number (n)."""
    rows = gazetteer.withColumn("_t", tokens(F.col("name"))).filter(F.col("name").rlike(r"[\p{L}\p{N}]"))
    return rows.select("place_id", "name", "country", "region", F.array_join("_t", " ").alias("gram"), F.size("_t").alias("n"))


def mentions(texts: DataFrame, key: str, text: str, gazetteer: DataFrame) -> DataFrame:
    """(key, start, n, place_id, name, country, region, ambiguous): the places that each text names, by token, without overlaps."""
    names = named(gazetteer)
    lengths = [r[0] for r in names.select("n").distinct().orderBy("n").collect()]  # a name has few words, so these are few numbers
    schema = [F.col(key).alias("_key"), F.posexplode_outer("_grams").alias("_i", "_g")]
    if not lengths:
        lengths = [1]

    def grams(t: Column) -> Column:
        """All runs of the lengths that names have."""
        def of(n: int) -> Column:
            starts = F.when(F.size(t) >= n, F.sequence(F.lit(0), F.size(t) - n)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), F.array_join(F.slice(t, i + 1, n), " ").alias("gram")))

        return F.concat(*[of(n) for n in lengths])

    runs = texts.select(F.col(key), let(tokens(F.col(text)), grams).alias("_grams")).select(*schema).select("_key", "_g.*")
    kinds = names.select("gram").distinct()
    found = runs.join(kinds, "gram", "left_semi").groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("n")).alias("less"), "n", "gram"))).alias("hits"))  # names of one text

    def longest(state: Column, hit: Column) -> Column:
        free = hit["start"] >= state["until"]
        return F.struct(F.when(free, hit["start"] + hit["n"]).otherwise(state["until"]).alias("until"), F.when(free, F.concat(state["kept"], F.array(F.struct(hit["start"], hit["n"], hit["gram"])))).otherwise(state["kept"]).alias("kept"))

    empty = F.from_json(F.lit('{"until":0,"kept":[]}'), "struct<until:int,kept:array<struct<start:int,n:int,gram:string>>>")
    kept = found.select("_key", F.explode(F.aggregate("hits", empty, longest, lambda s: s["kept"])).alias("h")).select("_key", "h.*")
    each = kept.join(names.drop("n"), "gram")
    borne = each.groupBy("_key", "start").agg(F.count("*").alias("bearers"))
    each = each.join(borne, ["_key", "start"])
    # a place speaks for its country, and for its region only if it lies in none
    sure = each.filter("bearers = 1").select("_key", F.coalesce("country", "region").alias("context")).filter("context is not null").distinct()
    near = each.filter("bearers > 1").join(sure.select(F.col("_key").alias("k"), "context"), (F.col("_key") == F.col("k")) & ((F.col("country") == F.col("context")) | (F.col("region") == F.col("context"))), "left_semi")
    settled = near.groupBy("_key", "start").agg(F.count("*").alias("fitting"))
    judged = each.join(settled, ["_key", "start"], "left").join(near.select("_key", "start", "place_id", F.lit(True).alias("fits")), ["_key", "start", "place_id"], "left")
    judged = judged.filter(F.col("fitting").isNull() | F.col("fits"))
    return judged.select(F.col("_key").alias(key), "start", "n", "place_id", "name", "country", "region", (F.coalesce("fitting", "bearers") > 1).alias("ambiguous"))


def remote(text: Column) -> Column:
    return F.coalesce(text.rlike(REMOTE), F.lit(False))


def offsets(text: Column) -> Column:
    """struct<low, high> of the offsets from UTC, in minutes, that a text names; nulls if it names none."""
    hours, minutes = (F.regexp_extract_all(text, F.lit(OFFSET), F.lit(g)) for g in (1, 2))

    def one(h: Column, m: Column) -> Column:
        hour = F.regexp_replace(h, r"\s", "").cast("int")
        return hour * 60 + F.when(h.startswith("-"), -1).otherwise(1) * F.coalesce(F.nullif(m, F.lit("")).cast("int"), F.lit(0))

    all_of = F.zip_with(hours, minutes, one)
    return F.struct(F.array_min(all_of).alias("low"), F.array_max(all_of).alias("high"))
