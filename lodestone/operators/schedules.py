"""Schedules in local time: moments, gaps and folds, occurrence ids, and bounded catch-up.

All times are without zone (timestamp_ntz): local ones of an IANA zone, or UTC. The zone's rules are those of the JVM's own data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import let
from ..functions.text import key_of
from .ranks import running

#: Halvings that find a change of offset to the second in a gap of up to a day.
HALVINGS = 17


def _utc(local: Column, zone: Column) -> Column:
    return F.convert_timezone(zone, F.lit("UTC"), local)


def _local(utc: Column, zone: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), zone, utc)


def _number(moment: Column) -> Column:
    """Whole seconds of a time without zone, read field by field: differences of such times in Spark would pass through the session's zone."""
    return F.datediff(F.to_date(moment), F.lit("1970-01-01")).cast("bigint") * 86_400 + F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)


def _seconds(later: Column, earlier: Column) -> Column:
    return _number(later) - _number(earlier)


def _plus(moment: Column, seconds: Column) -> Column:
    return moment + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def resolved(local: Column, zone: Column) -> Column:
    """struct<utc, kind, fold, offset_minutes> of a local time: what it means, and how that was found.

    A round trip tells: a time that comes back as another lies in a gap and means the first moment behind it, where the offset changes; a time that
    a second moment within a day shows too is a fold and means the first of the two. Null zones and times give null.
    """

    def of(first: Column) -> Column:
        back = _local(first, zone)
        skipped = _seconds(back, local)  # how much of local time the gap takes

        def behind(seconds: Column) -> Column:
            """The moment of the change: halving between the last second of the old offset and a moment of the new one."""
            new = _seconds(back, first)
            start = F.struct((-seconds).alias("old"), F.lit(0).cast("bigint").alias("new"))

            def halve(s: Column, _: Column) -> Column:
                middle = F.floor((s["old"] + s["new"]) / 2)
                is_new = _seconds(_local(_plus(first, middle), zone), _plus(first, middle)) == new
                return F.when(s["new"] - s["old"] <= 1, s).when(is_new, F.struct(s["old"].alias("old"), middle.alias("new"))).otherwise(F.struct(middle.alias("old"), s["new"].alias("new")))

            return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda s: _plus(first, s["new"]))

        def offset(utc: Column) -> Column:
            return (_seconds(_local(utc, zone), utc) / 60).cast("int")

        def again(days: int) -> Column:
            """Whether the offset in force a day away shows the same local time at another moment."""
            there = _plus(first, F.lit(days * 86_400))
            other = _plus(local, -_seconds(_local(there, zone), there))
            return F.when((_local(other, zone) == local) & (other != first), other)

        plain = let(F.least(first, again(1), again(-1)), lambda utc: F.struct(utc.alias("utc"), F.when(again(1).isNotNull() | again(-1).isNotNull(), "FOLD").otherwise("PLAIN").alias("kind"), F.lit(0).alias("fold"), offset(utc).alias("offset_minutes")))
        gap = let(behind(skipped.cast("bigint")), lambda utc: F.struct(utc.alias("utc"), F.lit("GAP").alias("kind"), F.lit(0).alias("fold"), offset(utc).alias("offset_minutes")))
        return F.when(skipped != 0, gap).otherwise(plain)

    return F.when(local.isNotNull() & zone.isNotNull(), let(_utc(local, zone), of))


def occurrence_id(plan: Column, zone: Column, local: Column) -> Column:
    """The durable identity of one occurrence: its plan, zone and local time, whatever moment that turns out to be."""
    return key_of(plan, zone, F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"))


def catch_up(occurrences: DataFrame, delivered: DataFrame, after, until, most: int = 1) -> DataFrame:
    """What a host does on waking: of (plan_id, occurrence_id, due) due after one moment and up to another and not in delivered (occurrence_id), the newest
    `most` of each plan RUN, the others are SKIPPED, each once; all columns stay, with `action`.
    """
    due = occurrences.filter((F.col("due") > F.lit(after)) & (F.col("due") <= F.lit(until))).dropDuplicates(["occurrence_id"])
    missed = due.join(delivered.select("occurrence_id").distinct(), "occurrence_id", "left_anti").select(*occurrences.columns)
    ranked = running(missed, ["plan_id"], [-_number(F.col("due")), F.col("occurrence_id")], rank="_rank")
    return ranked.select(*occurrences.columns, F.when(F.col("_rank") <= most, "RUN").otherwise("SKIPPED").alias("action"))
