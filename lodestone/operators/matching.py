"""Identity of jobs in six stages, as one ledger: what was matched, at which stage, how well, on what evidence, and what a guard had against it.

Stages 1 and 2 match by native and by origin id, 3 by a job-specific application address, 4 by company, title, places, time and similar
content; 5 clusters what differs in place only; 6 lists what a person must decide. Every group is matched to one of its members, never
in all pairs, so a group of any size gives one row a member.

The guard against reused ids looks at five kinds of evidence between an observation and the one that its id was first seen with. What it
stops is matched once more among those that also agree in company and title; the first of these, and whatever the guard stops there too, goes
to review beside what it was compared with.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..policy import POLICY
from .near import classes, similar_sets

#: Columns of an observation. Ids, addresses and days may be null; company and title are normalised, places a sorted set.
COLUMNS = ("job_id", "source_id", "source_job_id", "origin_provider", "origin_board", "origin_job_id", "apply_url", "company", "title", "places", "created_day", "seen_day", "text")
#: Titles of one job share this much of their words; a provider reuses ids if so many of them, and such a share, were seen with other jobs.
SAME_TITLE, RECYCLED_IDS, RECYCLED_SHARE = 0.5, 2, 0.5
#: Evidence of the guard, in order (fixed names).
GUARD = ("LONG_GAP", "TITLE_COMPANY", "PROVIDER_RECYCLES", "CREATED_APART", "OTHER_ORIGIN")

_ANCHOR = ("job_id", "company", "title", "created_day", "seen_day", "source_id", "source_job_id", "origin_provider", "origin_board", "origin_job_id")


def alike(a: Column, b: Column) -> Column:
    """The share of words that two titles have in common; two empty ones are alike."""
    x, y = F.array_distinct(F.filter(F.split(a, " "), lambda w: w != "")), F.array_distinct(F.filter(F.split(b, " "), lambda w: w != ""))
    return F.when(F.size(F.array_union(x, y)) == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def _field(anchor: str, name: str) -> Column:
    return F.col(f"{anchor}.{name}")


def guard(anchor: str, keys: list[str]) -> Column:
    """The kinds of evidence that an observation is another job than the one its id was first seen with, in a column of anchor."""
    apart = F.abs(F.col("seen_day") - _field(anchor, "seen_day"))
    title = alike(F.coalesce("title", F.lit("")), F.coalesce(_field(anchor, "title"), F.lit("")))
    other_company = F.col("company") != _field(anchor, "company")
    ids = [c for c in ("source_id", "source_job_id", "origin_provider", "origin_board", "origin_job_id") if c not in keys]
    # the other identity of the two differs although both observations have one
    whole = reduce(lambda x, y: x & y, [F.col(c).isNotNull() & _field(anchor, c).isNotNull() for c in ids])
    differs = reduce(lambda x, y: x | y, [F.col(c) != _field(anchor, c) for c in ids])
    fired = {
        "LONG_GAP": (apart > POLICY.id_reuse_gap_days) & (title < SAME_TITLE), "TITLE_COMPANY": other_company | (title < SAME_TITLE), "PROVIDER_RECYCLES": F.col("recycles") & (title < 1),
        "CREATED_APART": F.abs(F.col("created_day") - _field(anchor, "created_day")) > POLICY.match_window_days, "OTHER_ORIGIN": whole & differs,
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(fired[k], F.lit(False)), k) for k in GUARD]))


def _with_first(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with the first observation of their group, by day and id; a hot group is split by adaptive execution, its one anchor repeated."""
    order = F.struct(F.coalesce("seen_day", F.lit(1 << 30)).alias("day"), "job_id")
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*_ANCHOR), order).alias(name))
    return rows.join(first, keys)


def _recycling(rows: DataFrame, provider: str, keys: list[str]) -> DataFrame:
    """Providers whose ids were seen with jobs of different company or title too often to be trusted."""
    ids = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(F.struct("company", "title")).alias("jobs")).filter("n > 1")
    counted = ids.groupBy(provider).agg(F.sum((F.col("jobs") > 1).cast("long")).alias("reused"), F.count("*").alias("ids"))
    return counted.filter((F.col("reused") >= RECYCLED_IDS) & (F.col("reused") >= F.col("ids") * RECYCLED_SHARE)).select(provider, F.lit(True).alias("recycles"))


def _row(stage: int | Column, kept: Column, decision: str, reason: str, score: Column, evidence: Column, fired: Column) -> list[Column]:
    return [
        kept.alias("kept_job_id"), F.col("job_id").alias("absorbed_job_id"), (F.lit(stage) if isinstance(stage, int) else stage).alias("stage"), F.lit(decision).alias("decision"),
        score.cast("double").alias("match_score"), F.lit(reason).alias("reason_code"), F.to_json(evidence).alias("evidence_json"), F.array_join(fired, ",").alias("guard"),
    ]


def by_id(observations: DataFrame, stage: int, provider: str, keys: list[str]) -> list[DataFrame]:
    """Stage 1 or 2: observations of one id, past the guard."""
    known = observations.filter(reduce(lambda x, y: x & y, [F.col(k).isNotNull() & (F.col(k) != "") for k in keys]))
    known = known.join(_recycling(known, provider, keys), provider, "left").withColumn("recycles", F.coalesce("recycles", F.lit(False)))
    compared = _with_first(known, keys, "first").withColumn("fired", guard("first", keys))
    evidence = F.struct(*keys, "seen_day", _field("first", "seen_day").alias("first_day"))
    one = F.lit(1.0)
    none = F.array().cast("array<string>")
    passed = compared.filter((F.size("fired") == 0) & (F.col("job_id") != _field("first", "job_id"))).select(*_row(stage, _field("first", "job_id"), "MERGE", ("SAME_NATIVE_ID", "SAME_ORIGIN_ID")[stage - 1], one, evidence, none))
    stopped = _with_first(compared.filter(F.size("fired") > 0), [*keys, "company", "title"], "second").withColumn("again", guard("second", keys))
    leads = stopped.filter(F.col("job_id") == _field("second", "job_id")).select(*_row(6, _field("first", "job_id"), "REVIEW", "ID_REUSED", alike(F.col("title"), _field("first", "title")), evidence, F.col("fired")))
    follow = stopped.filter(F.col("job_id") != _field("second", "job_id"))
    evidence = F.struct(*keys, "seen_day", _field("second", "seen_day").alias("first_day"))
    joined = follow.filter(F.size("again") == 0).select(*_row(stage, _field("second", "job_id"), "MERGE", ("SAME_NATIVE_ID", "SAME_ORIGIN_ID")[stage - 1], one, evidence, none))
    doubtful = follow.filter(F.size("again") > 0).select(*_row(6, _field("second", "job_id"), "REVIEW", "ID_REUSED", one, evidence, F.col("again")))
    return [passed, leads, joined, doubtful]


def by_address(observations: DataFrame) -> list[DataFrame]:
    """Stage 3: one application address that names one job; null addresses, and generic ones that the caller nulls, match nothing."""
    known = observations.filter("apply_url is not null")
    first = known.groupBy("apply_url").agg(F.min("job_id").alias("root"))
    return [known.join(first, "apply_url").filter("job_id <> root").select(*_row(3, F.col("root"), "MERGE", "SAME_APPLY_URL", F.lit(1.0), F.struct("apply_url"), F.array().cast("array<string>")))]


def by_content(observations: DataFrame, words: int = POLICY.shingle_words, threshold: float = POLICY.similarity_threshold, window: int = POLICY.match_window_days) -> list[DataFrame]:
    """Stages 4 to 6 of observations with a company and title.

    Equal company, title and places are a block. Its texts are classes of equal shingle sets, and a class has one row for each span of
    window days, with its first and last observation: members of such a span merge into the first, spans of a class that are no more than window days
    apart into one another, and classes of similar content wherever two of their spans are that near. What is near in time but not alike
    goes to review beside the first class of its span.
    """
    block = ["company", "title", "place_key"]
    none = F.array().cast("array<string>")
    known = observations.filter("company is not null and title is not null and seen_day is not null").withColumn("place_key", F.array_join("places", "|"))
    # the block's columns ride along; doc_id is the job
    classed, sets = classes(known.select(F.col("job_id").alias("doc_id"), "text", *block), words, tuple(block))
    members = classed.select(F.col("doc_id").alias("job_id"), "root", *block).join(known.select("job_id", "seen_day"), "job_id").withColumn("span", F.floor(F.col("seen_day") / window))
    earliest, latest = F.struct("seen_day", "job_id"), F.struct("seen_day", (-F.col("job_id")).alias("minus"))
    spans = members.groupBy(*block, "root", "span").agg(F.min(earliest).alias("first"), F.max(latest).alias("last"))
    together = members.join(spans.select("root", "span", "first"), ["root", "span"]).filter(F.col("job_id") != F.col("first.job_id"))
    evidence = F.struct("company", "title", "place_key", "seen_day", F.col("first.seen_day").alias("first_day"))
    same = together.select(*_row(4, F.col("first.job_id"), "MERGE", "SAME_CONTENT", F.lit(1.0), evidence, none))

    order = Window.partitionBy("root").orderBy("span")  # spans of a class: as many as the calendar has
    chain = spans.withColumn("before", F.lag(F.struct("first", "last")).over(order)).filter(F.col("first.seen_day") - F.col("before.last.seen_day") <= window)
    evidence = F.struct("company", "title", "place_key", F.col("first.seen_day").alias("seen_day"), F.col("before.last.seen_day").alias("first_day"))
    chained = chain.select("*", F.col("first.job_id").alias("job_id")).select(*_row(4, F.col("before.first.job_id"), "MERGE", "SAME_CONTENT", F.lit(1.0), evidence, none))

    close = similar_sets(sets, threshold)
    left = spans.select(F.col("root").alias("doc_a"), F.col("span").alias("span_a"), F.col("first").alias("fa"), F.col("last").alias("la"))
    right = spans.select(*block, F.col("root").alias("doc_b"), F.explode(F.array(F.col("span") - 1, F.col("span"), F.col("span") + 1)).alias("span_a"), F.col("first").alias("fb"), F.col("last").alias("lb"))
    met = close.join(left, "doc_a").join(right, ["doc_b", "span_a"]).filter((F.col("fa.seen_day") - F.col("lb.seen_day") <= window) & (F.col("fb.seen_day") - F.col("la.seen_day") <= window))
    kept, gone = F.least("fa.job_id", "fb.job_id"), F.greatest("fa.job_id", "fb.job_id")
    evidence = F.struct("company", "title", "place_key", "jaccard")
    similar = met.select("*", gone.alias("job_id")).select(*_row(4, kept, "MERGE", "SIMILAR_CONTENT", F.col("jaccard"), evidence, none))

    lead = spans.groupBy(*block, "span").agg(F.min("first").alias("lead"))
    unlike = spans.join(lead, [*block, "span"]).filter(F.col("first.job_id") != F.col("lead.job_id"))
    evidence = F.struct("company", "title", "place_key", F.col("first.seen_day").alias("seen_day"), F.col("lead.seen_day").alias("first_day"))
    review = unlike.select("*", F.col("first.job_id").alias("job_id")).select(*_row(6, F.col("lead.job_id"), "REVIEW", "CONTENT_DIFFERS", F.lit(0.0), evidence, none))
    return [same, chained, similar, review, *_places(known)]


def _places(known: DataFrame) -> list[DataFrame]:
    """Stage 5, and 6 where places overlap: company and title agree, places do not; one row for each set of places, beside the first."""
    none = F.array().cast("array<string>")
    sets = known.groupBy("company", "title", "place_key").agg(F.min("job_id").alias("job_id"), F.first("places").alias("places"))
    first = sets.groupBy("company", "title").agg(F.min_by(F.struct("job_id", "places"), "job_id").alias("first"))
    other = sets.join(first, ["company", "title"]).filter(F.col("job_id") != F.col("first.job_id"))
    evidence = F.struct("company", "title", "place_key", F.array_join("first.places", "|").alias("first_places"))
    apart = ~F.arrays_overlap("places", "first.places")
    share = F.size(F.array_intersect("places", "first.places")) / F.greatest(F.size(F.array_union("places", "first.places")), F.lit(1))
    return [
        other.filter(apart).select(*_row(5, F.col("first.job_id"), "CLUSTER", "PLACES_DISAGREE", F.lit(0.0), evidence, none)),
        other.filter(~apart).select(*_row(6, F.col("first.job_id"), "REVIEW", "PLACES_OVERLAP", share, evidence, none)),
    ]


def staged(observations: DataFrame) -> DataFrame:
    """The ledger of all stages: one row for each pair that was compared to a result, the strongest stage speaking for it.

    Columns: kept_job_id, absorbed_job_id, stage, decision (MERGE, CLUSTER, REVIEW), match_score, reason_code, evidence_json, guard (kinds of
    evidence against a merge, comma-joined).
    """
    found = [
        *by_id(observations, 1, "source_id", ["source_id", "source_job_id"]), *by_id(observations, 2, "origin_provider", ["origin_provider", "origin_board", "origin_job_id"]),
        *by_address(observations), *by_content(observations),
    ]
    rows = reduce(DataFrame.unionByName, found)
    pair = F.struct(F.least("kept_job_id", "absorbed_job_id"), F.greatest("kept_job_id", "absorbed_job_id"))
    rest = ("stage", "decision", "match_score", "reason_code", "evidence_json", "guard")
    order = F.struct("stage", (-F.col("match_score")).alias("less"), "reason_code", "guard", "evidence_json", "kept_job_id")
    return rows.groupBy(pair.alias("pair")).agg(F.min_by(F.struct("kept_job_id", "absorbed_job_id", *rest), order).alias("r")).select("r.*")


def merge_edges(ledger: DataFrame) -> DataFrame:
    """Edges (a, b) of what may be one job, for the closure."""
    return ledger.filter("decision = 'MERGE'").select(F.col("kept_job_id").alias("a"), F.col("absorbed_job_id").alias("b"))
