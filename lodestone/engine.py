"""Reads and changes in one object, over one folder of tables and one of ledgers.

A read path gives a frame; `register` makes them views for SQL. A change appends one event to a ledger, once for its event id, and nothing is ever
rewritten: what is in force follows from the events, in the order of their times and ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import merges, revisions, search_index
from .operators.ledger import shared_folder
from .operators.store import Ledger
from .plans import catalogue, search
from .plans.search import TOP
from .sources.tables import table

#: Ledgers of changes and their columns; each has event_id as its key.
LEDGERS = {
    "dispositions": "event_id long, at timestamp_ntz, profile_id int, job_id long, disposition string, seen_event long", "merges": "event_id long, at timestamp_ntz, kind string, kept long, absorbed long",
    "applications": "event_id long, at timestamp_ntz, application_id long, job_id long, state string", "revisions": "event_id long, at timestamp_ntz, name string, kind string, revision long", "runs": "event_id long, at timestamp_ntz, run_id long, kind string",
}
DISPOSITIONS = ("NONE", "SHORTLISTED", "SNOOZED", "DISMISSED", "ARCHIVED")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Engine:
    """Jobs, inbox, search, sources, runs, applications and companies of the tables in data_dir, with the changes kept in ledger_dir."""

    def __init__(self, spark: SparkSession, data_dir: str, ledger_dir: str | None = None):
        self.spark, self.data_dir = spark, data_dir
        self._ledger_dir, self._index = ledger_dir, None

    def register(self, prefix: str = "") -> list[str]:
        """Views of all tables and read paths, for spark.sql; their names."""
        paths = {"jobs": self.jobs, "sources": self.sources, "runs": self.runs, "application_states": self.applications, "companies": self.companies, "health": lambda: self.query("health_dimensions")}
        views = {t: lambda t=t: table(self.spark, self.data_dir, t) for t in TABLES} | paths
        for name, frame in views.items():
            frame().createOrReplaceTempView(f"{prefix}{name}")
        return [f"{prefix}{name}" for name in views]

    # ---- changes --------------------------------------------------------------------------------------------------------

    def ledger(self, name: str) -> Ledger:
        folder = self._ledger_dir or f"{shared_folder(self.spark)}/ledgers"
        return Ledger(self.spark, f"{folder}/{name}", LEDGERS[name], ["event_id"])

    def _append(self, name: str, *rows: tuple) -> int:
        schema = LEDGERS[name].replace("at timestamp_ntz", "at string")
        frame = self.spark.createDataFrame(list(rows), schema).withColumn("at", F.col("at").cast("timestamp_ntz"))
        return self.ledger(name).append(frame)

    def set_disposition(self, event_id: int, at: str, profile_id: int, job_id: int, disposition: str, seen_event: int | None = None) -> int:
        """Append a disposition; seen_event is the event that the user saw as the last, and a later one makes this stale."""
        if disposition not in DISPOSITIONS:
            raise ValueError(f"no such disposition: {disposition}")
        return self._append("dispositions", (event_id, at, profile_id, job_id, disposition, seen_event))

    def dispositions(self) -> tuple[DataFrame, DataFrame]:
        """(profile_id, job_id, disposition, event_id) in force, and the stale events that were not accepted."""
        rows = self.ledger("dispositions").read()
        before = rows.alias("b").select("profile_id", "job_id", F.col("event_id").alias("earlier"))
        newest = rows.join(before, ["profile_id", "job_id"]).filter("earlier < event_id").groupBy("event_id").agg(F.max("earlier").alias("newest"))  # the changes of one job and profile
        judged = rows.join(newest, "event_id", "left").withColumn("stale", F.coalesce(F.col("seen_event") < F.col("newest"), F.lit(False)))
        best = judged.filter("not stale").groupBy("profile_id", "job_id").agg(F.max_by(F.struct("disposition", "event_id"), "event_id").alias("e"))
        return best.select("profile_id", "job_id", "e.disposition", "e.event_id"), judged.filter("stale").drop("newest", "stale")

    def merge(self, event_id: int, at: str, kept: int, absorbed: int) -> int:
        return self._append("merges", (event_id, at, "MERGE", kept, absorbed))

    def undo_merge(self, event_id: int, at: str, kept: int, absorbed: int) -> int:
        return self._append("merges", (event_id, at, "UNDO", kept, absorbed))

    def canonical(self, at: str) -> DataFrame:
        """(node, root) of merged jobs as of a time."""
        return merges.components_as_of(self.ledger("merges").read(), F.lit(at).cast("timestamp_ntz"))

    def set_application(self, event_id: int, at: str, application_id: int, job_id: int, state: str) -> int:
        return self._append("applications", (event_id, at, application_id, job_id, state))

    def application_states(self, at: str) -> DataFrame:
        """(application_id, job_id, state, shown_on): the last state of each application, on the job that shows it; merged jobs keep all of theirs."""
        rows = self.ledger("applications").read().filter(F.col("at") <= F.lit(at).cast("timestamp_ntz"))
        last = rows.groupBy("application_id").agg(F.max_by(F.struct("job_id", "state", "at"), F.struct("at", "event_id")).alias("e")).select("application_id", F.col("e.job_id").alias("owner"), "e.state", F.col("e.at").alias("made_at"))
        return merges.owned_as_of(last, self.canonical(at), F.lit(at).cast("timestamp_ntz")).select("application_id", F.col("owner").alias("job_id"), "state", "shown_on")

    def promote(self, event_id: int, at: str, name: str, revision: int) -> int:
        return self._append("revisions", (event_id, at, name, "ACTIVATE", revision))

    def roll_back(self, event_id: int, at: str, name: str, revision: int) -> int:
        return self._append("revisions", (event_id, at, name, "ROLLBACK", revision))

    def revisions(self) -> DataFrame:
        """(name, revision, since) in force."""
        return revisions.pointer(self.ledger("revisions").read())

    def request_run(self, event_id: int, at: str, run_id: int) -> int:
        return self._append("runs", (event_id, at, run_id, "REQUEST"))

    def cancel_run(self, event_id: int, at: str, run_id: int) -> int:
        return self._append("runs", (event_id, at, run_id, "CANCEL"))

    def requested_runs(self) -> DataFrame:
        """(run_id, requested_at, cancelled_at); a cancellation before any request is none."""
        g = self.ledger("runs").read().groupBy("run_id").agg(F.min(F.when(F.col("kind") == "REQUEST", F.col("at"))).alias("requested_at"), F.max(F.when(F.col("kind") == "CANCEL", F.col("at"))).alias("c"))
        return g.filter("requested_at is not null").select("run_id", "requested_at", F.when(F.col("c") >= F.col("requested_at"), F.col("c")).alias("cancelled_at"))

    # ---- reads ----------------------------------------------------------------------------------------------------------

    def query(self, name: str) -> DataFrame:
        """Any query of the catalogue by its name."""
        return catalogue.QUERIES[name](self.spark, self.data_dir)

    def jobs(self) -> DataFrame:
        """Jobs with their availability and the source that is believed."""
        return self.query("availability").join(self.query("canonical_provenance"), "job_id", "left")

    def inbox(self, profile_id: int) -> DataFrame:
        """What a profile sees, best first, with what each rule gave."""
        kept = self.query("inbox_predicate").filter(F.col("profile_id") == profile_id)
        return kept.join(self.query("score_breakdown").drop("score"), ["job_id", "profile_id"]).orderBy(F.desc("score"), "job_id")

    def search(self, text: str, top: int = TOP, **equal: str) -> DataFrame:
        """The best documents for the words of text, among those whose columns equal what is given."""
        docs = table(self.spark, self.data_dir, "documents").filter("text is not null")
        for column, value in equal.items():
            docs = docs.filter(F.col(column) == value)
        asked = self.spark.createDataFrame([(0, text)], "query_id long, text string")
        return search.bm25(docs.select("doc_id", "text"), asked, top).drop("query_id")

    def indexed(self, text: str, top: int = TOP, **equal: str) -> DataFrame:
        """Like search, over titles and bodies by the stored index, which the first call writes and the others read."""
        if self._index is None:
            self._index = search.document_index(self.spark, self.data_dir)
        asked = self.spark.createDataFrame([(0, text)], "query_id long, text string").select("query_id", search.tokens(F.col("text")).alias("terms"))
        allowed = None
        if equal:
            docs = table(self.spark, self.data_dir, "documents")
            for column, value in equal.items():
                docs = docs.filter(F.col(column) == value)
            allowed = docs.select(F.col("doc_id").alias("doc"))
        return search_index.search(self._index, asked, top, allowed).drop("query_id").withColumnRenamed("doc", "doc_id")

    def sources(self) -> DataFrame:
        return self.query("source_rollup")

    def runs(self) -> DataFrame:
        return self.query("run_counters").join(self.query("queue_depth").withColumnRenamed("day", "run"), "run")

    def applications(self) -> DataFrame:
        return self.query("application_latest")

    def companies(self) -> DataFrame:
        return self.query("company_rollup")

    def provenance(self, job_id: int) -> DataFrame:
        """What sources have said of a job, newest first."""
        rows = table(self.spark, self.data_dir, "lineitem").filter(F.col("l_partkey") == job_id)
        return rows.select(F.col("l_suppkey").alias("source_id"), F.col("l_shipdate").alias("evidence_at"), "l_linestatus", "l_returnflag").orderBy(F.desc("evidence_at"), "source_id")
