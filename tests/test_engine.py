"""The read side and compiled recipes."""

from __future__ import annotations

import pytest

from lodestone.engine import Engine
from lodestone.operators.recipes import compiled

SF = "/root/testdata/sf0.001"


def test_read_paths(spark):
    e = Engine(spark, SF)
    inbox = e.inbox(0).collect()
    assert inbox and [r["score"] for r in inbox] == sorted((r["score"] for r in inbox), reverse=True) and all(r["profile_id"] == 0 for r in inbox)
    hits = e.search("the that heat", top=5).collect()
    assert [r["rank"] for r in hits] == [1, 2, 3, 4, 5] and e.search("the", lang="de").count() <= 20
    assert e.search("").count() == 0
    for rows in (e.jobs(), e.sources(), e.runs(), e.applications(), e.companies(), e.provenance(1)):
        assert rows.count() > 0


def test_views_and_stored_index(spark):
    e = Engine(spark, SF)
    names = e.register("lode_")
    assert {"lode_jobs", "lode_companies", "lode_events", "lode_health"} <= set(names)
    assert spark.sql("SELECT count(*) FROM lode_jobs JOIN lode_part ON job_id = p_partkey").first()[0] > 0
    hits = e.indexed("the that heat", top=5)
    assert [r["rank"] for r in hits.collect()] == [1, 2, 3, 4, 5] and hits.columns == ["rank", "doc_id", "score"]
    docs = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'de'").select("doc_id").collect()}
    assert {r["doc_id"] for r in e.indexed("der die", lang="de").collect()} <= docs and e.indexed("").count() == 0


def test_changes_are_appended_once(spark, tmp_path):
    e = Engine(spark, SF, f"file://{tmp_path}/ledgers")
    assert e.set_disposition(1, "2024-01-01 10:00:00", 0, 7, "SHORTLISTED") == 1 and e.set_disposition(1, "2024-01-01 10:00:00", 0, 7, "SHORTLISTED") == 0
    e.set_disposition(2, "2024-01-01 11:00:00", 0, 7, "SNOOZED", seen_event=1)
    e.set_disposition(3, "2024-01-01 12:00:00", 0, 7, "DISMISSED", seen_event=1)  # has not seen event 2
    e.set_disposition(4, "2024-01-01 12:00:00", 1, 7, "ARCHIVED")
    now, stale = e.dispositions()
    assert sorted(map(tuple, now.collect())) == [(0, 7, "SNOOZED", 2), (1, 7, "ARCHIVED", 4)] and [r["event_id"] for r in stale.collect()] == [3]
    with pytest.raises(ValueError):
        e.set_disposition(5, "2024-01-01", 0, 7, "GONE")

    e.merge(1, "2024-01-02", 7, 8)
    e.set_application(1, "2024-01-01", 100, 8, "SENT")
    e.set_application(2, "2024-01-01", 101, 7, "SENT")
    e.set_application(3, "2024-01-03", 100, 8, "INTERVIEW")
    e.undo_merge(2, "2024-01-04", 7, 8)
    assert sorted(map(tuple, e.application_states("2024-01-03").collect())) == [(100, 8, "INTERVIEW", 7), (101, 7, "SENT", 7)]
    assert sorted(map(tuple, e.application_states("2024-01-05").collect())) == [(100, 8, "INTERVIEW", 8), (101, 7, "SENT", 7)]
    assert e.canonical("2024-01-05").collect() == [] and sorted(map(tuple, e.canonical("2024-01-02").collect())) == [(7, 7), (8, 7)]

    e.promote(1, "2024-01-01", "list", 1)
    e.promote(2, "2024-01-02", "list", 2)
    e.roll_back(3, "2024-01-03", "list", 2)
    assert [tuple(r) for r in e.revisions().collect()] == [("list", 1, 1)]
    e.request_run(1, "2024-01-01", 5)
    e.cancel_run(2, "2024-01-02", 5)
    e.cancel_run(3, "2024-01-02", 6)
    assert [(r["run_id"], r["cancelled_at"] is not None) for r in e.requested_runs().collect()] == [(5, True)]
    # another object over the same folder sees the same
    assert Engine(spark, SF, f"file://{tmp_path}/ledgers").revisions().count() == 1


def test_recipes(spark):
    html = "<HTML lang='en'><meta property='og:title' content=' T '><h1 class=x>H</h1><script type=\"application/ld+json\">{\"a\":{\"b\":5}}</script>"
    pages = spark.createDataFrame([(html,), ("",), (None,)], "html string")
    fields = {"t": [{"kind": "meta", "name": "og:title"}], "h": [{"kind": "tag", "name": "h2"}, {"kind": "tag", "name": "h1"}], "l": [{"kind": "attribute", "tag": "html", "name": "lang"}], "j": [{"kind": "json_ld", "path": "a.b"}]}
    got = pages.select(*compiled({"version": 1, "fields": fields})).collect()
    assert [tuple(r) for r in got] == [("T", "H", "en", "5"), (None,) * 4, (None,) * 4]


@pytest.mark.parametrize("recipe", [{}, {"version": 2, "fields": {"a": [{"kind": "tag", "name": "p"}]}}, {"version": 1, "fields": {"a": [{"kind": "python", "code": "x"}]}}, {"version": 1, "fields": {"a": [{"kind": "tag", "name": "p>(.*)"}]}}, {"version": 1, "fields": {"a": []}}])
def test_recipes_are_data_only(recipe):
    with pytest.raises(ValueError):
        compiled(recipe)
