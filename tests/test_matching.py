"""The identity ledger on worked cases of every stage and every kind of evidence, and on a group that holds most rows."""

from __future__ import annotations

import json

import pytest

from lodestone.operators import matching as M

SCHEMA = "job_id long, source_id string, source_job_id string, origin_provider string, origin_board string, origin_job_id string, apply_url string, company string, title string, places array<string>, created_day int, seen_day int, text string, extra string"
TEXT = " ".join(f"word{i}" for i in range(60))


def job(job_id, **own):
    base = {"source_id": None, "source_job_id": None, "origin_provider": None, "origin_board": None, "origin_job_id": None, "apply_url": None, "company": f"c{job_id}", "title": f"title {job_id}", "places": ["rome"], "created_day": None, "seen_day": 10, "text": f"text of {job_id}", "extra": "x"}
    return (job_id, *(base | own).values())


def ledger(spark, jobs):
    rows = M.staged(spark.createDataFrame(jobs, SCHEMA)).collect()
    return {(r["kept_job_id"], r["absorbed_job_id"]): r for r in rows}


def native(job_id, **own):
    return job(job_id, **({"source_id": "s", "source_job_id": "7", "company": "acme", "title": "data engineer berlin", "places": [f"p{job_id}"]} | own))


def test_native_id_and_its_guard(spark):
    jobs = [
        native(1), native(2, seen_day=40, title="senior data engineer berlin"), native(3, title="night nurse", seen_day=800), native(4, title="night nurse", seen_day=805), native(5, company="other", seen_day=20),
        native(6, created_day=5, source_job_id="8"), native(7, created_day=5 + 46, source_job_id="8", seen_day=12), native(8, created_day=5 + 45, source_job_id="8", seen_day=13),
        native(9, source_job_id="9", origin_provider="a", origin_board="b", origin_job_id="1"), native(10, source_job_id="9", origin_provider="a", origin_board="b", origin_job_id="2", seen_day=11), native(11, source_job_id=None), native(12, source_job_id=""), native(13, seen_day=None),
    ]
    got = {k: (r["stage"], r["decision"], r["guard"]) for k, r in ledger(spark, jobs).items() if r["stage"] != 5}
    assert got == {
        (1, 2): (1, "MERGE", ""), (1, 3): (6, "REVIEW", "LONG_GAP,TITLE_COMPANY"), (3, 4): (1, "MERGE", ""), (1, 5): (6, "REVIEW", "TITLE_COMPANY"), (6, 7): (6, "REVIEW", "CREATED_APART"), (6, 8): (1, "MERGE", ""),
        (9, 10): (6, "REVIEW", "OTHER_ORIGIN"), (1, 13): (1, "MERGE", ""),
    }


def test_providers_that_recycle_ids_are_read_strictly(spark):
    def origin(job_id, n, title, provider="p"):
        return job(job_id, origin_provider=provider, origin_board="b", origin_job_id=str(n), company="acme", title=title, places=[f"p{job_id}"])

    jobs = [origin(10 * n + k, n, t) for n, pair in enumerate([("cook", "pilot"), ("baker", "judge"), ("tax clerk", "tax clerk senior")], 1) for k, t in enumerate(pair)]
    jobs += [origin(100 + 10 * n + k, n, t, "q") for n, pair in enumerate([("cook", "pilot"), ("tax clerk", "tax clerk senior"), ("smith", "smith"), ("mason", "mason"), ("miller", "miller")], 1) for k, t in enumerate(pair)]
    got = {k: (r["stage"], r["decision"], r["guard"]) for k, r in ledger(spark, jobs).items() if r["stage"] in (1, 2) or r["guard"]}
    assert got[30, 31] == (6, "REVIEW", "PROVIDER_RECYCLES")  # p was seen to reuse ids
    assert got[120, 121] == (2, "MERGE", "") and got[130, 131] == (2, "MERGE", "")


def test_address_content_places(spark):
    near = " ".join(f"word{i}" for i in range(59)) + " changed"
    block = {"company": "acme", "title": "cook", "text": TEXT}
    jobs = [
        job(1, apply_url="https://x.example/jobs/1"), job(2, apply_url="https://x.example/jobs/1"),
        job(10, **block, seen_day=100), job(11, **block, seen_day=130), job(12, **block | {"text": near}, seen_day=101), job(13, **block, seen_day=400), job(14, **block | {"text": "something else entirely"}, seen_day=100),
        job(15, **block, places=["oslo"], seen_day=100), job(16, **block, places=["oslo", "rome"], seen_day=100), job(17, **block, seen_day=None), job(18, **block | {"text": None}, seen_day=100), job(19, **block | {"text": " "}, seen_day=100),
    ]
    found = ledger(spark, jobs)
    got = {k: (r["stage"], r["decision"], r["reason_code"]) for k, r in found.items()}
    assert got == {
        (1, 2): (3, "MERGE", "SAME_APPLY_URL"), (10, 11): (4, "MERGE", "SAME_CONTENT"), (10, 12): (4, "MERGE", "SIMILAR_CONTENT"), (10, 14): (6, "REVIEW", "CONTENT_DIFFERS"),
        (10, 15): (5, "CLUSTER", "PLACES_DISAGREE"), (10, 16): (6, "REVIEW", "PLACES_OVERLAP"),
    }
    evidence = json.loads(found[10, 12]["evidence_json"])
    assert evidence["company"] == "acme" and evidence["jaccard"] == found[10, 12]["match_score"] >= 0.8
    assert found[10, 16]["match_score"] == 0.5


def test_spans_of_equal_content_are_chained_by_their_nearest_days(spark):
    block = {"company": "acme", "title": "cook", "text": TEXT}
    days = {20: 45, 21: 89, 22: 91, 23: 130, 24: 176, 25: 200}
    got = {k for k, r in ledger(spark, [job(i, **block, seen_day=day) for i, day in days.items()]).items() if r["decision"] == "MERGE"}
    # spans of 45 days: 45-89 | 90-134 | 135-179 | 180-224
    assert got == {(20, 21), (22, 23), (20, 22), (24, 25)}  # 130 to 176 is a day too much


def test_a_group_of_most_rows_gives_a_row_each(spark):
    jobs = [job(i, source_id="s", source_job_id="1", company="acme", title="cook", text=TEXT if i % 2 else TEXT + " more", seen_day=i % 30, apply_url="https://x.example/1") for i in range(3000)]
    found = ledger(spark, jobs)
    assert len([1 for r in found.values() if r["stage"] == 1]) == 2999 and len(found) < 4 * 3000


def test_empty_and_columns(spark):
    got = M.staged(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["kept_job_id", "absorbed_job_id", "stage", "decision", "match_score", "reason_code", "evidence_json", "guard"] and got.collect() == []


@pytest.mark.parametrize("a, b, want", [("a b", "b a", 1.0), ("a b c", "a", 1 / 3), ("", "", 1.0), ("a a", "a", 1.0), ("a", "", 0.0)])
def test_alike(spark, a, b, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(M.alike(F.lit(a), F.lit(b))).first()[0] == want
