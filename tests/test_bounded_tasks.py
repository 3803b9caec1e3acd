"""Steps that are done once, and tasks that hold no more as their files grow."""

from __future__ import annotations

from lodestone.operators.recipes import extract, extract_all
from lodestone.plans import catalogue
from lodestone.plans.content import CANDIDATES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_recipes_read_together_give_what_each_gives(spark):
    pages = spark.createDataFrame([(1, "https://h.example/a", "<nav><ul><li><a href='/x'>one</a><li>no link</ul></nav><article><h1>T</h1></article>"), (2, "u", None), (3, "u", ""), (4, "u", "<p>none</p>")], "page_id long, url string, html string")
    both = extract_all(pages, CANDIDATES)
    for name, recipe in CANDIDATES.items():
        alone = extract(pages, recipe)
        got = both.filter(both["recipe"] == name).drop("recipe")
        assert got.columns == alone.columns and sorted(map(str, got.collect())) == sorted(map(str, alone.collect()))


def test_versions_are_dealt_by_job_and_not_sorted(spark):
    text = plan(catalogue.QUERIES["score_versions"](spark, SF))
    assert "SortAggregate" not in text and "REPARTITION_BY_NUM" in text


def test_a_sitemap_is_parsed_once(spark):
    assert catalogue.QUERIES["sitemap_scan"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("XPathListEvaluator") == 1
