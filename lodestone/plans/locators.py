"""Queries over pages as trees: locators of all kinds, recipes of cards, and suggested cards.

The SQL twins know how the pages at hand are written (a list of links in nav, one article, an ad) and read them by patterns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import url as ux
from ..operators import html as markup
from ..operators.recipes import extract
from ..sources.tables import table
from .registry import query

#: A list entry with its link, an article up to its end, and a paragraph's tag, as these pages write them.
_ENTRY = r'<li><a href="([^"]*)">([^<]*)</a></li>'
_ARTICLE = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"
_PARAGRAPHS = f"regexp_extract_all({_ARTICLE}, '<p>')"


def _decoded(text: str) -> str:
    return f"replace(replace(replace(replace({text}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


def _folded(text: str) -> str:
    return f"nullif(trim(regexp_replace({_decoded(text)}, '\\s+', ' ', 'g')), '')"


def trees(spark, d):
    """Pages with their tree, as `page`."""
    return table(spark, d, "pages").select("page_id", "url", markup.tree(F.col("html")).alias("page"))


@query(f"""SELECT page_id, {_folded("regexp_extract(html, '<article><h1>([^<]*)</h1>', 1)")} AS heading, CAST(len(regexp_extract_all(html, '<li><a href="/[^"]*">')) AS INTEGER) AS n_links,
  {_folded(f"regexp_extract_all(html, '{_ENTRY}', 2)[3]")} AS third_link, {_folded("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)")} AS ad, CAST(len({_PARAGRAPHS}) AS INTEGER) AS n_paragraphs,
  CAST(len(regexp_extract_all({_ARTICLE}, '<p><b>')) AS INTEGER) AS n_bold, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS language FROM pages""")
def locator_css(spark, d):
    """Selectors of child, descendant and sibling relations, attributes, places and :has, over whole pages."""
    page = F.col("page")
    return trees(spark, d).select(
        "page_id", markup.css("body > article > h1:first-child").first(page).alias("heading"), F.size(markup.css("nav li > a[href^='/']").matches(page)).alias("n_links"),
        markup.css("ul > li:nth-child(3) a").first(page).alias("third_link"), markup.css("body nav ~ div.ad").first(page).alias("ad"),
        F.size(markup.css("article > p").matches(page)).alias("n_paragraphs"), F.size(markup.css("article p:has(> b)").matches(page)).alias("n_bold"),
        markup.css("html[lang]", "lang").first(page).alias("language"),
    )


@query(f"""SELECT page_id, {_folded("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS heading, nullif(regexp_extract_all(html, '{_ENTRY}', 1)[2], '') AS second_target,
  CAST(len(regexp_extract_all(html, '<li><a href="/t')) AS INTEGER) AS n_t, CAST(len(list_filter(regexp_extract_all(html, '{_ENTRY}', 2), lambda t: contains({_decoded('t')}, 'th'))) AS INTEGER) AS n_th FROM pages""")
def locator_xpath(spark, d):
    """Paths with predicates on place, attributes and text."""
    page = F.col("page")
    return trees(spark, d).select(
        "page_id", markup.xpath("/html/body/article/h1").first(page).alias("heading"), markup.xpath("//nav/ul/li[2]/a/@href").first(page).alias("second_target"),
        F.size(markup.xpath("//li/a[starts-with(@href,'/t')]").matches(page)).alias("n_t"), F.size(markup.xpath("//li/a[contains(text(),'th')]").matches(page)).alias("n_th"),
    )


@query(f"""SELECT page_id, {_folded("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS heading, nullif(regexp_extract(html, '<li><a href="([^"]*th[^"]*)"', 1), '') AS th_target,
  CAST(len(regexp_extract_all(html, '<a href=')) AS INTEGER) AS n_links, CAST(len(regexp_extract_all(html, '<li>')) AS INTEGER) AS n_items FROM pages""")
def locator_roles(spark, d):
    """Roles, implied by an element's name, and patterns of link targets."""
    page = F.col("page")
    return trees(spark, d).select(
        "page_id", markup.role("heading").first(page).alias("heading"), markup.locator("href_pattern", "th").first(page).alias("th_target"),
        F.size(markup.role("link").matches(page)).alias("n_links"), F.size(markup.role("listitem").matches(page)).alias("n_items"),
    )


@query(f"""SELECT page_id, CASE WHEN n >= 3 THEN 'ul > li' END AS selector, CASE WHEN n >= 3 THEN n END AS n_cards, CASE WHEN n >= 3 THEN chars END AS n_chars FROM (
  SELECT page_id, CAST(len(l) AS INTEGER) AS n, CAST(list_sum(list_transform(l, lambda t: length(trim(regexp_replace({_decoded('t')}, '\\s+', ' ', 'g'))))) AS INTEGER) AS chars FROM (SELECT page_id, regexp_extract_all(html, '{_ENTRY}', 2) AS l FROM pages))""")
def card_suggest(spark, d):
    """The repeated structure with links that a page offers as its list."""
    cards = trees(spark, d).select("page_id", F.explode(F.array(markup.suggested_cards(F.col("page")))).alias("s"))  # worked out once, not for each field
    return cards.select("page_id", "s.selector", "s.n_cards", "s.n_chars")


@query(f"""WITH e AS (SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1) AS host, regexp_extract_all(html, '{_ENTRY}', 2) AS l FROM pages)
SELECT lower(host) AS host, 'ul > li' AS selector, count(*) AS n_pages, CAST(sum(len(l)) AS BIGINT) AS n_cards, CAST(min(len(l)) AS INTEGER) AS fewest FROM e WHERE len(l) >= 3 GROUP BY 1""")
def card_suggest_hosts(spark, d):
    """What the pages of a host agree on: the selector to start a recipe with, the one that most pages suggest first."""
    cards = trees(spark, d).select(ux.host(F.col("url")).alias("host"), F.explode(F.array_compact(F.array(markup.suggested_cards(F.col("page"))))).alias("s"))
    counted = cards.groupBy("host", F.col("s.selector").alias("selector")).agg(F.count("*").alias("n_pages"), F.sum("s.n_cards").alias("n_cards"), F.min("s.n_cards").alias("fewest"))
    order = F.struct((-F.col("n_pages")).alias("less"), "selector")
    best = counted.groupBy("host").agg(F.min_by(F.struct("selector", "n_pages", "n_cards", "fewest"), order).alias("b"))
    return best.select("host", "b.selector", "b.n_pages", "b.n_cards", "b.fewest")


LIST_RECIPE = {
    "version": 2,
    "card_locators": [{"kind": "data_attr", "value": "data-testid=job-card"}, {"kind": "relative_css", "value": "nav li:has(a[href*='/'])"}],
    "fields": {
        "title": {"required": True, "locators": [{"kind": "relative_css", "value": "h2,h3"}, {"kind": "role", "value": "link"}]},
        "job_url": {"required": True, "locators": [{"kind": "href_pattern", "value": "/"}]},
        "place": {"required": True, "locators": [{"kind": "text_anchor", "value": "Location"}, {"kind": "xpath", "value": ".//span[@class='place']"}]},
    },
    "next": [{"kind": "css", "value": "a[rel=next]", "attr": "href"}, {"kind": "relative_css", "value": "nav li:first-child a", "attr": "href"}],
}


@query(f"""WITH p AS (SELECT page_id, regexp_extract_all(html, '{_ENTRY}', 1) AS hrefs, regexp_extract_all(html, '{_ENTRY}', 2) AS titles FROM pages)
SELECT page_id, CAST(i - 1 AS INTEGER) AS card, {_folded('titles[i]')} AS title, nullif({_decoded('hrefs[i]')}, '') AS job_url, CAST(NULL AS VARCHAR) AS place, CASE WHEN {_folded('titles[i]')} IS NULL THEN 'title,place' ELSE 'place' END AS missing
FROM p, unnest(generate_series(1, len(hrefs))) AS s(i)""")
def recipe_cards(spark, d):
    """Cards of a recipe's second card locator, each with its fields; a required field that nothing finds is listed, never made up."""
    rows = extract(table(spark, d, "pages"), LIST_RECIPE)
    return rows.select("page_id", "card", "title", "job_url", "place", F.array_join("missing", ",").alias("missing"))


@query(f"""WITH p AS (SELECT page_id, len(regexp_extract_all(html, '{_ENTRY}', 1)) AS n, regexp_extract_all(html, '{_ENTRY}', 2) AS titles FROM pages)
SELECT 'title' AS field, 2 AS used, CAST(sum(len(list_filter(titles, lambda t: {_folded('t')} IS NOT NULL))) AS BIGINT) AS n FROM p UNION ALL SELECT 'job_url', 1, CAST(sum(n) AS BIGINT) FROM p UNION ALL SELECT 'place', NULL, CAST(sum(n) AS BIGINT) FROM p""")
def recipe_telemetry(spark, d):
    """How often each field was found by which of its locators; null: by none."""
    rows = extract(table(spark, d, "pages"), LIST_RECIPE).filter("card is not null")
    found = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"used.{f}").alias("used")) for f in LIST_RECIPE["fields"]]))
    return rows.select(found.alias("f")).groupBy("f.field", "f.used").agg(F.count("*").alias("n"))
