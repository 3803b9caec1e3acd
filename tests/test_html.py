"""Trees and locators against a tree built by hand in Python, on hostile markup and on all pages."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions.expressions import let
from lodestone.operators import html as H
from lodestone.operators.recipes import extract

PAGES = [
    "", "just text", "<p>one<p>two<b>bold</p>after</b>", "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>tail", "<table><tr><td>1<td>2<tr><th>3</table>",
    "<div class='a  b' ID=x data-k=\"q'r\">t</div></div><span>s", "<a href='/x?a=1&amp;b=2' href=second>L</a><a>none</a>", "<script>if (a<b) document.write('<p>x</p>')</script><p>y</p>",
    "<style>p>a{}</style><title>T &lt;1&gt;</title><textarea><p>no</textarea><br/><img src=i.png>z", "<!-- <p>hidden</p> --><p>shown</p><!-- never closed <p>", "<dl><dt>Location<dd>Berlin<dt>Pay<dd>5</dl>",
    "<P>UP <B>CASE</b></P>", "1 < 2 <p>x</p> 3 > 2 <", "<p>a<div>b</div>c</p>", "<a href=\"unclosed>text</a><p>after", "<select><option>1<option>2</select>", "<x-card data-testid=job-card><h2> A\n B </h2></x-card>",
    "<div><p>1</p><ul><li><p>in<li>next</ul><p>2</div>", "<b " + " ".join(f"a{i}='{i}'" for i in range(300)) + ">many</b>", "<div>" * 60 + "deep" + "</div>" * 60, "<ol>" + "<li><i>x" * 150 + "</ol>end",
]


class Node:
    def __init__(self, name, attrs, pos, depth):
        self.name, self.attrs, self.pos, self.depth, self.end = name, attrs, pos, depth, None


def reference(html):
    """Elements and texts, by the rules of the operator's docstring, one token after another."""
    tokens, i = [], 0
    inside = r"""(?:[^'">]|"[^"]*"|'[^']*')*>"""
    raw = "|".join(H.RAW)
    kinds = [("comment", re.compile(r"<!--.*?(?:-->|\Z)", re.S)), ("raw", re.compile(rf"<({raw})(?=[\s/>]){inside}(.*?)(?:</(?:{raw})\s*>|\Z)", re.S | re.I)), ("tag", re.compile(rf"</?[a-z]{inside}", re.S | re.I)), ("other", re.compile(r"<[!?][^>]*>")), ("text", re.compile(r"[^<]+|<"))]
    while i < len(html):
        for kind, pattern in kinds:
            m = pattern.match(html, i)
            if m:
                tokens.append((kind, m))
                i = m.end()
                break
    texts, nodes, stack = [], [], []

    def plain(t):
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            t = t.replace(a, b)
        return t

    def end(k, at):
        for n in stack[k:]:
            n.end = at
        del stack[k:]

    def top(names):
        return max((k for k, n in enumerate(stack) if n.name in names), default=-1)

    for pos, (kind, m) in enumerate(tokens):
        t = m.group()
        texts.append(plain(t) if kind == "text" else plain(m.group(2)) if kind == "raw" and m.group(1).lower() in ("title", "textarea") else "")
        if kind not in ("raw", "tag"):
            continue
        name = re.match(r"</?([A-Za-z][^\s/>]*)", t).group(1).lower()
        if t.startswith("</"):
            k = top([name])
            if k >= 0:
                end(k, pos)
            continue
        closes, barrier = H.IMPLIED.get(name, ("", ""))
        k = top(closes.split())
        if k > top(barrier.split()) and k >= 0:
            end(k, pos)
        opening = re.match(rf"<[a-z]{inside}", t, re.S | re.I).group()
        inner = re.sub(r"/\s*$", "", re.match(r"<[^\s/>]+(.*)>$", opening, re.S).group(1))
        attrs = {}
        for a in re.finditer(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", inner):
            attrs.setdefault(a.group(1).lower(), plain(a.group(2) or a.group(3) or a.group(4) or ""))
        node = Node(name, attrs, pos, len(stack) + 1)
        nodes.append(node)
        if kind == "raw" or name in H.VOID:
            node.end = pos + 1
        else:
            stack.append(node)
    end(0, len(tokens))

    def text(n):
        return " ".join("".join(texts[n.pos:n.end]).split())

    return [(n.pos, n.end, n.depth, n.name, n.attrs, text(n)) for n in nodes]


def trees(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    page = H.tree(F.col("html"))
    rows = let(page, lambda p: F.transform(p["elements"], lambda e: F.struct(e["pos"], e["end"], e["depth"], e["name"], e["attrs"], H.text_of(p, e))))
    return {r[0]: None if r[1] is None else [(*e[:4], {a: v for a, v in reversed([tuple(x) for x in e[4]])}, e[5]) for e in r[1]] for r in df.select("page_id", rows).collect()}


def test_trees_of_hostile_pages(spark):
    got = trees(spark, [*PAGES, None])
    for i, html in enumerate(PAGES):
        assert got[i] == reference(html), html[:80]
    assert got[len(PAGES)] is None


def test_trees_of_all_pages(spark):
    pages = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    got = trees(spark, pages)
    assert all(got[i] == reference(html) for i, html in enumerate(pages))


SAMPLE = """<html><body><div id=top class="box wide"><h2>One</h2><p>a <a href="/job/1" rel=next>first</a></p><p lang=en-GB>b</p></div>
<div class=box><p>c<a href='/other'>x</a><span>Location: Rome</span></p></div><section><article data-testid=job-card><h3>Two</h3><a href="/job/2">go</a></article>
<article data-testid="job-card"><h3></h3><a href="/job/3">go on</a><i role=heading>Three</i><label>Location</label> <em>Oslo</em></article><article><b>Four</b></article></section></body></html>"""


def values(spark, located):
    page = H.tree(F.lit(SAMPLE))
    return spark.range(1).select(let(page, lambda p: F.transform(located.matches(p), lambda e: F.coalesce(located.value(p, e), F.lit("-"))))).first()[0]


@pytest.mark.parametrize("selector, want", [
    ("h2, h3", ["One", "Two", "-"]), ("div.box", ["Onea firstb", "cxLocation: Rome"]), ("div.box.wide > p", ["a first", "b"]), ("#top a", ["first"]), ("a[href^='/job/']", ["first", "go", "go on"]),
    ("a[href$=\"3\"]", ["go on"]), ("[lang|=en]", ["b"]), ("article:has(a[href*='/job/'])", ["Twogo", "go onThreeLocation Oslo"]), ("article:not([data-testid])", ["Four"]), ("div ~ section > article:first-child h3", ["Two"]),
    ("article:nth-child(2) > a", ["go on"]), ("p ~ p", ["b"]), ("body > article", []), ("section:has(> article > b) i", ["Three"]), ("*[rel]", ["first"]), ("a[href*='']", []),
])
def test_css(spark, selector, want):
    assert values(spark, H.css(selector)) == want


@pytest.mark.parametrize("path, want", [
    ("//article/a/@href", ["/job/2", "/job/3"]), ("/html/body/div[2]/p/a", ["x"]), ("//article[@data-testid='job-card'][2]/a", ["go on"]), ("//a[contains(@href,'job')][starts-with(text(),'go ')]", ["go on"]),
    ("//*[@role]", ["Three"]), ("//h3[text()='Two']", ["Two"]), ("/div", []),
])
def test_xpath(spark, path, want):
    assert values(spark, H.xpath(path)) == want


def test_roles_patterns_and_anchors(spark):
    assert values(spark, H.role("heading")) == ["One", "Two", "-", "Three"]
    assert values(spark, H.locator("href_pattern", "/job/")) == ["/job/1", "/job/2", "/job/3"]
    assert values(spark, H.locator("data_attr", "data-testid=job-card")) == ["Twogo", "go onThreeLocation Oslo"]
    page = H.tree(F.lit(SAMPLE))
    both = spark.range(1).select(let(page, lambda p: F.array(H.TextAnchor("location").first(p), let(H.css("section").matches(p), lambda s: H.TextAnchor("location").first(p, F.get(s, 0))), H.TextAnchor("nowhere").first(p)))).first()[0]
    assert both == ["Rome", "Oslo", None]


@pytest.mark.parametrize("bad", ["", ">", "a,", ",a", "a:hover", "p:has(a", "a[b", "a:not(b c)", "a;b"])
def test_bad_selectors(bad):
    with pytest.raises(ValueError):
        H.css(bad)


@pytest.mark.parametrize("bad", ["", "//a[", "//a[position()<3]", "//a/@b/c", "a b"])
def test_bad_paths(bad):
    with pytest.raises(ValueError):
        H.xpath(bad)


def test_cards_are_suggested(spark):
    lists = "<nav><ul><li><a href=/1>a</a><li><a href=/2>b</a><li><a href=/3>c</a></ul></nav><main>" + "".join(f"<div class='card new'><h2>Job {i}</h2><a href=/j{i}>a longer text</a></div>" for i in range(4)) + "<p>x</p><p>y</p><p>z</p></main>"
    rows = [(0, lists), (1, "<p>x<p>y<p>z"), (2, None), (3, ""), (4, "<ul><li><a href=1>x</a><li><a href=2>y</a></ul>"), (5, "<ul><li><a href=1>x</a></li><li>no</li><li>link</li></ul>")]
    df = spark.createDataFrame(rows, "page_id long, html string").select("page_id", H.tree(F.col("html")).alias("page")).select("page_id", H.suggested_cards(F.col("page")).alias("s"))
    got = {r[0]: r[1] for r in df.collect()}
    assert tuple(got[0]) == ("main > div.card.new", 4, 4, sum(len(f"Job {i}a longer text") for i in range(4)))
    assert [got[i] for i in range(1, 6)] == [None] * 5


RECIPE = {
    "version": 2, "card_locators": [{"kind": "css", "value": "li.job"}, {"kind": "data_attr", "value": "data-testid=job-card"}],
    "fields": {"title": {"required": True, "locators": [{"kind": "relative_css", "value": "h2,h3"}, {"kind": "role", "value": "heading"}]}, "job_url": {"required": True, "locators": [{"kind": "href_pattern", "value": "/job/"}]}, "place": {"locators": [{"kind": "text_anchor", "value": "Location"}]}},
    "next": [{"kind": "css", "value": "a[rel=next]", "attr": "href"}],
}


def test_recipe(spark):
    df = spark.createDataFrame([(1, "https://h.example/list/", SAMPLE, "x"), (2, "https://h.example/", "<p>no cards", "x"), (3, "https://h.example/", None, "x")], "page_id long, url string, html string, card_ string")
    got = sorted((r["page_id"], r["card"], r["title"], r["job_url"], r["place"], r["used"] and tuple(r["used"]), r["missing"], r["next_url"]) for r in extract(df, RECIPE).collect())
    following = "https://h.example/job/1"
    assert got == [
        (1, 0, "Two", "/job/2", None, (1, 1, None), [], following), (1, 1, "Three", "/job/3", "Oslo", (2, 1, 1), [], following),
        (2, None, None, None, None, None, None, None), (3, None, None, None, None, None, None, None),
    ]
    whole = extract(df.filter("page_id = 1"), {k: RECIPE[k] for k in ("version", "fields")}).first()
    assert (whole["title"], whole["job_url"], whole["place"]) == ("One", "/job/1", "Rome")


@pytest.mark.parametrize("change", [{"version": 3}, {"fields": {}}, {"fields": {"a b": {"locators": []}}}, {"fields": {"t": {"locators": [{"kind": "css", "value": "x" * 400}]}}}, {"fields": {"t": {"locators": [{"kind": "eval", "value": "1"}]}}}, {"script": "x"}])
def test_bad_recipes(spark, change):
    with pytest.raises(ValueError):
        extract(spark.createDataFrame([], "url string, html string"), RECIPE | change)
