"""Content, facts, change classes, robots rules, and revisions on worked cases."""

from __future__ import annotations

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lodestone.functions.expressions import let
from lodestone.operators import content as C
from lodestone.operators import html as H
from lodestone.operators import revisions as R
from lodestone.operators import robots as B

PAGES = {
    "<html><head><title>no</title></head><body><nav><a href=/>home</a></nav><h1>A  &amp; B</h1><p>One <b>two</b><br>three</p><script>x</script><ul><li>x<li><a href='/j?a=1&amp;b=2'>link</a></ul><footer>f</footer></body>":
        ("# A & B\n\nOne **two**\nthree\n\n- x\n\n- [link](/j?a=1&b=2)", "A & B One two three x link"),
    "<h2>T</h2>text<pre>a  b</pre><table><tr><th>k<td>v</table>": ("## T\n\ntext\n\n```\na b\n```\n\n| k | v |", "T text a b k v"),
    "<form><p>x</form>": ("", ""), "plain": ("plain", "plain"), "": ("", ""), "<p>a<p>b": ("a\n\nb", "a b"), "<i>e</i><code>c</code>": ("_e_`c`", "ec"),
}


def test_markdown_and_plain_text(spark):
    df = spark.createDataFrame([(h,) for h in [*PAGES, None]], "html string").select("html", H.tree(F.col("html")).alias("page"))
    got = {r["html"]: (r["md"], r["text"]) for r in df.select("html", C.markdown(F.col("page")).alias("md"), C.plain(F.col("page")).alias("text")).collect()}
    assert {k: v for k, v in got.items() if k is not None} == PAGES and got[None] == (None, None)


@pytest.mark.parametrize("text, want", [
    ("the cat and the dog of it", "en"), ("Der Hund und die Katze sind nicht da", "de"), ("le chat et la souris dans une maison", "fr"), ("el perro y los gatos del pueblo", "es"), ("zzz qqq", None), ("", None), ("de", None), ("THE-OF, and!", "en"),
])
def test_language(spark, text, want):
    row = spark.range(1).select(let(C.language(F.lit(text)), lambda x: F.array(x))).first()[0][0]
    assert row["lang"] == want and (0 < row["confidence"] <= 1 if want else row["confidence"] == 0)


def test_facts_have_spans_and_versions(spark):
    text = "Über uns: Senior Engineer, full-time, remote within Europe. 5+ years of experience; no visa sponsorship given. Mail jobs@x.example"
    found = spark.range(1).select(C.facts(F.lit(text))).first()[0]
    got = {r["rule_id"]: r for r in found}
    assert set(got) == {"level.senior", "type.full", "scope.remote", "experience.years", "auth.required", "contact.mail"}
    for r in found:
        assert text[r["evidence_start"]:r["evidence_end"]] == r["evidence_text"] and r["rule_version"] >= 1
    assert got["scope.remote"]["evidence_text"] == "remote within Europe" and got["experience.years"]["rule_version"] == 2
    assert spark.range(1).select(C.facts(F.lit(None).cast("string"))).first()[0] == []


VERSION = {"title": "t", "salary": 1, "location": "l", "apply_url": "u", "content": "c", "body": "b", "state": "ACTIVE"}


@pytest.mark.parametrize("old, new, flags, want", [
    ({}, {}, (0, 0, 0), ["UNCHANGED"]), ({}, {"body": "x"}, (0, 0, 0), ["UNKNOWN_CHANGE"]), ({}, {"title": "x", "salary": 2, "body": "x"}, (0, 0, 0), ["TITLE_CHANGED", "SALARY_CHANGED"]), ({}, {"state": "CLOSED"}, (0, 0, 0), ["JOB_CLOSED"]),
    ({"state": "CLOSED"}, {}, (0, 0, 0), ["JOB_REOPENED"]), ({"state": "CLOSED"}, {"content": "x"}, (0, 0, 1), ["REPOST_DETECTED", "CONTENT_CHANGED"]), ({}, {"title": "x"}, (1, 0, 0), ["PAGE_TEMPLATE_CHANGED"]), ({}, {"salary": None, "location": None}, (0, 1, 0), ["EXTRACTION_DRIFT"]),
    ({}, {"location": None}, (0, 0, 0), ["LOCATION_CHANGED"]), ({}, {"apply_url": "v"}, (1, 1, 0), ["PAGE_TEMPLATE_CHANGED"]), ({"state": "CLOSED"}, {"state": "CLOSED"}, (0, 0, 1), ["UNCHANGED"]), (None, {}, (0, 0, 0), None),
])
def test_change_classes(spark, old, new, flags, want):
    kind = "struct<title:string,salary:int,location:string,apply_url:string,content:string,body:string,state:string>"
    versions = [None if v is None else F.from_json(F.lit(json.dumps(VERSION | v)), kind) for v in (old, new)]
    columns = [F.lit(None).cast(kind) if v is None else v for v in versions]
    assert spark.range(1).select(C.change_classes(*columns, *[F.lit(bool(x)) for x in flags])).first()[0] == want


def decide(rules, way):
    """The longest pattern that matches, allow first, by Python's own expressions."""
    best = (0, True)
    for kind, pattern in rules:
        body, end = (pattern[:-1], "$") if pattern.endswith("$") else (pattern, "")
        if pattern and re.match(".*".join(map(re.escape, body.split("*"))) + end, way):
            best = max(best, (len(pattern), kind == "allow"))
    return "ALLOWED" if best[1] else "DISALLOWED"


def test_robots(spark):
    rng = random.Random(6)
    patterns = ["/", "/a", "/a/", "/a*c", "/*.html$", "/a.b", "/a$", "", "/a?x=", "*", "/(a)", "/a[b]+"]
    ways = ["/", "/a", "/a/b", "/abc", "/x.html", "/x.html?y", "/aXb", "/a.b", "/a?x=1", "/(a)", "/a[b]+", "/aab", ""]
    files, want = [], {}
    for i in range(40):
        own = [(rng.choice(["allow", "disallow"]), rng.choice(patterns)) for _ in range(rng.randrange(1, 5))]
        files.append((f"h{i}.example", "Sitemap: x\nUSER-agent: Bot # me\r\nuser-agent: other\n" + "".join(f"{k.title()} : {p}\n" for k, p in own) + "\nCrawl-delay: 3\nUser-agent: *\nDisallow: /\n"))
        want |= {f"http://h{i}.example{w}": decide(own, w or "/") for w in ways}
    files += [("star.example", "User-agent: *\nDisallow: /x"), ("none.example", "# nothing"), ("else.example", "User-agent: other\nDisallow: /"), ("shared.example", "User-agent: bot\n\nCrawl-delay: 9\nUser-agent: *\nDisallow: /x")]
    want |= {"https://star.example/x": "DISALLOWED", "https://star.example/y": "ALLOWED", "https://none.example/": "NO_RULES", "https://else.example/": "NO_RULES", "https://unknown.example/": "NO_RULES", "https://shared.example/x": "DISALLOWED"}
    pages = spark.createDataFrame([(u, "x") for u in want], "url string, agent string")
    rules = B.parsed(spark.createDataFrame(files, "host string, body string"))
    got = B.decisions(pages, rules, "bot")
    assert got.columns == ["url", "agent", "robots_decision", "robots_rule"]
    assert {r["url"]: r["robots_decision"] for r in got.collect()} == want


def test_promotion_needs_fixtures_and_loses_nothing(spark):
    def rows(*x):
        return spark.createDataFrame(list(x), "page int, card int, title string")

    active = rows((1, 0, "a"), (1, 1, "b"), (2, 0, None))
    fixtures = rows((1, 0, "a"), (2, 0, None))

    def told(candidate, **limits):
        r = R.verdict(limits.pop("fixtures", fixtures), active, candidate, ["page", "card"], ["title"], **limits).first()
        return tuple(r)

    assert told(active) == (2, 2, 0, 0, 0, "ACTIVATE")
    assert told(rows((1, 0, "a"), (1, 1, "B"), (2, 0, None), (3, 0, "n"))) == (2, 2, 0, 1, 1, "ACTIVATE")
    assert told(rows((1, 0, "a"), (2, 0, None))) == (2, 2, 1, 0, 0, "REJECT")
    assert told(rows((1, 0, "a"), (2, 0, None)), most_lost=0.5)[-1] == "ACTIVATE"
    assert told(rows((1, 0, "x"), (1, 1, "b"), (2, 0, "made up"))) == (2, 0, 0, 0, 2, "REJECT")
    assert told(active, fixtures=fixtures.limit(0)) == (0, 0, 0, 0, 0, "REJECT")


def test_pointer_and_content_id(spark):
    events = [(1, "a", "ACTIVATE", 1), (2, "a", "ACTIVATE", 2), (3, "a", "ROLLBACK", 2), (4, "b", "ACTIVATE", 7), (5, "c", "ACTIVATE", 1), (6, "c", "ROLLBACK", 1), (7, "c", "ACTIVATE", 1), (8, "d", "ACTIVATE", 1), (9, "d", "ROLLBACK", 1)]
    got = R.pointer(spark.createDataFrame(events, "event_id long, name string, kind string, revision int"))
    assert sorted(map(tuple, got.collect())) == [("a", 1, 1), ("b", 7, 4), ("c", 1, 7)]
    assert R.content_id({"b": [1, {"y": 1, "x": "é"}], "a": None}) == R.content_id(json.loads('{ "a": null, "b": [1, {"x": "é", "y": 1}] }')) != R.content_id({"b": [{"y": 1, "x": "é"}, 1], "a": None})


def test_facts_are_searched_for_where_they_may_be(spark):
    """Each rule finds what its own pattern finds first, whatever the text; a run of 40,000 characters is not searched anew from each of them."""
    pieces = ["Licensed Under MIT", "released under x.", "a@b.co_x@y.zz", "@", "x | y | z |", " | |", "| a |  |", "y" * 90 + " | b |", "ab?", "abc?", "w" * 250 + "?", "senior dev", "LEAD x", "entry level a", "Full-Time", "part time", "fixed term", "fully remote within eu", "HYBRID", "work permit", "3 years of experience", ".", "\n"]
    rng = random.Random(7)
    texts = ["".join(rng.choice([x, x + " "]) for x in rng.sample(pieces, k)) for k in (1, 2, 3, 6) for _ in range(80)] + [None, "", *pieces]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", F.transform(C.facts(F.col("t")), lambda f: F.struct(f["rule_id"], f["evidence_text"], f["evidence_start"])).alias("f"))
    want = [F.array(F.lit(r[0]), F.regexp_substr("t", F.lit(r[4])), (F.regexp_instr("t", F.lit(r[4])) - 1).cast("string")).alias(f"r{i}") for i, r in enumerate(C.RULES)]
    for row in got.select("f", *want).collect():
        assert [(f[0], f[1], str(f[2])) for f in row["f"] or []] == [tuple(w) for w in row[1:] if w[1]]
    long = spark.createDataFrame([("aB3_" * 10_000,)], "t string")
    began = time.time()
    assert long.filter(F.size(C.facts(F.col("t"))) == 0).count() == 1
    assert time.time() - began < 5
