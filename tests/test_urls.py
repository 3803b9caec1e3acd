"""URLs against what the standard library and the address registries say."""

from __future__ import annotations

from urllib.parse import urljoin

import pytest

from lodestone.functions import url as ux
from pyspark.sql import functions as F

CANONICAL = {
    "https://user:pw@h.com:8443/x": "https://h.com:8443/x", "https://user:123@h.com/x": "https://h.com/x", "http://[::1]/a": "http://[::1]/a", "HTTP://Ex.COM:80/A?utm_source=q&b=1#f": "http://ex.com/A?b=1",
    "https://[2001:DB8::2]:443/": "https://[2001:db8::2]/", "https://[2001:db8::2]:444/": "https://[2001:db8::2]:444/", "http://h.com./p": "http://h.com/p", "http://a@b@h.com:81/p": "http://h.com:81/p", "https://h.com:80/": "https://h.com:80/",
    "https://h.com/x?a=1&#38;b=2": "https://h.com/x?a=1&b=2", "https://h.com/x?a=1&AMP;b=2&#x26;c=3": "https://h.com/x?a=1&b=2&c=3", r"https:\/\/h.com\/x\u0026y": "https://h.com/x&y", "/jobs/1": None, "http://h.com": "http://h.com/", "http://h.com?a=1": "http://h.com/?a=1",
    "https://h.com/?UTM_Source=q&Ref=1&b=2": "https://h.com/?b=2", "javascript:alert(1)": None, "": None, " https://h.com/a\n": "https://h.com/a", "https://h.com/a\tb": "https://h.com/ab", "mailto:a@b.c": None, "ftp://h.com/x": None, "https:///x": None,
}
VERDICTS = {
    "https://example.com/": "OK", "http://93.184.216.34/": "OK", "http://[2606:2800:220:1::1]/": "OK", "ftp://x/": "BAD_SCHEME", "javascript:alert(1)": "BAD_SCHEME", "http://a:b@x.com/": "CREDENTIALS", "http:///p": "NO_HOST",
    **{f"http://{h}/": "PRIVATE_ADDRESS" for h in (
        "[::1]", "[fc00::1]", "[fe80::1]", "[::ffff:10.0.0.1]", "[2001:db8::1]", "[2002:a00:1::]", "[2001::1]", "0.0.0.0", "2130706433", "0x7f000001", "0177.0.0.1", "127.1", "localhost.", "LOCALHOST", "a.localhost", "printer.local",
        "100.64.0.1", "10.1.2.3", "172.31.0.1", "192.168.1.1", "169.254.169.254", "198.18.0.1", "192.0.2.9", "203.0.113.5", "224.0.0.1", "255.255.255.255", "127.0.0.1:8080")},
    **{f"http://{h}/": "PRIVATE_ADDRESS" for h in ("%31%32%37.0.0.1", "\uff11\uff12\uff17.0.0.1", "127\u30020\u30020\u30021", "127.0.0.1\t", "intranet", "LOCALHOST%2e", "%6cocalhost", "127%2e0%2e0%2e1", "1\u00ad27.0.0.1", "127\uff0e0.0.1", "\uff3b::1]")},
    "http://\u2460\u2461\u2466.0.0.1/": "BAD_HOST", "http://\U0001d7cf27.0.0.1/": "BAD_HOST", "http:\\\\a:b@x.com/": "BAD_SCHEME", "http://a\\@x.com/": "PRIVATE_ADDRESS", "http://m\u00fcnchen.example/": "OK", "http://a%20b.com/": "OK", "http://a%25.com/": "BAD_HOST", "\thttps://example.com/x": "OK",
    "http://172.32.0.1/": "OK", "http://100.128.0.1/": "OK", "http://11.0.0.1/": "OK", "http://10.example.com/": "OK",
}


def column(spark, urls, f):
    rows = spark.createDataFrame([(u,) for u in urls], "u string")
    return {r["u"]: r["x"] for r in rows.select("u", f(F.col("u")).alias("x")).collect()}


def test_canonical(spark):
    assert column(spark, CANONICAL, ux.canonical) == CANONICAL
    assert column(spark, [None], ux.canonical) == {None: None}


def test_canonical_seen_from_a_page(spark):
    base = F.lit("https://h.com/a/b?c=1")
    got = column(spark, ["../x?utm_medium=1", "y&amp;z", r"\/j\/1", "//O.com", "#top", "?q=1&#38;r=2", "mailto:a@b.c"], lambda u: ux.canonical(u, base))
    assert got == {"../x?utm_medium=1": "https://h.com/x", "y&amp;z": "https://h.com/a/y&z", r"\/j\/1": "https://h.com/j/1", "//O.com": "https://o.com/", "#top": "https://h.com/a/b?c=1", "?q=1&#38;r=2": "https://h.com/a/b?q=1&r=2", "mailto:a@b.c": None}


def test_verdicts(spark):
    assert column(spark, VERDICTS, ux.verdict) == VERDICTS


@pytest.mark.parametrize("base", ["https://h.com/a/b/c?x=1#f", "http://h.com", "http://h.com/a/"])
def test_links_resolve_as_the_standard_library_has_it(spark, base):
    links = ["d", "./d", "../d", "../../d", "../../../d", "/d/../e", "d/", "d/.", "d/..", "?q=1", "#z", "//o.com/p", "https://o.com/p", "mailto:x@y", "d?a=/../b", "/", "."]
    got = column(spark, links, lambda u: ux.resolved(F.lit(base), u))
    assert got == {x: urljoin(base, x) for x in links}


def test_an_empty_link_is_the_page_without_its_fragment(spark):
    assert column(spark, [""], lambda u: ux.resolved(F.lit("http://h.com/a?b#c"), u)) == {"": "http://h.com/a?b"}
