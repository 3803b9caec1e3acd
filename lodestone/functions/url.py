"""URL canonicalisation and safety as column expressions. The raw URL is always kept beside what is derived."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that only track (fixed values).
TRACKING = r"(?i)^(utm_[a-z]+|gclid|fbclid|ref)="


_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*)://"
#: How pages and embedded JSON write & and / (fixed values).
_WRITTEN = [(r"\\/", "/"), (r"(?i)\\u002f", "/"), (r"(?i)\\u0026", "&"), (r"(?i)&(?:amp|#0*38|#x0*26);", "&"), (r"(?i)&(?:sol|#0*47|#x0*2f);", "/")]


def cleaned(url: Column) -> Column:
    """A URL as its page means it: escapes of HTML and JSON read, blanks at the ends, line breaks, tabs and other controls gone."""
    for pattern, plain in _WRITTEN:
        url = F.regexp_replace(url, pattern, plain)
    return F.regexp_replace(F.trim(url), r"^[\x00-\x20]+|[\x00-\x20]+$|[\x00-\x1f\x7f]", "")


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def _located(url: Column) -> Column:
    """Host and port: the authority without what stands before its last @."""
    return F.regexp_replace(authority(url), "^.*@", "")


def host(url: Column) -> Column:
    """Lower-case host without a final dot; an IPv6 address keeps its brackets."""
    return F.regexp_replace(F.lower(F.regexp_extract(_located(url), r"^(\[[^\]]*\]|[^:]*)", 1)), r"\.$", "")


def port(url: Column) -> Column:
    """The port with its colon, or an empty string."""
    return F.regexp_extract(_located(url), r"^(?:\[[^\]]*\]|[^:]*)(:[0-9]+)$", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def canonical(url: Column, base: Column | None = None) -> Column:
    """Scheme and host in lower case, no user, no default port, no fragment, no tracking parameter, a path; null for what is no web address.

    The URL is read as the page writes it, and seen from base if that is given, so that a relative one has a canonical form too.
    """
    whole = cleaned(url) if base is None else resolved(base, cleaned(url))
    plain = F.regexp_replace(whole, "#.*$", "")
    scheme = F.lower(F.regexp_extract(plain, _SCHEME, 1))
    kept = F.filter(F.split(query_string(plain), "&"), lambda p: ~p.rlike(TRACKING) & (p != ""))
    own = port(plain)
    default = ((scheme == "http") & (own == ":80")) | ((scheme == "https") & (own == ":443"))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    way = F.when(path(plain) == "", "/").otherwise(path(plain))
    form = F.concat(scheme, F.lit("://"), host(plain), F.when(default, F.lit("")).otherwise(own), way, tail)
    return F.when(scheme.isin("http", "https") & (host(plain) != ""), form)


def _without_dots(path: Column) -> Column:
    """The path with its . and .. segments worked off."""
    parts = F.split(path, "/")
    end = F.element_at(parts, -1)

    def step(done, part):
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    folded = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step)
    return F.concat(F.array_join(folded, "/"), F.when(end.isin(".", "..") & (F.size(parts) > 1), F.lit("/")).otherwise(F.lit("")))


def resolved(base: Column, link: Column) -> Column:
    """A link as an absolute URL, seen from base; what is absolute already stays as it is."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    whole = F.regexp_extract(base, "^([^?#]*)", 1)
    folder = F.regexp_extract(path(base), "^(.*/)", 1)
    way, tail = F.regexp_extract(link, "^([^?#]*)", 1), F.regexp_extract(link, "^[^?#]*(.*)$", 1)
    absolute = F.when(way.startswith("/"), way).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), way))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), link))
        .when(link == "", F.regexp_replace(base, "#.*$", ""))
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .when(link.startswith("?"), F.concat(whole, link))
        .otherwise(F.concat(origin, _without_dots(absolute), tail))
    )


def had_tracking(url: Column) -> Column:
    return F.exists(F.split(query_string(url), "&"), lambda p: p.rlike(TRACKING))


def safe_link(url: Column) -> Column:
    """The URL if it may be shown as a link, else null."""
    return F.when(F.lower(cleaned(url)).rlike("^https?://"), cleaned(url))


#: Hosts that no public address has: special IPv4 ranges, local names, and numbers in other forms than four decimal parts (fixed values).
SPECIAL_V4 = (
    r"^(0|10|127)\.", r"^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.", r"^169\.254\.", r"^172\.(1[6-9]|2[0-9]|3[01])\.", r"^192\.168\.",
    r"^192\.0\.[02]\.", r"^192\.88\.99\.", r"^198\.(1[89]|51\.100)\.", r"^203\.0\.113\.", r"^(22[4-9]|23[0-9]|24[0-9]|25[0-5])\.",
)
LOCAL_NAME = r"^(localhost|.*\.(localhost|local|internal|home\.arpa))$"
NUMBERS, FOUR_PARTS = r"^(0x[0-9a-f]*|[0-9]+)(\.(0x[0-9a-f]*|[0-9]+))*$", r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$"
#: Global unicast is 2000::/3; documentation, 6to4 and Teredo addresses in it are not taken either.
PUBLIC_V6, SPECIAL_V6 = r"^\[[23][0-9a-f]{3}:", r"^\[(2001:0?db8|2001:0{0,3}0?:|2001::|2002|3fff):?"


#: Full-width forms of ASCII, and the other full stops that name resolution takes for a dot.
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "\u3002\uFF61"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + ".."
#: What a name may hold once it is folded: letters and marks of any script, plain digits, hyphens and dots; other forms of digits may stand for an address.
NAME = r"^[\p{L}\p{M}0-9._-]+$"


def folded_host(url: Column) -> Column:
    """The host that a request would go to: percent codes read, wide forms narrowed, controls and soft hyphens gone, lower case."""
    # a browser takes a backslash for a slash
    written = host(F.replace(cleaned(url), F.lit("\\"), F.lit("/")))
    plain = F.coalesce(F.try_url_decode(F.replace(written, F.lit("+"), F.lit("%2B"))), written)
    return F.regexp_replace(F.lower(F.translate(F.regexp_replace(plain, r"[\x00-\x20\x7f\u00ad\u200b-\u200f\u2060\ufeff]", ""), _WIDE, _NARROW)), r"\.$", "")


def verdict(url: Column) -> Column:
    """Whether a URL may be fetched at all: OK, or the first reason against it. A name without a dot is local."""
    h, u = folded_host(url), cleaned(url)
    private = h.rlike(LOCAL_NAME) | (h.rlike(NUMBERS) & ~h.rlike(FOUR_PARTS)) | ~(h.contains(".") | h.startswith("["))
    for pattern in SPECIAL_V4:
        private = private | (h.rlike(FOUR_PARTS) & h.rlike(pattern))
    v6 = h.startswith("[") & (~h.rlike(PUBLIC_V6) | h.rlike(SPECIAL_V6))
    return (
        F.when(~F.lower(u).rlike("^https?://"), "BAD_SCHEME")
        .when(authority(F.replace(u, F.lit("\\"), F.lit("/"))).contains("@"), "CREDENTIALS")
        .when(h == "", "NO_HOST")
        .when(private | v6, "PRIVATE_ADDRESS")
        .when(~h.startswith("[") & ~h.rlike(NAME), "BAD_HOST")
        .otherwise("OK")
    )
