"""Text normalisation, hashes, escaping and redaction as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import let

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_S = r"[ \t\n\f\r]"
#: What is removed from texts before they are kept, in this order: patterns that Java and RE2 read alike, and what stays of a match (fixed values).
REDACTIONS = [
    # user and password in a URL
    (r"([A-Za-z][A-Za-z0-9+.-]*://)[^/@: \t\n\f\r]+:[^/@ \t\n\f\r]+@", ("", 1, "[secret]@")),
    # whole values of secret headers, up to the line's end
    (rf"""(?i)((?:proxy-)?authorization|(?:set-)?cookie|x-api-key|x-auth-token)(\\?["']?{_S}*[:=])[^\r\n]*""", ("", 1, "", 2, " [secret]")),
    (r"(?i)(bearer)[ \t]+[A-Za-z0-9._~+/=-]{6,}", ("", 1, " [secret]")),
    # fields and parameters of secret names, with what they are set to: quoted, in brackets, or up to the next blank or separator
    (rf"""(?i)([A-Za-z0-9_-]*(?:api[_-]?key|token|secret|passw(?:or)?d|passphrase|credential|private[_-]?key|session[_-]?id|storage[_-]?state)[A-Za-z0-9_-]*)(\\?["']?{_S}*[:=]{_S}*)(?:\\"[^"\\]*\\"|\\?"(?:[^"\\]+|\\.)*"?|'[^']*'?|\[[^\]]*\]?|\{{[^}}]*\}}?|[^&,;}}\] \t\n\f\r]+)""", ("", 1, "", 2, "[secret]")),
    (EMAIL, ("[email]",)),
    # the user's name in a local path
    (r"""(?i)([a-z]:\\users\\|/home/|/users/)[^\\/"' \t\n\f\r]+""", ("", 1, "[user]")),
]
SECRET = REDACTIONS[3][0]
#: Of each of these patterns, in the same order: texts of which a match holds one, whatever their case (a fixed list).
NEEDED = [
    ("://",), ("authorization", "cookie", "x-api-key", "x-auth-token"), ("bearer",), ("key", "token", "secret", "passw", "passphrase", "credential", "session", "storage"), ("@",), ("\\users\\", "/home/", "/users/"),
]
#: How a match of SECRET goes on from its name. It has no run before the name, which a search would begin anew at each of its characters.
SECRET_SET = rf"""(?i)(?:api[_-]?key|token|secret|passw(?:or)?d|passphrase|credential|private[_-]?key|session[_-]?id|storage[_-]?state)[A-Za-z0-9_-]*+\\?["']?{_S}*+[:=]"""
#: A field of this name, reduced to its letters, is secret whatever it holds.
SECRET_NAME = "authorization|cookie|passwd|password|passphrase|secret|token|apikey|credential|privatekey|sessionid|storagestate"
FORMULA_START = r"^[=+\-@\t\r]"


def normalised(text: Column) -> Column:
    """White space folded to single blanks, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def content_hash(text: Column) -> Column:
    """SHA-256 of the normalised text: equal for representations that differ in case and spacing only."""
    return F.sha2(normalised(text).cast("binary"), 256)


def body_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def key_of(*parts: Column) -> Column:
    """A stable logical key: SHA-256 of the parts, joined by a character that none of them holds."""
    return F.sha2(F.concat_ws("\u0001", *[p.cast("string") for p in parts]).cast("binary"), 256)


def normalised_name(name: Column) -> Column:
    """Company or title without punctuation and legal suffixes."""
    plain = F.regexp_replace(F.lower(name), r"[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\b(inc|ltd|llc|gmbh|corp)\b", ""), r" +", " "))


def escaped(text: Column) -> Column:
    """Text that no HTML reader executes."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def csv_safe(text: Column) -> Column:
    """Cells that spreadsheets would run as formulas get a leading apostrophe."""
    return F.when(text.rlike(FORMULA_START), F.concat(F.lit("'"), text)).otherwise(text)


def replacement(parts: tuple, group: str) -> str:
    """What a match becomes, in the notation of an engine: its mark before a group's number."""
    return "".join(p if isinstance(p, str) else f"{group}{p}" for p in parts)


def holds(low: Column, words: tuple[str, ...]) -> Column:
    """Whether a text in lower case holds one of some words."""
    return reduce(lambda x, y: x | y, [low.contains(w) for w in words])


def has_email(text: Column) -> Column:
    return text.contains("@") & text.rlike(EMAIL)


def has_secret(text: Column) -> Column:
    return holds(F.lower(text), NEEDED[3]) & text.rlike(SECRET_SET) & text.rlike(SECRET)


def redacted(text: Column) -> Column:
    """Text without addresses and secrets.

    Most texts hold nothing that any pattern needs, and stay. In others the patterns run from the first one that may match: those before it
    leave the text as it is.
    """
    def replaced(low: Column) -> Column:
        may = [holds(low, words) for words in NEEDED]
        may[3] = may[3] & text.rlike(SECRET_SET)
        out = None
        for k, found in enumerate(may):
            left = text
            for pattern, kept in REDACTIONS[k:]:
                left = F.regexp_replace(left, pattern, replacement(kept, "$"))
            out = F.when(found, left) if out is None else out.when(found, left)
        return out.otherwise(text)

    return let(F.lower(text), replaced)


_JSON_TOKEN = r'"(?:[^"\\]++|\\.)*+"|[{}\[\],:]|[^\s{}\[\],:"]++'
_WALK = "struct<depth:int,hide:int,start:int,spans:array<struct<a:int,b:int>>>"


def _string(token: Column) -> Column:
    """What a JSON string says."""
    plain = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.when(token.contains("\\"), F.get_json_object(F.concat(F.lit('{"v":'), token, F.lit("}")), "$.v")).otherwise(plain)


def _written(text: Column) -> Column:
    """A text as a JSON string."""
    record = F.to_json(F.struct(text.alias("v")))
    return F.substring(record, F.lit(6), F.length(record) - 6)


def redacted_json(text: Column, embedded: int = 1) -> Column:
    """JSON with secret fields replaced at any depth, whatever they hold, and addresses and secrets in all other strings; still JSON.

    The tokens of the text are read once. A fold over the brackets finds the objects and arrays that are values of secret fields;
    each becomes one string, as do plain values of such fields. Strings that hold JSON themselves are walked
    in the same way, embedded levels deep. What is no JSON is redacted as text. White space between tokens goes.
    """

    def walked(tokens: Column) -> Column:
        def secret(i: Column) -> Column:
            """Whether token i is the value of a secret field."""
            name = F.lower(F.regexp_replace(_string(F.get(tokens, i - 2)), "[^A-Za-z]", ""))
            return (F.get(tokens, i - 1) == ":") & F.coalesce(name.rlike(SECRET_NAME), F.lit(False))

        brackets = F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"].isin("{", "[", "}", "]"))

        def step(s: Column, x: Column) -> Column:
            opens = x["t"].isin("{", "[")
            hides = opens & (s["hide"] == 0) & F.coalesce(secret(x["i"]), F.lit(False))
            shows = ~opens & (s["depth"] == s["hide"])
            span = F.array(F.struct(s["start"].alias("a"), x["i"].alias("b")))
            return F.struct(
                F.when(opens, s["depth"] + 1).otherwise(s["depth"] - 1).alias("depth"),
                F.when(hides, s["depth"] + 1).when(shows, 0).otherwise(s["hide"]).alias("hide"),
                F.when(hides, x["i"]).otherwise(s["start"]).alias("start"),
                F.when(shows, F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"),
            )

        start = F.from_json(F.lit('{"depth":0,"hide":0,"start":0,"spans":[]}'), _WALK)

        def shown(spans: Column) -> Column:
            def one(t: Column, i: Column) -> Column:
                value = F.when(F.get(tokens, i + 1) == ":", t).otherwise(let(_string(t), lambda v: let(redacted_json(v, embedded - 1) if embedded else redacted(v), lambda r: F.when(r == v, t).otherwise(_written(r)))))
                plain = F.when(t.startswith('"'), value).otherwise(t)
                hidden = F.when(t.isin("}", "]", ",", ":"), t).when(F.coalesce(secret(i), F.lit(False)), F.lit('"[secret]"')).otherwise(plain)
                return F.when(F.exists(spans, lambda s: s["a"] == i), F.lit('"[secret]"')).when(F.exists(spans, lambda s: (s["a"] < i) & (i <= s["b"])), "").otherwise(hidden)

            return F.array_join(F.transform(tokens, one), "")

        return let(F.aggregate(brackets, start, step)["spans"], shown)

    is_json = text.rlike(r"^\s*[\[{]") & F.try_parse_json(text).isNotNull()
    return F.when(is_json, let(F.regexp_extract_all(text, F.lit(_JSON_TOKEN), F.lit(0)), walked)).otherwise(redacted(text))


def json_depth(text: Column) -> Column:
    """How deep a JSON text nests, strings aside: brackets are counted in one pass over its tokens."""
    brackets = F.filter(F.regexp_extract_all(text, F.lit(_JSON_TOKEN), F.lit(0)), lambda t: t.isin("{", "[", "}", "]"))

    def step(s: Column, t: Column) -> Column:
        now = s["now"] + F.when(t.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(brackets, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"])
