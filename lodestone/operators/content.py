"""Content of pages: cleaned trees as Markdown and plain text, their language, facts with evidence, and classes of change."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expressions import let
from ..functions.text import holds

# What of a page is no content, and how elements are written in Markdown, before and after what they hold.
SKIPPED = "script style noscript template nav footer aside form select button iframe svg head".split()
MARKS = {
    **{f"h{n}": ("\n\n" + "#" * n + " ", "\n\n") for n in range(1, 7)}, **dict.fromkeys("p div section article main header table ul ol dl blockquote figure".split(), ("\n\n", "\n\n")),
    "li": ("\n- ", "\n"), "dt": ("\n", "\n"), "dd": ("\n: ", "\n"), "tr": ("\n| ", "\n"), "td": ("", " | "), "th": ("", " | "), "br": ("\n", ""), "hr": ("\n\n---\n\n", ""), "pre": ("\n\n```\n", "\n```\n\n"), "code": ("`", "`"),
    **dict.fromkeys(("b", "strong"), ("**", "**")), **dict.fromkeys(("i", "em"), ("_", "_")),
}
#: Elements that part words in plain text too.
PARTING = [n for n, (a, b) in MARKS.items() if "\n" in a + b or "|" in b]
#: Frequent words of languages, as a profile to vote with (fixed lists).
PROFILES = {
    "de": "der die und das den von ist mit nicht ein eine auf für dem sich auch als wird sind oder".split(),
    "en": "the of and to in is that for with as on are by at this from or be have it".split(),
    "es": "de la que el en los del las por con una para es como más pero sus le ya o".split(),
    "fr": "le de et la les des en un une est que pour dans qui sur pas au plus avec ce".split(),
}


def _element_text(e: Column, side: int) -> Column:
    """What Markdown has before (0) or after (1) an element."""
    href = F.get(F.transform(F.filter(e["attrs"], lambda a: a["name"] == "href"), lambda a: a["value"]), 0)
    link = F.when((e["name"] == "a") & href.isNotNull(), "[" if side == 0 else F.concat(F.lit("]("), href, F.lit(")")))
    marks = F.create_map(*[F.lit(x) for n, m in MARKS.items() for x in (n, m[side])])
    return F.coalesce(link, F.try_element_at(marks, e["name"]), F.lit(""))


def _written(page: Column, mark) -> Column:
    """The page's texts in order with what mark(element, side) puts before and after elements; content only."""
    skipped = F.filter(page["elements"], lambda e: e["name"].isin(*SKIPPED))

    def join(out: Column) -> Column:
        def shown(at: Column) -> Column:
            return ~F.exists(out, lambda s: (s["pos"] <= at) & (at < s["end"]))

        texts = F.transform(page["texts"], lambda t, i: F.struct((i * 2).alias("at"), F.lit(0).alias("level"), F.when(shown(i), F.regexp_replace(t, r"\s+", " ")).otherwise("").alias("s")))
        own = F.filter(page["elements"], lambda e: shown(e["pos"]))
        # an element starts at its tag, outer ones first, and ends before the tag that follows, inner ones first
        before = F.transform(own, lambda e: F.struct((e["pos"] * 2).alias("at"), (e["depth"] - 100_000).alias("level"), mark(e, 0).alias("s")))
        after = F.transform(own, lambda e: F.struct((e["end"] * 2 - 1).alias("at"), (-e["depth"]).alias("level"), mark(e, 1).alias("s")))
        return F.array_join(F.transform(F.array_sort(F.concat(texts, before, after)), lambda x: x["s"]), "")

    return let(skipped, join)


def markdown(page: Column) -> Column:
    """The content of a page's tree as Markdown: navigation, footers, scripts and forms are left out; blank lines and blanks are folded."""
    text = _written(page, _element_text)
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]*\n[ \t]*", "\n"), r"\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?m)^(#+|-|:) *\n*$", ""), r"^\s+|\s+$", ""))


def plain(page: Column) -> Column:
    """The content of a page's tree as words with single blanks."""
    text = _written(page, lambda e, side: F.when(e["name"].isin(*PARTING), " ").otherwise(""))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def language(text: Column) -> Column:
    """struct<lang, confidence>: the profile that most of a text's frequent words are in, and its share of all votes; null and 0 where none votes or two tie."""
    words = F.split(F.lower(text), r"[^\p{L}]+")

    def vote(ws: Column) -> Column:
        def among(profile: list[str]):
            return lambda w: w.isin(profile)

        votes = F.array(*[F.struct(F.size(F.filter(ws, among(profile))).alias("n"), F.lit(lang).alias("lang")) for lang, profile in PROFILES.items()])

        def choose(v: Column) -> Column:
            most = F.array_max(F.transform(v, lambda x: x["n"]))
            total = F.aggregate(F.transform(v, lambda x: x["n"]), F.lit(0), lambda a, b: a + b)
            best = F.filter(v, lambda x: x["n"] == most)
            sure = (most > 0) & (F.size(best) == 1)
            return F.struct(F.when(sure, F.get(best, 0)["lang"]).alias("lang"), F.when(sure, F.round(most / total, 6)).otherwise(0.0).alias("confidence"))

        return let(votes, choose)

    return let(words, vote)


#: Rules of facts as versioned data: id, version, type, value, pattern that Java and RE2 read alike, confidence. Repetitions that a long line could
#: restart at each of its characters are bounded.
RULES = [
    ("licence.line", 2, "licence", "stated", r"(?i)licensed under [^.\n]*", 0.9), ("licence.release", 1, "licence", "stated", r"(?i)released under [^.\n]*", 0.9),
    ("contact.mail", 1, "contact", "mail", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0.95), ("layout.pipes", 1, "layout", "table", r"[^|\n]{1,80} \| [^|\n]{1,80} \|", 0.7), ("layout.question", 1, "layout", "question", r"[^.?!\n]{3,200}\?", 0.5),
    ("level.senior", 3, "seniority", "senior", r"(?i)(?:senior|lead|principal|staff) [a-z]+", 0.8), ("level.junior", 1, "seniority", "junior", r"(?i)(?:junior|entry[- ]level|graduate) [a-z]+", 0.8),
    ("type.full", 1, "employment_type", "full_time", r"(?i)full[- ]time", 0.9), ("type.part", 1, "employment_type", "part_time", r"(?i)part[- ]time", 0.9), ("type.contract", 1, "employment_type", "contract", r"(?i)(?:freelance|fixed[- ]term|contractor)", 0.8),
    ("scope.remote", 2, "remote_scope", "remote", r"(?i)(?:fully )?remote(?: within [a-z]+)?", 0.7), ("scope.hybrid", 1, "remote_scope", "hybrid", r"(?i)hybrid", 0.7),
    ("auth.required", 1, "work_authorization", "required", r"(?i)(?:work permit|right to work|visa sponsorship)[^.\n]*", 0.8), ("experience.years", 2, "experience", "years", r"(?i)[0-9]+\+? years?(?: of)? experience", 0.85),
]

#: Of a rule's pattern: texts of which a match holds one, whatever their case, and a pattern with the same first match that begins at fewer places or
#: gives nothing back, which RE2 does not read (None: the rule's own). A pattern without an entry is always searched for.
_LOCAL = "A-Za-z0-9._%+-"
SEARCHED = {pattern: found for (_, _, _, _, pattern, _), found in zip(RULES, [
    (("licensed under ",), None), (("released under ",), None), (("@",), rf"(?<![{_LOCAL}])[{_LOCAL}]++@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}"), ((" | ",), r"[^|\n]{2,81}+(?<= )\| [^|\n]{2,81}+(?<= )\|"), (("?",), r"[^.?!\n]{3,200}+\?"),
    (("senior ", "lead ", "principal ", "staff "), None), (("junior ", "entry", "graduate "), None), (("full",), None), (("part",), None), (("freelance", "fixed", "contractor"), None),
    (("remote",), None), (("hybrid",), None), (("work permit", "right to work", "visa sponsorship"), None), (("experience",), None),
])}


def facts(text: Column, rules: list[tuple] = RULES) -> Column:
    """array<struct<rule_id, rule_version, fact_type, value, confidence, evidence_text, evidence_start, evidence_end>>: the first evidence of each rule, by characters from 0."""
    def one(rule: tuple, low: Column) -> Column:
        rule_id, version, kind, value, pattern, confidence = rule
        def shown(found: Column) -> Column:
            return F.when(found.isNotNull() & (found != ""), let(F.regexp_instr(text, F.lit(pattern)) - 1, lambda start: evidence(found, start)))

        def evidence(found: Column, start: Column) -> Column:
            fields = {"rule_id": F.lit(rule_id), "rule_version": F.lit(version), "fact_type": F.lit(kind), "value": F.lit(value), "confidence": F.lit(confidence), "evidence_text": found, "evidence_start": start, "evidence_end": start + F.length(found)}
            return F.struct(*[c.alias(n) for n, c in fields.items()])

        words, same = SEARCHED.get(pattern, ((), None))
        found = F.regexp_substr(text, F.lit(same or pattern))
        return let(F.when(holds(low, words), found) if words else found, shown)

    return let(F.lower(text), lambda low: F.array_compact(F.array(*[one(r, low) for r in rules])))


#: Classes of change in the order in which they are listed (fixed names).
CHANGES = ("JOB_CLOSED", "JOB_REOPENED", "REPOST_DETECTED", "PAGE_TEMPLATE_CHANGED", "EXTRACTION_DRIFT", "TITLE_CHANGED", "SALARY_CHANGED", "LOCATION_CHANGED", "APPLY_URL_CHANGED", "CONTENT_CHANGED", "UNKNOWN_CHANGE", "UNCHANGED")


def change_classes(old: Column, new: Column, template: Column, drift: Column, repost: Column) -> Column:
    """All classes of a version against the one before it (structs of title, salary, location, apply_url, content, body, state), or null without one.

    template and drift say that the source changed its pages, or that extraction lost fields: then differences of fields are theirs, not the
    job's. A different body without any field that differs is an unknown change.
    """
    def differs(name: str) -> Column:
        return ~old[name].eqNullSafe(new[name])

    fields = {"TITLE_CHANGED": "title", "SALARY_CHANGED": "salary", "LOCATION_CHANGED": "location", "APPLY_URL_CHANGED": "apply_url", "CONTENT_CHANGED": "content"}
    closed, was = new["state"] == "CLOSED", old["state"] == "CLOSED"
    some = {
        "JOB_CLOSED": closed & ~was, "JOB_REOPENED": was & ~closed & ~repost, "REPOST_DETECTED": was & ~closed & repost, "PAGE_TEMPLATE_CHANGED": template, "EXTRACTION_DRIFT": drift & ~template,
        **{k: differs(f) & ~template & ~drift for k, f in fields.items()},
    }
    known = F.array_compact(F.array(*[F.when(F.coalesce(some[k], F.lit(False)), k) for k in CHANGES[:10]]))
    rest = F.when(F.size(known) > 0, known).when(differs("body"), F.array(F.lit("UNKNOWN_CHANGE"))).otherwise(F.array(F.lit("UNCHANGED")))
    return F.when(old.isNotNull(), rest)
