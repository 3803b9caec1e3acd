"""Pages as trees of elements, and locators over them, as column expressions: nothing is shuffled and no Python runs.

`tree(html)` cuts a page into a stream of tokens and folds it with a stack of open elements. Each element gets the place of its tag in the
stream, the place where it ends, and its depth, so that an element is inside another exactly if its place lies in the
other's interval. Void elements end at once; raw ones (script, style, title, textarea) are one token; some tags imply the end of what is
open (li, dt, dd, tr, td, th, option and p), up to the list or table that they stand in; a closing tag ends the nearest open element of its name and
what is open inside, or nothing; what is never closed ends with the page.

Locators of all kinds become one form: steps of tests, joined by the descendant, child and sibling relations, read from the last step to the
first over the intervals of one page.

Defined cases: a null page has a null tree; an empty one no elements; text outside of tags stays text, as does a tag whose quotes
or bracket never close; a repeated attribute counts by its first value; names are lower case.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expressions import let

# Fixed values of HTML: elements without content, raw elements, and tags that imply the end of others, with where that stops.
VOID = "area base br col embed hr img input link meta source track wbr".split()
RAW = "script style title textarea".split()
BLOCKS = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
IMPLIED = {"li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), **{b: ("p", "td th li dd button table") for b in BLOCKS}}
#: Roles that elements have by their names.
ROLES = {
    "heading": "h1 h2 h3 h4 h5 h6", "link": "a", "list": "ul ol", "listitem": "li", "article": "article", "button": "button", "navigation": "nav", "main": "main", "table": "table",
    "row": "tr", "cell": "td", "img": "img", "form": "form",
}

_INSIDE = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+>"""
TOKEN = rf"(?is)<!--.*?(?:-->|\z)|<(?:{'|'.join(RAW)})(?=[\s/>]){_INSIDE}.*?(?:</(?:{'|'.join(RAW)})\s*>|\z)|</?[a-z]{_INSIDE}|<[!?][^>]*+>|[^<]++|<"
_RAW_OPEN = rf"(?is)^<(?:{'|'.join(RAW)})(?=[\s/>]){_INSIDE}"
_ATTRIBUTE = r"""(?s)([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?"""
_EMPTY = "struct<stack:array<struct<i:int,name:string>>,done:array<struct<pos:int,end:int,depth:int>>>"


def decoded(text: Column) -> Column:
    """Text with the entities that every page uses read."""
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v.split()]))])


def _last(stack: Column, test: Callable[[Column], Column]) -> Column:
    """Place from 1 of the topmost open element that passes, else 0."""
    place = F.array_position(F.reverse(F.transform(stack, lambda s: F.coalesce(test(s["name"]), F.lit(False)))), True)
    return F.when(place == 0, 0).otherwise(F.size(stack) - place + 1).cast("int")


def _ended(stack: Column, first: Column, end: Column) -> Column:
    """Elements of the stack from first on, as ended at end."""
    popped = F.slice(stack, first, F.size(stack) - first + 1)
    return F.transform(popped, lambda s, k: F.struct(s["i"].alias("pos"), end.cast("int").alias("end"), (first + k).cast("int").alias("depth")))


def _step(state: Column, token: Column) -> Column:
    name, i = token["name"], token["i"]

    def closing(stack: Column) -> Column:
        """The first element that this tag ends: one more than the stack's size if none."""
        rule = F.try_element_at(_map({k: v for k, (v, _) in IMPLIED.items()}), name)
        barrier = F.try_element_at(_map({k: v for k, (_, v) in IMPLIED.items()}), name)
        implied = let(_last(stack, lambda n: F.array_contains(rule, n)), lambda at: F.when(at > _last(stack, lambda n: F.array_contains(barrier, n)), at).otherwise(0))
        found = F.when(token["kind"] == "c", _last(stack, lambda n: n == name)).otherwise(F.when(rule.isNull(), 0).otherwise(implied))
        return let(found, lambda at: F.when(at == 0, F.size(stack) + 1).otherwise(at).cast("int"))

    def after(first: Column) -> Column:
        kept = F.slice(state["stack"], 1, first - 1)
        leaf = F.array(F.struct(i.alias("pos"), (i + 1).cast("int").alias("end"), first.alias("depth")))
        done = F.concat(state["done"], _ended(state["stack"], first, i), F.when(token["kind"] == "v", leaf).otherwise(F.slice(leaf, 1, 0)))
        return F.struct(F.when(token["kind"] == "o", F.concat(kept, F.array(F.struct(i.alias("i"), name.alias("name"))))).otherwise(kept).alias("stack"), done.alias("done"))

    return let(closing(state["stack"]), after)


def tree(html: Column) -> Column:
    """struct<elements: array<struct<pos, end, depth, name, attrs>>, texts: array<string>>; texts has one entry a token."""
    name = lambda t: F.lower(F.regexp_extract(t, r"^</?([A-Za-z][^\s/>]*)", 1))

    def kind(t: Column, n: Column) -> Column:
        return F.when(n == "", "t").when(t.startswith("</"), "c").when(n.isin(*VOID, *RAW), "v").otherwise("o")

    def attributes(t: Column) -> Column:
        inner = F.regexp_replace(F.regexp_extract(F.regexp_extract(t, rf"(?is)^<[a-z]{_INSIDE}", 0), r"(?s)^<[^\s/>]+(.*)>$", 1), r"/\s*$", "")
        names, *values = [F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), F.lit(g)) for g in (1, 2, 3, 4)]
        zipped = F.arrays_zip(names.alias("n"), *[v.alias(f"v{k}") for k, v in enumerate(values)])
        return F.transform(zipped, lambda a: F.struct(F.lower(a["n"]).alias("name"), decoded(F.concat(a["v0"], a["v1"], a["v2"])).alias("value")))

    def text(t: Column) -> Column:
        raw = F.regexp_replace(F.regexp_replace(t, _RAW_OPEN, ""), rf"(?is)</(?:{'|'.join(RAW)})\s*>$", "")
        return F.when(~t.startswith("<") | (t == "<"), decoded(t)).when(t.rlike(r"(?i)^<(?:title|textarea)[\s/>]"), decoded(raw)).otherwise("")

    def build(tokens: Column) -> Column:
        tags = F.transform(tokens, lambda t, i: let(name(t), lambda n: F.struct(i.alias("i"), n.alias("name"), kind(t, n).alias("kind"))))
        start = F.from_json(F.lit('{"stack":[],"done":[]}'), _EMPTY)
        last = F.aggregate(F.filter(tags, lambda t: t["kind"] != "t"), start, _step)
        closed = let(last, lambda s: F.array_sort(F.concat(s["done"], _ended(s["stack"], F.lit(1), F.size(tokens)))))
        elements = F.transform(closed, lambda c: let(F.get(tokens, c["pos"]), lambda t: F.struct(c["pos"].alias("pos"), c["end"].alias("end"), c["depth"].alias("depth"), name(t).alias("name"), attributes(t).alias("attrs"))))
        return F.struct(elements.alias("elements"), F.transform(tokens, text).alias("texts"))

    return F.when(html.isNotNull(), let(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)), build))


def text_of(page: Column, element: Column) -> Column:
    """The text of an element, white space folded."""
    own = F.array_join(F.slice(page["texts"], element["pos"] + 1, element["end"] - element["pos"]), "")
    return F.trim(F.regexp_replace(own, r"\s+", " "))


def attribute(element: Column, name: str) -> Column:
    """The value of an element's attribute, or null."""
    return F.get(F.transform(F.filter(element["attrs"], lambda a: a["name"] == name.lower()), lambda a: a["value"]), 0)


def inside(inner: Column, outer: Column) -> Column:
    return (outer["pos"] < inner["pos"]) & (inner["pos"] < outer["end"])


Test = Callable[[Column, Column], Column]  # of a page and one of its elements


@dataclass
class Step:
    """One step of a locator: what an element must be, and how it stands to an element of the step before: descendant, child or sibling."""

    tests: list[Test] = field(default_factory=list)
    relation: str = " "

    def passed(self, page: Column, element: Column) -> Column:
        ok = F.lit(True)
        for test in self.tests:
            ok = ok & F.coalesce(test(page, element), F.lit(False))
        return ok


def _passes(steps: list[Step], page: Column, element: Column, within: Column | None = None) -> Column:
    """Whether an element is the last of the steps; within: the first step is sought inside this element only."""
    *before, last = steps
    ok = last.passed(page, element)
    if not before:
        if within is None:
            return ok & (element["depth"] == 1) if last.relation == ">" else ok
        return ok & inside(element, within) & ((element["depth"] == within["depth"] + 1) if last.relation == ">" else F.lit(True))

    def stands(other: Column) -> Column:
        if last.relation == "~":
            level = (other["depth"] == element["depth"]) & (other["pos"] < element["pos"])
            return level & ~F.exists(page["elements"], lambda x: (x["pos"] > other["pos"]) & (x["pos"] < element["pos"]) & (x["depth"] < element["depth"]))
        near = inside(element, other)
        return near & (other["depth"] == element["depth"] - 1) if last.relation == ">" else near

    return ok & F.exists(page["elements"], lambda other: stands(other) & _passes(before, page, other, within))


#: A locator, read: alternatives of steps, and what to take of the element (an attribute, or its text if None).
@dataclass
class Locator:
    alternatives: list[list[Step]]
    take: str | None = None

    def matches(self, page: Column, within: Column | None = None) -> Column:
        """The elements found, in the order of the page."""

        def ok(e: Column) -> Column:
            found = F.lit(False)
            for steps in self.alternatives:
                found = found | _passes(steps, page, e, within)
            return found

        return F.filter(page["elements"], ok)

    def value(self, page: Column, element: Column) -> Column:
        return F.nullif(F.trim(attribute(element, self.take)) if self.take else text_of(page, element), F.lit(""))

    def first(self, page: Column, within: Column | None = None) -> Column:
        """The first value found that is not empty."""
        return F.get(F.filter(F.transform(self.matches(page, within), lambda e: self.value(page, e)), lambda v: v.isNotNull()), 0)


def _named(*names: str) -> Test:
    return lambda page, e: e["name"].isin(*[n.lower() for n in names])


def _attr(name: str, op: str | None = None, value: str = "") -> Test:
    def test(page: Column, e: Column) -> Column:
        have = attribute(e, name)
        if op is None:
            return have.isNotNull()
        if op in ("^=", "$=", "*=") and value == "":
            return F.lit(False)
        return {
            "=": lambda: have == value, "^=": lambda: have.startswith(value), "$=": lambda: have.endswith(value), "*=": lambda: have.contains(value),
            "~=": lambda: F.array_contains(F.split(have, r"\s+"), value), "|=": lambda: (have == value) | have.startswith(value + "-"),
        }[op]()

    return test


def _nth(n: int, same_name: bool = False) -> Test:
    """The n-th among the elements of its parent, or among those of its name."""

    def test(page: Column, e: Column) -> Column:
        parent = F.array_max(F.transform(F.filter(page["elements"], lambda a: inside(e, a) & (a["depth"] == e["depth"] - 1)), lambda a: a["pos"]))
        before = F.filter(page["elements"], lambda s: (s["depth"] == e["depth"]) & (s["pos"] < e["pos"]) & (s["pos"] > F.coalesce(parent, F.lit(-1))) & ((s["name"] == e["name"]) if same_name else F.lit(True)))
        return F.size(before) == n - 1

    return test


_SIMPLE = re.compile(r"""
    (?P<tag>\*|[A-Za-z][\w-]*) | \#(?P<id>[\w-]+) | \.(?P<cls>[\w-]+)
  | \[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s"']+))\s*)?\]
  | :(?P<pseudo>first-child|nth-child|has|not)
""", re.X)


def _group(text: str, at: int) -> tuple[str, int]:
    """What stands in the brackets that open at a place, and the place after them."""
    depth, quote = 0, ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return text[at + 1:i], i + 1
    raise ValueError(f"brackets do not close: {text}")


def css(selector: str, take: str | None = None) -> Locator:
    """A selector of names, #id, .class, [attribute], :has(), :not(), :first-child, :nth-child(n), blank, >, ~ and commas."""
    alternatives, steps, i, relation = [], [], 0, " "
    text = selector.strip()
    current: Step | None = None
    while i < len(text):
        gap = re.compile(r"\s*([,>~])\s*|\s+").match(text, i)
        if gap:
            i = gap.end()
            if gap[1] == "," and current:
                alternatives.append(steps)
                steps, current, relation = [], None, " "
            elif gap[1] == ",":
                raise ValueError(f"no selector before a comma: {selector}")
            else:
                current, relation = None, gap[1] or " "
            continue
        part = _SIMPLE.match(text, i)
        if not part:
            raise ValueError(f"not a selector: {selector}")
        if current is None:
            current = Step(relation=relation)
            steps.append(current)
        i = part.end()
        if part["tag"]:
            if part["tag"] != "*":
                current.tests.append(_named(part["tag"]))
        elif part["id"]:
            current.tests.append(_attr("id", "=", part["id"]))
        elif part["cls"]:
            current.tests.append(_attr("class", "~=", part["cls"]))
        elif part["attr"]:
            current.tests.append(_attr(part["attr"], part["op"], part["dq"] or part["sq"] or part["bare"] or ""))
        elif part["pseudo"] == "first-child":
            current.tests.append(_nth(1))
        else:
            if i >= len(text) or text[i] != "(":
                raise ValueError(f"brackets are missing: {selector}")
            inner, i = _group(text, i)
            current.tests.append(_pseudo(part["pseudo"], inner))
    if not steps or current is None:
        raise ValueError(f"not a whole selector: {selector!r}")
    return Locator([*alternatives, steps], take)


def _pseudo(name: str, inner: str) -> Test:
    if name == "nth-child":
        return _nth(int(inner))
    child = inner.strip().startswith(">")
    read = css(inner.strip().lstrip(">"))
    if name == "has":
        if child:
            for steps in read.alternatives:
                steps[0].relation = ">"
        return lambda page, e: F.size(read.matches(page, e)) > 0
    if any(len(steps) > 1 for steps in read.alternatives):
        raise ValueError(":not takes tests of one element")
    return lambda page, e: ~F.greatest(F.lit(False), *[s[0].passed(page, e) for s in read.alternatives])


_XSTEP = re.compile(r"(?P<axis>//|/)(?:@(?P<attr>[\w:-]+)|(?P<text>text\(\))|(?P<name>\*|[A-Za-z][\w-]*))")
_XTEST = re.compile(r"""
    (?P<n>\d+) | @(?P<has>[\w:-]+)$ | (?:@(?P<attr>[\w:-]+)|(?P<self>text\(\)|\.))\s*=\s*(?P<eq>"[^"]*"|'[^']*')
  | (?P<fn>contains|starts-with)\(\s*(?:@(?P<fattr>[\w:-]+)|text\(\)|\.)\s*,\s*(?P<arg>"[^"]*"|'[^']*')\s*\)
""", re.X)


def _xtest(text: str) -> Test:
    t = _XTEST.fullmatch(text.strip())
    if not t:
        raise ValueError(f"not a predicate: {text}")
    if t["n"]:
        return _nth(int(t["n"]), same_name=True)
    if t["has"]:
        return _attr(t["has"])
    value = (t["eq"] or t["arg"])[1:-1]
    if t["attr"] or t["fattr"]:
        return _attr(t["attr"] or t["fattr"], {"contains": "*=", "starts-with": "^="}.get(t["fn"], "="), value)
    return lambda page, e: {"contains": lambda x: x.contains(value), "starts-with": lambda x: x.startswith(value)}.get(t["fn"], lambda x: x == value)(text_of(page, e))


def xpath(path: str) -> Locator:
    """A path of / and // steps with predicates on attributes, text and place; it may end in /@name or /text()."""
    text = path.strip()
    text = text[1:] if text.startswith(".") else text if text.startswith("/") else "//" + text
    steps, i, take = [], 0, None
    while i < len(text):
        part = _XSTEP.match(text, i)
        if not part or take is not None:
            raise ValueError(f"not a path: {path}")
        i = part.end()
        if part["attr"] or part["text"]:
            take = part["attr"] or ""
            continue
        step = Step([] if part["name"] == "*" else [_named(part["name"])], ">" if part["axis"] == "/" else " ")
        while i < len(text) and text[i] == "[":
            end = re.compile(r"""\[((?:[^\]"']|"[^"]*"|'[^']*')*)\]""").match(text, i)
            if not end:
                raise ValueError(f"a predicate does not close: {path}")
            step.tests.append(_xtest(end[1]))
            i = end.end()
        steps.append(step)
    if not steps:
        raise ValueError(f"not a whole path: {path!r}")
    return Locator([steps], take or None)


def role(name: str) -> Locator:
    """Elements of a role, by their attribute or else by their name."""
    if name not in ROLES:
        raise ValueError(f"no such role: {name}")
    by_name = _named(*ROLES[name].split())
    own = lambda page, e: F.when(attribute(e, "role").isNotNull(), attribute(e, "role") == name).otherwise(by_name(page, e) & ((attribute(e, "href").isNotNull()) if name == "link" else F.lit(True)))
    return Locator([[Step([own])]])


class TextAnchor(Locator):
    """What stands behind a label: the rest of the label's element, or else the text of the next element that has one."""

    def __init__(self, label: str):
        super().__init__([])
        self.label = label

    def first(self, page: Column, within: Column | None = None) -> Column:
        elements = F.filter(page["elements"], lambda e: inside(e, within)) if within is not None else page["elements"]
        label = F.lower(F.lit(self.label))

        def behind(e: Column) -> Column:
            rest = F.nullif(F.trim(F.regexp_replace(F.substring(text_of(page, e), F.length(label) + 1, F.lit(1 << 30)), r"^\s*:", "")), F.lit(""))
            following = F.filter(elements, lambda x: x["pos"] >= e["end"])
            return F.coalesce(rest, F.get(F.filter(F.transform(following, lambda x: F.nullif(text_of(page, x), F.lit(""))), lambda t: t.isNotNull()), 0))

        # the innermost element whose text starts with the label is the last of those that hold its first letter
        starts = F.filter(elements, lambda e: F.lower(text_of(page, e)).startswith(label) & F.lower(text_of(page, e)).substr(F.length(label) + 1, F.lit(1)).isin("", " ", ":"))
        innermost = F.filter(starts, lambda e: ~F.exists(starts, lambda x: inside(x, e)))
        return F.get(F.transform(innermost, behind), 0)


def locator(kind: str, value: str, take: str | None = None) -> Locator:
    """A locator as recipes write it."""
    if kind in ("css", "relative_css"):
        return css(value, take)
    if kind in ("xpath", "relative_xpath"):
        return xpath(value)
    if kind == "data_attr":
        name, _, wanted = value.partition("=")
        if not re.fullmatch(r"data-[\w-]+", name):
            raise ValueError(f"not a data attribute: {value}")
        return Locator([[Step([_attr(name, "=" if wanted else None, wanted)])]], take)
    if kind == "href_pattern":
        return Locator([[Step([_named("a"), _attr("href", "*=", value)])]], take or "href")
    if kind == "role":
        return role(value)
    if kind == "text_anchor":
        return TextAnchor(value)
    raise ValueError(f"no such locator: {kind}")


def signature(element: Column) -> Column:
    """An element's name with its classes in order, as a selector writes them."""
    classes = F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(attribute(element, "class"), F.lit("")), r"\s+"), lambda c: c.rlike(r"^[\w-]+$"))))
    return F.concat(element["name"], F.array_join(F.transform(classes, lambda c: F.concat(F.lit("."), c)), ""))


#: A card's element stands so often at least, and so large a share of its kind holds a link.
LEAST_CARDS, LINKED = 3, 0.8


def suggested_cards(page: Column) -> Column:
    """The repeated structure of a page (a column of its own: nested lambdas cost the analyser its rounds) that looks most like a list:
    struct<selector, n_cards, n_linked, n_chars>, or null.

    Elements of one parent and signature are a group. Its cards must be LEAST_CARDS at least, and LINKED of them hold a link; the group with
    the most text in cards wins, then the one with more cards, then the earlier one.
    """
    elements = page["elements"]

    def group(e: Column) -> Column:
        """The group that a first child of its kind stands for; null for later ones."""

        def of(parent: Column) -> Column:
            same = F.filter(elements, lambda s: (s["depth"] == e["depth"]) & inside(s, parent) & (s["name"] == e["name"]) & (signature(s) == signature(e)))
            linked = F.size(F.filter(same, lambda s: F.exists(elements, lambda a: (a["name"] == "a") & (a["pos"] >= s["pos"]) & (a["pos"] < s["end"]) & attribute(a, "href").isNotNull())))
            chars = F.aggregate(F.transform(same, lambda s: F.length(text_of(page, s))), F.lit(0), lambda a, b: a + b)
            return let(same, lambda cards: F.when((F.get(cards, 0)["pos"] == e["pos"]) & (F.size(cards) >= LEAST_CARDS), F.struct(
                (-chars).alias("less"), (-F.size(cards)).alias("fewer"), e["pos"].alias("pos"), F.concat(signature(parent), F.lit(" > "), signature(e)).alias("selector"),
                F.size(cards).alias("n_cards"), linked.alias("n_linked"), chars.alias("n_chars"))))

        parent = F.get(F.filter(elements, lambda a: inside(e, a) & (a["depth"] == e["depth"] - 1)), 0)
        return F.when(parent.isNotNull(), let(parent, of))

    # only an element that another of its name and depth follows can start a group
    starts = F.filter(elements, lambda e: F.exists(elements, lambda s: (s["pos"] > e["pos"]) & (s["depth"] == e["depth"]) & (s["name"] == e["name"])))
    groups = F.filter(F.transform(starts, group), lambda g: g.isNotNull() & (g["n_linked"] >= g["n_cards"] * LINKED))
    return let(F.array_min(groups), lambda g: F.when(g.isNotNull(), F.struct(g["selector"].alias("selector"), g["n_cards"].alias("n_cards"), g["n_linked"].alias("n_linked"), g["n_chars"].alias("n_chars"))))
