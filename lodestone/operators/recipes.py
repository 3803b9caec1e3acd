"""Extraction recipes as data, compiled to column expressions: nothing in a recipe is ever executed.

A recipe of version 1 is {"version": 1, "fields": {name: [locator, …]}}; a locator is {"kind": …} with the names that its kind takes. The first
locator that finds a text wins, and a field that none finds is null. Recipes of version 2 read pages as trees: see `extract`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as ux
from ..functions.expressions import let
from . import html as markup

#: Kinds of locators and the names that each takes.
KINDS = {"tag": ("name",), "attribute": ("tag", "name"), "meta": ("name",), "json_ld": ("path",)}
NAME = re.compile(r"[A-Za-z][A-Za-z0-9_.:-]{0,63}")
MOST_FIELDS, MOST_LOCATORS = 50, 10


def _locator(html: Column, locator: dict) -> Column:
    kind = locator.get("kind")
    if kind not in KINDS or set(locator) != {"kind", *KINDS[kind]}:
        raise ValueError(f"no such locator: {locator}")
    values = [locator[k] for k in KINDS[kind]]
    if not all(isinstance(v, str) and NAME.fullmatch(v) for v in values):
        raise ValueError(f"names may hold letters, digits and ._:- only: {locator}")
    names = [re.escape(v) for v in values]
    if kind == "tag":
        found = F.regexp_extract(html, rf"(?is)<{names[0]}(?:\s[^>]*)?>([^<]*)</{names[0]}>", 1)
    elif kind == "attribute":
        found = F.regexp_extract(html, rf"""(?is)<{names[0]}\s[^>]*?\b{names[1]}\s*=\s*["']([^"']*)["']""", 1)
    elif kind == "meta":
        found = F.regexp_extract(html, rf"""(?is)<meta\s[^>]*?(?:name|property)\s*=\s*["']{names[0]}["'][^>]*?\bcontent\s*=\s*["']([^"']*)["']""", 1)
    else:
        block = F.regexp_extract(html, r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>""", 1)
        found = F.get_json_object(block, f"$.{values[0]}")
    return F.nullif(F.trim(found), F.lit(""))


def compiled(recipe: dict, html: str = "html") -> list[Column]:
    """A column for each field of the recipe, named like it."""
    fields = recipe.get("fields")
    if recipe.get("version") != 1 or not isinstance(fields, dict) or not 0 < len(fields) <= MOST_FIELDS:
        raise ValueError("not a recipe of version 1")
    out = []
    for name, locators in fields.items():
        if not NAME.fullmatch(name) or not isinstance(locators, list) or not 0 < len(locators) <= MOST_LOCATORS:
            raise ValueError(f"not a field: {name}")
        out.append(F.coalesce(*[_locator(F.col(html), x) for x in locators]).alias(name))
    return out


#: Kinds of locators of recipes of version 2, whose value is text.
PAGE_KINDS = ("css", "relative_css", "xpath", "relative_xpath", "data_attr", "href_pattern", "role", "text_anchor")
LONGEST = 300


def _page_locator(written: dict) -> markup.Locator:
    if not {"kind", "value"} <= set(written) <= {"kind", "value", "attr"} or written["kind"] not in PAGE_KINDS:
        raise ValueError(f"no such locator: {written}")
    value, take = written["value"], written.get("attr")
    if not isinstance(value, str) or not 0 < len(value) <= LONGEST or not (take is None or isinstance(take, str) and NAME.fullmatch(take)):
        raise ValueError(f"not a locator's value: {written}")
    return markup.locator(written["kind"], value, take)


def _candidates(written: object) -> list[markup.Locator]:
    if not isinstance(written, list) or not 0 < len(written) <= MOST_LOCATORS:
        raise ValueError(f"not a list of locators: {written}")
    return [_page_locator(x) for x in written]


def extract(pages: DataFrame, recipe: dict, html: str = "html", url: str = "url") -> DataFrame:
    """The records of pages by a recipe of version 2: a row for each card, and one without a card for a page that has none.

    A recipe is {"version": 2, "card_locators": [locator, …], "fields": {name: {"required": bool, "locators": [locator, …]}}, "next": [locator, …]}.
    The first card locator that finds anything gives the cards, and fields are sought inside of them; without card locators a page is
    one card. Of a field's locators the first that finds a text wins, and `used` tells which; a required field that none finds is null
    and listed in `missing`, so that the record goes to review. `next_url` is the following page, resolved against this one's URL.
    """
    return _extracted(pages, {"": _read(recipe)}, html, url).drop("_recipe")


def extract_all(pages: DataFrame, recipes: dict[str, dict], html: str = "html", url: str = "url") -> DataFrame:
    """What `extract` gives by each of several recipes with the same fields, with the recipe's name as `recipe`: a page's tree is built once for all of them."""
    if len({tuple(r.get("fields") or ()) for r in recipes.values()}) != 1:
        raise ValueError("recipes that are read together have the same fields")
    return _extracted(pages, {name: _read(recipe) for name, recipe in recipes.items()}, html, url).withColumnRenamed("_recipe", "recipe")


def _read(recipe: dict) -> tuple[dict, list, list]:
    """The fields, cards and links to following pages of a recipe of version 2."""
    fields = recipe.get("fields")
    if recipe.get("version") != 2 or not set(recipe) <= {"version", "card_locators", "fields", "next"} or not isinstance(fields, dict) or not 0 < len(fields) <= MOST_FIELDS:
        raise ValueError("not a recipe of version 2")
    read = {}
    for name, spec in fields.items():
        if not NAME.fullmatch(name) or not isinstance(spec, dict) or not {"locators"} <= set(spec) <= {"locators", "required"}:
            raise ValueError(f"not a field: {name}")
        read[name] = (_candidates(spec["locators"]), bool(spec.get("required")))
    card_locators = _candidates(recipe["card_locators"]) if "card_locators" in recipe else []
    following = _candidates(recipe["next"]) if "next" in recipe else []
    return read, card_locators, following


def _extracted(pages: DataFrame, recipes: dict[str, tuple[dict, list, list]], html: str, url: str) -> DataFrame:
    none = F.lit(None).cast("string")

    def one_field(page: Column, card: Column | None, locators: list) -> Column:
        """struct<value, used>: the first locator's text, and its number from 1."""
        found = F.array(*[x.first(page, card) for x in locators])
        numbered = F.filter(F.transform(found, lambda v, i: F.struct(v.alias("value"), (i + 1).alias("used"))), lambda v: v["value"].isNotNull())
        return F.get(numbered, 0)

    def record(fields: dict, page: Column, card: Column | None) -> Column:
        parts = F.struct(*[one_field(page, card, locators).alias(name) for name, (locators, _) in fields.items()])

        def named(found: Column) -> Column:
            missing = F.array_compact(F.array(*[F.when(found[name]["value"].isNull(), name) for name, (_, required) in fields.items() if required], none))
            used = F.struct(*[found[name]["used"].alias(name) for name in fields])
            return F.struct(*[found[name]["value"].alias(name) for name in fields], used.alias("used"), missing.alias("missing"))

        return let(parts, named)

    def result(name: str, page: Column) -> Column:
        fields, card_locators, following = recipes[name]
        if card_locators:
            tried = [x.matches(page) for x in card_locators]
            cards = let(F.array(*tried), lambda t: F.get(F.filter(t, lambda cards: F.size(cards) > 0), 0))
            records = F.transform(cards, lambda card: record(fields, page, card))
        else:
            records = F.array(record(fields, page, None))
        link = F.coalesce(*[x.first(page) for x in following], none)
        return F.struct(records.alias("records"), F.when(link.isNotNull(), ux.resolved(F.col(url), link)).alias("next_url"))

    trees = pages.withColumn("_page", markup.tree(F.col(html)))
    whole = trees.withColumn("_read", let(F.col("_page"), lambda page: F.array(*[F.when(page.isNotNull(), result(name, page)) for name in recipes])))
    each = whole.select(*[F.col(c) for c in pages.columns], F.posexplode("_read").alias("_n", "_one"))
    named = F.element_at(F.array(*[F.lit(name) for name in recipes]), F.col("_n") + 1)
    rows = each.select(*[F.col(c) for c in pages.columns], named.alias("_recipe"), F.col("_one.next_url").alias("next_url"), F.posexplode_outer("_one.records").alias("card", "_record"))
    return rows.select("_recipe", *pages.columns, "card", "_record.*", "next_url")
