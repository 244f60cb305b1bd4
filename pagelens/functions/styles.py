"""Style rules of a page: declarations, selectors, and the cascade that picks a value for an element.

Selectors are compounds (a tag, ids, classes, attributes) in a chain of descendants and children. Siblings, pseudo-classes
and pseudo-elements match nothing, and the conditions of at-rules aren't judged, so that rules in them count. A winner is
chosen by importance, then inline styles, specificity and order. Only rules on the properties asked for are kept, so most
pages have none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, ExtractConfig

_DECLARATION = r"""([a-zA-Z-]+)\s*:\s*((?:[^;()"']|\((?:[^()"']|"[^"]*"|'[^']*')*\)|"[^"]*"|'[^']*')*)"""
_TEST = r"""\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*("[^"]*"|'[^']*'|[\w-]+)\s*([iIsS])?\s*)?\]"""
_COMPOUND = r"(?=[\w*.#\[])(?:[a-zA-Z][\w-]*|\*)?(?:[.#][\w-]+|" + _TEST.replace("(", "(?:").replace("(?:?:", "(?:") + ")*"
_SELECTOR = rf"^{_COMPOUND}(?:(?:\s*>\s*|\s+){_COMPOUND})*$"
_STEP = rf"(^|\s*>\s*|\s+)({_COMPOUND})"
# Attributes whose values selectors compare in any case.
_ANY_CASE = tuple("accept accept-charset align alink axis bgcolor charset checked clear codetype color compact declare defer dir direction disabled enctype face frame hreflang http-equiv lang language link media method multiple nohref noresize noshade nowrap readonly rel rev rules scope scrolling selected shape target text type valign valuetype vlink".split())
_IMPORTANT = r"(?i)!\s*important\s*$"
PROPERTIES = ("background", "background-image", "width", "height", "display")
INLINE = 1 << 20
DECLARED = "struct<at:int,property:string,value:string,important:boolean>"


def declarations(text: Column, properties: tuple[str, ...] = PROPERTIES) -> Column:
    """Array of (at, property, value, important) of those properties, in order."""
    names, values = F.regexp_extract_all(text, F.lit(_DECLARATION), F.lit(1)), F.regexp_extract_all(text, F.lit(_DECLARATION), F.lit(2))
    rows = F.zip_with(names, values, lambda k, v: F.struct(F.lower(k).alias("property"), F.trim(F.regexp_replace(v, _IMPORTANT, "")).alias("value"), F.rlike(v, F.lit(_IMPORTANT)).alias("important")))
    numbered = F.transform(rows, lambda d, i: F.struct(i.alias("at"), d["property"].alias("property"), d["value"].alias("value"), d["important"].alias("important")))
    return F.filter(numbered, lambda d: d["property"].isin(*properties))


def _let(value: Column, body) -> Column:
    """body(value), worked out once."""
    return F.transform(F.array(value), body)[0]


def _compound(text: Column) -> list[Column]:
    """tag, ids, classes, tests: (name, op, value, any_case) of attributes, op empty where any value will do."""
    bare = F.regexp_replace(text, _TEST, "")
    part = lambda i: F.regexp_extract_all(text, F.lit(_TEST), F.lit(i))
    rows = F.arrays_zip(part(1).alias("name"), part(2).alias("op"), part(3).alias("value"), part(4).alias("flag"))

    def test(t: Column) -> Column:
        name, flag = F.lower(t["name"]), F.lower(t["flag"])
        any_case = (flag == "i") | ((flag != "s") & name.isin(*_ANY_CASE))
        value = F.regexp_replace(t["value"], r"""^["']|["']$""", "")
        return F.struct(name.alias("name"), t["op"].alias("op"), F.when(any_case, F.lower(value)).otherwise(value).alias("value"), any_case.alias("any_case"))

    tag = F.lower(F.regexp_extract(bare, r"^([a-zA-Z][\w-]*)", 1))
    ids, classes = F.regexp_extract_all(bare, F.lit(r"#([\w-]+)"), F.lit(1)), F.regexp_extract_all(bare, F.lit(r"\.([\w-]+)"), F.lit(1))
    return [tag.alias("tag"), ids.alias("ids"), classes.alias("classes"), F.transform(rows, test).alias("tests")]


def rules(sheets: Column, properties: tuple[str, ...] = PROPERTIES) -> Column:
    """sheets: array of (pos, root, text), in order. Array of (root, nth, steps, specificity, declared).

    steps: the compounds of a selector from the outside in, (child, tag, ids, classes, tests); child: it has to be a
    child of the one before, not just a descendant.
    """
    block = r"([^{}]+)\{([^{}]*)\}"

    def of(sheet: Column) -> Column:
        css = F.regexp_replace(sheet["text"], r"(?s)/\*.*?\*/", " ")
        heads, bodies = F.regexp_extract_all(css, F.lit(block), F.lit(1)), F.regexp_extract_all(css, F.lit(block), F.lit(2))
        pairs = F.filter(F.zip_with(heads, bodies, lambda h, b: F.struct(h.alias("head"), declarations(b, properties).alias("declared"))), lambda r: F.size(r["declared"]) > 0)
        return F.transform(pairs, lambda r, i: F.struct(sheet["root"].alias("root"), (sheet["pos"].cast("bigint") * (1 << 32) + i).alias("nth"), F.regexp_replace(r["head"], r"^.*;", "").alias("head"), r["declared"].alias("declared")))

    def selectors(rule: Column) -> Column:
        some = F.filter(F.transform(F.split(rule["head"], r",(?![^\[]*\])"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.rlike(s, F.lit(_SELECTOR)))

        def row(s: Column) -> Column:
            joins, texts = F.regexp_extract_all(s, F.lit(_STEP), F.lit(1)), F.regexp_extract_all(s, F.lit(_STEP), F.lit(2))
            steps = F.zip_with(joins, texts, lambda j, t: F.struct(F.contains(j, F.lit(">")).alias("child"), *_compound(t)))
            return _let(steps, lambda t: F.struct(rule["root"].alias("root"), rule["nth"].alias("nth"), t.alias("steps"), _weight(t).alias("specificity"), rule["declared"].alias("declared")))

        return F.transform(some, row)

    trimmed = F.filter(sheets, lambda s: F.rlike(s["text"], F.lit(r"(?i)(?:" + "|".join(properties) + r")\s*:")))
    return F.flatten(F.transform(F.flatten(F.transform(trimmed, of)), selectors))


def _weight(steps: Column) -> Column:
    one = lambda s: F.size(s["ids"]) * 10_000 + (F.size(s["classes"]) + F.size(s["tests"])) * 100 + F.when(s["tag"] != "", 1).otherwise(0)
    return F.aggregate(steps, F.lit(0), lambda n, s: n + one(s))


def seen(element: Column) -> list[Column]:
    """What selectors look at: root, tag, attrs, and id and classes by themselves."""
    classes = F.split(F.coalesce(F.try_element_at(element["attrs"], F.lit("class")), F.lit("")), r"\s+")
    own_id = F.coalesce(F.try_element_at(element["attrs"], F.lit("id")), F.lit(""))
    return [element["root"].alias("root"), element["tag"].alias("tag"), element["attrs"].alias("attrs"), own_id.alias("id"), classes.alias("classes")]


def _fits(step: Column, e: Column) -> Column:
    def passes(t: Column) -> Column:
        raw = F.try_element_at(e["attrs"], t["name"])
        v, want = F.when(t["any_case"], F.lower(raw)).otherwise(raw), t["value"]
        some = want != ""
        held = (
            F.when(t["op"] == "", F.map_contains_key(e["attrs"], t["name"]))
            .when(t["op"] == "=", v == want)
            .when(t["op"] == "~=", some & F.array_contains(F.split(v, r"\s+"), want))
            .when(t["op"] == "|=", (v == want) | F.startswith(v, F.concat(want, F.lit("-"))))
            .when(t["op"] == "^=", some & F.startswith(v, want))
            .when(t["op"] == "$=", some & F.endswith(v, want))
            .otherwise(some & F.contains(v, want))
        )
        return F.coalesce(held, F.lit(False))

    return ((step["tag"] == "") | (step["tag"] == e["tag"])) & F.forall(step["ids"], lambda i: i == e["id"]) & (F.size(F.array_except(step["classes"], e["classes"])) == 0) & F.forall(step["tests"], passes)


_WIDE, _BLOCK = 1 << 12, 128


def links(sheet_rules: Column) -> Column:
    """Array of the steps of selectors with several: (key, root, first, child, tag, ids, classes, tests)."""

    def of(r: Column, i: Column) -> Column:
        return F.transform(r["steps"], lambda s, j: F.struct((i * _WIDE + j).alias("key"), r["root"].alias("root"), (j == 0).alias("first"), *[s[c].alias(c) for c in ("child", "tag", "ids", "classes", "tests")]))

    return F.flatten(F.transform(sheet_rules, lambda r, i: F.when(F.size(r["steps"]) > 1, of(r, i)).otherwise(F.filter(of(r, i), lambda s: F.lit(False)))))


def reached(elements: Column, chain: Column) -> Column:
    """For each element, in document order, the keys of chain whose beginnings it ends.

    elements: (pos, close, and what `seen` gives). One fold with a stack of open elements, each with the keys that it
    ends and those that it or an element around it in its root ends; what a selector needs outside is looked up in the
    innermost, so no pairs of elements are made. A fold copies all it holds at each step, so elements go block by block.
    """
    entry = "struct<close:int,root:int,own:array<int>,all:array<int>>"
    none, nothing = F.array().cast("array<int>"), F.array().cast("array<array<int>>")

    def step(acc: Column, e: Column) -> Column:
        def ended(up: Column) -> Column:
            outside = lambda s: s["first"] | F.coalesce(F.array_contains(F.when(s["child"], up["own"]).otherwise(up["all"]), s["key"] - 1), F.lit(False))
            return F.transform(F.filter(chain, lambda s: (s["root"] == e["root"]) & outside(s) & _fits(s, e)), lambda s: s["key"])

        def grown(still: Column, up: Column, own: Column) -> Column:
            new = F.struct(e["close"].alias("close"), e["root"].alias("root"), own.alias("own"), F.array_union(F.coalesce(up["all"], none), own).alias("all"))
            return F.struct(F.when(e["close"] > e["pos"], F.array_append(still, new)).otherwise(still).alias("open"), F.array_append(acc["out"], own).alias("out"))

        innermost = lambda still: F.try_element_at(F.filter(still, lambda o: o["root"] == e["root"]), F.lit(-1))
        return _let(F.filter(acc["open"], lambda o: o["close"] >= e["pos"]), lambda still: _let(innermost(still), lambda up: _let(ended(up), lambda own: grown(still, up, own))))

    def block(acc: Column, b: Column) -> Column:
        own = F.aggregate(F.slice(elements, b * _BLOCK + 1, _BLOCK), F.struct(acc["open"].alias("open"), nothing.alias("out")), step)
        return _let(own, lambda x: F.struct(x["open"].alias("open"), F.concat(acc["out"], x["out"]).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(elements) - 1, F.lit(0)) / _BLOCK).cast("int"))
    return F.aggregate(blocks, F.struct(F.array().cast(f"array<{entry}>").alias("open"), nothing.alias("out")), block)["out"]


def matching(element: Column, keys: Column, sheet_rules: Column) -> Column:
    """The rules that apply to an element (`seen`); keys: what it ends (`reached`), null where no selector has steps."""
    one = lambda r: (r["root"] == element["root"]) & _fits(F.get(r["steps"], F.lit(0)), element)
    return F.filter(sheet_rules, lambda r, i: F.when(F.size(r["steps"]) == 1, one(r)).otherwise(F.coalesce(F.array_contains(keys, i * _WIDE + F.size(r["steps"]) - 1), F.lit(False))))


def winner(applied: Column, inline: Column, *properties: str) -> Column:
    """The value that holds for the properties, which override each other; null if none is declared."""
    order = lambda d, weight, nth: F.struct(d["important"].alias("important"), weight.alias("weight"), nth.cast("bigint").alias("nth"), d["at"].alias("at"), d["value"].alias("value"))
    mine = lambda ds: F.filter(ds, lambda d: d["property"].isin(*properties))
    ruled = F.flatten(F.transform(applied, lambda r: F.transform(mine(r["declared"]), lambda d: order(d, r["specificity"], r["nth"]))))
    styled = F.transform(mine(inline), lambda d: order(d, F.lit(INLINE), F.lit(0)))
    return F.array_max(F.concat(ruled, styled))["value"]


def pixels(value: Column) -> Column:
    """A length in pixels, null for any other value."""
    number = F.regexp_extract(value, r"(?i)^\s*(\d+\.?\d*|\.\d+)\s*px\s*$", 1).try_cast("double")
    return F.when(F.rlike(value, F.lit(r"^\s*0+(?:\.0*)?\s*$")), F.lit(0.0)).otherwise(number)


def box(element: Column, applied: Column, inline: Column) -> Column:
    """(width, height) as styles or attributes say, each null if neither does; nothing that isn't displayed has one of 0."""
    gone = F.coalesce(F.lower(winner(applied, inline, "display")) == "none", F.lit(False))

    def side(name: str) -> Column:
        declared = winner(applied, inline, name)
        attribute = F.regexp_extract(F.coalesce(F.try_element_at(element["attrs"], F.lit(name)), F.lit("")), r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
        return F.when(gone, 0.0).when(declared.isNotNull(), pixels(declared)).otherwise(attribute).alias(name)

    return F.struct(side("width"), side("height"))


def background(element: Column, applied: Column, inline: Column, config: ExtractConfig = DEFAULT) -> Column:
    """(urls, sprite): pictures behind an element, and whether its box is that of an icon."""
    sprite = lambda size: F.coalesce((size["width"] < config.sprite_box) & (size["height"] < config.sprite_box), F.lit(False))
    image = F.when((F.size(applied) > 0) | (F.size(inline) > 0), winner(applied, inline, "background", "background-image"))
    # most elements have nothing behind them, and no box is worked out for those
    urls = F.coalesce(F.regexp_extract_all(image, F.lit(config.css_url), F.lit(1)), F.array().cast("array<string>"))
    return _let(urls, lambda u: F.struct(u.alias("urls"), F.when(F.size(u) > 0, _let(box(element, applied, inline), sprite)).otherwise(False).alias("sprite")))
