"""The sweeps of an extraction as array functions over a page's elements: every occurrence of an image URL, why it was
kept or not, and what is left after the first of each URL.

All of it runs in the page's row, so nothing is shuffled. An occurrence has a key, an array of numbers that sorts as the
sweeps meet it: document, then for each shadow root around it (7, its element, 0), then sweep, element and place.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ExtractConfig
from ..functions import columns as C
from ..functions import containment, styles
from ..sources.html import dom
from ..sources.urls import resolved

VIDEO, IMG, SOURCE, POSTER, LINK, META, SVG, CSS, RAW = range(9)
# What the log calls the sweeps; links and metas count as one, and the source isn't credited.
LABELS = {VIDEO: "動画", IMG: "img", SOURCE: "source", POSTER: "poster", LINK: "link/meta", META: "link/meta", SVG: "svg", CSS: "CSS背景"}
#: Names of the sweeps in rows.
NAMES = ("video", "img", "source", "poster", "link/meta", "link/meta", "svg", "css", "raw source")
_META = {"property": ("og:image", "og:image:url", "og:image:secure_url"), "name": ("twitter:image", "twitter:image:src"), "itemprop": ("image",)}
#: Full sweeps of a page that doesn't walk: one to begin with, one at the hand-over.
SWEEPS_RUN = 2

_LAST = (1 << 31) - 1
FOUND = "struct<key:array<int>,sweep:int,url:string,base:int,origin:string,link:string,sprite:boolean>"


def attr(e: Column, name: str) -> Column:
    """Null if it isn't there or empty."""
    return F.nullif(F.try_element_at(e["attrs"], F.lit(name)), F.lit(""))


def _around(doc: Column, path: Column) -> Column:
    return F.concat(F.array(doc), F.flatten(F.transform(path, lambda h: F.array(F.lit(CSS), h, F.lit(0)))))


def _row(e: Column, sweep: int, place, url: Column, own: bool, origin: Column, link: Column | None = None, sprite: Column | None = None, at: Column | None = None) -> Column:
    """own: the URL is relative to the element's document, not to the page."""
    here = F.array(F.lit(sweep), e["pos"], *([at] if at is not None else []), *[p if isinstance(p, Column) else F.lit(p) for p in place])
    base = e["doc"] if own else F.lit(0)
    none = F.lit(None).cast("string")
    return F.struct(F.concat(_around(e["doc"], e["path"]), here).alias("key"), F.lit(sweep).alias("sweep"), url.alias("url"), base.alias("base"), origin.alias("origin"), (none if link is None else link).alias("link"), (F.lit(False) if sprite is None else sprite).alias("sprite"))


def _of(elements: Column, *tags: str) -> Column:
    return F.filter(elements, lambda e: e["tag"].isin(*tags))


def _finding(config: ExtractConfig) -> list[dict[str, Column]]:
    """Columns to add, step by step, up to ``found``."""
    steps: list[dict[str, Column]] = []
    url = F.col("url")
    shop = F.coalesce(C.walks_carousels(C.host(url), config), F.lit(False))
    judged = shop & F.coalesce(C.is_permalink(C.path(url), config), F.lit(False))
    dom_origin = F.lit("dom")

    els = F.col("elements")
    steps.append({"__imgs": _of(els, "img"), "__videos": _of(els, "video"), "__links": F.filter(els, lambda e: (e["tag"] == "a") & F.map_contains_key(e["attrs"], F.lit("href")))})
    steps.append({"__near": F.when(judged & (F.size("__links") > 0), containment.nearest(F.col("__links"), F.col("__imgs"), lambda a: a["attrs"]["href"]))})
    parents = F.array_distinct(F.transform("__videos", lambda v: v["parent"]))
    steps.append({"__boxes": F.when(F.size("__videos") > 0, F.filter(els, lambda e: F.array_contains(parents, e["pos"])))})
    steps.append({"__spans": F.when(F.size("__boxes") > 0, containment.within(F.col("__boxes"), F.col("__imgs")))})

    def covers(v: Column) -> Column:
        span = F.get(F.filter("__spans", lambda s: s["pos"] == v["parent"]), F.lit(0))
        inside = F.filter(F.slice("__imgs", F.coalesce(span["from"], F.lit(1)), F.coalesce(span["n"], F.lit(0))), lambda i: i["root"] == v["root"])
        own = F.transform(inside, lambda i, k: _row(v, VIDEO, [k + 1], attr(i, "src"), True, F.lit("video")))
        return F.concat(F.array(_row(v, VIDEO, [0], attr(v, "poster"), False, F.lit("video"))), own)

    def pictures(i: Column, link: Column) -> Column:
        large = C.best_from_srcset(attr(i, "srcset"))
        lazy = F.coalesce(large, C.best_from_srcset(attr(i, "data-srcset")), *[attr(i, a) for a in config.lazy_attributes])
        src = attr(i, "src")
        return F.array(_row(i, IMG, [0], src, True, dom_origin, link), _row(i, IMG, [1], F.when(src.isNull(), lazy), False, dom_origin, link), _row(i, IMG, [2], large, False, dom_origin, link))

    media, sources = _of(els, "picture", "video", "audio"), _of(els, "source")
    steps.append({"__media": F.when(F.size(sources) > 0, containment.nearest(media, sources, lambda m: m["tag"]))})
    links_origin = F.when(shop, F.lit("meta")).otherwise(dom_origin)

    def preload(e: Column) -> Column:  # selectors take rel in any case, and as in its own
        rel = F.split(F.lower(F.coalesce(attr(e, "rel"), F.lit(""))), r"\s+")
        wanted = F.array_contains(rel, "preload") & F.coalesce(attr(e, "as") == "image", F.lit(False))
        return wanted | F.array_contains(rel, "image_src") | F.array_contains(rel, "apple-touch-icon")

    def named(e: Column) -> Column:
        out = F.lit(False)
        for k, values in _META.items():
            out |= F.coalesce(attr(e, k).isin(*values), F.lit(False))
        return out

    rules = F.col("__rules")

    def behind(x: Column) -> Column:
        e, style = x["e"], attr(x["e"], "style")
        inline = F.when(style.isNotNull(), styles.declarations(style)).otherwise(F.array().cast(f"array<{styles.DECLARED}>"))
        one = F.transform(F.array(F.struct(styles.matching(x["seen"], x["keys"], rules).alias("applied"), inline.alias("inline"))), lambda s: styles.background(e, s["applied"], s["inline"], config))[0]
        return F.transform(F.array(one), lambda b: F.transform(b["urls"], lambda u, k: _row(e, CSS, [F.lit(1), k], u, True, dom_origin, sprite=b["sprite"])))[0]

    steps.append({"__rules": styles.rules(F.filter(els, lambda e: (e["tag"] == "style") & e["text"].isNotNull()))})
    most = config.styled_elements
    near = lambda e: F.lit(True) if most is None else e["nth"] < most
    wanted = F.filter(els, lambda e: near(e) & ((F.size(rules) > 0) | F.coalesce(F.contains(F.lower(attr(e, "style")), F.lit("background")), F.lit(False))))
    steps.append({"__wanted": wanted, "__chain": styles.links(rules)})
    steps.append({"__seen": F.transform("__wanted", lambda e: F.struct(e["pos"].alias("pos"), e["close"].alias("close"), *styles.seen(e)))})
    # with rules, every element up to the limit is wanted, so all that is around one of them is there
    steps.append({"__keys": F.when(F.size("__chain") > 0, styles.reached(F.col("__seen"), F.col("__chain")))})
    styled = F.arrays_zip(F.col("__wanted").alias("e"), F.col("__seen").alias("seen"), F.coalesce("__keys", F.array().cast("array<array<int>>")).alias("keys"))
    rows = [
        F.flatten(F.transform("__videos", covers)),
        F.flatten(F.zip_with("__imgs", F.coalesce("__near", F.array().cast("array<string>")), pictures)),
        F.transform(F.filter(F.zip_with(sources, F.coalesce("__media", F.array().cast("array<string>")), lambda e, m: F.struct(e.alias("e"), m.alias("m"))), lambda x: x["m"].isNotNull()), lambda x: _row(x["e"], SOURCE, [0], F.coalesce(C.best_from_srcset(attr(x["e"], "srcset")), attr(x["e"], "src")), False, dom_origin)),
        F.transform(F.filter(els, lambda e: F.map_contains_key(e["attrs"], F.lit("poster"))), lambda e: _row(e, POSTER, [0], attr(e, "poster"), False, F.lit("video"))),
        F.flatten(F.transform(F.filter(els, lambda e: (e["tag"] == "link") & preload(e)), lambda e: F.array(_row(e, LINK, [0], attr(e, "href"), False, links_origin), _row(e, LINK, [1], C.best_from_srcset(attr(e, "imagesrcset")), False, links_origin)))),
        F.transform(F.filter(els, lambda e: (e["tag"] == "meta") & named(e)), lambda e: _row(e, META, [0], attr(e, "content"), False, F.lit("meta"))),
        F.transform(_of(els, "image"), lambda e: _row(e, SVG, [0], F.coalesce(attr(e, "href"), attr(e, "xlink:href")), False, dom_origin)),
        F.flatten(F.transform(styled, behind)),
    ]
    known = F.filter(F.concat(*[r.cast(f"array<{FOUND}>") for r in rows]), lambda r: r["url"].isNotNull())
    steps.append({"found": F.array_sort(known)})
    if most is None:
        return steps
    # a shadow root of an element beyond the limit isn't reached
    steps.append({"__late": F.transform(F.filter(els, lambda e: ~near(e)), lambda e: e["pos"])})
    reached = F.when(F.size("__late") > 0, F.filter("found", lambda r: ~F.exists("__late", lambda h: F.exists(r["key"], lambda k: k == h) & (F.array_position(r["key"], h) < F.size(r["key"]) - 2) & (F.element_at(r["key"], F.greatest(F.array_position(r["key"], h).cast("int") + 1, F.lit(1))) == 0)))).otherwise(F.col("found"))
    steps.append({"found": reached})
    return steps


def found_in(pages: DataFrame, config: ExtractConfig = DEFAULT) -> DataFrame:
    """pages with elements and bases (sources.html.dom). Adds ``found``: all URLs that the sweeps meet, as written, in order."""
    steps = _built(_finding, pages, config)
    return _added(pages, steps).drop(*[c for step in steps for c in step if c.startswith("__")])


def _built(make, pages: DataFrame, config: ExtractConfig):
    return _kept_columns(make, pages.sparkSession.sparkContext.applicationId, config)


@lru_cache(maxsize=8)
def _kept_columns(make, application: str, config: ExtractConfig):
    """Columns are made once for a Spark application: they are thousands of calls to the JVM, and name no table."""
    return make(config)


def _added(pages: DataFrame, steps: list[dict[str, Column]]) -> DataFrame:
    for step in steps:
        pages = pages.withColumns(step)
    return pages


def occurrences(pages: DataFrame, config: ExtractConfig = DEFAULT) -> DataFrame:
    """pages: (page_id, url, html), and frames or none. A row per row of pages: (page_id, url, n_imgs, n_sprites, n_source, met).

    met: array of (key, sweep, url: resolved, origin, what) in order, sweep RAW for the source. what: ``kept`` for the
    first of a URL, ``seen``, ``ui asset`` or ``sprite`` (that last one is no candidate for first, and comes before it is
    asked whether it is an asset). URLs that can't be read are left out. n_source: matches in the source, up to the limit if there is one; n_sprites: elements whose
    backgrounds are icons, whatever their URLs.
    """
    given = ["frames"] if "frames" in pages.columns else []
    p = found_in(dom(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", *given)), config)
    before, after = _built(_judging, pages, config)
    p = _added(p, before).select("page_id", "url", "found", "n_imgs", "n_sprites", "n_source", "__full")
    return _added(p, after).select("page_id", "url", "n_imgs", "n_sprites", "n_source", "met")


def _judging(config: ExtractConfig) -> tuple[list[dict[str, Column]], list[dict[str, Column]]]:
    """Columns to add to ``found``, up to the resolved URLs, and from there up to ``met``."""
    text = C.source_matches(F.coalesce("html", F.lit("")), config)
    sprites = F.size(F.filter("found", lambda r: r["sprite"] & (F.element_at(r["key"], -1) == 0)))
    n_imgs = F.size(F.filter("elements", lambda e: (e["tag"] == "img") & (e["root"] == -2)))
    urls = F.concat(F.transform("found", lambda r: r["url"]), F.col("__source"), F.transform("found", lambda r: r["link"]))
    at = F.concat(F.transform("found", lambda r: r["base"]), F.transform("__source", lambda r: F.lit(0)), F.transform("found", lambda r: F.element_at(r["key"], 1)))
    before = [{"__source": text}, {"n_imgs": n_imgs, "n_sprites": sprites, "n_source": F.size("__source"), "__urls": urls, "__at": at}, {"__full": resolved("__urls", "__at", "bases")}]
    n, m = F.size("found"), F.col("n_source")
    # from here on no lambda looks at a column of the row: a filter that Spark moves down would work it out for each element
    page_origin, page_key = _site(F.col("url")), C.page_key(C.path(F.col("url")), config)

    def place(x: Column) -> Column:
        r, target = x["found"], x["link"]
        away = (_site(target) != x["site"]) | (C.page_key(C.path(target), config) != x["page"])
        origin = F.when(r["link"].isNotNull() & F.coalesce(away, F.lit(False)), F.lit("other")).otherwise(r["origin"])
        return F.struct(r["key"].alias("key"), r["sweep"].alias("sweep"), x["full"].alias("url"), origin.alias("origin"), r["sprite"].alias("sprite"))

    several = lambda c: F.array_repeat(c, n)
    zipped = F.arrays_zip(F.col("found"), F.slice("__full", 1, n).alias("full"), F.slice("__full", n + m + 1, n).alias("link"), several(page_origin).alias("site"), several(page_key).alias("page"))
    source = F.transform(F.slice("__full", n + 1, m), lambda u, i: F.struct(F.array(F.lit(_LAST), i).alias("key"), F.lit(RAW).alias("sweep"), u.alias("url"), F.lit("source").alias("origin"), F.lit(False).alias("sprite")))
    every = F.filter(F.concat(F.transform(zipped, place), source), lambda r: r["url"].isNotNull())
    judged = F.transform(every, lambda r, i: F.struct(r["url"].alias("url"), i.alias("i"), r.alias("r"), F.when(r["sprite"], "sprite").when(C.is_ui_asset(r["url"], config), "ui asset").alias("what")))
    # sorted by URL, the first of each is the one whose neighbour before is another
    passing = F.filter("__by_url", lambda x: x["what"].isNull())
    previous = F.concat(F.array(F.lit(None).cast("string")), F.transform("__passing", lambda x: x["url"]))
    firsts = F.filter(F.zip_with("__passing", previous, lambda x, u: F.struct(x["i"].alias("i"), x["r"].alias("r"), F.when(x["url"] == u, "seen").otherwise("kept").alias("what"))), lambda x: x["i"].isNotNull())
    rest = F.transform(F.filter("__by_url", lambda x: x["what"].isNotNull()), lambda x: F.struct(x["i"].alias("i"), x["r"].alias("r"), x["what"].alias("what")))
    met = F.transform(F.array_sort(F.concat(firsts, rest)), lambda x: F.struct(x["r"]["key"].alias("key"), x["r"]["sweep"].alias("sweep"), x["r"]["url"].alias("url"), x["r"]["origin"].alias("origin"), x["what"].alias("what")))
    return before, [{"__by_url": F.array_sort(judged)}, {"__passing": passing}, {"met": met}]


def _site(url: Column) -> Column:
    """Scheme, host and port, the default port left out."""
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:@]*:(\d+)", 1)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    known = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.concat_ws(" ", scheme, C.host(url), F.when(known, "").otherwise(port))


def kept(met: Column) -> Column:
    return F.filter(met, lambda r: r["what"] == "kept")


def skipped_assets(met: Column, runs: int = SWEEPS_RUN) -> Column:
    """How often interface artwork was passed over: each full sweep counts it again, the source is read once."""
    mine = F.filter(met, lambda r: r["what"] == "ui asset")
    once = F.size(F.filter(mine, lambda r: r["sweep"] == RAW))
    return ((F.size(mine) - once) * runs + once).cast("bigint")


def names(met: Column, most: int = 12, least_chars: int = 12, shown_chars: int = 30) -> Column:
    """Folders and file names of the page's own images, long ones shortened; a name seen before is passed over."""
    path = lambda r: F.split(F.split_part(r["url"], F.lit("?"), F.lit(1)), "/")
    own = F.transform(F.filter(kept(met), lambda r: r["origin"] == "dom"), lambda r: F.struct(F.element_at(path(r), -1).alias("name"), F.coalesce(F.try_element_at(path(r), F.lit(-2)), F.lit("")).alias("folder")))
    long = F.filter(own, lambda x: F.length(x["name"]) >= least_chars)
    # sorted by name and place, the first of each name is the one whose neighbour before is another
    placed = F.array_sort(F.transform(long, lambda x, i: F.struct(x["name"].alias("name"), i.alias("i"), x["folder"].alias("folder"))))
    previous = F.concat(F.array(F.lit(None).cast("string")), F.transform(placed, lambda x: x["name"]))
    marked = F.zip_with(placed, previous, lambda x, u: F.struct(x["i"].alias("i"), x["name"].alias("name"), x["folder"].alias("folder"), F.coalesce(x["name"] == u, F.lit(False)).alias("again")))
    first = F.array_sort(F.filter(marked, lambda x: x["i"].isNotNull() & ~x["again"]))
    shown = lambda n: F.when(F.length(n) > shown_chars, F.concat(F.left(n, F.lit(shown_chars)), F.lit("…"))).otherwise(n)
    return F.transform(F.slice(first, 1, most), lambda x: F.concat(x["folder"], F.lit("/"), shown(x["name"])))


def credits(met: Column) -> Column:
    """Array of (key, label, n): images credited to each sweep, in the order in which the sweeps were first credited.

    What a shadow root adds is credited to its own sweeps and again to the backgrounds of each root around it.
    """

    def of(r: Column) -> Column:
        depth = F.floor((F.size(r["key"]) - 3) / 3).cast("int")
        ends = lambda n, s: F.concat(F.slice(r["key"], 1, 1 + 3 * n), F.array(s, F.lit(_LAST)))
        # links and metas are credited together, once both are done
        own = F.struct(ends(depth, F.when(r["sweep"] == LINK, META).otherwise(r["sweep"])).alias("key"), F.when(r["sweep"] == LINK, META).otherwise(r["sweep"]).alias("sweep"))
        outer = F.transform(F.when(depth > 0, F.sequence(F.lit(0), depth - 1)).otherwise(F.array().cast("array<int>")), lambda d: F.struct(ends(d, F.lit(CSS)).alias("key"), F.lit(CSS).alias("sweep")))
        return F.concat(F.array(own), outer)

    rows = F.flatten(F.transform(F.filter(kept(met), lambda r: r["sweep"] != RAW), of))

    def total(sweep: int) -> Column:
        mine = F.filter(rows, lambda c: c["sweep"] == sweep)
        return F.struct(F.array_min(F.transform(mine, lambda c: c["key"])).alias("key"), F.lit(LABELS[sweep]).alias("label"), F.size(mine).cast("bigint").alias("n"))

    counted = F.array(*[total(s) for s in (VIDEO, IMG, SOURCE, POSTER, META, SVG, CSS)])
    return F.array_sort(F.filter(counted, lambda c: c["n"] > 0))
