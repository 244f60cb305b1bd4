"""Column functions on URLs, source sets and labels; all native, and but for those with lambdas inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, ExtractConfig


def source_matches(html: Column, config: ExtractConfig = DEFAULT) -> Column:
    """URLs that the markup names, up to the limit on matches if there is one, in order, with repeats."""
    found = F.regexp_extract_all(unescape_slashes(html), F.lit(config.image_url), 0)
    return found if config.source_matches is None else F.slice(found, 1, config.source_matches)


def is_ui_asset(url: Column, config: ExtractConfig = DEFAULT) -> Column:
    return F.rlike(url, F.lit(config.ui_asset))


def unescape_slashes(html: Column) -> Column:
    """Undoes the spellings of a slash in inline JSON, in this order."""
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("/")), ("\\u002F", "\\u002f", "\\/"), html)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def page_identity(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def is_permalink(url_path: Column, config: ExtractConfig = DEFAULT) -> Column:
    return F.rlike(url_path, F.lit(config.post_path))


def page_key(url_path: Column, config: ExtractConfig = DEFAULT) -> Column:
    """post:<code> for a post's path, else path: and the first two segments."""
    post = F.regexp_extract(url_path, config.post_path, 1)
    segments = F.slice(F.filter(F.split(url_path, "/"), lambda x: x != ""), 1, 2)
    return F.when(post != "", F.concat(F.lit("post:"), post)).otherwise(F.concat(F.lit("path:"), F.array_join(F.transform(segments, lambda x: F.concat(F.lit("/"), x)), "")))


def walks_carousels(hostname: Column, config: ExtractConfig = DEFAULT) -> Column:
    return reduce(lambda a, b: a | b, [(hostname == h) | F.endswith(hostname, F.lit(f".{h}")) for h in config.carousel_hosts], F.lit(False))


def starting_slide(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"[?&]img_index=(\d+)", 1).try_cast("int"), F.lit(1))


def passes(slide: Column) -> Column:
    return F.when(slide >= 3, F.array(F.lit("previous"), F.lit("next"))).otherwise(F.array(F.lit("next")))


def best_from_srcset(srcset: Column) -> Column:
    """The candidate of the highest score: 1 without a number, n for "nw", 1000 n for "nx"; ties keep the first.

    Candidates are split at every comma, so a URL with a comma is cut there.
    """

    def scored(part: Column, i: Column) -> Column:
        bits = F.split(F.regexp_replace(part, r"^[\s ﻿]+|[\s ﻿]+$", ""), r"[\s ﻿]+")
        second = F.coalesce(F.get(bits, F.lit(1)), F.lit(""))
        number = F.regexp_extract(second, r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
        score = F.when(number.isNull(), F.lit(1.0)).otherwise(F.when(F.endswith(second, F.lit("x")), number * 1000).otherwise(number))
        return F.struct(score.alias("score"), (-i).alias("at"), F.get(bits, F.lit(0)).alias("url"))

    rows = F.filter(F.transform(F.split(srcset, ","), scored), lambda r: (r["url"] != "") & (r["score"] > -1))
    return F.array_max(rows)["url"]


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def extension(url: Column) -> Column:
    """Of the last path segment, as written; empty for none."""
    return F.regexp_extract(F.regexp_extract(path(url), r"([^/]*)/*$", 1), r"[^.]\.([^.]+)$", 1)


def format_label(url: Column) -> Column:
    e = F.lower(extension(url))
    known = {"heic": "HEIF", "heif": "HEIF", "webp": "WebP", "svg": "SVG", "gif": "GIF", "png": "PNG", "jpg": "JPEG", "jpeg": "JPEG"}
    return reduce(lambda c, kv: c.when(e == kv[0], kv[1]), known.items(), F.when(F.lit(False), "")).otherwise(F.upper(e))


def save_extension(url: Column) -> Column:
    return F.coalesce(F.nullif(extension(url), F.lit("")), F.lit("jpg"))


def css_urls(style: Column, config: ExtractConfig = DEFAULT) -> Column:
    return F.regexp_extract_all(style, F.lit(config.css_url), 1)


def is_sprite(width: Column, height: Column, config: ExtractConfig = DEFAULT) -> Column:
    return (width < config.sprite_box) & (height < config.sprite_box)


def slide_signature(sources: Column) -> Column:
    shown = F.transform(F.slice(sources, 1, 8), lambda x: F.concat(F.right(F.coalesce(x, F.lit("")), F.lit(24)), F.lit(",")))
    return F.concat(F.size(sources).cast("string"), F.lit(":"), F.array_join(shown, ""))


def log_line(is_error: Column, text: Column) -> Column:
    return F.concat(F.when(is_error, "[ERR] ").otherwise(""), text)
