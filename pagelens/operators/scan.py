"""Scans of page markup: the raw-source scan on its own, and the whole extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ExtractConfig
from ..functions import columns as C
from ..functions.columns import source_matches
from . import sweeps


def source_scan(pages: DataFrame, config: ExtractConfig = DEFAULT) -> DataFrame:
    """(page_id, pos, url): distinct image URLs of the markup without interface artwork, in order of first sight.

    A page is a row and its matches an array, so filter, cap and first-wins run in the row: no shuffle, no Python.
    """
    urls = F.filter(source_matches(F.col("html"), config), lambda u: ~C.is_ui_asset(u, config))
    return pages.select("page_id", F.posexplode(F.array_distinct(urls)).alias("pos", "url"))


def extract_images(pages: DataFrame, config: ExtractConfig = DEFAULT) -> DataFrame:
    """Image rows of every page: (page_id, order, url, width, height, origin, sweep).

    ``order`` counts the images of a page from 0, in the row's own task: no shuffle. Rows that repeat a page_id are
    pages of their own. A null html has no images.
    """
    return images_of(sweeps.occurrences(pages, config))


def images_of(found: DataFrame) -> DataFrame:
    """Image rows of pages whose occurrences are known."""
    # outer, as else the test for an empty array is worked out on its own, too
    rows = found.select("page_id", F.posexplode_outer(sweeps.kept(F.col("met"))).alias("order", "m")).where("order IS NOT NULL")
    names = F.array(*map(F.lit, sweeps.NAMES))
    return rows.select("page_id", F.col("order").cast("bigint").alias("order"), "m.url", F.lit(0).alias("width"), F.lit(0).alias("height"), "m.origin", F.element_at(names, F.col("m.sweep") + 1).alias("sweep"))


def rendered_names(images: DataFrame, most: int = 12, least_chars: int = 12, shown_chars: int = 30) -> DataFrame:
    """One row per page with images of its own: the first distinct file names with their folders, long ones shortened.

    Images that the page itself shows (origin dom) count, in order; a name seen before is passed over.
    """
    path = F.split(F.split_part("url", F.lit("?"), F.lit(1)), "/")
    named = images.where("origin = 'dom'").select("page_id", "order", F.element_at(path, -1).alias("name"), F.coalesce(F.try_element_at(path, F.lit(-2)), F.lit("")).alias("folder"))
    first = named.where(F.length("name") >= least_chars).groupBy("page_id", "name").agg(F.min(F.struct("order", "folder")).alias("at"))
    shown = F.when(F.length("name") > shown_chars, F.concat(F.left("name", F.lit(shown_chars)), F.lit("…"))).otherwise(F.col("name"))
    ranked = first.select("page_id", "at.order", F.concat("at.folder", F.lit("/"), shown).alias("shown"))
    rows = ranked.groupBy("page_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("order", "shown"))), 1, most).alias("rows"))
    return rows.select("page_id", F.size("rows").cast("bigint").alias("n_names"), F.array_join(F.transform("rows", lambda r: r["shown"]), " / ").alias("names"))


def largest(images: DataFrame) -> DataFrame:
    """The image with the largest area of each page; ties keep the first, and none without an area counts."""
    area = F.col("width").cast("bigint") * F.col("height")
    return images.where(area > 0).groupBy("page_id").agg(F.max_by(F.struct("order", "url", area.alias("area")), F.struct(area.alias("area"), (-F.col("order")).alias("at"))).alias("m")).select("page_id", "m.order", "m.url", "m.area")


def payload(images: DataFrame, pages: DataFrame, title: Column | None = None) -> DataFrame:
    """One row per page, images nested; a page without images has an empty array, which is no failure."""
    nested = images.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("order", "url", "width", "height", "origin"))).alias("images"))
    found = title if title is not None else F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    empty = F.array().cast(nested.schema["images"].dataType)
    return pages.select("page_id", F.col("url").alias("page_url"), found.alias("page_title")).join(nested, "page_id", "left").withColumn("images", F.coalesce("images", empty))


def sweep_counts(found: DataFrame) -> DataFrame:
    """(label, n_new): images that each sweep added over all pages, the source's too, which the log doesn't credit."""
    credited = F.transform(sweeps.credits(F.col("met")), lambda c: F.struct(c["label"].alias("label"), c["n"].alias("n")))
    source = F.size(F.filter(sweeps.kept(F.col("met")), lambda r: r["sweep"] == sweeps.RAW)).cast("bigint")
    every = F.concat(credited, F.array(F.struct(F.lit(sweeps.NAMES[sweeps.RAW]).alias("label"), source.alias("n"))))
    rows = found.select(F.explode_outer(every).alias("c")).where("c.n > 0")
    return rows.groupBy(F.col("c.label").alias("label")).agg(F.sum("c.n").alias("n_new"))


def skips(found: DataFrame) -> DataFrame:
    """(page_id, n_assets, n_sprites): interface artwork and icons, every occurrence counted, as often as sweeps ran."""
    return found.select("page_id", sweeps.skipped_assets(F.col("met")).alias("n_assets"), (F.col("n_sprites") * sweeps.SWEEPS_RUN).cast("bigint").alias("n_sprites"))
