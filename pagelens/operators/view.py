"""The visible set, counts of what is hidden, selection and saving, as plans over key tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import columns as C


@dataclass(frozen=True)
class Gates:
    source_only: bool = False
    video_posters: bool = False
    meta_images: bool = False
    other_posts: bool = False
    size_tier: int = 0

    @property
    def least_pixels(self) -> int:
        """An unknown tier counts as the first."""
        return DEFAULT.size_tiers[self.size_tier] if 0 <= self.size_tier < len(DEFAULT.size_tiers) else 0


def with_pixels(images: DataFrame, pixel_sizes: DataFrame) -> DataFrame:
    """Adds px_w, px_h where the true size is known, and longest_side. A late size changes the next plan's result."""
    out = images.join(pixel_sizes.select("id", F.col("w").alias("px_w"), F.col("h").alias("px_h")), "id", "left")
    return out.withColumn("longest_side", F.coalesce(F.greatest("px_w", "px_h").cast("int"), F.greatest("width", "height")))


def visible(images: DataFrame, pixel_sizes: DataFrame, saved: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """Images not saved, whose origin's gate is open, and that are large enough or of unknown size."""
    shut = [o for o, on in (("source", gates.source_only), ("video", gates.video_posters), ("meta", gates.meta_images), ("other", gates.other_posts)) if not on]
    open_rows = images.where(~F.coalesce("origin", F.lit("dom")).isin(shut)) if shut else images
    side = F.col("longest_side")
    return with_pixels(open_rows.join(saved.select("id"), "id", "left_anti"), pixel_sizes).where((side == 0) | (side >= gates.least_pixels))


def hidden_counts(images: DataFrame, saved: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """One row: images by gated origin that aren't saved, whatever their size, and whether anything may be hidden."""
    left = images.join(saved.select("id"), "id", "left_anti")
    n = lambda o: F.count_if(F.coalesce("origin", F.lit("dom")) == o)
    out = left.agg(n("source").alias("n_source"), n("video").alias("n_video"), n("meta").alias("n_meta"), n("other").alias("n_other"))
    any_shut = F.lit(gates.least_pixels > 0)
    for c, on in (("n_source", gates.source_only), ("n_video", gates.video_posters), ("n_meta", gates.meta_images), ("n_other", gates.other_posts)):
        any_shut |= (F.col(c) > 0) & F.lit(not on)
    return out.withColumn("has_hidden", any_shut)


def badge(url: Column, separator: str = " ") -> Column:
    """Format and size: the true one, else the page's if both sides are known."""
    label = C.format_label(url)
    text = lambda w, h: F.concat(label, F.lit(separator), w.cast("bigint").cast("string"), F.lit("×"), h.cast("bigint").cast("string"))
    w, h = F.col("width"), F.col("height")
    return F.when(F.col("px_w").isNotNull(), text(F.col("px_w"), F.col("px_h"))).when((w > 0) & (h > 0), text(w, h)).otherwise(label)


def numbered(rows: DataFrame, order: str = "id") -> DataFrame:
    """Index in the grid, from 0, without one task for all: offsets of blocks are added to positions in them.

    Runs a job while the plan is built: blocks are cut at quantiles of ``order``, a numeric column (nulls first). The bounds are values, a few per shuffle
    partition, so both uses of the blocks agree; range partitions are sampled anew each time that they are computed.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(F.percentile_approx(order, [k / n for k in range(1, n)] or [0.5])).first()[0]
    block = F.size(F.filter(F.lit(sorted(set(bounds))), lambda b: b < F.col(order))) if bounds else F.lit(0)
    blocks = rows.withColumn("__block", block)
    inside = blocks.withColumn("__at", F.row_number().over(Window.partitionBy("__block").orderBy(order)))
    sizes = blocks.groupBy("__block").agg(F.count("*").alias("__n"))  # a row per block
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(before.select("__block", "__before")), "__block").withColumn("idx", (F.col("__before") + F.col("__at") - 1).cast("bigint")).drop("__block", "__before", "__at")


def select_all(selected: DataFrame, shown: DataFrame) -> DataFrame:
    return selected.select("id").union(shown.select("id")).distinct()


def deselect(selected: DataFrame, ids: DataFrame) -> DataFrame:
    """Also what is left of a selection after a save."""
    return selected.select("id").join(ids.select("id"), "id", "left_anti")


def toggle(selected: DataFrame, ids: DataFrame) -> DataFrame:
    """In one of both, not in the other; one pass, pre-aggregated."""
    both = selected.select("id").distinct().union(ids.select("id").distinct())
    return both.groupBy("id").agg(F.count("*").alias("n")).where("n = 1").select("id")


def all_selected(shown: DataFrame, selected: DataFrame) -> DataFrame:
    """One row: there is something to see, and all of it is selected."""
    marked = shown.select("id").join(selected.select("id", F.lit(True).alias("on")), "id", "left")
    return marked.agg(F.coalesce(F.every(F.coalesce("on", F.lit(False))), F.lit(False)).alias("all_selected"))


def save_tally(results: DataFrame) -> DataFrame:
    """One row: saved, failed, and the last error in save order."""
    return results.agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.expr("max_by(error, id) FILTER (WHERE NOT ok)").alias("message"))
