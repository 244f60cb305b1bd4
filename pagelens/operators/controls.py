"""The gallery's own controls in a page, and the part of the page that they belong to.

A page's elements are an array in its row (sources.html.elements), so nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ExtractConfig

_SPACE = " \t\n\x0b\x0c\r\u00a0\u3000\ufeff"


def labelled(elements: Column, pattern: str) -> Column:
    """Elements that are buttons, laid out, in no link, with a label that fits; in document order."""

    def fits(e: Column) -> Column:
        button = (e["tag"] == "button") | (F.lower(e["role"]) == "button")
        return F.coalesce(F.rlike(F.trim(e["label"], F.lit(_SPACE)), F.lit(pattern)), F.lit(False)) & button & ~e["in_link"] & e["laid_out"]

    return F.filter(elements, fits)


def largest_picture(elements: Column) -> Column:
    """The img with the largest box; ties keep the first, and one without an area never counts."""
    area = lambda e: e["width"] * e["height"]
    pictures = F.filter(elements, lambda e: (e["tag"] == "img") & (area(e) > 0))
    return F.array_max(F.transform(pictures, lambda e: F.struct(area(e).alias("area"), (-e["pos"]).alias("at"), e.alias("element"))))["element"]


def controls(pages: DataFrame, config: ExtractConfig = DEFAULT) -> DataFrame:
    """pages: (page_id, elements, forward_first). Adds next, scope and previous, each null if there is none.

    ``next`` is looked for in the whole page; ``previous`` only inside the gallery, as a "back" elsewhere leaves the
    page. ``scope`` is the position of the gallery's container: that of the next control where the forward pass comes
    first and has found one, else that of the largest picture.
    """
    out = pages.withColumn("next", F.get(labelled(F.col("elements"), config.next_label), F.lit(0)))
    from_next = F.when(F.col("forward_first"), F.col("next.container"))
    out = out.withColumn("scope", F.coalesce(from_next, largest_picture(F.col("elements"))["container"]))
    inside = F.filter("elements", lambda e: F.array_contains(e["ancestors"], F.col("scope")))
    return out.withColumn("previous", F.get(labelled(inside, config.previous_label), F.lit(0)))
