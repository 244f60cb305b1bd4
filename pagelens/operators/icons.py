"""The icon set: the glyph's segments, each size drawn once, and the manifest of its slots."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import raster

# The drawing on a unit canvas. An arrow of a shaft and a head; a tray of walls, corners and a floor.
SHAFT = ((0.50, 0.09), (0.50, 0.615))
HEAD = ((0.305, 0.425), (0.50, 0.62), (0.695, 0.425))
TRAY = {"left": 0.155, "right": 0.845, "top": 0.545, "bottom": 0.885, "radius": 0.13}


def glyph() -> Column:
    """An array of segments (ax, ay, bx, by), not yet recentred."""
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    path = lambda *points: raster.polyline(F.array(*[point(*p) for p in points]))
    t = TRAY
    low, inner_left, inner_right = t["bottom"] - t["radius"], t["left"] + t["radius"], t["right"] - t["radius"]
    corner = lambda cx, start, stop: raster.polyline(raster.arc(*map(F.lit, (cx, low, t["radius"], start, stop))))
    tray = (
        path((t["left"], t["top"]), (t["left"], low)),
        corner(inner_left, math.pi, math.pi / 2),
        path((inner_left, t["bottom"]), (inner_right, t["bottom"])),
        corner(inner_right, math.pi / 2, 0.0),
        path((t["right"], low), (t["right"], t["top"])),
    )
    return F.concat(path(*SHAFT), path(*HEAD), *tray)


def sizes(slots: DataFrame, by: list[str]) -> DataFrame:
    """Distinct pixel sizes, so that each is drawn once however many slots use it."""
    return slots.select(*by, "px").distinct()


def manifest(slots: DataFrame, by: list[str], author: str = "xcode") -> DataFrame:
    """slots: (by..., slot, idiom, size, scale, px). One JSON text per icon set, its images in the order of ``slot``."""
    entry = F.struct("slot", F.format_string("icon-%d.png", F.col("px")).alias("filename"), "idiom", "scale", "size")
    rows = slots.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    images = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in ("filename", "idiom", "scale", "size")]))
    info = F.struct(F.lit(author).alias("author"), F.lit(1).alias("version"))
    return rows.select(*by, F.to_json(F.struct(images.alias("images"), info.alias("info"))).alias("contents"))
