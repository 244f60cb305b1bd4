"""The drawing kit: segments, coverage by distance, downsampling, over pixel rows (y, x, alpha)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.images import png_of


def _along(px: Column, py: Column, ax: Column, ay: Column, dx: Column, dy: Column, length: Column) -> Column:
    """Which part of a segment lies before its point next to (px, py); length is squared."""
    return F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length)))


def _apart(px: Column, py: Column, ax: Column, ay: Column, dx: Column, dy: Column, t: Column) -> Column:
    x, y = px - (ax + dx * t), py - (ay + dy * t)
    return x * x + y * y


def _squared(px: Column, py: Column, s: Column) -> Column:
    dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
    return _apart(px, py, s["ax"], s["ay"], dx, dy, _along(px, py, s["ax"], s["ay"], dx, dy, dx * dx + dy * dy))


def segment_distance(px: Column, py: Column, s: Column) -> Column:
    """From a point to a segment (ax, ay, bx, by); a segment without length is its first point."""
    return F.sqrt(_squared(px, py, s))


def polyline(points: Column) -> Column:
    """Consecutive pairs of an array of (x, y)."""
    shifted = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    return F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), shifted, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def arc(cx: Column, cy: Column, r: Column, start: Column, stop: Column, steps: int = 8) -> Column:
    angle = lambda i: start + (stop - start) * i / steps
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.struct((cx + r * F.cos(angle(i))).alias("x"), (cy + r * F.sin(angle(i))).alias("y")))


def recentre(segments: DataFrame, scale: float | Column, by: list[str]) -> DataFrame:
    """segments: (by..., ax, ay, bx, by); a scale may be a column of ``by``. Scaled about the middle of each drawing's box and put in the canvas centre."""
    box = segments.groupBy(*by).agg(*[((F.min(F.least(f"a{c}", f"b{c}")) + F.max(F.greatest(f"a{c}", f"b{c}"))) / 2).alias(f"c{c}") for c in "xy"])
    return segments.join(box, by).select(*by, *[(F.lit(0.5) + (F.col(f"{e}{c}") - F.col(f"c{c}")) * scale).alias(f"{e}{c}") for e in "ab" for c in "xy"])


def _inside(px: Column, py: Column, s: Column, half: float) -> Column:
    within = lambda v, a, b: (v >= F.least(a, b) - half) & (v <= F.greatest(a, b) + half)
    return within(px, s["ax"], s["bx"]) & within(py, s["ay"], s["by"])


def _alpha(squared: Column, size: int, half: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(((half - F.sqrt(squared)) * size + 0.5) * 255))).cast("int")


def coverage(segments: Column, x: Column, y: Column, size: int, stroke: float) -> Column:
    """Alpha of a pixel: falls off over about a pixel at the stroke's edge. Half goes to even.

    Only segments count whose box, widened by half the stroke, holds the pixel's middle; without one it is empty.
    """
    px, py, half = (x + 0.5) / size, (y + 0.5) / size, stroke / 2
    least = F.array_min(F.transform(F.filter(segments, lambda s: _inside(px, py, s, half)), lambda s: _squared(px, py, s)))
    # a pixel without a segment is a canvas away from the nearest
    return _alpha(F.coalesce(least, F.lit((half + 1.0) ** 2)), size, half)


def grid(segments: DataFrame, size: int, stroke: float, by: list[str], cell: int = 32) -> DataFrame:
    """(by..., cx, cy, near): cells of ``cell`` x ``cell`` pixels with the segments whose widened boxes touch them and whose
    strokes reach them.

    segments: (by..., ax, ay, bx, by). Cells that no segment reaches have no row.
    """
    last, half = -(-size // cell) - 1, stroke / 2
    # a pixel's middle may lie on a box's very edge, so cells are taken a pixel wider
    at = lambda v, more: F.greatest(F.lit(0), F.least(F.lit(last), F.floor((F.floor(v * size) + more) / cell))).cast("int")
    span = lambda c: F.sequence(at(F.least(f"a{c}", f"b{c}") - half, -1), at(F.greatest(f"a{c}", f"b{c}") + half, 1))
    rows = segments.select(*by, F.struct("ax", "ay", "bx", "by").alias("s"), span("y").alias("ys"), F.explode(span("x")).alias("cx"))
    cells = rows.select(*by, "s", "cx", F.explode("ys").alias("cy"))
    # alpha ends half a pixel beyond the stroke: a cell is empty if its middle lies farther from the line through the
    # segment by the cell's half diagonal and a pixel
    dx, dy, reach = F.col("s.bx") - F.col("s.ax"), F.col("s.by") - F.col("s.ay"), half + (1 + cell * 0.5**0.5) / size
    across = dx * ((F.col("cy") + 0.5) * cell / size - F.col("s.ay")) - dy * ((F.col("cx") + 0.5) * cell / size - F.col("s.ax"))
    return cells.where(F.abs(across) <= reach * F.sqrt(dx * dx + dy * dy) + 1e-9).groupBy(*by, "cx", "cy").agg(F.collect_list("s").alias("near"))


def covered(segments: DataFrame, size: int, stroke: float, by: list[str], cell: int = 32) -> DataFrame:
    """(by..., y, x, alpha) of the pixels that aren't empty: each looks only at the segments of its cell, so that work
    grows with the strokes' length and not with pixels times segments."""
    # Rows of a pixel and a segment, as lambdas over a pixel's segments are interpreted, at microseconds a pixel; a pixel
    # has the largest of its alphas, and its cell's rows are in one partition already, so nothing is shuffled again. What
    # depends on the segment or the line only is worked out before the next explode: it keeps the generated code of a
    # pixel below the size that the JVM compiles, and filters aren't moved below an explode.
    half, c = stroke / 2, F.col
    line = lambda at, k: (c(at) * cell + c(k)).cast("int")
    ends = [x for k in "xy" for x in (c(f"s.a{k}").alias(f"a{k}"), (c(f"s.b{k}") - c(f"s.a{k}")).alias(f"d{k}"), (F.least(f"s.a{k}", f"s.b{k}") - half).alias(f"low{k}"), (F.greatest(f"s.a{k}", f"s.b{k}") + half).alias(f"high{k}"))]
    rows = grid(segments, size, stroke, by, cell).select(*by, "cx", "cy", F.explode("near").alias("s")).select(*by, "cx", "cy", *ends)
    rows = rows.withColumn("length", c("dx") * c("dx") + c("dy") * c("dy"))
    offsets = F.explode(F.sequence(F.lit(0), F.lit(cell - 1)))
    for k in "yx":
        rows = rows.select("*", offsets.alias("i")).withColumn(k, line(f"c{k}", "i")).drop("i").where(c(k) < size)
        rows = rows.withColumn(f"p{k}", (c(k) + 0.5) / size).where((c(f"p{k}") >= c(f"low{k}")) & (c(f"p{k}") <= c(f"high{k}")))
    rows = rows.select(*by, "cx", "cy", "y", "x", *("px", "py", "ax", "ay", "dx", "dy"), F.explode_outer(F.array(_along(c("px"), c("py"), c("ax"), c("ay"), c("dx"), c("dy"), c("length")))).alias("t"))
    rows = rows.select(*by, "cx", "cy", "y", "x", F.explode_outer(F.array(_apart(c("px"), c("py"), c("ax"), c("ay"), c("dx"), c("dy"), c("t")))).alias("squared"))
    # beyond this, alpha is 0 even before it is rounded
    near = rows.where(c("squared") <= (half + 1 / size) ** 2)
    return near.groupBy(*by, "cx", "cy", "y", "x").agg(F.min("squared").alias("squared")).select(*by, "y", "x", _alpha(c("squared"), size, half).alias("alpha")).where("alpha > 0")


def downsample_covered(pixels: DataFrame, size: int, target: int, by: list[str]) -> DataFrame:
    """As `downsample`, of pixels without the empty ones; tiles with nothing in them have no row. target divides size."""
    step = size // target
    return pixels.groupBy(*by, F.floor(F.col("y") / step).cast("int").alias("ty"), F.floor(F.col("x") / step).cast("int").alias("tx")).agg(F.bround(F.sum("alpha") / (step * step)).cast("int").alias("alpha"))


def downsample(pixels: DataFrame, size: int, target: int, by: list[str]) -> DataFrame:
    """Mean alpha of each tile, half to even. Tiles of a target that doesn't divide the size differ in width."""
    step = size / target
    tile = lambda v: F.least(F.floor((F.col(v) + 1e-9) / step), F.lit(target - 1))
    if size % target:
        edges = [int(i * step) for i in range(target)]
        tile = lambda v: F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(v))) - 1
    return pixels.groupBy(*by, tile("y").cast("int").alias("ty"), tile("x").cast("int").alias("tx")).agg(F.bround(F.avg("alpha")).cast("int").alias("alpha"))


def to_png(pixels: DataFrame, size: int, by: list[str]) -> DataFrame:
    """(by..., png): each drawing's pixels (by..., y, x, alpha) as the bytes of a file, ``size`` pixels wide."""
    drawn = pixels.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("y", "x", "alpha"))).alias("p"))
    return drawn.select(*by, png_of(F.transform("p", lambda p: p["alpha"].cast("int")), F.lit(size)).alias("png"))
