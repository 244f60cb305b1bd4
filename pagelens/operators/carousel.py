"""The slide walk over recorded snapshots (page_id, pass_no, step, elapsed_ms, url list), first sight wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, ExtractConfig
from ..functions import columns as C


def admitted(snapshots: DataFrame, config: ExtractConfig = DEFAULT) -> DataFrame:
    """Snapshots before the walk stops: by steps of a pass, time in all, or a change of page identity.

    Any of these ends the whole walk: later steps and passes don't come up, whatever they hold.
    """
    walk = Window.partitionBy("page_id").orderBy("pass_no", "step")
    over = (F.col("step") > config.max_steps) | (F.col("elapsed_ms") > config.budget_ms) | (F.col("identity") != F.first("identity").over(walk))
    marked = snapshots.withColumn("__over", F.coalesce(over, F.lit(False)).cast("int"))
    return marked.withColumn("__ended", F.max("__over").over(walk)).where("__ended = 0").drop("__over", "__ended")


def first_seen(found: DataFrame) -> DataFrame:
    """found: (page_id, pass_no, backward, step, n, url). The first row of each URL of a page, with its order key.

    A step back sorts ahead of the one before it: -(1000 step) + n; forward finds count up after all of them.
    """
    seen = Window.partitionBy("page_id", "url").orderBy("pass_no", "step", "n")
    first = found.withColumn("__r", F.row_number().over(seen)).where("__r = 1").drop("__r")
    forward = F.row_number().over(Window.partitionBy("page_id", "backward").orderBy("pass_no", "step", "n")) - 1
    within = F.row_number().over(Window.partitionBy("page_id", "pass_no", "step").orderBy("n")) - 1
    return first.withColumn("order", F.when(F.col("backward"), -(F.col("step") * 1000) + within).otherwise(forward).cast("bigint"))


def change_points(snapshots: DataFrame, key: str, order: list[str], sources: str) -> DataFrame:
    """Snapshots whose signature differs from the one before; the first counts as a change."""
    marked = snapshots.withColumn("signature", C.slide_signature(F.col(sources)))
    before = F.lag("signature").over(Window.partitionBy(key).orderBy(*order))
    return marked.withColumn("changed", before.isNull() | (before != F.col("signature")))
