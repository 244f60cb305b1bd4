"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def hang(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the rows a to the rows b, in place: afterwards label holds the least row number that each is joined to."""
    while len(a):
        x, y = label[a], label[b]
        a, b = np.maximum(x, y), np.minimum(x, y)
        keep = a != b
        a, b = a[keep], b[keep]
        np.minimum.at(label, a, b)
        while (label[label] != label).any():
            label[:] = label[label]


def _state(edges: DataFrame) -> tuple:
    """Tells whether a round changed anything: the number of links, all distinct, and two checksums of them."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(1), "u"))).first())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links: (a, b) of longs, undirected. Returns (node, component): the smallest node reachable, for linked nodes.

    Each round hangs every node on a smaller one, so no row gathers a component: rows are (node, parent) pairs, and
    minima are pre-aggregated before each shuffle. Rounds grow with the logarithm of the longest chain. Only a count
    and a checksum of the links come to the driver. The result of each round is written to the shared folder.

    Links with a null end link nothing. No links give no rows.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    now = _state(edges)
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours of u move to the least of u's neighbourhood
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours of u, and u, move to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        done = materialize(small)
        before, now = now, _state(done)
        discard(edges)
        edges = done
        if now == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
