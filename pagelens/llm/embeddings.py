"""Operator 5: near-duplicate vectors by a forest of random-projection trees with spill overlap.

Each tree splits its nodes, one level at a time, at the median of the projections on a random direction; rows within
``spill`` of the median go to both sides, at most ``max_spills`` times a tree. Projections are scaled by the root of
the dimension, so that the overlap is the same share of a node at every dimension: some 8 of 100 rows. The directions
of a tree's levels are drawn once, so a row's projections are computed once and the growing of the trees is plain
DataFrame work: medians are pre-aggregated, children are exploded, and leaves leave the table that the next level
rewrites. Nodes of up to ``leaf`` rows are leaves; so is a node that a split hardly divides (a tight cluster). The
forest is fitted on all rows; recall is measured against brute force in the tests.

Within leaves all pairs are compared by exact cosine; a leaf above ``tile`` rows is dealt as tiles that cover each of
its pairs once. No pair leaves a task: rows carry the list of their leaves, a pair counts in the first leaf that both
share, and a tile returns for each row the number of vectors that it links to and the least row that it is joined to.

Equal vectors of a label are one node with a multiplicity, so copies never pair up; n_links counts them back in.
Null and odd input: null labels, null, empty or zero vectors and vectors with null or non-finite components link
with nothing. Vectors of different length never link. Rows with equal vec_id and vector are one vector; rows with
equal vec_id and other vectors are linked on their own. A null vec_id links like others and can join two groups, but
names no component and isn't counted by n_links. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_spread, materialize, table
from .components import components, hang


@dataclass(frozen=True)
class Forest:
    cosine: float = 0.98
    trees: int = 5
    leaf: int = 256
    tile: int = 2048
    #: half width of the overlap in units of 1 / sqrt(dimension); two unit vectors at the cosine limit differ by 0.2 such
    #: units in a direction, as a standard deviation
    spill: float = 0.1
    #: how often a row may go to both sides in a tree: 8 leaves a tree at most
    max_spills: int = 3
    max_levels: int = 40
    #: a node is a leaf if more than this share of its rows would go to one side
    stuck: float = 0.75
    seed: int = 11


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps tiny and huge components in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _project(batches: Iterator[pa.RecordBatch], forest: Forest, levels: int) -> Iterator[pa.RecordBatch]:
    """(id, kind, tree, p: scaled projections by level) of every row and tree."""
    for b in batches:
        values, at = _matrix(b.column(2))
        for size in np.unique(np.diff(at)).tolist():
            pick = np.flatnonzero(np.diff(at) == size)
            x = _unit(values[at[pick][:, None] + np.arange(size)])
            rows = pa.array(pick)
            for t in range(forest.trees):
                r = np.random.default_rng([forest.seed, t, size]).standard_normal((size, forest.max_levels))[:, :levels]
                p = (x @ (r / np.sqrt((r * r).sum(axis=0))) * math.sqrt(size)).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(pick) + 1, dtype=np.int32) * levels), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(np.full(len(pick), t, np.int32)), lists], names=["id", "kind", "tree", "p"])


def keyed(vectors: DataFrame) -> DataFrame:
    """vectors with ``kind``, a key of label and length, and ``node``, a key of these and the vector; null if it can't link."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    valid = F.coalesce(F.col("label").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding")
    return rows.select("vec_id", "embedding", F.when(valid, F.xxhash64("label", F.size(e))).alias("kind"), F.when(valid, F.xxhash64(F.xxhash64(F.lit(1), e), F.xxhash64(F.lit(2), e), "label")).alias("node"))


def grow(rows: DataFrame, forest: Forest, levels: int) -> DataFrame:
    """rows: (id, kind, tree, p). Returns (id, kind, leaf) of all leaves, a long that is one leaf within its kind."""
    rows = materialize(rows.select("id", "kind", F.xxhash64("kind", "tree").alias("at"), F.lit(0).alias("spills"), "p"))
    leaves, wide, x = [], F.lit(forest.spill), F.get("p", F.lit(0))
    for _ in range(levels):
        stats = materialize(rows.groupBy("kind", "at").agg(F.count("*").alias("n"), F.percentile_approx(x, [1 - forest.stuck, 0.5, forest.stuck], 1000).alias("q")))
        low, cut, high = (F.get("q", F.lit(i)) for i in range(3))
        split = stats.where((F.col("n") > forest.leaf) & (high > cut + wide) & (low < cut - wide)).select("kind", "at", cut.alias("cut"))
        if not split.limit(1).count():
            break
        both = (x <= F.col("cut") + wide) & (x >= F.col("cut") - wide) & (F.col("spills") < forest.max_spills)
        side = lambda s, more: F.struct(F.lit(s).alias("s"), (F.col("spills") + more).alias("spills"))
        sides = F.when(both, F.array(side(0, 1), side(1, 1))).when(x <= F.col("cut"), F.array(side(0, 0))).otherwise(F.array(side(1, 0)))
        moved = rows.join(split, ["kind", "at"], "left").select("id", "kind", "at", "cut", "p", F.explode(F.when(F.col("cut").isNull(), F.array(side(0, 0))).otherwise(sides)).alias("to"))
        done = F.col("cut").isNull()
        children = materialize(moved.select("id", "kind", F.when(done, F.col("at")).otherwise(F.xxhash64("at", "to.s")).alias("at"), "to.spills", F.when(~done, F.slice("p", 2, levels)).alias("p"), done.alias("done")))
        leaves.append(children.where("done").select("id", "kind", F.col("at").alias("leaf")))
        discard(stats)
        rows = children.where("NOT done").drop("done")
    out = rows.select("id", "kind", F.col("at").alias("leaf"))
    for more in leaves:
        out = out.union(more)
    return out


def _first_common(a: np.ndarray, b: np.ndarray, lists: np.ndarray, leaf: int, step: int = 1 << 15) -> np.ndarray:
    """Whether no leaf below this one is on both rows' lists. lists: padded with the largest long."""
    early = np.where(lists < leaf, lists, np.iinfo(np.int64).max)
    early.sort(axis=1)
    early = early[:, : int((early < leaf).sum(axis=1).max(initial=0))]
    other = np.where(early < leaf, early, np.iinfo(np.int64).min)  # padding never meets padding
    return np.concatenate([~(early[a[i : i + step], :, None] == other[b[i : i + step], None, :]).any(axis=(1, 2)) for i in range(0, len(a), step)] or [np.zeros(0, bool)])


def _compare(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """(id, n, root) of the linked rows of each tile of a partition sorted by kind, leaf and tile."""

    def solve(t: pa.Table, leaf: int) -> pa.RecordBatch:
        ids, copies, part = (t.column(c).to_numpy() for c in ("id", "copies", "part"))
        values, _ = _matrix(t.column("embedding"))
        x = _unit(values.reshape(len(ids), -1))
        flat, at = t.column("leaves").combine_chunks(), np.append(0, np.cumsum(t.column("leaves").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)))
        size = np.diff(at)
        lists = np.full((len(ids), int(size.max())), np.iinfo(np.int64).max)
        lists[np.repeat(np.arange(len(ids)), size), np.arange(at[-1]) - np.repeat(at[:-1], size)] = flat.flatten().to_numpy()
        n, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        cross = t.column("cross")[0].as_py()
        left = np.flatnonzero(part == part.min()) if cross else np.arange(len(ids))
        right = np.flatnonzero(part != part.min()) if cross else left
        for i in range(0, len(left), 256):
            to = right if cross else right[i:]
            c = x[left[i : i + 256]] @ x[to].T >= cosine
            a, b = np.nonzero(c if cross else np.triu(c, 1))
            a, b = left[i + a], to[b]
            hang(label, a, b)
            mine = _first_common(a, b, lists, leaf)
            a, b = a[mine], b[mine]
            n += np.bincount(a, weights=copies[b], minlength=len(ids)).astype(np.int64) + np.bincount(b, weights=copies[a], minlength=len(ids)).astype(np.int64)
        out = np.flatnonzero((n > 0) | (label != np.arange(len(ids))))
        return pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(n[out]), pa.array(ids[label[out]])], names=["id", "n", "root"])

    rest, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(3)]
        cuts = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in cols], axis=0)))
        for i, j in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            now = tuple(int(c[i]) for c in cols)
            if now != key and rest:
                yield solve(pa.Table.from_batches(rest), key[1])
                rest = []
            key = now
            rest.append(batch.slice(i, j - i))
    if rest:
        yield solve(pa.Table.from_batches(rest), key[1])


def leaf_table(nodes: DataFrame, forest: Forest) -> DataFrame:
    """nodes: (id, kind, embedding), distinct. (id, kind, leaf) of every node in every tree."""
    largest = nodes.groupBy("kind").count().agg(F.max("count")).first()[0] or 0
    levels = min(forest.max_levels, 8 + max(0, math.ceil(math.log2(max(1, largest / forest.leaf)))))
    element = "id bigint, kind bigint, tree int, p array<float>"
    return materialize(grow(nodes.select("id", "kind", "embedding").mapInArrow(lambda it: _project(it, forest, levels), element), forest, levels))


def linked_rows(nodes: DataFrame, forest: Forest) -> DataFrame:
    """nodes: (id, kind, embedding, copies), distinct. (id, n: copies linked to, root), some rows for each linked node."""
    leaves = leaf_table(nodes, forest)
    large = materialize(leaves.groupBy("kind", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > forest.tile).select("kind", "leaf", F.ceil(F.col("n") / forest.tile).cast("int").alias("parts")))
    own = leaves.groupBy("id").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))  # a few for each tree
    rows = nodes.join(own, "id").select("*", F.explode("leaves").alias("leaf")).join(large, ["kind", "leaf"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))
    dealt = dealt.select("kind", "leaf", (F.least("part", "o") * F.col("parts") + F.greatest("part", "o")).alias("tile"), "part", (F.col("part") != F.col("o")).alias("cross"), "id", "copies", "leaves", "embedding")
    # by spark.sql.shuffle.partitions: set it so that a partition holds some hundred megabytes of vectors
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.repartition(n, "kind", "leaf", "tile").sortWithinPartitions("kind", "leaf", "tile", "part").mapInArrow(lambda it: _compare(it, forest.cosine), "id bigint, n bigint, root bigint")
    return materialize(found)


def near_duplicates(vectors: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of vectors."""
    rows = keyed(vectors)
    valid = rows.where("node IS NOT NULL")
    ids = valid.select("node", "vec_id").distinct().groupBy(F.col("node").alias("id")).agg(F.min("vec_id").alias("low"), F.count("vec_id").alias("copies"))
    nodes = materialize(valid.select(F.col("node").alias("id"), "kind", "embedding").dropDuplicates(["id"]).join(ids, "id"))
    found = linked_rows(nodes.drop("low"), forest)
    groups = materialize(components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))))
    low = nodes.select("id", "low").join(groups, nodes.id == groups.node).select("id", "component", "low")
    least = low.join(low.groupBy("component").agg(F.min("low").alias("least")), "component").select("id", "least")
    beyond = found.groupBy("id").agg(F.sum("n").alias("beyond"))
    named = nodes.select("id", "low", "copies").join(least, "id", "left").join(beyond, "id", "left").select("id", F.coalesce("least", "low").alias("component"), "copies", F.coalesce("beyond", F.lit(0)).alias("beyond"))
    counts = materialize(valid.groupBy("node").agg(F.count("*").alias("n")))
    out = join_spread(rows.drop("embedding"), named.withColumnRenamed("id", "node"), "node", counts)
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    links = F.coalesce(F.col("copies") - F.col("vec_id").isNotNull().cast("int") + F.col("beyond"), F.lit(0))
    return out.select("vec_id", links.cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_sql(cosine: float = 0.98) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {cosine}),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a), k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.a LEFT JOIN k ON vec_id = k.a"""


QUERIES = {"op5_embedding_dedup": op5_embedding_dedup}
SQL = {"op5_embedding_dedup": op5_sql()}
