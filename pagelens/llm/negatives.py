"""Operator 13: hard negatives by a multiway hyperplane tree with distance ranges (GNAT).

Scores are integer inner products. To search them by distance, each row x gets one more component, sqrt(M^2 - |x|^2)
with M the longest row, and each anchor a zero: then D^2 = |a|^2 + M^2 - 2 score, so a window of scores is an annulus
around the anchor in a true metric. A node of the tree has up to ``ways`` split points; a row goes to the nearest, which
cuts space by hyperplanes. For each split point i and sibling subtree j the index stores the least and the greatest
distance from i to any row under j. An anchor at distance d from i finds nothing under j if [d - high, d + high] or
low - d say that no row there lies inside the annulus. Leaves that stand are compared exactly, so results are exact;
the triangle inequality is taken with a slack for rounding.

Split points are chosen on a bounded sample (``sample`` rows, by hash); every row is indexed, and ranges come from all
rows. Positives are found in two steps: the anchor's own leaf gives a k-th score, which bounds the annulus for the rest.

Anchors travel to the leaves that stand; a leaf of more than ``piece`` rows is dealt as pieces and anchors come in
blocks of some ``block``, so that a task holds one block of anchors and streams rows past it, however large a leaf, a
label or a group of copies is. A tile sends back k rows for each window; no pairs are written.

Rows with a null id, a null label, a null vector or any null or non-finite component take no part. Rows equal in id,
label and vector are one row; rows that share an id and differ are rows of their own, ties between them go by label and
vector. Vectors of different length never meet. Anchors without positives, or whose windows hold nothing, have no rows;
so has an empty table. Scaled components are held to +-2^22, so that sums of 512 products are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

MOST = 1 << 22


@dataclass(frozen=True)
class Search:
    positives: int = 5
    negatives: int = 3
    #: a negative's score as a share of the positive's, in hundredths
    low: int = 50
    high: int = 95
    ways: int = 16
    depth: int = 2
    sample: int = 8192
    piece: int = 8192
    block: int = 2048
    seed: int = 5


@dataclass
class Tree:
    """Nodes of split points; child c of node k is a node (>= 0) or leaf -1 - c. low, high: ranges by node, i and j."""

    length: float
    points: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0
    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.length**2 - (x * x).sum(axis=1), 0))])

    def new_leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def grow(self, x: np.ndarray, depth: int, search: Search, rng: np.random.Generator) -> int:
        """x: lifted sample rows. Returns the child number of the subtree made."""
        if depth == 0 or len(x) < 4 * search.ways:
            return self.new_leaf()
        pool = x[rng.choice(len(x), min(len(x), 3 * search.ways), replace=False)]
        chosen, far = [0], distances(pool, pool[:1])[:, 0]
        while len(chosen) < search.ways and far.max() > 0:  # the one farthest from those chosen
            chosen.append(int(far.argmax()))
            far = np.minimum(far, distances(pool, pool[chosen[-1:]])[:, 0])
        if len(chosen) < 2:
            return self.new_leaf()
        node, at = len(self.points), pool[chosen]
        self.points.append(at)
        self.children.append([])
        near = distances(x, at).argmin(axis=1)
        self.children[node] = [self.grow(x[near == j], depth - 1, search, rng) for j in range(len(at))]
        return node

    def walk(self, x: np.ndarray, visit=None) -> np.ndarray:
        """Leaf of each lifted row; visit(node, distances, child) is told of each step."""
        leaf = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if self.points else []
        while todo:
            node, rows = todo.pop()
            d = distances(x[rows], self.points[node])
            j = d.argmin(axis=1)
            if visit:
                visit(node, d, j)
            for c, child in enumerate(self.children[node]):
                mine = rows[j == c]
                if child < 0:
                    leaf[mine] = -1 - child
                elif len(mine):
                    todo.append((child, mine))
        return leaf

    def standing(self, q: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """Whether each leaf may hold a row within an annulus of each query; inner, outer: (queries, windows)."""
        if not self.points:
            return np.ones((len(q), 1), bool)
        out = np.zeros((len(q), self.leaves), bool)
        size = np.sqrt((q * q).sum(axis=1))
        slack = (1e-7 * (1 + size + self.length))[:, None]
        lifted, todo = np.column_stack([q, np.zeros(len(q))]), [(0, np.arange(len(q)))]
        while todo:
            node, rows = todo.pop()
            d = distances(lifted[rows], self.points[node])
            for j, child in enumerate(self.children[node]):
                low, high = self.low[node][:, j], self.high[node][:, j]
                least = np.maximum(d - high, low - d).max(axis=1)[:, None]  # no row is nearer, or farther than this
                most = (d + high).min(axis=1)[:, None]
                mine = rows[((least <= outer[rows] + slack[rows]) & (most >= inner[rows] - slack[rows])).any(axis=1)]
                if child < 0:
                    out[mine, -1 - child] = True
                elif len(mine):
                    todo.append((child, mine))
        return out


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * (x @ points.T), 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dim = b.column("dim").to_numpy(zero_copy_only=False)
    for d in np.unique(dim).tolist():
        yield d, b.take(pa.array(np.flatnonzero(dim == d)))


def integers(embedding: Column, scale: int = 256) -> Column:
    held = lambda v: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(v.cast("double") * scale)))
    return F.transform(embedding, lambda v: held(v).cast("int"))


def prepared(vectors: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """(id, sig, label, dim, anchor, vec) of the rows that take part; vectors: (vec_id, embedding, anchor boolean)."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & label.isNotNull() & e.isNotNull()).where(finite)
    rows = rows.select(F.col("vec_id").cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.size(e).alias("dim"), F.coalesce("anchor", F.lit(False)).alias("anchor"), integers(e, scale).alias("vec"))
    return rows.withColumn("sig", F.xxhash64("label", "vec")).dropDuplicates(["id", "label", "vec"])


def fit(rows: DataFrame, search: Search) -> dict[int, Tree]:
    """A tree for each vector length in the sample, without ranges."""
    square = F.aggregate("vec", F.lit(0).cast("bigint"), lambda a, v: a + v.cast("bigint") * v)
    sample = rows.select("dim", "vec").orderBy(F.xxhash64("id", F.lit(search.seed)), "sig").limit(search.sample).toPandas()
    seen = [int(d) for d in sample["dim"].unique()]
    longest = {r.dim: math.sqrt(r.m) for r in rows.where(F.col("dim").isin(seen)).groupBy("dim").agg(F.max(square).alias("m")).collect()} if seen else {}
    trees = {}
    for d in filter(None, seen):
        x = np.array([v for v in sample.loc[sample["dim"] == d, "vec"]], np.float64).reshape(-1, d)
        trees[d] = Tree(longest[d])
        if trees[d].grow(trees[d].lifted(x), search.depth, search, np.random.default_rng(search.seed)) < 0:
            trees[d] = Tree(longest[d])  # one leaf
    return trees


def index(rows: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """rows with their leaf; fills in the trees' ranges, from all rows."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, b in _by_dim(batch):
                leaf = trees[d].walk(trees[d].lifted(_matrix(b.column("vec")))) if d in trees else np.zeros(b.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32))], names=[*b.schema.names, "leaf"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's least and greatest distances: as many rows as the trees have ranges."""
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for d, b in _by_dim(batch):
                if d not in trees:
                    continue

                def visit(node: int, far: np.ndarray, j: np.ndarray, d: int = d) -> None:
                    m = far.shape[1]
                    low, high = held.setdefault((d, node), (np.full((m, m), np.inf), np.full((m, m), -np.inf)))
                    np.minimum.at(low.T, j, far)
                    np.maximum.at(high.T, j, far)

                trees[d].walk(trees[d].lifted(_matrix(b.column("vec"))), visit)
        for (d, node), (low, high) in held.items():
            i, j = np.nonzero(np.isfinite(low))
            same = lambda v: pa.array(np.full(len(i), v, np.int32))
            yield pa.RecordBatch.from_arrays([same(d), same(node), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(low[i, j]), pa.array(high[i, j])], names=["dim", "node", "i", "j", "low", "high"])

    placed = materialize(rows.mapInArrow(place, rows.schema.simpleString()[7:-1] + ",leaf:int"))
    found = placed.select("dim", "vec").mapInArrow(ranges, "dim int, node int, i int, j int, low double, high double").groupBy("dim", "node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    for t in trees.values():
        t.low = [np.full((len(p), len(p)), np.inf) for p in t.points]  # a subtree of no rows is always passed over
        t.high = [np.full((len(p), len(p)), -np.inf) for p in t.points]
    for r in found.collect():  # as many rows as the trees have pairs of siblings
        trees[r.dim].low[r.node][r.i, r.j], trees[r.dim].high[r.node][r.i, r.j] = r.low, r.high
    return placed


WINDOWS = "array<struct<no:int,low:bigint,high:bigint>>"


def leaves_of(anchors: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """anchors: (id, sig, label, dim, home, vec, windows: inclusive scores). A row for each leaf that stands."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, b in _by_dim(batch):
                wins = b.column("windows").to_pylist()
                if d in trees:
                    t, q = trees[d], _matrix(b.column("vec"))
                    width, square = max(map(len, wins), default=0), (q * q).sum(axis=1) + trees[d].length ** 2
                    inner, outer = np.full((len(q), width), np.inf), np.full((len(q), width), -np.inf)
                    for k, ws in enumerate(wins):
                        for c, w in enumerate(ws):
                            inner[k, c], outer[k, c] = (math.sqrt(max(0.0, square[k] - 2.0 * w[side])) for side in ("high", "low"))
                    k, leaf = np.nonzero(t.standing(q, inner, outer))
                else:
                    k, leaf = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(k)).columns, pa.array(leaf.astype(np.int32))], names=[*b.schema.names, "leaf"])

    return anchors.mapInArrow(route, anchors.schema.simpleString()[7:-1] + ",leaf:int")


FOUND = "anchor bigint, a_sig bigint, no int, id bigint, sig bigint, score bigint"


def _compare(batches: Iterator[pa.RecordBatch], same_label: bool, k: int) -> Iterator[pa.RecordBatch]:
    """The first k rows of each window of each tile; a partition is sorted by tile, anchors first, then rows by id."""
    key, queries, state = None, [], None

    def begin() -> tuple | None:
        """Windows of the tile's anchors, and the best rows of each so far."""
        if not queries:
            return None
        t = pa.Table.from_batches(queries)
        wins = t.column("windows").to_pylist()
        at = np.repeat(np.arange(len(wins)), [len(w) for w in wins])
        flat = [w for ws in wins for w in ws]
        if not flat:
            return None
        q = _matrix(t.column("vec").combine_chunks())
        ids, sig, label = (t.column(c).to_numpy() for c in ("id", "sig", "label"))
        low, high = (np.array([w[s] for w in flat], np.float64) for s in ("low", "high"))
        best = np.full((len(flat), k), -np.inf), np.zeros((len(flat), k), np.int64), np.zeros((len(flat), k), np.int64)
        return q, ids, sig, label, at, np.array([w["no"] for w in flat], np.int32), low, high, best

    def meet(b: pa.RecordBatch) -> None:
        q, ids, sig, label, at, _, low, high, (score, row, row_sig) = state
        r_id, r_sig, r_label = (b.column(c).to_numpy() for c in ("id", "sig", "label"))
        s = q @ _matrix(b.column("vec")).T  # exact: all sums are below 2^53
        fits = (label[:, None] == r_label) == same_label
        fits &= ~((ids[:, None] == r_id) & (sig[:, None] == r_sig))
        for i in range(0, len(at), 1024):  # rows come by id, so a later one has to be better than the k-th so far
            w = slice(i, i + 1024)
            sw = s[at[w]]
            hit, r = np.nonzero(fits[at[w]] & (sw >= low[w, None]) & (sw <= high[w, None]) & (sw > score[w, -1:]))
            if not len(hit):
                continue
            old, place = np.nonzero(np.isfinite(score[w]))
            win = np.concatenate([old, hit])
            new = np.concatenate([score[w][old, place], sw[hit, r]])
            new_id, new_sig = np.concatenate([row[w][old, place], r_id[r]]), np.concatenate([row_sig[w][old, place], r_sig[r]])
            order = np.lexsort((new_sig, new_id, -new, win))
            win = win[order]
            nth = np.arange(len(win)) - np.searchsorted(win, win)
            keep = nth < k
            to, order = (win[keep] + i, nth[keep]), order[keep]
            score[to], row[to], row_sig[to] = new[order], new_id[order], new_sig[order]

    def end() -> pa.RecordBatch | None:
        if state is None:
            return None
        _, ids, sig, _, at, no, _, _, (score, row, row_sig) = state
        w, c = np.nonzero(np.isfinite(score))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[at[w]], sig[at[w]], no[w], row[w, c], row_sig[w, c], score[w, c].astype(np.int64))], names=[x.split()[0] for x in FOUND.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "leaf", "piece", "block", "is_row")]
        cuts = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in cols], axis=0)))
        for i, j in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            if (now := tuple(int(c[i]) for c in cols[:4])) != key:
                if (done := end()) is not None:
                    yield done
                key, queries, state = now, [], None
            if not cols[4][i]:
                queries.append(batch.slice(i, j - i))
                continue
            if queries:
                state, queries = begin(), []
            for at in range(i, j, 2048) if state else ():
                meet(batch.slice(at, min(2048, j - at)))
    if (done := end()) is not None:
        yield done


def search_leaves(asked: DataFrame, rows: DataFrame, sizes: DataFrame, same_label: bool, k: int, search: Search, blocks: int) -> DataFrame:
    """asked: anchors with windows and a leaf; rows: the index; sizes: (dim, leaf, pieces). Rows as FOUND says."""
    leaf = ["dim", "leaf"]
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "sig"), F.lit(blocks)).cast("int")).join(sizes, leaf)
    asked = materialize(asked)
    wanted = asked.select(*leaf, "block").distinct()
    cols = ["dim", "leaf", "piece", "block", "is_row", "id", "sig", "label", "vec", "windows"]
    q = asked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("is_row", F.lit(0)).select(*cols)
    r = rows.join(sizes, leaf).withColumn("piece", F.pmod(F.xxhash64("id", "sig", F.lit(1)), F.col("pieces")).cast("int")).join(wanted, leaf)
    r = r.withColumns({"is_row": F.lit(1), "windows": F.lit(None).cast(WINDOWS)}).select(*cols)
    tile = ["dim", "leaf", "piece", "block"]
    dealt = q.union(r).repartition(*tile).sortWithinPartitions(*tile, "is_row", "id", "sig")
    return dealt.mapInArrow(lambda it: _compare(it, same_label, k), FOUND)


def _first(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The first k of each window, with their rank from 1."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id", "sig")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, search: Search = Search()) -> DataFrame:
    """rows: as `prepared` makes them. (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    rows = materialize(rows)
    trees = fit(rows, search)
    placed = index(rows, trees)
    sizes = materialize(placed.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / search.piece).cast("int").alias("pieces")))
    anchors = placed.where("anchor").select("id", "sig", "label", "dim", F.col("leaf").alias("home"), "vec")
    blocks = math.ceil(anchors.count() / search.block) or 1
    every = F.struct(F.lit(0).alias("no"), F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high"))
    at_home = anchors.withColumn("windows", F.array(every).cast(WINDOWS)).withColumn("leaf", F.col("home"))
    near = materialize(search_leaves(at_home, placed, sizes, True, search.positives, search, blocks))
    # the k-th score at home: nothing below it can be among the first k
    kth = _first(near, search.positives, "anchor", "a_sig").where(F.col("rank") == search.positives).select(F.col("anchor").alias("id"), F.col("a_sig").alias("sig"), F.col("score").alias("kth"))
    above = F.struct(F.lit(0).alias("no"), F.coalesce("kth", F.lit(-(1 << 62))).alias("low"), F.lit(1 << 62).alias("high"))
    away = leaves_of(anchors.join(kth, ["id", "sig"], "left").withColumn("windows", F.array(above).cast(WINDOWS)).drop("kth"), trees).where("leaf <> home")
    best = near.union(search_leaves(away, placed, sizes, True, search.positives, search, blocks))
    positives = materialize(_first(best, search.positives, "anchor", "a_sig").select("anchor", "a_sig", F.col("rank").alias("no"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    whole = lambda x: f"(({x}) - pmod({x}, 100)) div 100"  # of hundredths, the largest whole number that isn't above
    window = F.expr(f"struct(no, -({whole(f'{-search.low} * positive_score')}) AS low, {whole(f'{search.high} * positive_score')} AS high)")
    asked = positives.groupBy(F.col("anchor").alias("id"), F.col("a_sig").alias("sig")).agg(F.filter(F.collect_list(window), lambda w: w["low"] <= w["high"]).cast(WINDOWS).alias("windows")).where(F.size("windows") > 0)
    found = search_leaves(leaves_of(anchors.join(asked, ["id", "sig"]), trees), placed, sizes, False, search.negatives, search, blocks)
    out = _first(found, search.negatives, "anchor", "a_sig", "no").join(positives, ["anchor", "a_sig", "no"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding").withColumn("anchor", F.col("vec_id") % 50 == 0)
    return mine(prepared(vectors, label))


def op13_sql(search: Search = Search()) -> str:
    return f"""
WITH v AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id AND len(a.e) = len(b.e)),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= {search.positives}),
n AS (SELECT p.a, p.b, p.score, s.b AS negative, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS r
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND {search.low} * p.score <= 100 * s.score AND 100 * s.score <= {search.high} * p.score)
SELECT a AS anchor_id, b AS positive_id, r::INT AS rank, negative AS negative_id, score AS positive_score, negative_score FROM n WHERE r <= {search.negatives}"""


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
SQL = {"op13_hard_negatives": op13_sql()}
