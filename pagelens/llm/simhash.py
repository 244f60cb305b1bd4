"""Operator 3: SimHash near-duplicates, found through pivot distance tables.

Fingerprints at 3 or fewer differing bits agree wholly in at least one of ``blocks - 3`` chosen blocks, so equal-block
buckets hold every such pair; which blocks is a matter of scale only (`block_count`), never of recall. Pivot
distances of random 64-bit words differ by 3 or less in nearly half of all pairs, so pivots alone can't be a join
key: they work inside the buckets. There each fingerprint has a row of the pivot table, its Hamming distances to many
reference fingerprints; rows are sorted by the first coordinate, a row meets only those whose coordinate is within
the reach, pairs with a larger difference in any other coordinate are discarded (the triangle inequality: they can't
be links), and survivors are verified: bit by bit, or by their shingles where ``Similar`` asks for a similarity.

Texts of a similarity of 0.8 differ in some 10 of 64 bits, and no set of blocks is sure to hold such a pair. Their
buckets are bands of min-hashes of the shingles instead: 12 bands of 5 miss 8 of 1000 pairs at 0.8, and fewer above it.
The reach of 19 bits lets all but one of a thousand of them pass; survivors are verified by the exact Jaccard
similarity of their shingle sets, which travel only for texts that share a band with another.

Equal fingerprints (or equal word sequences) are one node, so copies never pair up. A bucket above ``tile`` nodes is
dealt as tiles, pairs of parts of bounded size, that cover all its pairs. A tile returns a star for each of its
components instead of all pairs. Null and odd input: a null, empty or blank text has fingerprint zero and links like
any other; rows with equal text or equal doc_id are linked. Rows with a null doc_id link like others, and can join two
documents, but name no component: theirs is that of their group, null if no row of the group has a doc_id. Empty
tables give empty results.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_spread, materialize, slices, table
from .components import components, hang

SEED, SHINGLE, REACH, PIVOTS = 42, 3, 3, 24


@dataclass(frozen=True)
class Similar:
    """Links by the Jaccard similarity of shingle sets."""

    words: int = 5
    similarity: float = 0.8
    reach: int = 19
    bands: int = 12
    rows: int = 5
    tile: int = 4096


def shingles(text: str | None, width: int) -> list[int]:
    """Hashes of all runs of so many words, repeats included; of the whole sequence if there are fewer."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII white space and A-Z only
    if not w:
        return []
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= width:
        return [digest(joined, SEED)]
    ends = (np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-width])]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=True)]


def majority(hashes: list[int]) -> int:
    """The 64-bit SimHash of these hashes, as a signed long."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        h = np.array(hashes[i : i + (1 << 14)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of the 3-word shingles of a text, as a signed long."""
    return majority(shingles(text, SHINGLE))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        fps = pa.array([fingerprint(x) for x in b.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), fps, *b.columns[2:]], names=["doc_id", "fp", *b.schema.names[2:]])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp: the fingerprint as a signed long)."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def block_count(nodes: int) -> int:
    """4 blocks (buckets of 16 equal bits, 4 tables) for few nodes, up to 6 (32 bits, 20 tables) for very many."""
    return 4 if nodes < 1 << 20 else 5 if nodes < 1 << 25 else 6


def block_masks(blocks: int) -> list[int]:
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    masks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in itertools.pairwise(edges)]
    return [sum(m) for m in itertools.combinations(masks, blocks - REACH)]


def pivots() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**64, PIVOTS, np.uint64)


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted sets of hashes, whatever their size: the smaller is looked up in the larger, a block at a time."""
    if len(x) > len(y):
        x, y = y, x
    both = 0
    for i in range(0, len(x), 1 << 16):
        part = x[i : i + (1 << 16)]
        both += int((y[np.minimum(np.searchsorted(y, part), len(y) - 1)] == part).sum())
    return both / max(1, len(x) + len(y) - both)


def stars(fp: np.ndarray, group: np.ndarray, reach: int = REACH, same=None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a, b) that span the components of the links inside each group. group: sorted.

    same: whether two rows, given by number and within the reach, are a link; asked only where they aren't joined yet.
    """
    coords = np.empty((len(fp), PIVOTS), np.int8)
    for k, p in enumerate(pivots()):
        coords[:, k] = np.bitwise_count(fp ^ p)
    order = np.lexsort((coords[:, 0], group))
    fp, group, coords = fp[order], group[order], coords[order]
    first = coords[:, 0].copy()
    label = np.arange(len(fp))

    def top(i: int) -> int:
        while label[i] != i:
            label[i] = i = label[label[i]]
        return i

    def verify(a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = top(i), top(j)
            if x != y and same(order[i], order[j]):
                label[max(x, y)] = min(x, y)

    alive, step, found_a, found_b, held = np.arange(len(fp)), 0, [], [], 0
    while len(alive):
        step += 1
        alive = alive[alive + step < len(fp)]
        other = alive + step
        near = (group[other] == group[alive]) & (first[other] - first[alive] <= reach)
        alive = alive[near]  # sorted by the first coordinate: beyond it, none comes back
        a, b = alive, alive + step
        for k in range(1, PIVOTS):
            if not len(a):
                break
            ok = np.abs(coords[a, k] - coords[b, k]) <= reach
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= reach
        if same is not None:
            verify(a[ok], b[ok])
            continue
        found_a.append(a[ok])
        found_b.append(b[ok])
        held += int(ok.sum())
        if held > 1 << 18:
            hang(label, np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, held = [], [], 0
    if held:
        hang(label, np.concatenate(found_a), np.concatenate(found_b))
    while (label[label] != label).any():
        label[:] = label[label]
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return order[linked], order[label[linked]]


def _bucket_stars(batches: Iterator[pa.RecordBatch], spec: Similar | None = None) -> Iterator[pa.RecordBatch]:
    """Streams a partition sorted by bucket; a bucket cut by the end of a batch waits for the next."""
    rest = None

    def solve(t: pa.Table) -> pa.RecordBatch:
        same = None
        if spec:
            sets = t.column(5)
            held = lambda i: np.frombuffer(sets[int(i)].as_buffer(), np.uint32)
            same = lambda i, j: jaccard(held(i), held(j)) >= spec.similarity
        cols = [t.column(i).to_numpy() for i in range(5)]
        new = np.zeros(len(cols[0]), bool)
        for c in cols[:3]:
            new[1:] |= c[1:] != c[:-1]
        a, b = stars(cols[3].view(np.uint64), np.cumsum(new), spec.reach if spec else REACH, same)
        return pa.RecordBatch.from_arrays([pa.array(cols[4][a]), pa.array(cols[4][b])], names=["a", "b"])

    for batch in batches:
        t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not t.num_rows:
            continue
        last = np.ones(t.num_rows, bool)
        for i in range(3):
            c = t.column(i).to_numpy()
            last &= c == c[-1]
        cut = int(np.argmax(last))
        rest = t.slice(cut)
        if cut:
            yield solve(t.slice(0, cut))
    if rest is not None and rest.num_rows:
        yield solve(rest)


def tiles(rows: DataFrame, tile: int) -> DataFrame:
    """rows: (t, k, fp, rep), k the bucket of table t. Deals them over tiles that hold each pair of a bucket together."""
    large = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("t", "k", F.ceil(F.col("n") / tile).cast("int").alias("parts"))
    dealt = rows.join(materialize(large), ["t", "k"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    out = dealt.select("t", "k", "fp", "rep", "parts", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))
    return out.select("t", "k", (F.least("own", "o") * F.col("parts") + F.greatest("own", "o")).alias("tile"), "fp", "rep")


def _solve(dealt: DataFrame, spec: Similar | None = None) -> DataFrame:
    """Stars of all tiles. The number of partitions is spark.sql.shuffle.partitions: of a size that a task can hold."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "t", "k", "tile").sortWithinPartitions("t", "k", "tile").mapInArrow(lambda it: _bucket_stars(it, spec), "a bigint, b bigint")


def links(nodes: DataFrame, n_nodes: int, tile: int = 4096) -> DataFrame:
    """nodes: (fp, rep), fp distinct. Returns (a, b) of reps that span every component of the links."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("bigint")).alias("k")) for i, m in enumerate(block_masks(block_count(n_nodes)))])
    return _solve(tiles(nodes.where("rep IS NOT NULL").select("fp", "rep", F.inline(keys)), tile))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs. Nodes are fingerprints; those of one doc_id are linked too."""
    fps = materialize(fingerprints(docs))
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    several = fps.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("doc_id", "a")
    one_id = fps.join(several, "doc_id").select("a", F.col("fp").alias("b"))
    groups = materialize(components(links(nodes.select("fp", F.col("fp").alias("rep")), nodes.count()).union(one_id)))
    return join_spread(fps, _named(nodes, groups), "fp", nodes).select("doc_id", "fp", "component_id")


def _named(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(fp, component_id): the least rep of the fingerprint's group. nodes: (fp, rep); groups: of linked ones only."""
    linked = nodes.join(groups, nodes.fp == groups.node).select("fp", "rep", "component")
    least = linked.groupBy("component").agg(F.min("rep").alias("low"))
    low = linked.join(least, "component").select("fp", "low")
    return nodes.join(low, "fp", "left").select("fp", F.least("low", "rep").alias("component_id"))


def _sketches(batches: Iterator[pa.RecordBatch], spec: Similar) -> Iterator[pa.RecordBatch]:
    """(doc_id, own, fp: a hash of the word sequence, sim: its SimHash, keys: a bucket in each band)."""
    rng = np.random.default_rng(SEED)
    n = spec.bands * spec.rows
    mul, add = rng.integers(1, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(1, 2**63, n, np.uint64)
    for b in slices(batches):
        nodes, sims, keys = [], [], []
        for text in b.column(1).to_pylist():
            hashes = shingles(text, spec.words)
            h = np.unique(np.array(hashes or [0], np.uint64))
            low = np.full(n, 2**64 - 1, np.uint64)
            for i in range(0, len(h), 1 << 13):
                np.minimum(low, (h[i : i + (1 << 13), None] * mul + add).min(axis=0), out=low)
            nodes.append(_signed(xxhash.xxh3_64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()))))
            sims.append(majority(hashes) if hashes else 0)
            keys.append([_signed(xxhash.xxh3_64_intdigest(x.tobytes())) for x in low.reshape(spec.bands, spec.rows)])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(x, pa.int64()) for x in (nodes, sims)), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "own", "fp", "sim", "keys"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sets(batches: Iterator[pa.RecordBatch], spec: Similar) -> Iterator[pa.RecordBatch]:
    """(rep, set: the text's distinct shingles as sorted 32-bit hashes)."""
    for b in slices(batches):
        sets = []
        for text in b.column(1).to_pylist():
            h = np.array(shingles(text, spec.words) or [0], np.uint64)
            sets.append(np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["rep", "set"])


def _similar_links(docs: DataFrame, rows: DataFrame, spec: Similar) -> DataFrame:
    """docs: (doc_id, text, own); rows: their sketches. (a, b) of fps that span the components of similar texts."""
    nodes = rows.groupBy("fp").agg(F.first("sim").alias("sim"), F.first("keys").alias("keys"))
    bands = materialize(nodes.select("fp", "sim", F.posexplode("keys").alias("t", "k")))
    shared = bands.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1").select("t", "k")
    met = materialize(bands.join(shared, ["t", "k"], "left_semi").select("t", "k", F.col("sim").alias("fp"), F.col("fp").alias("rep")))
    discard(bands)
    # one row of each text that shares a band, whose shingles are made again and travel to its buckets
    asked = rows.join(met.select(F.col("rep").alias("fp")).distinct(), "fp", "left_semi").groupBy(F.col("fp").alias("rep")).agg(F.min(F.struct("doc_id", "own")).alias("one")).alias("q")
    d = docs.alias("d")
    texts = d.join(asked, F.col("d.doc_id").eqNullSafe(F.col("q.one.doc_id")) & (F.col("d.own") == F.col("q.one.own"))).select("q.rep", "d.text")
    sets = materialize(texts.mapInArrow(lambda it: _sets(it, spec), "rep bigint, set binary").dropDuplicates(["rep"]))
    return _solve(tiles(met, spec.tile).join(sets, "rep").select("t", "k", "tile", "fp", "rep", "set"), spec)


def drop_near_duplicates(docs: DataFrame, spec: Similar | None = None) -> DataFrame:
    """docs without the rows that another document of their group represents: the smallest doc_id stays.

    spec: links texts by their similarity; else fingerprints of 3 or fewer differing bits are linked. Rows are judged by
    their own text, so groups aren't linked by doc_id: where a doc_id is repeated, only its rows that are copies go.
    A row with a null doc_id stays.
    """
    own = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), own.alias("own"))
    if spec:
        fps = materialize(texts.mapInArrow(lambda it: _sketches(it, spec), "doc_id bigint, own bigint, fp bigint, sim bigint, keys array<bigint>"))
    else:
        fps = materialize(texts.mapInArrow(_fingerprints, "doc_id bigint, fp bigint, own bigint"))
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    found = _similar_links(texts, fps, spec) if spec else links(nodes.select("fp", F.col("fp").alias("rep")), nodes.count())
    groups = materialize(components(found))
    gone = join_spread(fps, _named(nodes, groups), "fp", nodes).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"), F.col("own").alias("__own"))
    return docs.join(gone, (docs["doc_id"] == gone["__gone"]) & (own == gone["__own"]), "left_anti")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash": op3_simhash}
