"""Operator 12: benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ten consecutive words (a shorter item is one window). The windows are the sets to join,
their three-word shingles the tokens. Shingles are ordered by how rare they are in all documents. A window has to be
contained whole, so its necessary prefix is one shingle, the rarest: a document holds the window only where it holds
that shingle. Documents are read as positions of shingles and looked up in the prefixes; a match at a position gives
the one place where the window can start (positional bound), which has to leave room for it inside the document
(length bound); then the words of the document at that place are compared with the window's. A window with a shingle
that no document has can't occur and isn't looked up at all.

Everything is DataFrame and SQL functions. Prefixes are broadcast in blocks of ``block_bytes`` at most, a pass over the
documents for each, so that a benchmark of any size has bounded broadcasts; documents' words are never shuffled, only
windows that were found and one row a document.

Null and empty texts have no words and are never contaminated; rows with equal doc_id are documents of their own.
Items of no words have no windows. Items that share an item_id are one item; one without an item_id marks words, but
isn't counted or named. Repeated windows, in an item or between items, are looked up once. An empty benchmark leaves
all documents clean, an empty table of documents gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

#: What separates words, once A-Z are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Overlap:
    words: int = 10
    shingle: int = 3
    #: bytes of prefixes that are broadcast at a time
    block_bytes: int = 32 << 20


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def shingle_key(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(words, at + i) for i in range(size)])


def windows(benchmark: DataFrame, overlap: Overlap) -> tuple[DataFrame, DataFrame]:
    """(window, words, n) of the distinct windows, and (window, item_id) of the items that have them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - overlap.words, F.lit(0))))
    rows = items.select("item_id", "w", at.alias("at")).select("item_id", F.slice("w", F.col("at") + 1, F.lit(overlap.words)).alias("words"))
    distinct = materialize(rows.select("words").distinct().select(F.monotonically_increasing_id().alias("window"), "words", F.size("words").alias("n")))
    owners = materialize(rows.where("item_id IS NOT NULL").join(distinct, "words").select("window", "item_id").distinct())
    return distinct, owners


def _blocks(rows: DataFrame, key: str, size: Column, overlap: Overlap) -> list[DataFrame]:
    """rows, a written table, cut by key into broadcasts of bounded size; none for no rows."""
    total = rows.agg(F.sum(size)).first()[0]
    if total is None:
        return []
    n = math.ceil(total / overlap.block_bytes) or 1
    return [F.broadcast(rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == k)) for k in range(n)]


def _positions(docs: DataFrame, sizes: list[int], first: int) -> DataFrame:
    """(row, doc_id, words, n_words, pos, key): the shingles of each document at each position from ``first`` on."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), tokens(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    # a document of no words has no position but the one before the first
    at = rows.select("*", F.explode(F.sequence(F.lit(first), F.greatest(F.col("n_words"), F.lit(first + 1)) - 1)).alias("pos"))
    keys = [shingle_key(F.col("words"), F.col("pos"), s) for s in sizes]
    key = keys[0] if len(keys) == 1 else F.explode(F.array(*keys))
    return at.select("*", key.alias("key"))


def prefixes(docs: DataFrame, distinct: DataFrame, overlap: Overlap) -> DataFrame:
    """(key, at, window, words, n): each window that can occur, by its rarest shingle and the shingle's place in it."""
    size = F.least(F.lit(overlap.shingle), F.col("n"))
    by_size = reduce(lambda c, s: c.when(size == s, shingle_key(F.col("words"), F.col("at"), s)), range(1, overlap.shingle + 1), F.when(F.lit(False), F.lit(0).cast("bigint")))
    shingles = materialize(distinct.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - size)).alias("at")).select("*", by_size.alias("key")))
    keys, sizes = shingles.select("key").distinct(), _sizes(distinct, overlap)
    counts = None
    for block in _blocks(materialize(keys), "key", F.lit(32), overlap):
        found = _positions(docs, sizes, 0).select("key").join(block, "key").groupBy("key").agg(F.count("*").alias("df"))
        counts = found if counts is None else counts.union(found)
    if counts is None:
        return shingles.where("FALSE")
    ranked = shingles.join(materialize(counts), "key", "left")
    order = F.struct(F.col("df"), F.col("key"), F.col("at"))
    rarest = ranked.groupBy("window").agg(F.min(order).alias("p"), F.every(F.col("df").isNotNull()).alias("can"))
    return materialize(rarest.where("can").select("window", "p.key", "p.at").join(distinct, "window"))


def _sizes(distinct: DataFrame, overlap: Overlap) -> list[int]:
    """Shingle sizes in use, 1 to ``overlap.shingle``: short windows have short shingles."""
    return sorted(r[0] for r in distinct.select(F.least(F.lit(overlap.shingle), F.col("n"))).distinct().collect()) or [overlap.shingle]


def occurrences(docs: DataFrame, distinct: DataFrame, overlap: Overlap) -> DataFrame:
    """(row, doc_id, n_words, start, n, window): a row per document with null window, and one per window in it."""
    found, sizes = None, _sizes(distinct, overlap)
    size = F.lit(64) + F.octet_length(F.array_join("words", " ")) + F.lit(32) * F.col("n")
    for k, block in enumerate(_blocks(prefixes(docs, distinct, overlap), "key", size, overlap)):
        d, p = _positions(docs, sizes, -1 if k == 0 else 0), block.withColumnsRenamed({"key": "p_key", "words": "p_words"})
        if len(sizes) > 1:
            d = d.where((F.col("pos") >= 0) | (F.col("key") == shingle_key(F.col("words"), F.col("pos"), sizes[0])))
        start = F.col("pos") - F.col("at")
        holds = (F.col("key") == F.col("p_key")) & (F.col("pos") >= 0) & (start >= 0) & (start + F.col("n") <= F.col("n_words"))
        same = F.when(holds, F.slice("words", F.greatest(start + 1, F.lit(1)), F.greatest(F.col("n"), F.lit(0))) == F.col("p_words"))
        met = d.join(p, (F.col("key") == F.col("p_key")) & holds & same, "left").where("pos = -1 OR window IS NOT NULL")
        met = met.select("row", "doc_id", "n_words", start.alias("start"), "n", "window")
        found = met if found is None else found.union(met)
    if found is None:
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("n", "int"), ("window", "bigint"))]
        return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size(tokens(F.col("text"))).alias("n_words"), *nothing)
    return materialize(found)


def contamination(docs: DataFrame, benchmark: DataFrame, overlap: Overlap = Overlap()) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated), a row per row of docs; items: sorted as strings."""
    distinct, owners = windows(benchmark, overlap)
    found = occurrences(docs.select("doc_id", "text"), distinct, overlap)
    hits = found.where("window IS NOT NULL")
    # words under the union of intervals: what each adds to those that start before it
    before = F.max(F.col("start") + F.col("n")).over(Window.partitionBy("row").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1))
    added = F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", F.coalesce(before, F.lit(0))))
    words = hits.select("row", added.alias("added")).groupBy("row").agg(F.sum("added").alias("n_hit"))
    named = hits.select("row", "window").distinct().join(owners, "window").select("row", "item_id").distinct()
    items = named.groupBy("row").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("items"))
    out = found.where("window IS NULL").select("row", "doc_id", "n_words").join(words, "row", "left").join(items, "row", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), n("n_hit"), n("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def op12_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op12_sql(overlap: Overlap = Overlap()) -> str:
    k = overlap.words
    words = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BETWEEN}'), lambda x: x <> '')"
    return f"""
WITH i AS (SELECT item_id::VARCHAR AS item_id, {words} AS w FROM benchmark),
b AS (SELECT DISTINCT item_id, least(len(w), {k}) AS n, array_to_string(list_slice(w, s, s + {k} - 1), ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {k} + 1, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, w FROM (SELECT doc_id, {words} AS w FROM documents)),
p AS (SELECT r, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
h AS (SELECT DISTINCT r, s, n, item_id FROM p JOIN b USING (win, n)),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS x FROM (SELECT DISTINCT r, s, n FROM h)) GROUP BY r),
q AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN q USING (r)"""


QUERIES = {"op12_decontaminate": op12_decontaminate}
SQL = {"op12_decontaminate": op12_sql()}
