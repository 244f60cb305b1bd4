"""Operator 6: drops boilerplate lines, keys found in many documents, but for one holder.

Occurrences (key hash, doc, position) are range-partitioned by hash and then document, so that even a key found in
every document is dealt over many partitions, and sorted within each: by hash, largest document first, position. One
pass streams a partition and keeps the first document of each key. A key that crosses partitions is settled by the
edges of the partitions, three rows a partition at most, joined by Spark's own aggregation. What comes back is one
compressed keep bitmap per document, never text.

Null and odd input: a null or empty text is one empty line, kept. Rows with equal doc_id are one document for counts;
each row gets its own bitmap by (doc_id, text). A null doc_id sorts below every other. Keys count once per document.
Extra columns pass through ``drop_lines`` untouched. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_CHARS, materialize, shared_dir, slices, table


@dataclass(frozen=True)
class LineRules:
    min_chars: int = 40
    min_docs: int = 5


#: Stands for a null doc_id inside the shuffle: below every id.
NO_ID = -(2**63)


def line_keys(text: str, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """(position, key) of each line that is long enough."""
    for i, line in enumerate(text.split("\n")):
        if len(line) >= min_chars and len(key := line.strip(SPACE_CHARS)) >= min_chars:
            yield i, key.encode("utf-8", "surrogatepass").lower()


def _occurrences(batches: Iterator[pa.RecordBatch], rules: LineRules) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 4096):
        hi, lo, ids, marks, at = [], [], [], [], []
        for doc, text, mark in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            for i, key in line_keys(text or "", rules.min_chars):
                h = xxhash.xxh3_128_intdigest(key)
                hi.append((h >> 64) - 2**63)
                lo.append((h & (2**64 - 1)) - 2**63)
                ids.append(NO_ID if doc is None else doc)
                marks.append(mark)
                at.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((hi, pa.int64()), (lo, pa.int64()), (ids, pa.int64()), (marks, pa.int64()), (at, pa.int32()))], names=["hi", "lo", "id", "mark", "at"])


def _arrays(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    """A range partition as arrays; its size is bounded, however common a key is."""
    t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    return [c.to_numpy() for c in t.columns] if t is not None and t.num_rows else None


def _runs(hi: np.ndarray, lo: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the keys, the key number of each row, and whether a row is the first of its document in its key."""
    key = np.ones(len(hi), bool)
    key[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    doc = key.copy()
    doc[1:] |= ids[1:] != ids[:-1]
    return np.flatnonzero(key), np.cumsum(key) - 1, doc


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last key of a partition: documents, the largest and the smallest."""
    if (cols := _arrays(batches)) is None:
        return
    hi, lo, ids = cols[:3]
    starts, number, first = _runs(hi, lo, ids)
    docs = np.bincount(number, weights=first).astype(np.int64)
    ends = np.append(starts[1:], len(hi)) - 1
    pick = np.unique([0, len(starts) - 1])
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hi[starts[pick]], lo[starts[pick]], docs[pick], ids[starts[pick]], ids[ends[pick]])], names=["hi", "lo", "docs", "top", "bottom"])


def _dropped(batches: Iterator[pa.RecordBatch], rules: LineRules, shared: dict) -> Iterator[pa.RecordBatch]:
    """Positions to drop. shared: (hi, lo) -> (documents, the holder that keeps it) of keys that cross partitions."""
    if (cols := _arrays(batches)) is None:
        return
    hi, lo, ids, marks, at = cols
    starts, number, first = _runs(hi, lo, ids)
    docs, keeper = np.bincount(number, weights=first).astype(np.int64), ids[starts].copy()
    for k in {0, len(starts) - 1}:
        if known := shared.get((int(hi[starts[k]]), int(lo[starts[k]]))):
            docs[k], keeper[k] = known
    out = (docs >= rules.min_docs)[number] & (ids != keeper[number])
    yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (ids, marks, at)], names=["id", "mark", "at"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 4096):
        packed = []
        for at in (x.values.to_numpy() for x in b.column(2)):
            bits = np.ones(int(at.max()) // 8 * 8 + 8, np.uint8)
            bits[at] = 0
            packed.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["id", "mark", "bitmap"])


def keep_bitmaps(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """(id, mark, bitmap) of the documents that lose lines: zlib-compressed bits, 0 for a dropped line.

    The bitmap ends with the byte of the last dropped line; lines beyond it stay.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    occ = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text")).mapInArrow(lambda it: _occurrences(it, rules), "hi bigint, lo bigint, id bigint, mark bigint, at int")
    order = [F.col("hi"), F.col("lo"), F.col("id").desc(), F.col("at"), F.col("mark")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = occ.repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint()
    edges = ranged.mapInArrow(_edges, "hi bigint, lo bigint, docs bigint, top bigint, bottom bigint")
    # a document that ends one partition and starts the next is counted in both: neighbours share it if bottom = top
    crossing = {}
    for e in edges.groupBy("hi", "lo").agg(F.sum("docs").alias("docs"), F.max("top").alias("top"), F.count("*").alias("parts"), F.sort_array(F.collect_list(F.struct("top", "bottom")), asc=False).alias("ends")).where("parts > 1").collect():
        again = sum(a["bottom"] == b["top"] for a, b in zip(e["ends"], e["ends"][1:], strict=False))
        crossing[e["hi"], e["lo"]] = (e["docs"] - again, e["top"])

    drops = ranged.mapInArrow(lambda it: _dropped(it, rules, crossing), "id bigint, mark bigint, at int")
    return drops.groupBy("id", "mark").agg(F.collect_set("at").alias("at")).mapInArrow(_bitmaps, "id bigint, mark bigint, bitmap binary")


def _apply(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        texts, counts, drops = [], [], []
        for text, bitmap in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            lines = (text or "").split("\n")
            n, dropped = len(lines), 0
            if bitmap is not None:
                keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
                keep = np.append(keep[:n], np.ones(max(0, n - len(keep)), np.uint8))
                dropped = int(n - keep.sum())
                text = "\n".join(x for x, k in zip(lines, keep, strict=True) if k)
            counts.append(n)
            drops.append(dropped)
            texts.append(hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest() if digest else text)
        yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(counts, pa.int64()), pa.array(drops, pa.int64()), pa.array(texts, pa.string())], names=[*b.schema.names[2:], "n_lines", "n_dropped", "kept"])


def drop_lines(docs: DataFrame, rules: LineRules = LineRules(), digest: bool = False) -> DataFrame:
    """(doc: all columns of docs in a struct, n_lines, n_dropped, kept: the text without its dropped lines).

    digest: kept is the SHA-256 of that text instead, so that no text leaves the task.
    """
    marked = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if not digest or c == "doc_id"]).alias("doc"))
    left = marked.select("text", "doc", F.coalesce(F.col("doc.doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("mark"))
    bitmaps = materialize(keep_bitmaps(docs, rules))  # also so that no task packs and applies in two Python workers at once
    # a merge join at every size: bitmaps grow with the documents
    joined = left.join(bitmaps.hint("merge"), ["id", "mark"], "left").select("text", "bitmap", "doc")
    schema = T.StructType([joined.schema["doc"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])
    return joined.mapInArrow(lambda it: _apply(it, digest), schema)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return out.select("doc.doc_id", "n_lines", "n_dropped", F.col("kept").alias("kept_sha256"))


def op6_sql(rules: LineRules = LineRules()) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{upper}', '{lower}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {rules.min_chars} GROUP BY key HAVING count(DISTINCT doc_id) >= {rules.min_docs}),
f AS (SELECT k.doc_id, k.i, k.line, c.keeper IS NOT NULL AND c.keeper <> k.doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id"""


QUERIES = {"op6_line_dedup": op6_line_dedup}
SQL = {"op6_line_dedup": op6_sql()}
