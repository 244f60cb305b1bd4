"""Operator 10: byte-level BPE encoding and decoding, by a rank queue of hierarchical bitmaps.

Symbols are a linked list. Every adjacent pair that has a merge rank waits in the bucket of that rank, which holds list
positions, leftmost first; a bitmap of the ranks in words, and above it a word that marks which of these aren't empty,
give the least rank by two find-first-set steps. A merge pushes the two new pairs; an entry whose pair has changed
meanwhile is stale, and skipped when it comes up. So a pre-token of n bytes takes O(n log n), however long.

All pre-tokens of a batch that the worker doesn't know yet share one list, cut between them, and one queue: what the
queue picks for one pre-token never depends on another, so each merges as it would alone, and a bucket is emptied in
one go, up to a merge that makes a pair of lower rank. Documents are encoded in parallel; pre-tokens that come again in
a worker are remembered, at most ``REMEMBERED`` of them and those of one batch.

Null and odd input: a null text is empty and has no tokens. Rows are encoded one by one, so repeated rows, ties, null
ids and extra columns (carried in a struct) change nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table

REMEMBERED = 360_000

#: Characters of Unicode's White_Space, spelled out since regex engines differ about 1C to 1F.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Texts of these characters alone (Latin letters, digits, punctuation) are split alike by the faster engine.
_PLAIN = re.compile("[\\x00-\\x1b\\x20-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]*")
_FAST = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")


def splitter(pattern: str):
    """A function from a text to its pre-tokens, for the public pattern."""
    import regex

    whole = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))
    return lambda text: _FAST.findall(text) if _PLAIN.fullmatch(text) else whole.findall(text)


class RankQueue:
    """Positions by merge rank; gives the least rank's positions, leftmost first.

    Two levels of bitmaps: words of 256 ranks, and one top word with a bit for each word that isn't empty.
    """

    BIT = [1 << i for i in range(256)]

    def __init__(self, ranks: int):
        self.low = [0] * (ranks + 255 >> 8)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, *at: int) -> None:
        if (held := self.buckets.get(rank)) is not None:
            held.extend(at)
            return
        self.buckets[rank] = list(at)
        word = rank >> 8
        if not self.low[word]:
            self.top |= 1 << word
        self.low[word] |= self.BIT[rank & 255]

    def take(self) -> tuple[int, list[int]] | None:
        """The least rank and all its positions, leftmost first; None if the queue is empty."""
        if not self.top:
            return None
        word = (self.top & -self.top).bit_length() - 1
        bits = self.low[word]
        bit = bits & -bits
        self.low[word] = bits ^ bit
        if bits == bit:
            self.top &= self.top - 1
        rank = (word << 8) + bit.bit_length() - 1
        held = self.buckets.pop(rank)
        held.sort()
        return rank, held

    def pop(self) -> tuple[int, int] | None:
        """The least rank and its leftmost position."""
        if (least := self.take()) is None:
            return None
        rank, (at, *rest) = least
        if rest:
            self.push(rank, *rest)
        return rank, at


class Bpe:
    def __init__(self, ranks_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        self.vocab = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.vocab[rank] = token
        self.queue = RankQueue(len(self.vocab))
        self.split = splitter(pattern)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @cached_property
    def pairs(self) -> dict[int, int]:
        """Rank of the token that two tokens make: every way to cut each token in two. Two ids to a key."""
        ranks, out = self.ranks, {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    out[a << 32 | b] = rank
        return out

    @cached_property
    def bytes_table(self) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of single bytes, and of the tokens that two bytes make, -1 for none."""
        one = np.array([self.ranks[bytes([c])] for c in range(256)], np.int64)
        return one, np.array([self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each pre-token."""
        whole = list(map(self.ranks.get, pieces))
        cut = [p for p, w in zip(pieces, whole, strict=True) if w is None and p]
        merged = iter(self._merge(cut) if cut else ())
        return [next(merged) if w is None and p else [] if w is None else [w] for p, w in zip(pieces, whole, strict=True)]

    def encode_piece(self, piece: bytes) -> list[int]:
        return self.encode_pieces([piece])[0]

    def _merge(self, pieces: list[bytes]) -> list[list[int]]:
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n, ends = len(raw), np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        one, two = self.bytes_table
        first = np.full(n, -1)
        first[:-1] = two[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        first[ends - 1] = -1  # no pair reaches over the end of a pre-token
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends[:-1]] = -1
        part, pair, right, left = one[raw].tolist(), first.tolist(), after.tolist(), before.tolist()
        queue, rank_of = self.queue, self.pairs.get
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        for at in np.split(order, np.flatnonzero(np.diff(first[order])) + 1) if len(order) else []:
            queue.push(int(first[at[0]]), *at.tolist())
        push, get = queue.push, queue.buckets.get
        while (least := queue.take()) is not None:
            r, held = least
            for k, i in enumerate(held):
                if pair[i] != r:
                    continue  # stale
                part[i] = r
                j = right[i]
                part[j] = pair[j] = -1
                lower = False
                e = right[i] = right[j]
                if e >= 0:
                    left[e] = i
                    pair[i] = x = rank_of(r << 32 | part[e], -1)
                    if x >= 0:
                        if (b := get(x)) is not None:
                            b.append(i)
                        else:
                            push(x, i)
                            lower = x < r
                else:
                    pair[i] = -1
                if (h := left[i]) >= 0:
                    pair[h] = x = rank_of(part[h] << 32 | r, -1)
                    if x >= 0:
                        if (b := get(x)) is not None:
                            b.append(h)
                        else:
                            push(x, h)
                            lower |= x < r
                if lower:  # goes before what is left of this bucket
                    if k + 1 < len(held):
                        push(r, *held[k + 1 :])
                    break
        out, at = [], 0
        for end in ends.tolist():
            out.append([p for p in part[at:end] if p >= 0])
            at = end
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text, as little-endian unsigned 32-bit integers."""
        known, older = self.known, self.older
        split = list(map(self.split, texts))
        fresh = set().union(*split).difference(known)
        again = [p for p in fresh if p in older]
        known.update(zip(again, map(older.__getitem__, again), strict=True))
        new = list(fresh.difference(again))
        known.update(zip(new, (struct.pack(f"<{len(ids)}I", *ids) for ids in self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in new])), strict=True))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        if len(known) > REMEMBERED // 2:  # pre-tokens not met in a generation are forgotten
            self.older, self.known = known, {}
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, Bpe] = {}


def _loaded(held) -> Bpe:
    """The worker's tokenizer of this vocabulary and pattern."""
    raw, pattern = held.value
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(raw, pattern)
    return _LOADED[key]


def vocabulary(spark, path: str, pattern: str):
    """The rank file, under a megabyte, broadcast once."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((f.read(), pattern))


def encode(docs: DataFrame, held) -> DataFrame:
    """(doc: all columns but text in a struct, ids: binary, four bytes a token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(held)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bpe.encode([x or "" for x in b.column(1).to_pylist()]), pa.binary())], names=["doc", "ids"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], T.StructField("ids", T.BinaryType())]))


def decode(encoded: DataFrame, held) -> DataFrame:
    """encoded with a column ``decoded``, the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(held)
        for b in slices(batches):
            ids = b.column(b.schema.get_field_index("ids")).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([bpe.decode(x) for x in ids], pa.binary())], names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, held) -> DataFrame:
    """decode(encode(docs)), by one Python worker instead of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(held)
        for b in slices(batches):
            ids = bpe.encode([x or "" for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary())], names=["doc", "ids", "decoded"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]))


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded bytes."""
    import public_tokenizers

    held = vocabulary(docs.sparkSession, path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
    out = round_trip(docs.select("doc_id", "text"), held)
    return out.select("doc.doc_id", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
