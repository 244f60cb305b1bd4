"""Operator 4: removes byte strings that also start in an earlier document, by names of anchors and of windows.

Prefix doubling as sorts of rank pairs was built and left: it returned the same rows, but all positions of the corpus
wrote 46 times the text in seven shuffles, and a fifth of all positions survives the anchors below, so rounds over
these alone would still write some nine times the text. Names stand for ranks here: equal for equal strings, doubled up
inside a task (a name at length 2h is made of the names at h of two positions h apart), and positions whose name is in
one document only leave. There are two rounds:

1. Every window of ``length`` bytes picks one anchor in it, the start of its least-hashing ``anchor``-byte string, so
   that equal windows pick equal anchors at equal offsets. Names of anchors, doubled up inside the task from 1 byte to
   ``anchor`` bytes, are dealt by range and sorted; those in one document only are unique and leave, and all windows
   that picked them with them. Whole texts are named too: exact copies of an earlier document go at once.
2. Windows of the surviving anchors go on, as runs of neighbouring windows with their bytes. Their names double up to
   ``length`` (the last pair overlaps), are sorted, and each string gets the least document that holds it. A window is
   removed if that is a smaller one than its own.

Names only bring windows together: before a window is removed its bytes are compared with those of the least document's,
and strings whose names are equal by chance are told apart. Whole texts are compared by 128 bits. A chunk of documents
sends a run of windows that many of its documents share once, with the least of them, so a passage that a third of all
documents hold is pre-aggregated before the shuffle. An anchor with more than ``hot`` such runs in all would fill a
bucket by itself, as a phrase of 20 bytes in ever other surroundings does: its windows go one by one, by 128 bits of
name, to the bucket of their own name, so that no bucket grows with the corpus. Texts are dealt to chunks once; each
step recomputes the chunk's anchors rather than shuffle them.

A chunk and a bucket share a row. Above ``even`` bytes of text both grow with the root of the corpus, so that rows grow
as the corpus does, and a task's memory as its root; a bucket's windows are ranked a part at a time, which doesn't grow.

Null and odd input: a null text has no bytes. Rows with equal doc_id are one document and never remove each other's
bytes. A null doc_id counts as smaller than every other. Texts below ``length`` bytes stay whole. An empty table gives
an empty result. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

NO_ID = -(2**63)


@dataclass(frozen=True)
class Repeats:
    length: int = 50
    anchor: int = 20
    #: bytes of text to a chunk, and bytes of the corpus to a bucket of names, about
    chunk_bytes: int = 2 << 20
    bucket_bytes: int = 4 << 20
    #: bytes of the corpus above which chunks and buckets both grow, with its root
    even: int = 1 << 30
    #: runs of an anchor above which its windows are dealt by their own names
    hot: int = 20_000

    def dealt(self, total: int) -> tuple[int, int, int]:
        """Chunks, buckets and the parts of a bucket, for so many bytes of text."""
        grown = max(1.0, math.sqrt(total / self.even))
        return 1 + int(total / (self.chunk_bytes * grown)), 1 + int(total / (self.bucket_bytes * grown)), math.ceil(grown)


#: A long text is searched in slices of so many windows; an index into a slice has to fit the low bits of a key.
SLICE, LOW = 1 << 19, np.uint64((1 << 20) - 1)
_rng = np.random.default_rng(20)
_FAMILIES = [(_rng.integers(1, 2**63, 256, np.uint64), {h: np.uint64(_rng.integers(1, 2**62, dtype=np.uint64) * 2 + 1) for h in (1, 2, 4, 8, 16, 32)}) for _ in range(2)]


def names(text: np.ndarray, length: int, family: int = 0) -> np.ndarray:
    """Names of all strings of so many bytes along the last axis, doubled up from single bytes; 2 <= length <= 64."""
    of_byte, step = _FAMILIES[family]
    h, x = 1, of_byte[text]
    while h * 2 <= length:
        x = x[..., :-h] * step[h] + x[..., h:]
        h *= 2
    if h < length:  # the last pair overlaps
        x = x[..., : x.shape[-1] - (length - h)] * step[h] + x[..., length - h :]
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def runs(text: np.ndarray, spec: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor names, first window, last window) of the runs of windows with one anchor."""
    reach = spec.length - spec.anchor + 1
    out = [[], [], []]
    for s in range(0, len(text) - spec.length + 1, SLICE):
        h = names(text[s : s + SLICE + spec.length - 1], spec.anchor)
        least, w = (h & ~LOW) | np.arange(len(h), dtype=np.uint64), 1
        while w * 2 <= reach:
            least = np.minimum(least[:-w], least[w:])
            w *= 2
        if w < reach:
            least = np.minimum(least[: len(least) - (reach - w)], least[reach - w :])
        at = (least & LOW).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        last = np.append(first[1:], len(at)) - 1
        name = h[at[first]]  # the least of many: mixed anew, so that names spread evenly over ranges
        name = (name ^ (name >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        for o, x in zip(out, (name ^ (name >> np.uint64(32)), first + s, last + s), strict=True):
            o.append(x)
    return tuple(np.concatenate(o) if o else np.zeros(0, t) for o, t in zip(out, (np.uint64, np.int64, np.int64), strict=True))


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of equal width."""
    return ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _by_bucket(x: np.ndarray, buckets: int, parts: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(bucket, which names are in it, part by part; how many are in each of its parts)."""
    fine = _bucket(x, buckets * parts)
    order = np.argsort(fine, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(fine[order] // parts)) + 1) if len(order) else []:
        b = int(fine[own[0]]) // parts
        yield b, own, np.bincount(fine[own] - b * parts, minlength=parts).astype(np.int32).tobytes()


class Chunk:
    """The documents of a chunk in a fixed order, with their anchors."""

    def __init__(self, t: pa.Table, spec: Repeats):
        ids = [NO_ID if x is None else x for x in t.column("doc_id").to_pylist()]
        raw = [(x or "").encode("utf-8", "surrogatepass") for x in t.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], raw[i]))
        self.spec, self.rows = spec, order
        self.ids, self.raw = [ids[i] for i in order], [raw[i] for i in order]
        self.text = [np.frombuffer(x, np.uint8) for x in self.raw]
        self.long = [i for i, x in enumerate(self.raw) if len(x) >= spec.length]
        found = [runs(self.text[i], spec) for i in self.long]
        self.size = [len(x[0]) for x in found]
        cat = lambda k, t: np.concatenate([x[k] for x in found]) if found else np.zeros(0, t)
        self.name, self.first, self.last = cat(0, np.uint64), cat(1, np.int64), cat(2, np.int64)
        self.of = np.repeat(np.array(self.long, np.int64), self.size)
        self.every, self.where = np.unique(self.name, return_inverse=True)
        whole = [xxhash.xxh3_128_intdigest(self.raw[i]) for i in self.long]
        self.digest, self.digest_low = np.array([x >> 64 for x in whole], np.uint64), np.array([x & (1 << 64) - 1 for x in whole], np.uint64)
        self.digest_order = np.lexsort((self.digest_low, self.digest))

    def shared_inside(self) -> np.ndarray:
        """Whether a name is in more than one document of this chunk."""
        ids = np.array(self.ids, np.int64)[self.of]
        low, high = np.full(len(self.every), 2**63 - 1), np.full(len(self.every), -(2**63))
        np.minimum.at(low, self.where, ids)
        np.maximum.at(high, self.where, ids)
        return low < high

    def flags(self, ranked: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which names survive, which texts are copies, which names are hot. ranked: (bucket, these as bits), for all buckets."""
        ranked = sorted(ranked)
        counts = lambda x: dict(zip(*(c.tolist() for c in np.unique(_bucket(x, self.buckets), return_counts=True)), strict=True))
        of_names, of_texts = counts(self.every), counts(self.digest)
        bits = lambda k, n: np.concatenate([_unpacked(f[k], n.get(f[0], 0)) for f in ranked]) if ranked else np.zeros(0, bool)
        return bits(1, of_names), bits(2, of_texts), bits(3, of_names)

    def pieces(self, alive: np.ndarray, copies: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple], "Hot"]:
        """The arguments are what `flags` returns.

        Returns the documents that are copies; the runs that go on and the runs that stand for them, equal ones of a
        chunk being sent once, by the least document; by bucket (bucket, runs, their bytes, their lengths, how many are
        in each part); and the windows of the runs of hot names.
        """
        copied = np.zeros(len(self.raw), bool)
        copied[np.array(self.long, np.int64)[self.digest_order]] = copies
        go = np.flatnonzero(alive[self.where] & ~copied[self.of]) if len(alive) else np.zeros(0, np.int64)
        whole = [self.raw[d][a : b + self.spec.length] for d, a, b in zip(self.of[go].tolist(), self.first[go].tolist(), self.last[go].tolist(), strict=True)]
        seen: dict[bytes, int] = {}
        lead = np.array([seen.setdefault(x, i) for i, x in enumerate(whole)], np.int64)  # documents are in order: the first is the least
        out = []
        heads = np.flatnonzero(lead == np.arange(len(lead)))
        is_hot = hot[self.where[go[heads]]] if len(heads) else np.zeros(0, bool)
        singles = Hot(heads[is_hot], [whole[i] for i in heads[is_hot].tolist()], np.array(self.ids, np.int64)[self.of[go[heads[is_hot]]]], self.spec)
        heads = heads[~is_hot]
        for bucket, part, counts in _by_bucket(self.name[go[heads]], self.buckets, self.parts):
            own = heads[part]
            out.append((bucket, own, b"".join(whole[i] for i in own.tolist()), np.array([len(whole[i]) for i in own.tolist()], np.uint8), counts))
        return copied, np.stack([go, lead]) if len(go) else np.zeros((2, 0), np.int64), out, singles

    buckets, parts = 1, 1


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8))[:n].astype(bool)


class Hot:
    """The windows of a chunk's runs of hot names: each string once, by two names, with the least document that holds it."""

    def __init__(self, heads: np.ndarray, whole: list[bytes], ids: np.ndarray, spec: Repeats):
        self.heads, self.ids = heads, ids
        h = [[names(np.frombuffer(x, np.uint8), spec.length, family) for x in whole] for family in (0, 1)]
        self.run = np.repeat(np.arange(len(whole)), [len(x) for x in h[0]])
        pair = np.stack([np.concatenate(x) if x else np.zeros(0, np.uint64) for x in h], axis=1)
        self.pair, self.where = np.unique(pair, axis=0, return_inverse=True) if len(pair) else (pair, np.zeros(0, np.int64))
        self.where = self.where.ravel()
        self.least = np.full(len(self.pair), 2**63 - 1)
        np.minimum.at(self.least, self.where, ids[self.run])

    def sent(self, buckets: int, parts: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
        """(bucket, the strings in it, by number; how many are in each of its parts)."""
        return _by_bucket(self.pair[:, 0], buckets, parts)

    def masks(self, earlier: np.ndarray) -> np.ndarray:
        """For each run, a bit for each window that a smaller document holds. earlier: strings held outside by one smaller still."""
        gone = earlier[self.where] | (self.least[self.where] < self.ids[self.run])
        offset = np.arange(len(self.run)) - np.searchsorted(self.run, self.run)
        out = np.zeros(len(self.heads), np.uint64)
        np.bitwise_or.at(out, self.run[gone], np.uint64(1) << offset[gone].astype(np.uint64))
        return out


def _chunk(t: pa.Table, spec: Repeats, buckets: int, parts: int = 1) -> Chunk:
    c = Chunk(t, spec)
    c.buckets, c.parts = buckets, parts
    return c


_SENT = "bucket int, chunk bigint, kind int, a binary, b binary, c binary, d binary, e binary, f binary"


def _rows(rows: list[tuple], kinds: tuple, columns: list[str]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=columns)


_SENT_KINDS, _SENT_NAMES = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6), ["bucket", "chunk", "kind", *"abcdef"]
_BACK = "chunk bigint, kind int, bucket int, a binary, b binary, c binary"
_BACK_KINDS, _BACK_NAMES = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 3), ["chunk", "kind", "bucket", *"abc"]


def _planes(x: np.ndarray) -> bytes:
    """The upper 48 bits of sorted names, byte by byte, which compresses well."""
    return x.view(np.uint8).reshape(-1, 8)[:, 2:].T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    p = np.frombuffer(raw, np.uint8).reshape(6, -1)
    out = np.zeros((p.shape[1], 8), np.uint8)
    out[:, 2:] = p.T
    return out.view(np.uint64).ravel()


def _send_names(t: pa.Table, spec: Repeats, buckets: int) -> pa.Table:
    c = _chunk(t, spec, buckets)
    chunk, ids = t.column("chunk")[0].as_py(), np.array(c.ids, np.int64)
    shared, digest, low = c.shared_inside(), c.digest[c.digest_order], c.digest_low[c.digest_order]
    owner = ids[np.array(c.long, np.int64)][c.digest_order] if c.long else np.zeros(0, np.int64)
    n_runs = np.minimum(np.bincount(c.where, minlength=len(c.every)), 255).astype(np.uint8)
    of_name, of_text = _bucket(c.every, buckets), _bucket(digest, buckets)
    out = []
    for b in np.union1d(of_name, of_text).tolist():
        i, j = np.searchsorted(of_name, [b, b + 1])
        k, m = np.searchsorted(of_text, [b, b + 1])
        out.append((b, chunk, 0, _planes(c.every[i:j]), np.packbits(shared[i:j]).tobytes(), digest[k:m].tobytes(), owner[k:m].tobytes(), n_runs[i:j].tobytes(), low[k:m].tobytes()))
    return _rows(out, _SENT_KINDS, _SENT_NAMES)


def _rank_names(t: pa.Table, spec: Repeats) -> pa.Table:
    """Which names of a bucket are in two documents or more, which are hot, and which texts are copies of an earlier document's."""
    sent = [_from_planes(x) for x in t.column("a").to_pylist()]
    inside = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(s)] for x, s in zip(t.column("b").to_pylist(), sent, strict=True)]
    _, where, n = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    n = n + np.bincount(where, weights=np.concatenate(inside), minlength=len(n))
    n_runs = np.bincount(where, weights=np.frombuffer(b"".join(t.column("e").to_pylist()), np.uint8), minlength=len(n))
    cuts = np.cumsum([len(s) for s in sent])[:-1]
    alive, hot = np.split(n[where] > 1, cuts), np.split(n_runs[where] > spec.hot, cuts)
    high, owners, low = ([np.frombuffer(x, k) for x in t.column(c).to_pylist()] for c, k in (("c", np.uint64), ("d", np.int64), ("f", np.uint64)))
    _, where = np.unique(np.stack([np.concatenate(high), np.concatenate(low)], axis=1), axis=0, return_inverse=True)
    where, owner = where.ravel(), np.concatenate(owners)
    least = np.full(where.max(initial=-1) + 1, 2**63 - 1)
    np.minimum.at(least, where, owner)
    copies = np.split(owner > least[where], np.cumsum([len(s) for s in high])[:-1])
    pack = lambda x: np.packbits(x).tobytes()
    rows = [(c, 0, b, pack(x), pack(y), pack(z)) for c, b, x, y, z in zip(t.column("chunk").to_pylist(), t.column("bucket").to_pylist(), alive, copies, hot, strict=True)]
    return _rows(rows, _BACK_KINDS, _BACK_NAMES)


def _of_kind(t: pa.Table, kind: int, columns: str = "abc") -> list[tuple]:
    """(bucket, columns...) of the rows of a kind."""
    return [x for k, *x in zip(*(t.column(c).to_pylist() for c in ("kind", "bucket", *columns)), strict=True) if k == kind]


def _send_windows(docs: pa.Table, back: pa.Table, spec: Repeats, buckets: int, parts: int) -> pa.Table:
    """Kind 0: the chunk's flags, for its last step. Kind 1: runs of windows with their bytes, by anchor. Kind 2: windows of hot anchors, by their own names."""
    out = []
    if docs.num_rows:
        c, chunk = _chunk(docs, spec, buckets, parts), docs.column("chunk")[0].as_py()
        flags = c.flags(_of_kind(back, 0))
        _, (go, _), runs_, hot = c.pieces(*flags)
        ids = np.array(c.ids, np.int64)
        out = [(chunk % buckets, chunk, 0, *(np.packbits(x).tobytes() for x in flags), b"", b"", b"")]
        out += [(b, chunk, 1, raw, size.tobytes(), ids[c.of[go[own]]].tobytes(), counts, b"", b"") for b, own, raw, size, counts in runs_]
        out += [(b, chunk, 2, hot.pair[own, 0].tobytes(), hot.pair[own, 1].tobytes(), hot.least[own].tobytes(), counts, b"", b"") for b, own, counts in hot.sent(buckets, parts)]
    return _rows(out, _SENT_KINDS, _SENT_NAMES)


def _part_by_part(t: pa.Table, kind: int) -> Iterator[pa.Table]:
    """A bucket's rows of a kind, cut to one of its parts after the other."""
    a, b, c, d = (t.column(x).to_pylist() for x in "abcd")
    counts = np.array([np.frombuffer(x, np.int32) for x in d], np.int64)
    stop = np.cumsum(counts, axis=1)
    wide = [8, 8, 8] if kind == 2 else [1, 1, 8]
    ends = [np.append(0, np.cumsum(np.frombuffer(x, np.uint8), dtype=np.int64)) for x in b] if kind == 1 else []
    for k in range(counts.shape[1]):
        lo, hi = (stop - counts)[:, k].tolist(), stop[:, k].tolist()
        first = zip((e[i] for e, i in zip(ends, lo, strict=True)), (e[j] for e, j in zip(ends, hi, strict=True)), strict=True) if kind == 1 else zip(lo, hi, strict=True)
        cut = [[x[i * w : j * w] for x, (i, j) in zip(col, at, strict=True)] for col, w, at in zip((a, b, c), wide, (first, zip(lo, hi, strict=True), zip(lo, hi, strict=True)), strict=True)]
        yield pa.table([pa.array(x, pa.binary()) for x in cut], names=["a", "b", "c"])


def _rank_windows(t: pa.Table, spec: Repeats) -> pa.Table:
    """For each run of a bucket, a bit for each window that a smaller document holds too; for each window of a hot anchor, the same.

    A chunk's flags pass through.
    """
    kinds = np.array(t.column("kind").to_pylist())
    held = t.filter(pa.array(kinds == 0))
    rows = [(chunk, 0, *x) for chunk, x in zip(held.column("chunk").to_pylist(), _of_kind(held, 0), strict=True)]
    for kind, rank in ((1, _rank_runs), (2, _rank_hot)):
        own = t.filter(pa.array(kinds == kind))
        if own.num_rows:
            found = zip(*(rank(part, spec) for part in _part_by_part(own, kind)), strict=True)  # by row
            masks = (b"".join(x) if kind == 1 else np.packbits(np.concatenate(x)).tobytes() for x in found)
            rows += [(c, kind, b, x, b"", b"") for c, b, x in zip(own.column("chunk").to_pylist(), own.column("bucket").to_pylist(), masks, strict=True)]
    return _rows(rows, _BACK_KINDS, _BACK_NAMES)


def _rank_hot(t: pa.Table, spec: Repeats) -> list[np.ndarray]:
    a, b, ids = ([np.frombuffer(x, k) for x in t.column(c).to_pylist()] for c, k in (("a", np.uint64), ("b", np.uint64), ("c", np.int64)))
    h, low, own = np.concatenate(a), np.concatenate(b), np.concatenate(ids)
    if not len(h):  # an empty part
        return [np.zeros(0, bool) for _ in a]
    order = np.lexsort((low, h))
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (low[order][1:] != low[order][:-1]))
    least = np.minimum.reduceat(own[order], np.flatnonzero(new))
    hit = np.zeros(len(h), bool)
    hit[order] = own[order] > least[np.cumsum(new) - 1]
    return np.split(hit, np.cumsum([len(x) for x in a])[:-1])


def _rank_runs(t: pa.Table, spec: Repeats) -> list[bytes]:
    widest = 2 * spec.length - spec.anchor
    sizes = [np.frombuffer(x, np.uint8).astype(np.int64) for x in t.column("b").to_pylist()]
    raw = np.frombuffer(b"".join(t.column("a").to_pylist()), np.uint8)
    size, ids = np.concatenate(sizes), np.concatenate([np.frombuffer(x, np.int64) for x in t.column("c").to_pylist()])
    if not len(size):  # an empty part
        return [b""] * len(sizes)
    start = np.cumsum(size) - size
    width = np.arange(widest)
    found, run, step = [], [], 5_000
    padded = np.append(raw, np.zeros(widest, np.uint8))
    for i in range(0, len(size), step):
        h = names(padded[start[i : i + step, None] + width], spec.length)
        ok = np.arange(h.shape[1]) + spec.length <= size[i : i + step, None]
        found.append(h[ok])
        run.append(np.nonzero(ok)[0] + i)
    h, run = np.concatenate(found), np.concatenate(run)
    offset = np.arange(len(run)) - np.append(0, np.cumsum(size - spec.length + 1))[run]
    owner, at = ids[run], start[run] + offset
    order = np.lexsort((owner, h))  # the first of a name is the least document's
    new = np.append(True, h[order][1:] != h[order][:-1])
    group, lead = np.cumsum(new) - 1, order[np.flatnonzero(new)]
    hit = np.zeros(len(h), bool)
    hit[order] = owner[order] > owner[lead[group]]
    # bytes decide: strings that differ from the least document's are looked at one by one
    of = np.zeros(len(h), np.int64)
    of[order] = group
    check, bytes_of, differ = np.flatnonzero(hit), np.arange(spec.length), set()
    for i in range(0, len(check), 20_000):
        x = check[i : i + 20_000]
        same = (padded[at[x][:, None] + bytes_of] == padded[at[lead[of[x]]][:, None] + bytes_of]).all(axis=1)
        differ.update(of[x[~same]].tolist())
    for g in differ:
        members = order[np.searchsorted(group, g) : np.searchsorted(group, g + 1)]  # by document
        least: dict[bytes, int] = {}
        for m in members.tolist():
            hit[m] = owner[m] > least.setdefault(padded[at[m] : at[m] + spec.length].tobytes(), owner[m])
    masks = np.zeros(len(size), np.uint64)
    np.bitwise_or.at(masks, run[hit], np.uint64(1) << offset[hit].astype(np.uint64))
    return [x.tobytes() for x in np.split(masks, np.cumsum([len(s) for s in sizes])[:-1])]


_OUT = "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary"


def _finish(docs: pa.Table, back: pa.Table, spec: Repeats, buckets: int, parts: int) -> Iterator[tuple[int | None, bytes, np.ndarray, np.ndarray]]:
    """(doc_id, text, starts, stops) of each document's removed spans."""
    c = _chunk(docs, spec, buckets, parts)
    ((_, *flags),) = _of_kind(back, 0)
    copied, (go, lead), runs_, hot = c.pieces(*(_unpacked(x, n) for x, n in zip(flags, (len(c.every), len(c.digest), len(c.every)), strict=True)))
    masks, bits = (dict(_of_kind(back, kind, "a")) for kind in (1, 2))
    of_head = np.zeros(len(go), np.uint64)
    for b, own, *_ in runs_:
        of_head[own] = np.frombuffer(masks[b], np.uint64)
    earlier = np.zeros(len(hot.pair), bool)
    for b, own, _ in hot.sent(buckets, parts):
        earlier[own] = _unpacked(bits[b], len(own))
    of_head[hot.heads] = hot.masks(earlier)
    ids = np.array(c.ids, np.int64)
    hit = of_head[lead]
    later = ids[c.of[go]] > ids[c.of[go[lead]]]  # a smaller document of this chunk holds the same run
    hit = np.where(later, ~np.uint64(0), hit)
    by_doc = np.searchsorted(c.of[go], np.arange(len(c.raw) + 1))
    wide = np.arange(spec.length - spec.anchor + 1)
    for d, raw in enumerate(c.raw):
        edge = np.zeros(len(raw) + 1, np.int64)
        if copied[d]:
            edge[0], edge[-1] = 1, -1
        else:
            own = slice(by_doc[d], by_doc[d + 1])
            first, n = c.first[go[own]], (c.last - c.first)[go[own]] + 1
            on = (hit[own, None] >> wide.astype(np.uint64) & np.uint64(1)).astype(bool) & (wide < n[:, None])
            at = (first[:, None] + wide)[on]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + spec.length, -1)
        gone = np.cumsum(edge)[:-1] > 0
        turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
        yield None if c.ids[d] == NO_ID else c.ids[d], raw, turn[::2], turn[1::2]


def _cut(docs: pa.Table, back: pa.Table, spec: Repeats, buckets: int, parts: int, digest: bool) -> pa.Table:
    out: tuple[list, list, list, list] = ([], [], [], [])
    for doc, raw, start, stop in _finish(docs, back, spec, buckets, parts) if docs.num_rows else ():
        kept = b"".join(raw[a:b] for a, b in zip([0, *stop.tolist()], [*start.tolist(), len(raw)], strict=True))
        out[0].append(doc)
        out[1].append(len(raw))
        out[2].append([{"start": a, "stop": b} for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
        out[3].append(hashlib.sha256(kept).digest() if digest else kept)
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.table([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), span, pa.binary()), strict=True)], names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, spec: Repeats = Repeats(), digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, spans: removed [start, stop) in bytes, kept: the bytes that stay), a row per row of docs.

    digest: kept is the SHA-256 of these bytes instead.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets, parts = spec.dealt(total)
    # the text is in the key only to deal rows without doc_id; equal rows share a chunk either way
    dealt = rows.select(F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(chunks)).alias("chunk"), "doc_id", "text")
    named = dealt.groupBy("chunk").applyInArrow(lambda t: _send_names(t, spec, buckets), _SENT)
    flags = named.groupBy("bucket").applyInArrow(lambda t: _rank_names(t, spec), _BACK)
    windows = dealt.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(lambda x, y: _send_windows(x, y, spec, buckets, parts), _SENT)
    masks = windows.groupBy("bucket").applyInArrow(lambda t: _rank_windows(t, spec), _BACK)
    return dealt.groupBy("chunk").cogroup(masks.groupBy("chunk")).applyInArrow(lambda x, y: _cut(x, y, spec, buckets, parts, digest), _OUT)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    length = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", length.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.lower(F.hex("kept")).alias("kept_sha256"))


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
