"""Operator 8: scoring by a hidden Markov language model.

A token's probability is its class's under the latent state times its own within the class:
P(w | z) = B[z, class(w)] * (c(w) + 1) / (N_class + V_class + 1). Classes are a fixed number of hash buckets of words,
so the trained tables have a fixed size, while the word counts c cover every training token and stay distributed.
Baum-Welch: tasks add up expected transitions, emissions and states before the first token over their documents; Spark
sums them; K*K + K*C + K numbers come to the driver. Texts count as they are, from the first token to the last. Long
ones are cut into segments for both training and scoring, whose scaled transfer matrices carry the state over: what
comes before and after a segment is exact, so that cutting changes nothing but the order of sums. The exact likelihood
of a whole text is the scaled forward recursion.

Counting words without sending every token: a block of documents (16 MB of text) is tokenized once into local word
numbers; a row for each of its distinct words is summed up by the word's hash, with Spark's own aggregation and join,
so that a word of every block is pre-aggregated and its rows can be split; the totals come back to the block. Blocks
are written to the shared folder, so their numbering survives retries.

Null and odd input: a null or empty text is one end token. A null doc_id counts as the empty text for crc32, and so
trains. Repeated rows train twice and score alike. Extra columns are left out. An empty table gives an empty result.
With no training rows N and V are 0 and the model is uniform.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, slices, table


@dataclass(frozen=True)
class Hmm:
    states: int = 6
    classes: int = 4096
    rounds: int = 4
    #: texts above so many tokens are trained on in segments, which carry their state over
    whole: int = 1024
    segment: int = 256
    #: chance of staying in a state before training
    stay: float = 0.95
    #: weight of the corpus's class shares in a state's emissions
    prior: float = 100.0
    seed: int = 17
    held_out_modulus: int = 7
    held_out_remainder: int = 2
    block_bytes: int = 16 << 20
    #: texts that are put in order of length together, and padded tokens of them that are trained on at a time
    batch_texts: int = 4000
    batch_tokens: int = 1 << 19


#: The end of a text, which no word can be.
END = b"\n"


def is_held_out(doc_id: int | None, model: Hmm) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % model.held_out_modulus == model.held_out_remainder


_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("tokens", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])
_BLOCK_SQL = "block bigint, ids array<bigint>, lengths binary, tokens binary, words binary, counts binary"


def _blocks(batches: Iterator[pa.RecordBatch], model: Hmm) -> Iterator[pa.RecordBatch]:
    """One row per block: documents, their token numbers, the block's distinct words by hash and their training counts."""
    import uuid

    def flush(ids: list, parts: list, number: dict) -> pa.RecordBatch:
        held = np.array([is_held_out(d, model) for d in ids], bool)
        tokens = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        lengths = np.array([len(p) for p in parts], np.int32)
        counts = np.bincount(tokens[~np.repeat(held, lengths)], minlength=len(number)).astype(np.int32)
        digest = xxhash.xxh3_64_intdigest
        words = np.fromiter((digest(w) for w in number), np.uint64, len(number))
        # the name is a random word: a retried task's blocks are other rows, but only one try's rows are written
        row = [uuid.uuid4().int >> 65, ids, lengths.tobytes(), tokens.tobytes(), words.tobytes(), counts.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

    fresh = lambda: ([], [], defaultdict(count().__next__), 0)
    ids, parts, number, held = fresh()
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass").lower()
            words = raw.split()  # bytes: ASCII white space and A-Z only
            words.append(END)
            ids.append(doc)
            parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            held += len(raw) + 1
            if held >= model.block_bytes:
                yield flush(ids, parts, number)
                ids, parts, number, held = fresh()
    if ids:
        yield flush(ids, parts, number)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct word of a block: (block, local number, hash, count)."""
    for b in batches:
        for block, words, counts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            h, n = np.frombuffer(words, np.int64), np.frombuffer(counts, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), block)), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h), pa.array(n.astype(np.int64))], names=["block", "local", "h", "n"])


def class_of(hashes: np.ndarray, classes: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(classes)).astype(np.int64)


_DOC_SQL = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, within double, classes binary"


def _numbered(blocks: pa.Table, totals: pa.Table, model: Hmm, tokens: np.ndarray, types: np.ndarray) -> pa.Table:
    """The documents of a block, with what their words are worth and their classes."""
    n, v = int(tokens.sum()), int(types.sum())
    out: dict = defaultdict(list)
    for ids, lengths, numbers, words in zip(*(blocks.column(c).to_pylist() for c in ("ids", "lengths", "tokens", "words")), strict=True):
        h = np.frombuffer(words, np.uint64)
        c = np.zeros(len(h), np.int64)
        c[totals.column("local").to_numpy()] = totals.column("total").to_numpy()
        cls = class_of(h, model.classes)
        base = np.log10((c + 1) / (n + (v + 1)))
        within = np.log10((c + 1) / (tokens[cls] + types[cls] + 1))
        seq, size = np.frombuffer(numbers, np.int32), np.frombuffer(lengths, np.int32)
        ends = np.cumsum(size)
        starts = ends - size
        add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every text has a token
        codes = cls[seq].astype(np.uint16)
        out["doc_id"] += ids
        out["held_out"] += [is_held_out(d, model) for d in ids]
        out["n_tokens"] += size.tolist()
        out["n_known"] += add((c > 0).astype(np.int64)[seq]).tolist()
        out["base_score"] += add(base[seq]).tolist()
        out["within"] += add(within[seq]).tolist()
        out["classes"] += [codes[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    types_ = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
    return pa.table([pa.array(out[k], t) for k, t in zip(("doc_id", "held_out", "n_tokens", "n_known", "base_score", "within", "classes"), types_, strict=True)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "within", "classes"])


def _segments(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded segments, longest first; their lengths; and the text that each comes from."""
    seqs = [np.frombuffer(x, np.uint16) for x in texts]
    cut = [(i, s[a : a + length]) for i, s in enumerate(seqs) for a in range(0, len(s), length)]
    cut.sort(key=lambda x: -len(x[1]))
    size = np.array([len(s) for _, s in cut])
    out = np.zeros((len(cut), size[0] if len(size) else 0), np.int64)
    for k, (_, s) in enumerate(cut):
        out[k, : len(s)] = s
    return out, size, np.array([i for i, _ in cut])


def expected_counts(codes: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, first: np.ndarray, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Expected transitions (K, K) and emissions (K, C) over segments, longest first; their log-likelihood; and the
    expected state before each.

    first: the state before all segments or each; after: what follows each, as a likelihood by its last state.
    """
    k, (s, length) = a.shape[0], codes.shape
    active = np.searchsorted(-size, -np.arange(length), side="left")  # segments longer than t
    codes = np.ascontiguousarray(codes.T)  # by time, so that a step reads and writes neighbours
    e = np.ascontiguousarray(b.T)[codes]
    alpha, scale = np.zeros((length + 1, s, k)), np.ones((length + 1, s))
    alpha[0] = first
    for t in range(length):
        n = active[t]
        x = (alpha[t, :n] @ a) * e[t, :n]
        z = x.sum(axis=1)
        scale[t + 1, :n] = z
        alpha[t + 1, :n] = x / z[:, None]
    moves, gamma = np.zeros((k, k)), np.zeros((length, s, k))
    beta = np.ones((s, k)) if after is None else after / (alpha[size, np.arange(s)] * after).sum(axis=1, keepdims=True)
    for t in range(length - 1, -1, -1):
        n = active[t]
        right = e[t, :n] * beta[:n] / scale[t + 1, :n, None]
        gamma[t, :n] = alpha[t + 1, :n] * beta[:n]
        moves += alpha[t, :n].T @ right
        beta[:n] = right @ a.T
    mask = np.arange(length)[:, None] < size
    flat, shares = codes[mask], gamma[mask]
    emit = np.stack([np.bincount(flat, weights=shares[:, j], minlength=b.shape[1]) for j in range(k)])
    return moves * a, emit, float(np.log(scale).sum()), alpha[0] * beta


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of codes, and their lengths. parts: longest first."""
    size = np.array([len(p) for p in parts])
    codes = np.zeros((len(parts), size[0]), np.int64)
    for r, p in enumerate(parts):
        codes[r, : len(p)] = p
    return codes, size


def transfer(parts: list[np.ndarray], a: np.ndarray, b: np.ndarray, batch: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """The matrix from the state before each segment to the state at its end, scaled, and log10 of the scales."""
    k, bt = len(a), np.ascontiguousarray(b.T)
    matrices, logs = np.empty((len(parts), k, k)), np.zeros(len(parts))
    order = sorted(range(len(parts)), key=lambda j: -len(parts[j]))
    for g in range(0, len(order), batch):
        own = order[g : g + batch]
        codes, size = _padded([parts[j] for j in own])
        codes = np.ascontiguousarray(codes.T)
        m, log = np.repeat(np.eye(k)[None], len(own), axis=0), np.zeros(len(own))
        active = np.searchsorted(-size, -np.arange(size[0]), side="left")
        for t in range(size[0]):
            n = active[t]
            x = (m[:n].reshape(-1, k) @ a).reshape(n, k, k) * bt[codes[t, :n]][:, None, :]
            z = x.max(axis=(1, 2))
            m[:n] = x / z[:, None, None]
            log[:n] += np.log10(z)
        matrices[own], logs[own] = m, log
    return matrices, logs


def log10_likelihoods(texts: list[bytes], a: np.ndarray, b: np.ndarray, first: np.ndarray, length: int, batch: int = 1000) -> np.ndarray:
    """Exact, of each whole text: a segment is a scaled matrix, and a text the product of its segments."""
    out = np.zeros(len(texts))
    cut = [(i, p) for i, x in enumerate(texts) for p in _cut(np.frombuffer(x, np.uint16), length)]
    matrices, logs = transfer([p for _, p in cut], a, b, batch)
    v, at = None, -1
    for j, (i, _) in enumerate(cut):
        if i != at:
            v, at = first, i
        v = v @ matrices[j]
        z = v.sum()
        out[i] += np.log10(z) + logs[j]
        v = v / z
    return out


def _cut(seq: np.ndarray, length: int) -> list[np.ndarray]:
    return [seq[i : i + length] for i in range(0, len(seq), length)]


def text_counts(texts: list[bytes], model: Hmm, a: np.ndarray, b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """expected_counts of whole texts, and the expected state before a text: long ones by segments with their context."""
    k, parts, before, after, begins = len(a), [], [], [], []
    seqs = [np.frombuffer(x, np.uint16) for x in texts]
    cut = [_cut(x, model.segment) if len(x) > model.whole else [x] for x in seqs]
    matrices, at = transfer([p for own in cut if len(own) > 1 for p in own], a, b)[0], 0  # all at once: a step takes many
    for own in cut:
        left, right = [first], [np.ones(k)]
        if len(own) > 1:
            through, at = matrices[at : at + len(own)], at + len(own)
            for m in through[:-1]:
                v = left[-1] @ m
                left.append(v / v.sum())
            for m in through[:0:-1]:
                v = m @ right[-1]
                right.append(v / v.sum())
        parts += own
        before += left
        after += right[::-1]
        begins += [True, *[False] * (len(own) - 1)]
    moves, emit, log, start = np.zeros_like(a), np.zeros_like(b), 0.0, np.zeros(k)
    order, i = sorted(range(len(parts)), key=lambda j: -len(parts[j])), 0
    while i < len(order):
        own = order[i : i + max(1, model.batch_tokens // len(parts[order[i]]))]
        codes, size = _padded([parts[j] for j in own])
        m, e, x, g = expected_counts(codes, size, a, b, np.array([before[j] for j in own]), np.array([after[j] for j in own]))
        moves, emit, log, start = moves + m, emit + e, log + x, start + g[[begins[j] for j in own]].sum(axis=0)
        i += len(own)
    return moves, emit, log, start


def _count_task(batches: Iterator[pa.RecordBatch], model: Hmm, a: np.ndarray, b: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
    flat = np.zeros(a.size + b.size + 1 + len(first))
    for batch in batches:
        for part in slices([batch], model.batch_texts):
            moves, emit, log, start = text_counts(part.column(0).to_pylist(), model, a, b, first)
            flat += np.concatenate([moves.ravel(), emit.ravel(), [log], start])
    some = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], names=["i", "x"])


def train(docs: DataFrame, model: Hmm, tokens: np.ndarray, types: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions (K, K), class emissions (K, C) and the state before a text, by Baum-Welch."""
    k, c, rng = model.states, model.classes, np.random.default_rng(model.seed)
    share = (tokens + types + 1) / (tokens + types + 1).sum()
    b = share * np.exp(rng.normal(0, 0.7, (k, c)))
    b /= b.sum(axis=1, keepdims=True)
    a = np.full((k, k), (1 - model.stay) / max(1, k - 1))
    np.fill_diagonal(a, model.stay if k > 1 else 1.0)
    first = np.full(k, 1 / k)
    rows = docs.where("NOT held_out").select("classes")
    for _ in range(model.rounds):
        held = (a, b, first)
        sums = rows.mapInArrow(lambda it, held=held: _count_task(it, model, *held), "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x"))
        flat = np.zeros(k * k + k * c + 1 + k)
        for r in sums.collect():  # K*K + K*C + 1 + K numbers, whatever the input
            flat[r.i] = r.x
        moves, emit, start = flat[: k * k].reshape(k, k) + 1, flat[k * k : k * k + k * c].reshape(k, c) + model.prior * share, flat[-k:] + 1
        a, b, first = moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True), start / start.sum()
    return a, b, first


def _score_task(batches: Iterator[pa.RecordBatch], model: Hmm, a: np.ndarray, b: np.ndarray, first: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    for t in batches:
        texts = t.column(6).to_pylist()
        log = np.concatenate([log10_likelihoods(texts[i : i + 1000], a, b, first, model.segment) for i in range(0, len(texts), 1000)] or [np.zeros(0)])
        score = log + t.column(5).to_numpy()
        yield pa.RecordBatch.from_arrays([*(t.column(i) for i in range(4)), pa.array(np.full(len(texts), n)), t.column(4), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(docs: DataFrame, model: Hmm = Hmm()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    blocks = materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _blocks(it, model), _BLOCK_SQL))
    words = blocks.select("block", "words", "counts").mapInArrow(_words, "block bigint, local int, h bigint, n bigint")
    totals = materialize(words.where("n > 0").groupBy("h").agg(F.sum("n").alias("total")))
    tokens, types = np.zeros(model.classes, np.int64), np.zeros(model.classes, np.int64)
    for r in totals.groupBy(F.expr(f"shiftrightunsigned(h, 40) % {model.classes}").alias("c")).agg(F.sum("total").alias("tokens"), F.count("*").alias("types")).collect():  # a row per class
        tokens[r.c], types[r.c] = r.tokens, r.types
    # a merge join at every size: both sides grow with the corpus
    back = words.select("block", "local", "h").join(totals.hint("merge"), "h").select("block", "local", "total")
    numbered = blocks.select("block", "ids", "lengths", "tokens", "words").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(lambda x, y: _numbered(x, y, model, tokens, types), _DOC_SQL)
    rows = materialize(numbered)
    discard(blocks, totals)
    a, b, first = train(rows, model, tokens, types)
    n = int(tokens.sum())
    return rows.mapInArrow(lambda it: _score_task(it, model, a, b, first, n), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op8_hmm_score(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op8_hmm_score": op8_hmm_score}
