"""Operator 11: phrase collocations by best-first branch and bound.

Phrases are the nodes of a prefix tree: words, then pairs, triples and quadruples that grow them to the right. With A
the count of a node and c that of its first word, no phrase below it scores more than 2,000,000 * A // (c + A), since a
phrase isn't more frequent than its prefix, its rest not less frequent than itself, and x / (c + x) rises with x. Nodes
are expanded best first: a round takes, for each language, the band of bounds that holds the best nodes not yet
expanded, ``first`` of them, then ``more`` times as many, counts their extensions in one pass over the corpus for each
length, and settles all phrases that score within the band. Bands end at the same score for nodes and phrases, so what
a round has settled is complete; a language is done when it has ``top`` surviving phrases, ties included, or no nodes.

A candidate is dropped if a longer one around it is nearly as frequent. Counts fall as phrases grow, so the phrases one
word longer tell: those to the right are in the tree, those to the left are counted for candidates of the band, as are
the triples that quadruples end in.

Words are told by 64 bits of hash of language and word; the vocabulary is counted as text first, and should two of its
words share a hash, another hash is taken. Counts are grouped by the words of a phrase, not by a hash of it. A task adds
up its own counts before they are shuffled. Bitmaps of bounded size say which words, pairs and prefixes matter; one
that lets too much through costs time only, as what it lets through is counted in full and then compared exactly. Texts
are read three times (words, pairs, runs of frequent pairs), later passes read the runs.

Null and empty texts have no words; a null language is `und`. Repeated rows and ids count as often as they come. An
empty table, or one without a frequent phrase, gives no rows. Other columns are ignored. Scores and comparisons are
decimal, so that products may pass 64 bits.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, slices, table

#: Bytes of a text as they count: A-Z in lower case, tabs as spaces, ends of pieces as line ends.
_AS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
_END, _EMPTY = 0, 1


@dataclass(frozen=True)
class Mining:
    top: int = 2000
    least: int = 30
    scale: int = 2_000_000
    #: a candidate is dropped if a longer one has this share of its occurrences, in hundredths
    cover: int = 80
    first: int = 16_000
    more: int = 4
    #: bounds of nodes are put in classes this wide to find a band
    step: int = 1000
    #: a bitmap has 2 to this power bits at most (16 MB)
    most_bits: int = 27
    #: distinct phrases that a task holds
    held: int = 800_000


def _mix(*words: np.ndarray) -> np.ndarray:
    h = np.full(len(words[0]), 0x9E3779B97F4A7C15, np.uint64)
    for w in words:
        h = (h ^ w.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Bits:
    """A set of phrases, with false members and no missing ones."""

    def __init__(self, power: int, words: np.ndarray | None = None):
        self.power, self.words = power, np.zeros(1 << power - 6, np.uint64) if words is None else words

    def _places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        for x in (h, h * np.uint64(0xD6E8FEB86659FD93)):
            yield x >> np.uint64(64 - self.power)

    def add(self, h: np.ndarray) -> None:
        for at in self._places(h):
            np.bitwise_or.at(self.words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))

    def has(self, h: np.ndarray) -> np.ndarray:
        a, b = (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) for at in self._places(h))
        return (a & b).astype(bool)


def bitmap(rows: DataFrame, columns: list[str], mining: Mining) -> Bits:
    """rows: written. Each partition sends its words that aren't zero; a bitmap's size bounds what comes to the driver."""
    power = min(mining.most_bits, max(16, math.ceil(math.log2(16 * (rows.count() + 1)))))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bits(power)
        for b in batches:
            if b.num_rows:
                bits.add(_mix(*(b.column(i).to_numpy() for i in range(len(columns)))))
        at = np.flatnonzero(bits.words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits.words[at].view(np.int64))], names=["at", "word"])

    found = rows.select(*columns).mapInArrow(fill, "at bigint, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
    out = Bits(power)
    out.words[found["at"].to_numpy(np.int64)] = found["word"].to_numpy(np.int64).view(np.uint64)
    return out


class Tally:
    """Counts of phrases, as columns of words; ``over`` once it holds too many."""

    def __init__(self, width: int, held: int):
        self.width, self.held, self.parts, self.size = width, held, [], 0

    def add(self, words: list[np.ndarray]) -> bool:
        if len(words[0]):
            self.parts.append([*words, np.ones(len(words[0]), np.int64)])
            self.size += len(words[0])
        if self.size > 2 * self.held:
            self.compress()
        return self.size > self.held and len(self.parts) == 1

    def compress(self) -> None:
        cols = [np.concatenate([p[i] for p in self.parts]) for i in range(self.width + 1)]
        order = np.argsort(_mix(*cols[:-1]))
        cols = [c[order] for c in cols]
        cuts = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in cols[:-1]], axis=0)))
        self.parts = [[*(c[cuts] for c in cols[:-1]), np.add.reduceat(cols[-1], cuts)]]
        self.size = len(cuts)

    def take(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self.compress()
            cols = self.parts[0]
            self.parts, self.size = [], 0
            for i in range(0, len(cols[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in cols], names=names)


def _joined(b: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """Tokens of each language of a short batch: words, ends of pieces, and empty ones."""
    texts: dict[str, list[str]] = {}
    for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
        texts.setdefault(lang, []).append(text)
    for lang, some in texts.items():
        yield lang, "\n".join(some).encode().translate(_AS).replace(b"\n", b" \n ").split(b" ")


class _Ids(dict):
    """Ids of one language's words; forgets them all when there are many."""

    def __init__(self, lang: str):
        self.seed = xxhash.xxh64_intdigest(lang.encode(), 42)
        self.clear()

    def clear(self) -> None:
        super().clear()
        self[b""], self[b"\n"] = _EMPTY, _END

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        h += 2 * (h < 2)
        self[word] = h = h - (1 << 64) if h >> 63 else h
        return h


def _streams(batches: Iterator[pa.RecordBatch], salt: str, frequent: Bits) -> Iterator[np.ndarray]:
    """Ids of a short batch's words in order; 0 for ends of pieces and words that aren't frequent."""
    memo: dict[str, _Ids] = {}
    for b in slices(batches, 256):
        for lang, tokens in _joined(b):
            ids = memo.setdefault(lang, _Ids(salt + lang))
            a = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
            a = np.append(a[a != _EMPTY], _END)
            yield np.where(frequent.has(_mix(a)), a, _END)
        if sum(map(len, memo.values())) > 1 << 19:
            memo.clear()


def word_counts(docs: DataFrame, held: int) -> DataFrame:
    """docs: (lang, text), no nulls. (lang, word, n) of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                c.pop(b"", None)
                c.pop(b"\n", None)
                words = list(c)
                for i in range(0, len(words), 1 << 16):
                    w = words[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(w), pa.string()), pa.array(w, pa.binary()).cast(pa.string()), pa.array([c[x] for x in w], pa.int64())], names=["lang", "word", "n"])
            counts.clear()

        for b in slices(batches, 256):
            for lang, tokens in _joined(b):
                counts.setdefault(lang, Counter()).update(tokens)
            if sum(map(len, counts.values())) > held // 4:
                yield from rows()
        yield from rows()

    return docs.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _summed(rows: DataFrame, width: int, mining: Mining, parts: int | None = None) -> DataFrame:
    """Frequent phrases; rows were added up in their tasks, so they are dealt by phrase before the next sum."""
    by = [f"w{i + 1}" for i in range(width)]
    dealt = rows.repartition(parts, *by) if parts else rows.repartition(*by)
    return dealt.groupBy(*by).agg(F.sum("n").alias("n")).where(F.col("n") >= mining.least)


def _names(width: int) -> list[str]:
    return [*(f"w{i + 1}" for i in range(width)), "n"]


def _schema(width: int) -> str:
    return ", ".join(f"{c} bigint" for c in _names(width))


def pair_counts(docs: DataFrame, salt: str, frequent, mining: Mining) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(2, mining.held)
        for a in _streams(batches, salt, frequent.value):
            at = np.flatnonzero((a[:-1] != 0) & (a[1:] != 0))
            if tally.add([a[at], a[at + 1]]):
                yield from tally.take(_names(2))
        yield from tally.take(_names(2))

    return docs.mapInArrow(count, _schema(2))


def runs_of(docs: DataFrame, salt: str, frequent, pairs) -> DataFrame:
    """(ids): runs of three words or more whose neighbours are frequent pairs, each ended by a 0, some runs a row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a in _streams(batches, salt, frequent.value):
            if len(a) < 3:
                continue
            link = np.append((a[:-1] != 0) & (a[1:] != 0) & pairs.value.has(_mix(a[:-1], a[1:])), False)
            inner = np.flatnonzero(link[:-1] & link[1:])
            held = np.zeros(len(a), bool)
            for k in range(3):
                held[inner + k] = True
            if not len(inner):
                continue
            kept = np.flatnonzero(held)
            flat = np.insert(a[kept], np.flatnonzero(~link[kept]) + 1, _END)  # a pair of a run of two alone has no held word
            ends = np.flatnonzero(flat == _END) + 1
            cuts = ends[np.append(np.diff(ends // 512) > 0, True)]  # some 512 words a row
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.append(0, cuts).astype(np.int32)), pa.array(flat))], names=["ids"])

    return docs.mapInArrow(cut, "ids array<bigint>")


def grown(runs: DataFrame, tests: dict[int, list[tuple[int, int, object]]], mining: Mining) -> DataFrame:
    """Frequent phrases (w1..w4, n), w4 0 for triples, that pass one of the tests for their length: (first word, number
    of words, bitmap) of a part of the phrase."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(4, mining.held)
        for b in batches:
            a = b.column(0).flatten().to_numpy()
            for width, some in tests.items():
                if len(a) < width:
                    continue
                words = [a[i : len(a) - width + 1 + i] for i in range(width)]
                at = np.flatnonzero(reduce(np.logical_and, [w != _END for w in words]))
                words = [w[at] for w in words]
                fits = reduce(np.logical_or, [bits.value.has(_mix(*words[i : i + n])) for i, n, bits in some])
                words = [w[fits] for w in words]
                if tally.add([*words, *[np.zeros(len(words[0]), np.int64)] * (4 - width)]):
                    yield from tally.take(_names(4))
        yield from tally.take(_names(4))

    return _summed(runs.mapInArrow(count, _schema(4)), 4, mining)


def _div(scale: int, n: Column, total: Column) -> Column:
    """scale * n // total, exactly."""
    product = F.lit(scale).cast("decimal(10,0)") * n.cast("decimal(20,0)")
    rest = product % total.cast("decimal(20,0)")
    return ((product - rest) / total.cast("decimal(20,0)")).cast("bigint")


class Search:
    """The rounds: what is counted so far, and the band of scores that each open language is at."""

    def __init__(self, docs: DataFrame, mining: Mining):
        self.mining, self.spark = mining, docs.sparkSession
        docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
        every = materialize(word_counts(docs, mining.held))
        self.totals = materialize(every.groupBy("lang").agg(F.sum("n").alias("total")))
        salt = next(s for s in ("", *map(str, range(1, 99))) if not self._clashes(every, s))
        self.words = materialize(self._with_ids(every, salt).where(F.col("n") >= mining.least))
        frequent = self._bits(self.words, ["w"])
        tokens = self.totals.agg(F.sum("total")).first()[0] or 0
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(tokens * 32 / (256 << 20)))
        pairs = materialize(_summed(pair_counts(docs, salt, frequent, mining), 2, mining, parts))
        self.runs = materialize(runs_of(docs, salt, frequent, self._bits(pairs, ["w1", "w2"])))
        word = lambda i: self.words.select(F.col("w").alias(f"w{i}"), F.col("n").alias(f"f{i}"), *([F.col("lang")] if i == 1 else []))
        pairs = pairs.join(word(1), "w1").join(word(2), "w2")
        self.pairs = materialize(self._scored(pairs, [("f1", "f2")]).withColumn("bound", self._bound()))
        discard(every)

    @staticmethod
    def _with_ids(words: DataFrame, salt: str) -> DataFrame:
        h = F.xxhash64(F.concat(F.lit(salt), F.col("lang")), "word")
        return words.withColumn("w", F.when(h.isin(0, 1), h + 2).otherwise(h))

    def _clashes(self, words: DataFrame, salt: str) -> bool:
        return bool(self._with_ids(words, salt).groupBy("w").count().where("count > 1").limit(1).count())

    def _bits(self, rows: DataFrame, columns: list[str]):
        return self.spark.sparkContext.broadcast(bitmap(rows, columns, self.mining))

    def _bound(self) -> Column:
        return _div(self.mining.scale, F.col("n"), F.col("f1") + F.col("n"))

    def _scored(self, rows: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
        """Adds score, l and r of the lowest-scoring cut, the shortest first part of those that tie."""
        each = [F.struct(_div(self.mining.scale, F.col("n"), F.col(a) + F.col(b)).alias("score"), F.lit(k).alias("k"), F.col(a).alias("l"), F.col(b).alias("r")) for k, (a, b) in enumerate(cuts)]
        return rows.withColumn("__cut", F.least(*each) if len(each) > 1 else each[0]).select("*", "__cut.score", "__cut.l", "__cut.r").drop("__cut")

    def _next_bands(self, bands: DataFrame | None, at_least: int) -> DataFrame:
        """(lang, low, high): bounds and scores to settle next, of languages that are open."""
        nodes = self.pairs.select("lang", "bound") if bands is None else self.pairs.select("lang", "bound").join(bands.select("lang"), "lang", "left_semi")
        classes = nodes.groupBy("lang", F.floor(F.col("bound") / self.mining.step).alias("c")).agg(F.count("*").alias("m"))
        above = classes.withColumn("m", F.sum("m").over(Window.partitionBy("lang").orderBy(F.col("c").desc())))
        low = above.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("m") >= at_least, F.col("c"))), F.lit(0)).alias("c"))
        low = low.select("lang", (F.col("c") * self.mining.step).cast("bigint").alias("low"))
        if bands is None:
            return low.withColumn("high", F.lit(self.mining.scale + 1).cast("bigint"))
        fresh = low.join(bands.select("lang", F.col("low").alias("high")), "lang")
        return fresh.select("lang", F.greatest(F.lit(0), F.least("low", F.col("high") - self.mining.step)).cast("bigint").alias("low"), "high")

    def _in_band(self, rows: DataFrame, column: str, bands: DataFrame) -> DataFrame:
        return rows.join(bands, "lang").where((F.col(column) >= F.col("low")) & (F.col(column) < F.col("high"))).drop("low", "high")

    def _pair(self, a: int, b: int, name: str, *more: Column) -> DataFrame:
        return self.pairs.select(F.col("w1").alias(f"w{a}"), F.col("w2").alias(f"w{b}"), F.col("n").alias(name), *more)

    def run(self) -> DataFrame:
        """(lang, w1..w4, a, l, r, score): all surviving phrases down to each language's last band; w3, w4 0 if short."""
        nothing = self.spark.createDataFrame([], "lang string, w1 bigint, w2 bigint, w3 bigint, w4 bigint, a bigint, l bigint, r bigint, score bigint")
        triples, quads, whole, survivors, bands, nodes = [], [], [], [], None, self.mining.first
        union = lambda parts: reduce(DataFrame.union, parts)
        while True:
            bands = materialize(self._next_bands(bands, nodes))
            if not bands.limit(1).count():
                break
            front = materialize(self._in_band(self.pairs, "bound", bands).select("w1", "w2"))
            got = grown(self.runs, {3: [(0, 2, self._bits(front, ["w1", "w2"]))]}, self.mining).drop("w4").join(front, ["w1", "w2"], "left_semi")
            got = got.join(self._pair(1, 2, "n12", F.col("lang"), F.col("f1")), ["w1", "w2"]).join(self._pair(2, 3, "n23", F.col("f2").alias("f3")), ["w2", "w3"])
            got = self._scored(got, [("f1", "n23"), ("n12", "f3")]).withColumn("bound", self._bound())
            triples.append(materialize(got.select("lang", "w1", "w2", "w3", "n", "f1", "n12", "l", "r", "score", "bound")))
            triple = union(triples)

            front = materialize(self._in_band(triple, "bound", bands).select("w1", "w2", "w3"))
            got = grown(self.runs, {4: [(0, 3, self._bits(front, ["w1", "w2", "w3"]))]}, self.mining).join(front, ["w1", "w2", "w3"], "left_semi")
            got = got.join(triple.select("lang", "w1", "w2", "w3", "f1", "n12", F.col("n").alias("n123")), ["w1", "w2", "w3"])
            got = got.join(self._pair(3, 4, "n34", F.col("f2").alias("f4")), ["w3", "w4"])
            # the triple that it ends in isn't counted yet, but isn't less frequent than the phrase
            pre = F.least(self._bound(), _div(self.mining.scale, F.col("n"), F.col("n12") + F.col("n34")), _div(self.mining.scale, F.col("n"), F.col("n123") + F.col("f4")))
            quads.append(materialize(got.withColumn("pre", pre).select("lang", "w1", "w2", "w3", "w4", "n", "f1", "n12", "n34", "n123", "f4", "pre")))
            quad = union(quads)

            two = materialize(self._in_band(self.pairs, "score", bands).select("lang", "w1", "w2", "n", "l", "r", "score"))
            three = materialize(self._in_band(triple, "score", bands).select("lang", "w1", "w2", "w3", "n", "l", "r", "score"))
            four = materialize(self._in_band(quad, "pre", bands))
            ends = materialize(four.select("w2", "w3", "w4").distinct())
            left = {3: [(0, 3, self._bits(ends, ["w2", "w3", "w4"])), (1, 2, self._bits(two, ["w1", "w2"]))], 4: [(1, 3, self._bits(three, ["w1", "w2", "w3"]))]}
            left = materialize(grown(self.runs, left, self.mining))
            third = left.where("w4 = 0").select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("w3").alias("w4"), F.col("n").alias("n234"))
            exact = self._scored(four.join(third, ["w2", "w3", "w4"]), [("f1", "n234"), ("n12", "n34"), ("n123", "f4")])
            whole.append(materialize(exact.select("lang", "w1", "w2", "w3", "w4", "n", "l", "r", "score")))

            most = lambda a, b, keys: a.union(b).groupBy(*keys).agg(F.max("n").alias("longer"))
            over2 = most(triple.select("w1", "w2", "n"), left.where("w4 = 0").select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "n"), ["w1", "w2"])
            over3 = most(quad.select("w1", "w2", "w3", "n"), left.where("w4 <> 0").select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("w4").alias("w3"), "n"), ["w1", "w2", "w3"])
            alone = F.coalesce(F.lit(100).cast("decimal(4,0)") * F.col("longer").cast("decimal(20,0)") < F.lit(self.mining.cover).cast("decimal(4,0)") * F.col("n").cast("decimal(20,0)"), F.lit(True))
            none = F.lit(0).cast("bigint")
            row = lambda w3, w4: ["lang", "w1", "w2", w3.alias("w3"), w4.alias("w4"), F.col("n").alias("a"), "l", "r", "score"]
            now = two.join(over2, ["w1", "w2"], "left").where(alone).select(*row(none, none))
            now = now.union(three.join(over3, ["w1", "w2", "w3"], "left").where(alone).select(*row(F.col("w3"), none)))
            now = now.union(self._in_band(union(whole), "score", bands).select(*row(F.col("w3"), F.col("w4"))))
            survivors.append(materialize(now))
            counts = union(survivors).groupBy("lang").agg(F.count("*").alias("m"))
            bands = materialize(bands.join(counts, "lang", "left").where((F.coalesce("m", F.lit(0)) < self.mining.top) & (F.col("low") > 0)).select("lang", "low", "high"))
            nodes *= self.mining.more
        return reduce(DataFrame.union, survivors, nothing)


def collocations(docs: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """docs: (lang, text). (lang, rank, phrase, a, l, r, n, score): the first ``top`` surviving phrases of each language."""
    search = Search(docs, mining)
    out = search.run()
    for i in range(1, 5):
        out = out.join(search.words.select(F.col("w").alias(f"w{i}"), F.col("word").alias(f"word{i}")), f"w{i}", "left")
    out = out.select("lang", F.concat_ws(" ", *[f"word{i}" for i in range(1, 5)]).alias("phrase"), "a", "l", "r", "score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    best = out.withColumn("rank", rank).where(F.col("rank") <= mining.top).join(search.totals, "lang")
    return best.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op11_sql(mining: Mining = Mining()) -> str:
    score = lambda a, x: f"({mining.scale} * a::HUGEINT // (({a}) + ({x})))"
    grams = " UNION ALL ".join(f"SELECT lang, list_slice(w, i, i + {k - 1}) AS p FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM t WHERE len(w) >= {k})" for k in (1, 2, 3, 4))
    return rf"""
WITH x AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s FROM documents),
t AS (SELECT lang, list_filter(regexp_split_to_array(s, '[ \t]+'), lambda v: v <> '') AS w FROM x),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM t GROUP BY lang),
f AS MATERIALIZED (SELECT lang, p, count(*) AS a FROM ({grams}) GROUP BY ALL HAVING count(*) >= {mining.least}),
c AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1),
s AS (SELECT c.lang, c.p, c.a, c.k, l.a AS l, r.a AS r, {score('l.a', 'r.a').replace('* a::', '* c.a::')}::BIGINT AS score FROM c JOIN f l ON l.lang = c.lang AND l.p = c.p[1:c.k] JOIN f r ON r.lang = c.lang AND r.p = c.p[c.k + 1:]),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
o AS (SELECT lang, q, max(a) AS longer FROM (SELECT lang, a, unnest([p[1:len(p) - 1], p[2:]]) AS q FROM f WHERE len(p) > 2) GROUP BY ALL)
SELECT m.lang, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, n.n AS n, score
FROM m JOIN n ON n.lang = m.lang LEFT JOIN o ON o.lang = m.lang AND o.q = m.p WHERE longer IS NULL OR 100 * longer < {mining.cover} * a
QUALIFY rank <= {mining.top}"""


QUERIES = {"op11_collocations": op11_collocations}
SQL = {"op11_collocations": op11_sql()}
