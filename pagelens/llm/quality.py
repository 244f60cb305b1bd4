"""Operator 9: quality rules whose thresholds follow the corpus.

Four shape measures of each text are sketched per (lang, source) and judged against Tukey fences read from the
sketches. A sketch is a histogram of buckets of at most 1/64 relative width: counts add up, so sketches merge across
partitions, and the sketches of a language's sources merge into the language's, those of all into the corpus's. A
quartile is blended with that of the level above, by the group's size, so that a small group leans on its language. The
sketches are exact in their counts and independent of row order, so results are reproducible. Only DataFrame functions.

Null and odd input: a null text has no words. Null lang or source is a group of its own. Rows are judged one by one,
so repeated rows and ties in doc_id change nothing but counts. An empty table gives an empty result. Extra columns are
carried through ``filter_quality`` in a struct, so their names can't clash with the measures.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize, table, words


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: texts that a parent's quartile counts for: a source's is blended with its language's, that with the corpus's
    prior: int = 100
    #: fence = quartile -/+ reach * max(interquartile range, least spread of the measure)
    reach: int = 3
    #: least spread by measure: tenths of a character a word; symbols, repeated lines, repeated words in a thousand
    spread_length: int = 10
    spread_symbols: int = 50
    spread_lines: int = 100
    spread_repeats: int = 100


MEASURES = ("length", "symbols", "lines", "repeats")


def measures(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Counts of each text. carry: columns of docs to keep, in a struct ``doc``.

    Repeated 3-word windows: each window's 64-bit hash is packed with its index into one long, the longs are sorted,
    and equal neighbours (compared by whole hashes) give the indexes of windows found twice or more. In a text where
    packing brings two different hashes together, pairs of hash and index are sorted instead. That is O(n log n) in one
    row, with no explode or shuffle.
    """
    n = F.size("w")
    at = lambda a, i: F.get(a, i)
    hashed = F.transform("w", lambda w: F.xxhash64(w))
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(F.col("h"), i), at(F.col("h"), i + 1), at(F.col("h"), i + 2)))).otherwise(F.array().cast("array<bigint>"))
    packed = F.sort_array(F.transform("v", lambda x, i: F.call_function("shiftleft", x, F.col("bits")).bitwiseOR(i.cast("bigint"))))
    low = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bits")) - 1).cast("int")
    high = lambda j: F.call_function("shiftright", at(F.col("p"), j), F.col("bits"))
    hash_at = lambda j: at(F.col("v"), index(j))
    packed_at = lambda j: at(F.col("v"), low(at(F.col("p"), j)))
    clash = (F.size("p") >= 2) & F.exists(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), lambda j: (high(j) == high(j - 1)) & (packed_at(j) != packed_at(j - 1)))
    pairs = F.transform(F.array_sort(F.transform("v", lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s: s["i"])
    places = F.when(clash, pairs).otherwise(F.transform("p", low))
    index = lambda j: at(F.col("p"), j)
    same = lambda j: hash_at(j) == hash_at(j - 1)
    twice = F.when(F.size("p") >= 2, F.filter(F.sequence(F.lit(1), F.size("p") - 1), same)).otherwise(F.array().cast("array<int>"))
    spans = F.flatten(F.transform("q", lambda j: F.array(index(j), index(j) + 1, index(j) + 2, index(j - 1), index(j - 1) + 1, index(j - 1) + 2)))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]")))
    return (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), F.col("lang").alias("lang"), F.col("source").alias("source"), F.coalesce("text", F.lit("")).alias("t"))
        .withColumn("w", words(F.col("t")))
        .withColumn("h", hashed)
        .withColumn("bits", F.length(F.bin(n.cast("bigint"))))
        .withColumn("v", windows)
        .withColumn("p", packed)
        .withColumn("p", places)
        .withColumn("q", twice)
        .withColumn("l", lines)
        .select(
            "doc",
            "lang",
            "source",
            n.cast("bigint").alias("n_words"),
            F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
            (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
            F.size("l").cast("bigint").alias("n_lines"),
            F.size(F.array_distinct(spans)).cast("bigint").alias("n_repeat_words"),
        )
    )


def base_failed(rules: QualityRules):
    return (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent)


def _scaled() -> dict:
    """Measures as whole numbers, so that any engine computes the same."""
    per = lambda a, b, k: F.expr(f"({a} * {k}) div {b}")
    return {
        "length": per("word_chars", "greatest(n_words, 1)", 10),
        "symbols": per("n_symbols", "greatest(n_words, 1)", 1000),
        "lines": per("n_dup_lines", "greatest(n_lines, 1)", 1000),
        "repeats": per("n_repeat_words", "greatest(n_words, 1)", 1000),
    }


def sketch(measured: DataFrame) -> DataFrame:
    """Mergeable quantile sketches: counts by (lang, source, measure, bucket). Below 128 buckets are exact."""
    x = "x"
    shift = f"greatest(length(bin({x})) - 7, 0)"
    values = measured.select("lang", "source", F.explode(F.create_map(*[y for k, v in _scaled().items() for y in (F.lit(k), v)])).alias("measure", "x"))
    return values.groupBy("lang", "source", "measure", F.expr(f"shiftleft(shiftright({x}, {shift}), {shift})").alias("bucket")).agg(F.count("*").alias("n"))


def _quartiles(cells: DataFrame, keys: list[str]) -> DataFrame:
    merged = cells.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "measure")
    run = merged.withColumn("below", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    least = lambda k: F.min(F.when(F.col("below") * 4 >= F.col("all") * k, F.col("bucket")))
    return run.groupBy(*keys, "measure").agg(F.max("all").alias("n"), least(1).alias("q1"), least(3).alias("q3"))


def _blend(own: str, n: str, parent: str, rules: QualityRules, div: str) -> str:
    """A group's quartile and its parent's, weighted by the group's size and the prior: no step at any size. As SQL."""
    return f"(({own} * {n} + ({parent}) * {rules.prior}) {div} ({n} + {rules.prior}))"


def thresholds(cells: DataFrame, rules: QualityRules) -> DataFrame:
    """One row per (lang, source) of the sketches, with the fences of each measure."""
    own, by_lang, every = _quartiles(cells, ["lang", "source"]), _quartiles(cells, ["lang"]), _quartiles(cells, [])
    o, g, e = own.alias("o"), by_lang.alias("g"), every.alias("e")
    picked = (
        o.join(g, F.col("o.lang").eqNullSafe(F.col("g.lang")) & (F.col("o.measure") == F.col("g.measure")))
        .join(e, F.col("o.measure") == F.col("e.measure"))
        .select(
            "o.lang",
            "o.source",
            "o.measure",
            *[F.expr(_blend(f"o.{q}", "o.n", _blend(f"g.{q}", "g.n", f"e.{q}", rules, "div"), rules, "div")).alias(q) for q in ("q1", "q3")],
        )
    )
    spread = F.create_map(*[y for m in MEASURES for y in (F.lit(m), F.lit(getattr(rules, f"spread_{m}")).cast("bigint"))])[F.col("measure")]
    reach = F.greatest(F.col("q3") - F.col("q1"), spread) * rules.reach
    fences = picked.withColumn("high", F.col("q3") + reach).withColumn("low", F.col("q1") - reach)
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    return fences.groupBy("lang", "source").agg(pick("length", "low").alias("length_low"), *[pick(m, "high").alias(f"{m}_high") for m in MEASURES])


def judge(measured: DataFrame, limits: DataFrame, rules: QualityRules) -> DataFrame:
    """Joins every row with its group's fences; adds base_failed and kept."""
    s = _scaled()
    m, t = measured.alias("m"), limits.alias("t")
    joined = m.join(t, F.col("m.lang").eqNullSafe(F.col("t.lang")) & F.col("m.source").eqNullSafe(F.col("t.source")), "left").drop(F.col("t.lang"), F.col("t.source"))
    inside = (s["length"] >= F.col("length_low")) & (s["length"] <= F.col("length_high"))
    for k in ("symbols", "lines", "repeats"):
        inside &= s[k] <= F.col(f"{k}_high")
    return joined.withColumn("base_failed", base_failed(rules)).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def assess(docs: DataFrame, carry: list[str], rules: QualityRules = QualityRules()) -> DataFrame:
    """Measures every row once, into a table in the shared folder; sketches those that pass the base rules; judges all."""
    measured = materialize(measures(docs, carry))
    limits = materialize(thresholds(sketch(measured.where(~base_failed(rules))), rules))
    return judge(measured, limits, rules)


def filter_quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Rows of docs that are kept, all columns as they were."""
    return assess(docs, docs.columns, rules).where("kept").select("doc.*")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = assess(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_sql(rules: QualityRules = QualityRules()) -> str:
    bucket = "((x >> greatest(length(bin(x)) - 7, 0)) << greatest(length(bin(x)) - 7, 0))"
    scaled = "(word_chars * 10) // greatest(n_words, 1) AS length, (n_symbols * 1000) // greatest(n_words, 1) AS symbols, (n_dup_lines * 1000) // greatest(n_lines, 1) AS lines, (n_repeat_words * 1000) // greatest(n_words, 1) AS repeats"
    level = lambda keys: f"""SELECT {keys} measure, max(total) AS n, min(bucket) FILTER (below * 4 >= total) AS q1, min(bucket) FILTER (below * 4 >= total * 3) AS q3
      FROM (SELECT {keys} measure, bucket, sum(n) OVER (PARTITION BY {keys} measure ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY {keys} measure) AS total
            FROM (SELECT {keys} measure, bucket, sum(n) AS n FROM cells GROUP BY {keys} measure, bucket)) GROUP BY {keys} measure"""  # noqa: E731
    spread = " ".join(f"WHEN '{m}' THEN {getattr(rules, f'spread_{m}')}" for m in MEASURES)
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
win AS (SELECT * FROM (SELECT doc_id, i, a, lead(a, 1) OVER q AS b, lead(a, 2) OVER q AS c FROM p WINDOW q AS (PARTITION BY doc_id ORDER BY i)) WHERE c IS NOT NULL),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) >= 2),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM twice, range(3) r(o) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
        coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
b AS (SELECT *, n_words < {rules.min_words} OR n_repeat_words * 100 > n_words * {rules.max_repeat_percent} AS base_failed, {scaled} FROM m),
v AS (SELECT lang, source, unnest(['length', 'symbols', 'lines', 'repeats']) AS measure, unnest([length, symbols, lines, repeats]) AS x FROM b WHERE NOT base_failed),
cells AS (SELECT lang, source, measure, {bucket} AS bucket, count(*) AS n FROM v GROUP BY ALL),
o AS ({level('lang, source,')}), g AS ({level('lang,')}), e AS ({level('')}),
f AS (SELECT o.lang, o.source, o.measure, {', '.join(f"{_blend(f'o.{q}', 'o.n', _blend(f'g.{q}', 'g.n', f'e.{q}', rules, '//'), rules, '//')} AS {q}" for q in ('q1', 'q3'))}
      FROM o JOIN g ON o.lang IS NOT DISTINCT FROM g.lang AND o.measure = g.measure JOIN e ON o.measure = e.measure),
r AS (SELECT *, {rules.reach} * greatest(q3 - q1, CASE measure {spread} END) AS reach FROM f),
t AS (SELECT lang, source, max(q1 - reach) FILTER (measure = 'length') AS length_low, {', '.join(f"max(q3 + reach) FILTER (measure = '{m}') AS {m}_high" for m in MEASURES)} FROM r GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(length BETWEEN length_low AND length_high AND symbols <= symbols_high AND lines <= lines_high AND repeats <= repeats_high, TRUE) AS kept
FROM b LEFT JOIN t ON b.lang IS NOT DISTINCT FROM t.lang AND b.source IS NOT DISTINCT FROM t.source"""


QUERIES = {"op9_quality_rules": op9_quality_rules}
SQL = {"op9_quality_rules": op9_sql()}
