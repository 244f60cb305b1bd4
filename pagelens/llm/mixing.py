"""Operator 1: mixing sources to target weights, by iterative proportional fitting. Only DataFrame functions.

Texts are counted once. Token totals by (source, lang, topic) are the seed table of the fitting; each round scales its
rows to the targets of source, then language, then topic, and holds a row's weight to the tokens it has. What is wanted
in all is ``rate`` of the tokens, or less where a target asks for more than its key holds: the total is lowered to
what the scarcest key allows. After every ``rounds`` rounds the shares are compared with the targets; the fitting ends
once none is off by more than ``tolerance``. After every ``patience`` comparisons it goes on at a total lower by a
tenth. A document is kept with its cell's probability, weight over tokens, by a hash of its id. With ``most_copies``
above 1 a weight may pass the tokens there are, up to so many times: a scarce source is repeated, instead of shrinking
all others to what it has. What was wanted in the end, and how far the shares are from the targets, come with every row.

The seed table has a row per cell, however many documents there are; it stays distributed, and is written to the shared
folder after every round. Hot cells are pre-aggregated before the shuffle. Only totals come to the driver.

Targets are tempered shares, tokens ** power, unless given as tables (key, share). Keys that such a table doesn't name
share what it leaves of 1 by their tokens; keys that hold no token drop out, and the rest is scaled to 1. Topic is the
shape of the text.

Null and odd input: a null source or language is a cell of its own. A null or empty text has no tokens; its cell's
probability holds for it, 0 if the cell has no token. Repeated rows count twice and share one draw; a null doc_id
draws as the empty string. Extra columns are carried in a struct. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, table, words


@dataclass(frozen=True)
class Mix:
    #: tokens wanted, as a share of those there are, if the targets allow it
    rate: float = 0.8
    #: mild, so that over half of the tokens can be had at the target shares
    powers: dict = field(default_factory=lambda: {"source": 0.95, "lang": 0.9, "topic": 0.95})
    rounds: int = 2
    patience: int = 6
    #: a share may be off by so much
    tolerance: float = 0.001
    #: share of the scarcest key's tokens that the total may ask for
    slack: float = 0.95
    #: times that the total is lowered before the fitting gives up; the residual is returned either way
    lowered: int = 40
    #: times that a document may come
    most_copies: float = 1.0
    #: raise a ValueError when the fitting gives up
    strict: bool = False


def count_tokens(docs: DataFrame, carry: list[str]) -> DataFrame:
    """(doc, source, lang, topic, draw, n_tokens). Topic: table if a fifth of the words are bars, list if lines are short."""
    t = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), F.col("source").alias("source"), F.col("lang").alias("lang"), t.alias("t"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"))
    n, lacks = F.size(words(F.col("t"))).cast("bigint"), lambda c: F.length("t") - F.length(F.replace(F.col("t"), F.lit(c), F.lit("")))
    counted = rows.select("*", n.alias("n_tokens"), lacks("|").alias("bars"), (lacks("\n") + 1).alias("lines"))
    topic = F.when(F.col("bars") * 5 >= F.greatest("n_tokens", F.lit(1)), "table").when(F.col("lines") * 8 >= F.col("n_tokens"), "list").otherwise("prose")
    draw = F.conv(F.substring(F.md5("id"), 1, 12), 16, 10).cast("double") / F.lit(2.0**48)
    return counted.select("doc", "source", "lang", topic.alias("topic"), draw.alias("draw"), "n_tokens")


def target_shares(cells: DataFrame, dim: str, mix: Mix, target: DataFrame | None = None) -> DataFrame:
    """(key, margin: tokens of the key, share: wanted of all)."""
    margins = cells.groupBy(F.col(dim).alias("key")).agg(F.sum("tokens").cast("double").alias("margin"))
    if target is None:
        raised = margins.withColumn("share", F.pow("margin", F.lit(mix.powers[dim])))
    else:
        t = target.select(F.col("key").alias("__key"), F.col("share").cast("double").alias("named"))
        named = margins.join(t, margins["key"].eqNullSafe(t["__key"]), "left").select("key", "margin", "named")
        left = named.agg(F.sum("named").alias("given"), F.sum(F.when(F.col("named").isNull(), F.col("margin"))).alias("others")).first()
        rest = max(0.0, 1.0 - (left["given"] or 0.0)) / (left["others"] or 1.0)
        raised = named.select("key", "margin", F.when(F.col("margin") > 0, F.coalesce("named", F.col("margin") * rest)).otherwise(0.0).alias("share"))
    whole = raised.agg(F.sum("share")).first()[0] or 1.0
    return raised.select("key", "margin", (F.col("share") / F.lit(whole)).alias("share"))


def rake(cells: DataFrame, mix: Mix = Mix(), targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """cells: (source, lang, topic, tokens). Adds weight: tokens wanted of the cell; wanted: of all cells; and residual:
    how far the share of any key is from its target, at most."""
    dims = list(mix.powers)
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    wanted, w = mix.rate * total, cells
    for d in dims:
        shares = materialize(target_shares(cells, d, mix, (targets or {}).get(d)))
        scarcest = shares.where("share > 0").agg(F.min(F.col("margin") / F.col("share"))).first()[0]
        wanted = wanted if scarcest is None else min(wanted, mix.slack * mix.most_copies * scarcest)
        w = w.join(shares.select(F.col("key").alias("__key"), F.col("share").alias(f"share_{d}")), w[d].eqNullSafe(F.col("__key"))).drop("__key")
    w, held, off = w.withColumn("weight", F.col("tokens") * F.lit(wanted / (total or 1.0))), None, 0.0
    for check in range(1, mix.lowered * mix.patience + 1):
        for _ in range(mix.rounds):
            for d in dims:
                # joined by Spark's choice: the sums of few keys are broadcast, those of many are not; no key is one task
                sums = w.groupBy(F.col(d).alias("__key")).agg(F.sum("weight").alias("__margin"))
                scaled = F.least(F.col("weight") * F.col(f"share_{d}") * F.lit(wanted) / F.col("__margin"), F.col("tokens") * F.lit(float(mix.most_copies)))
                w = w.join(sums, F.col(d).eqNullSafe(F.col("__key"))).withColumn("weight", F.when(F.col("__margin") > 0, scaled).otherwise(0.0)).drop("__key", "__margin")
            w = materialize(w)  # a round at a time: plans stay short
            if held is not None:
                discard(held)
            held = w
        by_key = [w.groupBy(d).agg(F.abs(F.sum("weight") / F.lit(wanted or 1.0) - F.first(f"share_{d}")).alias("off")).select("off") for d in dims]
        off = reduce(DataFrame.union, by_key).agg(F.max("off")).first()[0] or 0.0
        if off <= mix.tolerance:
            break
        if check % mix.patience == 0:
            wanted *= 0.9
    if off > mix.tolerance and mix.strict:
        raise ValueError(f"the targets can't be met: a share is off by {off:.4f}")
    return w.select(*dims, "tokens", "weight", F.lit(wanted).alias("wanted"), F.lit(off).alias("residual"))


def mix_documents(docs: DataFrame, carry: list[str], mix: Mix = Mix(), targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(doc, source, lang, topic, n_tokens, probability, kept, copies, wanted, residual) of every row.

    probability: copies to expect, above 1 only if ``most_copies`` is; copies: those drawn, the same for each run.
    """
    counted = materialize(count_tokens(docs, carry))
    cells = materialize(counted.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")))
    fitted = materialize(rake(cells, mix, targets)).withColumn("p", F.when(F.col("tokens") > 0, F.least(F.col("weight") / F.col("tokens"), F.lit(float(mix.most_copies)))).otherwise(0.0)).alias("f")
    c = counted.alias("c")
    on = F.col("c.source").eqNullSafe(F.col("f.source")) & F.col("c.lang").eqNullSafe(F.col("f.lang")) & (F.col("c.topic") == F.col("f.topic"))
    p = F.col("f.p")
    copies = F.floor(p) + (F.col("c.draw") < p - F.floor(p)).cast("bigint")
    return c.join(fitted, on, "left").select("c.doc", "c.source", "c.lang", "c.topic", "c.n_tokens", p.alias("probability"), (copies > 0).alias("kept"), copies.alias("copies"), "f.wanted", "f.residual")


def sample_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of docs that the mix draws, as often as it does, all columns as they were."""
    rows = mix_documents(docs, docs.columns, mix).where("kept")
    if mix.most_copies > 1:
        rows = rows.select("doc", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return rows.select("doc.*")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    out = mix_documents(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc.doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "kept", F.round("wanted", 3).alias("wanted"), F.round("residual", 6).alias("residual"))


def op1_sql(mix: Mix = Mix()) -> str:
    """A recursion, one scaling of one dimension a step."""
    dims, step = list(mix.powers), mix.rounds * len(mix.powers)
    long = step * mix.patience
    shares = "".join(f", share_{d}" for d in dims)
    pick = lambda x: " ".join(f"WHEN {k} THEN {x}_{d}" for k, d in enumerate(dims))
    t = "coalesce(text, '')"
    return rf"""
WITH RECURSIVE n AS (SELECT doc_id, source, lang, len(regexp_extract_all({t}, '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
    length({t}) - length(replace({t}, '|', '')) AS bars, length({t}) - length(replace({t}, chr(10), '')) + 1 AS lines FROM documents),
c AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN bars * 5 >= greatest(n_tokens, 1) THEN 'table' WHEN lines * 8 >= n_tokens THEN 'list' ELSE 'prose' END AS topic,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS draw FROM n),
cells AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM c GROUP BY ALL),
{''.join(f"t_{d} AS (SELECT {d} AS key, sum(tokens)::DOUBLE AS margin, pow(sum(tokens)::DOUBLE, {p}) AS p FROM cells GROUP BY {d}), s_{d} AS (SELECT key, margin, p / sum(p) OVER () AS share_{d} FROM t_{d}), " for d, p in mix.powers.items())}
total AS (SELECT least((SELECT sum(tokens) FROM cells)::DOUBLE * {mix.rate}, {', '.join(f"(SELECT {mix.slack} * min(margin / share_{d}) FROM s_{d} WHERE share_{d} > 0)" for d in dims)}) AS wanted),
r AS (SELECT 0 AS k, FALSE AS done, source, lang, topic, tokens{shares}, (SELECT wanted FROM total) AS wanted, tokens * ((SELECT wanted FROM total) / (SELECT sum(tokens) FROM cells)::DOUBLE) AS weight
  FROM cells {' '.join(f"JOIN s_{d} ON s_{d}.key IS NOT DISTINCT FROM cells.{d}" for d in dims)}
  UNION ALL
  SELECT k + 1, done, source, lang, topic, tokens{shares}, wanted, least(weight * (CASE k % {len(dims)} {pick('share')} END) * wanted / nullif(CASE k % {len(dims)} {pick('m')} END, 0), tokens::DOUBLE)
  FROM (SELECT * REPLACE (CASE WHEN k > 0 AND k % {long} = 0 THEN wanted * 0.9 ELSE wanted END AS wanted, k > 0 AND k % {step} = 0 AND worst <= {mix.tolerance} AS done)
    FROM (SELECT *, max(greatest({', '.join(f"abs(m_{d} / wanted - share_{d})" for d in dims)})) OVER () AS worst FROM (SELECT *{''.join(f", sum(weight) OVER (PARTITION BY {d}) AS m_{d}" for d in dims)} FROM r)))
  WHERE NOT done AND k < {long * mix.lowered}),
f AS (SELECT *, max(off) OVER () AS residual FROM (SELECT *, greatest({', '.join(f"abs(sum(weight) OVER (PARTITION BY {d}) / wanted - share_{d})" for d in dims)}) AS off FROM (SELECT * FROM r QUALIFY k = max(k) OVER ())))
SELECT doc_id, c.source, c.lang, c.topic, n_tokens, round(coalesce(least(weight / nullif(tokens, 0), 1.0), 0.0), 6) AS probability, draw < coalesce(least(weight / nullif(tokens, 0), 1.0), 0.0) AS kept,
  round(wanted, 3) AS wanted, round(residual, 6) AS residual
FROM c JOIN f ON c.source IS NOT DISTINCT FROM f.source AND c.lang IS NOT DISTINCT FROM f.lang AND c.topic = f.topic"""


QUERIES = {"op1_mix_sources": op1_mix_sources}
SQL = {"op1_mix_sources": op1_sql()}
