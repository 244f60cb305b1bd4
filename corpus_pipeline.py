"""A corpus from raw documents to token ids, in five stages; each is an operator of pagelens.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. Stages hold for nulls, empty texts, repeated rows and extra
columns as their operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import bpe, common, lines, mixing, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many documents share; n_chars follows the text."""
    out = lines.drop_lines(docs)
    text = F.when(F.col("doc.text").isNull() & (F.col("n_dropped") == 0), F.lit(None).cast("string")).otherwise(F.col("kept"))
    made = {"text": text, "n_chars": F.when(F.col("n_dropped") == 0, F.col("doc.n_chars")).otherwise(F.length(text).cast("bigint")) if "n_chars" in docs.columns else None}
    return out.select(*[made.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose 5-word shingles are similar to 0.8 or more: the smallest doc_id."""
    return simhash.drop_near_duplicates(docs, simhash.Similar())


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents by calibrated probabilities."""
    return mixing.sample_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to."""
    return bpe.digests(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("byte_bpe", tokenize)]

#: SimHash groups and BPE have no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
