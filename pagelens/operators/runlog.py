"""Run logs: lines, sections in a fixed order, the run's label, and a store that a save overwrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C

# Section titles as users of the log know them.
SECTIONS = {"extraction": "=== 読み込み ===", "current": "=== 今回の保存 ===", "previous": "=== 前回の記録 ==="}


def version_text(version: Column, build: Column) -> Column:
    """A part that isn't known is a question mark."""
    return F.concat(F.lit("v"), F.coalesce(version, F.lit("?")), F.lit(" ("), F.coalesce(build, F.lit("?")), F.lit(")"))


def run_label(counter: Column, at: Column, version: Column) -> Column:
    """counter: runs before this one, null for none yet. Parts are two spaces apart."""
    number = F.concat(F.lit("実行 #"), (F.coalesce(counter, F.lit(0)) + 1).cast("string"))
    return F.concat_ws("  ", number, F.date_format(at, "MM/dd HH:mm:ss"), F.coalesce(version, F.lit("?")))


def stored(settings: DataFrame, name: str, missing: int = 0) -> DataFrame:
    """One row (value): a stored whole number, as the run counter or the size tier; ``missing`` where there is none."""
    return settings.where(F.col("name") == name).agg(F.coalesce(F.max("value"), F.lit(missing)).cast("int").alias("value"))


def log_lines(entries: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """entries: (run_id, section, seq, text, is_error). Adds the heading of each section that has lines; ordered by line_no.

    labels: (run_id, label), a row per run; the label opens the run's text, also where nothing follows.
    """
    rank = F.when(F.col("section") == "extraction", 0).when(F.col("section") == "current", 1).otherwise(2)
    text = F.when(F.col("section") == "current", C.log_line(F.col("is_error"), F.col("text"))).otherwise(F.col("text"))
    rows = entries.select("run_id", rank.alias("rank"), F.col("seq").cast("bigint").alias("seq"), text.alias("line"))
    heads = rows.groupBy("run_id", "rank").agg(F.lit(-1).cast("bigint").alias("seq"), F.element_at(F.array(*map(F.lit, SECTIONS.values())), F.first("rank") + 1).alias("line"))
    rows = rows.union(heads.select("run_id", "rank", "seq", "line"))
    if labels is not None:
        rows = rows.union(labels.select("run_id", F.lit(-1), F.lit(-1).cast("bigint"), "label"))
    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy("run_id").orderBy("rank", "seq"))).select("run_id", "line_no", "line")


def is_error_line(line: Column) -> Column:
    return F.startswith(line, F.lit("[ERR] "))


def write_log(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The stored lines; none if nothing was stored."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.text(path).select(F.col("value").alias("line"))
    except AnalysisException:
        return spark.createDataFrame([], "line string")


def clear_log(spark: SparkSession, path: str) -> None:
    """Nothing is stored from here on until the next save."""
    write_log(spark.createDataFrame([], "line string"), path)
