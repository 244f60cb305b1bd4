"""Shared helpers: white space, tables, and results written to the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of every word rule here.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, as in tests, a temporary one, for local masters only."""
    sc = spark.sparkContext
    if (path := spark.conf.get("spark.checkpoint.dir", None)) or (path := sc.getCheckpointDir()):
        return path
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, path, True)
    sc.setCheckpointDir(f"file://{path}")
    return sc.getCheckpointDir()


#: Folders of written tables, by session; `discard` takes one out, `clear` all.
_written: set[str] = set()


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors, has known size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written.discard(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `materialize` that nothing reads any more: what was made of them is written itself."""
    for t in tables:
        _delete(t.sparkSession, t.written_to)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this session has written; for use once the results of its queries are saved."""
    for path in sorted(_written):
        _delete(spark, path)


#: A key with more than 1 of so many rows is hot; there are fewer such keys than this number, so a list of them is small.
HOT_SHARE = 1000


def join_spread(rows: DataFrame, lookup: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """rows left-joined with lookup, which has one row a key, such that no task gets all rows of a hot key.

    counts: (key, n), the rows of each key, written before. Rows of a hot key are dealt over the shuffle partitions, and
    its row of lookup goes to each of them. The list of hot keys, under HOT_SHARE rows of one long, is broadcast.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.where((F.col("n") > 1) & (F.col("n") * HOT_SHARE > total)).select(F.col(key).alias("__key"), F.lit(True).alias("__hot")))
    mark = lambda df: df.join(hot, df[key] == F.col("__key"), "left").drop("__key")
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    left = mark(rows).withColumn("__salt", F.when(F.col("__hot"), salt).otherwise(0)).drop("__hot")
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    right = mark(lookup).withColumn("__salt", F.explode(every)).drop("__hot")
    return left.join(right, [key, "__salt"], "left").drop("__salt")


def slices(batches, rows: int = 512):
    """Arrow batches cut into short ones, so that Python objects of few texts are held at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; a text that is ASCII as a whole takes the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
