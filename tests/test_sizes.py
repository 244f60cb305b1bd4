"""Late sizes as a stream of changes add up to what the batch view says."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from pagelens.operators import view
from pagelens.streaming import sizes

SCHEMA = "id bigint, at timestamp, kind string, origin string, width double, height double"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def test_changes_add_up(spark, rocks, tmp_path):
    rng = random.Random(6)
    gates = view.Gates(video_posters=True, size_tier=1)
    images = [(i, "https://h/a", rng.choice((0, 100, 299, 300, 900)), rng.choice((0, 50, 400)), rng.choice((None, "dom", "video", "source"))) for i in range(60)]
    sized = [(i, float(rng.choice((10, 299, 300, 1200))), float(rng.randint(1, 310))) for i in range(60) if i % 3]
    saved = [i for i in range(60) if i % 7 == 2]
    events = [(i, 1, "image", o, float(w), float(h)) for i, _, w, h, o in images] + [(i, rng.randint(0, 3), "size", None, w, h) for i, w, h in sized] + [(i, 3, "saved", None, None, None) for i in saved]
    events += [(i, 1, "image", o, float(w), float(h)) for i, _, w, h, o in images[:9]]  # told twice
    when = lambda k: datetime.datetime(2026, 1, 1, 0, k)
    for k in range(4):
        spark.createDataFrame([(e[0], when(k), *e[2:]) for e in events if e[1] == k], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = sizes.changes(stream, gates).writeStream.format("memory").queryName("sizes").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("sizes")
    assert rows.where("change = -1").count() > 3
    left = rows.groupBy("id", "longest_side").agg(F.sum("change").alias("n")).where("n <> 0")
    want = view.visible(spark.createDataFrame(images, "id bigint, url string, width int, height int, origin string"), spark.createDataFrame(sized, "id bigint, w double, h double"), spark.createDataFrame([(i,) for i in saved], "id bigint"), gates)
    assert {(r.id, r.longest_side, r.n) for r in left.collect()} == {(r.id, r.longest_side, 1) for r in want.collect()}
