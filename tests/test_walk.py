"""The slide walk: passes, limits, numbering, and a stream that says what the batch says."""

import datetime

import pytest
from pyspark.sql import functions as F

from pagelens.streaming import walk as W

SCHEMA = "page_id bigint, seq int, at timestamp, elapsed_ms int, url string, signature string, has_next boolean, has_previous boolean, images array<struct<url:string,origin:string>>, extra array<struct<url:string,origin:string>>, source array<string>"
START = datetime.datetime(2026, 1, 1)
HERE = "https://www.instagram.com/p/X/"


def polls(page, looks, url=HERE, every=20):
    """looks: (signature, images, has_next, has_previous) of each poll, more by name in a fifth place."""
    out = []
    for k, (signature, images, forward, back, *more) in enumerate(looks):
        m = {"extra": [], "source": [], "url": url, "ms": k * every, **(more[0] if more else {})}
        out.append((page, k, START + datetime.timedelta(milliseconds=m["ms"]), m["ms"], m["url"], signature, forward, back, [(u, "dom") for u in images], [(u, "dom") for u in m["extra"]], m["source"]))
    return out


def run(spark, rows):
    got = W.walked(spark.createDataFrame(rows, SCHEMA)).orderBy("page_id", "n").collect()
    return [(r.url, r.order) for r in got if r.kind == "image"], [r.text for r in got if r.kind == "note"]


def test_back_first_then_forward(spark):
    looks = [("a", ["3", "4"], True, True), ("b", ["2", "3", "1x"], True, True), ("c", ["1"], True, False), ("d", ["5"], False, True, {"extra": ["bg"], "source": ["3", "s"]})]
    images, notes = run(spark, polls(1, looks, HERE + "?img_index=3"))
    assert images == [("3", 0), ("4", 1), ("2", -1000), ("1x", -999), ("1", -2000), ("5", 2), ("bg", 3), ("s", 4)]
    assert notes == ["前へ1回目: +2件 20ms", "前へ2回目: +1件 20ms", "「前へ」ボタンが消えたため終了 (2回送り) / 次へへ", "次へ1回目: +1件 20ms", "「次へ」ボタンが消えたため終了 (1回送り)"]


def test_a_walk_that_ends_going_back_numbers_the_rest_so(spark):
    """The last sweep and the source keep the block of the step that was under way."""
    looks = [("a", ["3"], True, True), ("b", ["2"], True, True), ("b", ["2", "late"], True, True, {"url": "https://www.instagram.com/q/", "extra": ["bg"], "source": ["s"]})]
    images, notes = run(spark, polls(1, looks, HERE + "?img_index=9"))
    assert images == [("3", 0), ("2", -1000), ("late", -2000), ("bg", -1999), ("s", -1998)] and notes[-1] == W.LEFT


def test_settling_and_limits(spark):
    same = [("a", [], True, False)] * 7 + [("a", ["late"], True, False)]  # six polls without a change end the step
    assert run(spark, polls(1, same))[1] == ["次へ1回目: +0件 120ms", W.TIME_UP]
    many = [(str(k), [f"u{k}"], True, False) for k in range(60)]
    images, notes = run(spark, polls(1, many))
    assert notes[-1] == W.LIMIT % ("次へ", 30) and len(images) == 31
    slow = [(str(k), [], True, False, {"ms": 300 * k}) for k in range(9)]
    assert run(spark, polls(1, slow))[1][-1] == W.LIMIT % ("次へ", 4)  # at 1,200 ms, past 900
    assert run(spark, polls(1, [("a", ["x"], True, True)], "https://h.example/"))[1] == [W.NOT_HERE]
    assert run(spark, polls(1, [("a", ["x", "https://h/rsrc.php/y", None, "x"], False, True)], HERE + "?img_index=3"))[0] == [("x", 0)]
    assert run(spark, polls(1, [("a", ["x"], None, None, {"url": None, "source": None})])) == ([("x", 0)], [W.NOT_HERE])


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def test_stream_says_what_the_batch_says(spark, rocks, tmp_path):
    rows = []
    for page in range(6):
        looks = [(f"{k // 2}", [f"{page}-{k}", f"{page}-{(k * 3) % 5}"], k < 9, k < 4, {"extra": [f"bg{k}"], "source": ["s"]}) for k in range(3 + 3 * page)]
        rows += polls(page, looks, HERE + ("?img_index=5" if page % 2 else ""), 40)
    late = [(99, 0, START + datetime.timedelta(seconds=s), 0, "https://h.example/", "", False, False, [], [], []) for s in (30, 60)]
    cuts = [[r for r in rows if r[3] < 120], [r for r in rows if 120 <= r[3] < 300], [r for r in rows if r[3] >= 300], late[:1], late[1:]]
    for i, part in enumerate(cuts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = W.walking(stream).writeStream.format("memory").queryName("walks").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("walks").where("page_id < 99")
    want = W.walked(spark.createDataFrame(rows, SCHEMA))
    assert want.where("kind = 'image'").count() > 40 and want.where(F.col("text") == W.TIME_UP).count() > 0
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
