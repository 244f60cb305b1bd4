"""Hand-over, saving, controls, log and icons by hand-derived cases."""

import datetime
import json

from pyspark.sql import functions as F

from pagelens.operators import controls, handoff, icons, raster, runlog, saving, scan, sweeps
from pagelens.sources import html as H
from pagelens.sources import images as I


def test_last_payload_of_the_first_item_wins(spark):
    rows = [(1, 0, "com.apple.property-list", 0, "a"), (1, 0, "com.apple.binary-property-list", 1, "b"), (1, 0, "com.apple.property-list", 2, None), (1, 1, "com.apple.property-list", 3, "c"), (2, 0, "public.url", 0, "x"), (3, 1, "com.apple.property-list", 0, "y"), (4, 0, None, 0, None), (5, 0, "com.apple.property-list", 0, None)]
    got = {r.run_id: (r.n_attachments, r.n_providers, r.payload, r.failure) for r in handoff.received(spark.createDataFrame(rows, "run_id int, item int, type string, seq int, payload string")).collect()}
    assert got == {1: (3, 3, "b", None), 2: (1, 0, None, handoff.NO_PROVIDER), 3: (0, 0, None, handoff.NO_ITEM), 4: (1, 0, None, handoff.NO_PROVIDER), 5: (1, 1, None, handoff.NOTHING)}


def test_typed_rows_keep_their_places(spark):
    images = [(u, None, 3, None) for u in ("https://h/a", None, "", "https://h:x1/a", "https://h:81/a", "https://[::1]/a", "https://[::1]:z/a", "https://u:p@h/a:b", "rel/x:y.png")] + [("https://h/b", 1, None, "other")]
    rows = spark.createDataFrame([(1, images), (2, []), (3, None)], "k int, images array<struct<url:string,width:int,height:int,origin:string>>")
    got = handoff.typed_rows(rows, ["k"]).orderBy("id").collect()
    assert [(r.k, r.id) for r in got] == [(1, i) for i in (0, 4, 5, 7, 8, 9)]
    assert got[0].width == 0 and got[0].height == 3 and not got[0].is_other_post and got[-1].is_other_post and got[-1].height == 0


def test_trace(spark):
    rows = [(1, "https://www.instagram.com/u/", None, 9), (2, "https://h.example/", "<img src=a.png><meta itemprop=image content=m.png><i style='background:url(i.png);width:5px;height:5px'></i>", 8), (3, None, None, None), (4, "https://www.instagram.com/p/X/?img_index=4", "", 1)]
    found = sweeps.occurrences(spark.createDataFrame(rows, "page_id bigint, url string, html string, elapsed_ms int").drop("elapsed_ms")).join(spark.createDataFrame([(r[0], r[3]) for r in rows], "page_id bigint, elapsed_ms int"), "page_id")
    got = {r.page_id: r.lines for r in handoff.trace(found).collect()}
    T = handoff.TRACE
    assert got[1] == ["URL: https://www.instagram.com/u/", T["no_slide"], T["first"] % (0, 0), T["no_back"], T["no_next"], T["source"] % (0, 0), T["not_judged"], T["total"] % (0, 9)]
    assert got[2][4:] == [T["elsewhere"], T["source"] % (0, 0), T["meta"] % 1, T["sprites"] % 2, T["sources"] % "img 1 / link/meta 1", T["total"] % (2, 8)]
    assert got[3][-1] == T["total"] % (0, 0) and got[4][1:7] == [T["slide"] % "4", T["first"] % (0, 0), T["back"], T["no_previous"], T["no_next"], T["source"] % (0, 0)]
    walked = found.where("page_id = 1").withColumn("steps", F.array(F.lit("次へ1回目: +0件 20ms")))
    assert "次へ1回目: +0件 20ms" in handoff.trace(walked).first().lines


def test_controls(spark):
    html = """<nav><button aria-label="Back">b</button><a href=/2><span role=button aria-label=next>n</span></a></nav>
    <div aria-label=next></div><button aria-label=next hidden>n</button>
    <article><img width=9 height=9><button aria-label=" 次の写真 ">n</button></article>
    <main><img width=30 height=3><img width=1 height=90><div><button aria-label=prev>p</button></div></main>"""
    rows = [(1, html, True), (2, html, False), (3, None, True), (4, "<b><i><img width=1 height=1></i></b><button aria-label=Back>", False)]
    got = {r.page_id: r for r in controls.controls(H.elements(spark.createDataFrame(rows, "page_id int, html string, forward_first boolean"))).collect()}
    assert got[1].next.label.strip() == "次の写真" and got[1].previous is None  # its article has no way back
    assert got[2].next.label.strip() == "次の写真" and got[2].previous.label == "prev"  # the picture's main has
    assert got[3].next is got[3].scope is got[3].previous is None and got[4].scope == 0 and got[4].previous is None


def test_largest_needs_an_area(spark):
    rows = spark.createDataFrame([(1, 0, "a", 0, 5), (1, 1, "b", 2, 2), (1, 2, "c", 4, 1), (2, 0, "d", 0, 0)], "page_id int, order int, url string, width int, height int")
    assert [(r.page_id, r.url, r.area) for r in scan.largest(rows).collect()] == [(1, "b", 4)]


def test_saving(spark, tmp_path):
    png = bytearray(I.png([[1, 2]]))
    fetched = spark.createDataFrame([("https://h/a.PNG", 200, png), ("https://h/b", 404, png), ("https://h/c.gif", 200, bytearray(b"GIF")), ("https://h/d.svg", 200, bytearray(b'<svg width="3" height="6"><rect width="3" height="3"/></svg>')), ("https://h/e.svg", 200, png), ("https://h/g", 200, None), ("https://h/h.svg", 200, bytearray(b"<svg/>"))], "url string, status int, content binary")
    images = spark.createDataFrame([(i, f"https://h/{u}") for i, u in enumerate(("a.PNG", "b", "c.gif", "d.svg", "e.svg", "f", "g", "h.svg"))], "id bigint, url string")
    rows = saving.saved(images, fetched, "x")
    got = {r.id: r for r in rows.collect()}
    assert [got[i].error for i in range(8)] == [None, "ダウンロード失敗 (HTTP 404)", saving.UNDECODABLE, None, saving.UNDECODABLE, saving.CANCELLED, saving.UNDECODABLE, saving.UNDECODABLE]
    assert got[0].content == png and got[0].name.endswith(".PNG") and got[3].name.startswith("x-") and got[3].name.endswith(".png")
    drawn = I.decode_png(got[3].content)
    assert drawn.shape == (2048, 1024, 4) and (drawn[:1024, :, 3] == 255).all() and not drawn[1024:].any()
    saving.write_library(rows, str(tmp_path / "library"))
    stored = spark.read.parquet(str(tmp_path / "library")).orderBy("seq").collect()
    assert [(r.seq, r.name) for r in stored] == [(0, got[0].name), (3, got[3].name)]


def test_fetched_files(spark, tmp_path):
    (tmp_path / "f" / "in").mkdir(parents=True)
    (tmp_path / "f" / "in" / "a.bin").write_bytes(b"abc")
    index = spark.createDataFrame([("u", 200, "in/a.bin"), ("v", 500, "none")], "url string, status int, path string")
    assert {r.url: (r.status, r.content) for r in saving.fetched_files(spark, index, str(tmp_path / "f")).collect()} == {"u": (200, b"abc"), "v": (500, None)}


def test_thumbnails_and_what_is_pending(spark):
    images = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id int, url string")
    fetched = spark.createDataFrame([("a", 404, bytearray(I.png([[0] * 600] * 3))), ("b", 200, bytearray(b"no"))], "url string, status int, content binary")
    made = {r.id: r for r in saving.thumbnails(images, fetched).collect()}
    assert (made[1].w, made[1].h, made[1].thumb_w, made[1].thumb_h, made[1].failed) == (600, 3, 300, 2, False) and made[2].failed and made[2].thumb_w is None
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    left = lambda *t: sorted(r.id for r in saving.pending(images, *t).collect())
    assert left(ids(1), ids(3), ids(2)) == [4] and left(ids(1), ids(3)) == [2, 4]
    shows = lambda *t: [r.shows for r in saving.shown(images, *t).orderBy("id").collect()]
    assert shows(ids(1, 2), ids(2, 3)) == ["thumbnail", "thumbnail", "failed", "waiting"] and shows(ids(1), ids(3), ids(1, 4)) == ["full", "waiting", "failed", "full"]


def test_log_label_counter_and_clearing(spark, tmp_path):
    settings = spark.createDataFrame([("runs", 4)], "name string, value int")
    assert runlog.stored(settings, "runs").first().value == 4 and runlog.stored(settings, "sizeFilter", 1).first().value == 1
    at = datetime.datetime(2026, 1, 2, 3, 4, 5)
    label = spark.range(1).select(F.lit(1).alias("run_id"), runlog.run_label(F.lit(4), F.lit(at), runlog.version_text(F.lit("1.0"), F.lit(None))).alias("label"))
    assert label.first().label == "実行 #5  01/02 03:04:05  v1.0 (?)"
    none = spark.createDataFrame([], "run_id int, section string, seq int, text string, is_error boolean")
    lines = runlog.log_lines(none, label)
    assert [(r.line_no, r.line) for r in lines.collect()] == [(1, label.first().label)]
    path = str(tmp_path / "log")
    runlog.write_log(lines, path)
    runlog.clear_log(spark, path)
    assert runlog.read_log(spark, path).count() == 0


def test_icons(spark):
    segments = spark.range(1).select(F.explode(icons.glyph()).alias("s")).select("s.*")
    assert segments.count() == 22 and segments.agg(F.max("ay")).first()[0] == 0.885
    by = segments.withColumn("k", F.lit(1))
    low, high = raster.recentre(by, 0.5, ["k"]).agg(F.min(F.least("ax", "bx")), F.max(F.greatest("ax", "bx"))).first()
    assert abs(low - (0.5 - 0.1725)) < 1e-9 and abs(high - (0.5 + 0.1725)) < 1e-9
    slots = spark.createDataFrame([(1, 1, "ipad", "20x20", "2x", 40), (1, 0, "iphone", "20x20", "1x", 20), (1, 2, "ipad", "40x40", "1x", 40)], "k int, slot int, idiom string, size string, scale string, px int")
    got = json.loads(icons.manifest(slots, ["k"]).first().contents)
    assert [i["filename"] for i in got["images"]] == ["icon-20.png", "icon-40.png", "icon-40.png"] and got["info"] == {"author": "xcode", "version": 1} and icons.sizes(slots, ["k"]).count() == 2


def test_save_guards_and_log(spark):
    runs = [(1, 0, False, "denied"), (2, 2, None, "authorized"), (3, 2, True, "not_determined"), (4, 2, True, "restricted"), (5, 2, True, "limited"), (6, None, True, "authorized"), (7, 1, True, None)]
    results = spark.createDataFrame([(5, 1, "https://h/b/", False, "no"), (5, 0, "https://h/a.png?x", True, None), (4, 0, "https://h/z", True, None)], "run_id int, seq int, url string, ok boolean, error string")
    done = saving.outcomes(spark.createDataFrame(runs, "run_id int, n_selected int, usage_text boolean, permission string"), results, "App")
    got = {r.run_id: (r.stopped, r.succeeded, r.failed) for r in done.collect()}
    assert got == {1: ("none", 0, 0), 2: ("no_usage", 0, 2), 3: ("unasked", 0, 2), 4: ("denied", 0, 2), 5: (None, 1, 1), 6: ("none", 0, 0), 7: ("denied", 0, 1)}
    assert {r.run_id: r.message for r in done.collect()}[5] == "no" and "「App」" in done.where("run_id = 3").first().message
    lines = {}
    for r in saving.save_log(done, results).orderBy("run_id", "part", "seq").collect():
        lines.setdefault(r.run_id, []).append(("[ERR] " if r.is_error else "") + r.line)
    assert lines[5] == ["保存開始: 2件", "説明文の有無: あり", "権限状態: 一部のみ許可", "OK: a.png", "[ERR] 失敗: b — no", "完了: 成功1 失敗1"]
    assert lines[1] == ["[ERR] 保存対象が0件です"] and lines[2] == ["保存開始: 2件", "[ERR] 説明文の有無: なし(致命的)"] and lines[3][-1] == "[ERR] " + saving.LOG["unasked"] and len(lines[4]) == 4


def test_grid_of_cells(spark):
    """The icon at 1024 x 1024: the same pixels as by looking at all segments, with a fraction of the looks."""
    glyph = spark.range(1).select(F.lit(1).alias("k"), F.explode(icons.glyph()).alias("s")).select("k", "s.*")
    size, stroke, n = 1024, 0.055, glyph.count()
    cells = raster.grid(glyph, size, stroke, ["k"]).cache()
    looks = cells.agg(F.sum(F.size("near") * 32 * 32)).first()[0]
    assert looks < 0.1 * n * size * size
    every = glyph.groupBy("k").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("all"))
    # of the rows of pixels through each fourth row, all of them; elsewhere nothing may be covered that the grid left out
    direct = every.select("all", F.explode(F.sequence(F.lit(2), F.lit(size - 1), F.lit(4))).alias("y")).select("all", "y", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("x"))
    direct = direct.select("y", "x", raster.coverage(F.col("all"), F.col("x"), F.col("y"), size, stroke).alias("alpha")).where("alpha > 0")
    found = raster.covered(glyph, size, stroke, ["k"]).where("y % 4 = 2").select("y", "x", "alpha")
    assert found.count() > 1000 and found.exceptAll(direct).count() == 0 == direct.exceptAll(found).count()


def test_a_run_is_stored_once(spark, tmp_path):
    """A write that fails midway leaves no run; the next one replaces what it left; a stored run stays as it is."""
    rows = spark.range(40).selectExpr("id", "id AS seq", "true AS ok", "concat('n', id) AS name", "encode('x', 'UTF-8') AS content").repartition(4)
    path = str(tmp_path / "library")
    bad = rows.withColumn("name", F.when(F.col("seq") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    try:
        saving.write_library(bad, path, "r1")
        raise AssertionError("it was to fail")
    except Exception as e:
        assert "lost" in str(e)
    assert saving.write_library(rows, path, "r1") and not saving.write_library(rows.limit(3), path, "r1") and saving.write_library(rows.limit(3), path, "r2")
    stored = spark.read.parquet(path)
    assert {(r.run_id, r.n, r.d) for r in stored.groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("name").alias("d")).collect()} == {("r1", 40, 40), ("r2", 3, 3)}
    files = stored.where("run_id = 'r1'").groupBy(F.input_file_name().alias("f")).agg(F.min("seq").alias("a"), F.max("seq").alias("b")).orderBy("f").collect()
    assert all(x.b < y.a for x, y in zip(files, files[1:]))


def test_cells_that_a_stroke_reaches(spark):
    """A diagonal's box touches every cell, its stroke a band of them; pixels where strokes cross keep the larger alpha."""
    lines = spark.createDataFrame([(1, 0.1, 0.1, 0.9, 0.9), (2, 0.1, 0.9, 0.9, 0.1), (2, 0.1, 0.1, 0.9, 0.9), (3, 0.5, 0.5, 0.5, 0.5), (3, 0.5, 0.5, 0.5, 0.5)], "k int, ax double, ay double, bx double, by double")
    size, stroke = 64, 0.1
    n = {r.k: r.n for r in raster.grid(lines, size, stroke, ["k"], 8).groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert n[1] < 40 and n[2] < 64 and n[3] == 4
    all_of = lines.groupBy("k").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("all")).select("k", "all", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("i")).selectExpr("k", "all", "CAST(i div 64 AS INT) AS y", "i % 64 AS x")
    direct = all_of.select("k", "y", "x", raster.coverage(F.col("all"), F.col("x"), F.col("y"), size, stroke).alias("alpha")).where("alpha > 0")
    found = raster.covered(lines, size, stroke, ["k"], 8)
    assert found.exceptAll(direct).count() == 0 == direct.exceptAll(found).count() and found.groupBy("k", "y", "x").count().where("count > 1").count() == 0
    assert "ArrayTransform" not in found._jdf.queryExecution().optimizedPlan().toString() and "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
