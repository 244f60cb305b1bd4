"""Extraction rules by hand-derived cases: sources, sweeps, URL forms, view, log, raster, stream."""

import math
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelens.config import DEFAULT
from pagelens.functions import columns as C
from pagelens.operators import carousel, raster, runlog, scan, view
from pagelens.sources import urls as U
from pagelens.sources import images as I


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


SRCSETS = [("a.jpg 320w, b.jpg 1600w, c.jpg 2x", "c.jpg"), ("a.jpg 1x,b.jpg 1000w", "a.jpg"), ("a.jpg abc, b.jpg -5w", "a.jpg"), ("a.jpg -1w", None), ("", None), (" , ,x.png", "x.png"), ("a.jpg 1.5x, b.jpg 1501w", "b.jpg"), ("a.jpg\t2e3w,b.jpg 1x", "a.jpg"), ("a,b.jpg 2w", "b.jpg")]


@pytest.mark.parametrize("srcset,best", SRCSETS)
def test_srcset(spark, srcset, best):
    assert one(spark, C.best_from_srcset(F.col("s")), s=srcset) == best


@pytest.mark.parametrize("path,key", [("/p/X/", "post:X"), ("/user/p/X/", "post:X"), ("/p/X/media", "post:X"), ("/REEL/y?z", "post:y"), ("/a/b/c", "path:/a/b"), ("/", "path:"), ("", "path:"), ("/xp/q", "path:/xp/q")])
def test_page_key(spark, path, key):
    assert one(spark, C.page_key(F.col("p")), p=path) == key


@pytest.mark.parametrize("url,label,saved", [("https://x/a.HEIF", "HEIF", "HEIF"), ("https://x/a.jpeg?y=.png", "JPEG", "jpeg"), ("https://x/a.JPG", "JPEG", "JPG"), ("https://x/a", "", "jpg"), ("https://x/a.tiff", "TIFF", "tiff"), ("https://x.com", "", "jpg"), ("https://x/.png", "", "jpg")])
def test_format_label(spark, url, label, saved):
    assert one(spark, C.format_label(F.col("u")), u=url) == label
    assert one(spark, C.save_extension(F.col("u")), u=url) == saved


@pytest.mark.parametrize("url,want", [("../b c.png", "https://h.example/x/b%20c.png"), ("//CDN.Example:443/é.png", "https://cdn.example/%C3%A9.png"), (" data:image/png;base64,x", None), ("", None), (None, None), ("a\n.png?q=1#f", "https://h.example/x/y/a.png?q=1#f"), ("http://h:80", "http://h/"), ("blob:abc", "blob:abc"), ("http://[bad", None)])
def test_resolve_url(url, want):
    assert U.resolve(url, "https://h.example/x/y/z.html") == want


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_resolving_twice_changes_nothing(text):
    if (once := U.resolve(text, "https://h.example/a/")) and once.startswith("http"):
        assert U.resolve(once, "https://h.example/a/") == once


def extract(spark, markup, url="https://h.example/"):
    rows = scan.extract_images(spark.createDataFrame([(1, url, markup)], "page_id bigint, url string, html string")).orderBy("order").collect()
    return [(r.url.rpartition("/")[2], r.origin, r.sweep) for r in rows]


def test_sweeps_and_precedence(spark):
    video = '<section><video poster=p.png></video><div><img src=cover.png></div></section><img src=cover.png><img src=b.png>'
    assert extract(spark, video) == [("p.png", "video", "video"), ("cover.png", "video", "video"), ("b.png", "dom", "img")]
    assert extract(spark, '<meta property="og:image" content=a.png><img src=a.png><meta itemprop=image content=m.png>') == [("a.png", "dom", "img"), ("m.png", "meta", "link/meta")]
    link = '<link rel="x preload" as=image href=l.png imagesrcset="s.png 2x">'
    assert extract(spark, link) == [("l.png", "dom", "link/meta"), ("s.png", "dom", "link/meta")]
    assert extract(spark, link, "https://www.instagram.com/")[0][1] == "meta"
    assert extract(spark, '<img data-original=z.png data-src=""><picture><source srcset="q.png 1w"></picture><source src=no.png><svg><image xlink:href=v.png></svg><b poster=o.png>') == [("z.png", "dom", "img"), ("q.png", "dom", "source"), ("o.png", "video", "poster"), ("v.png", "dom", "svg")]
    assert extract(spark, '<i style="background-image:url(1.png), url(\'2.png\')"></i><i style="color:url(3.png)"></i>') == [("1.png", "dom", "css"), ("2.png", "dom", "css")]
    shadow = '<img src=a.png><div><template shadowrootmode=open><img src=s.png></template></div><iframe srcdoc="<img src=f.png>"></iframe>'
    assert extract(spark, shadow) == [("a.png", "dom", "img"), ("s.png", "dom", "img"), ("f.png", "dom", "img")]
    assert extract(spark, "<noscript><img src=a.png></noscript><template><img src=b.png></template>") == []
    assert extract(spark, None) == [] == extract(spark, "")


def test_links_elsewhere(spark):
    inside = '<a href="/p/other/"><img src=1.png></a><a href="/u/p/ME/x"><img src=2.png></a><img src=1.png>'
    assert [o for _, o, _ in extract(spark, inside, "https://www.instagram.com/p/ME/")] == ["other", "dom"]
    assert {o for _, o, _ in extract(spark, inside, "https://www.instagram.com/someone/")} == {"dom"}
    assert {o for _, o, _ in extract(spark, inside, "https://h.example/p/ME/")} == {"dom"}


def test_source_scan(spark):
    markup = r'"https:\/\/a.example/x.JPG" https://b.example/y.jpg.webp <i src=https://h.example/rsrc.php/1.png> https://b.example/z.png?q={1}' + "https://many.example/m.png " * 900 + "https://late.example/l.png"
    df = spark.createDataFrame([(1, markup), (2, None)], "page_id bigint, html string")
    assert [r.url for r in scan.source_scan(df).orderBy("pos").collect()] == ["https://a.example/x.JPG", "https://b.example/y.jpg", "https://b.example/z.png?q=", "https://many.example/m.png"]
    plan = scan.source_scan(df)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan and DEFAULT.source_matches == 800


def test_view_gates_and_tiers(spark):
    sizes = [0, 299, 300, 649, 650]
    images = spark.createDataFrame([(i, "https://x/a.png", s, 1 if s else 0, o) for i, (s, o) in enumerate([*((s, None) for s in sizes), (900, "source"), (900, "other")])], "id bigint, url string, width int, height int, origin string")
    px, none = spark.createDataFrame([(1, 700.0, 5.0)], "id bigint, w double, h double"), spark.createDataFrame([], "id bigint")
    ids = lambda g, saved=none: {r.id for r in view.visible(images, px, saved, g).collect()}
    assert ids(view.Gates()) == {0, 1, 2, 3, 4} == ids(view.Gates(size_tier=9))
    assert ids(view.Gates(size_tier=1)) == {0, 1, 2, 3, 4} and ids(view.Gates(size_tier=2)) == {0, 1, 4}
    assert ids(view.Gates(source_only=True), spark.createDataFrame([(0,)], "id bigint")) == {1, 2, 3, 4, 5}
    assert view.all_selected(images.limit(0), none).first().all_selected is False
    assert [r.idx for r in view.numbered(images.select("id")).orderBy("id").collect()] == list(range(7))


@pytest.mark.parametrize("n", [0, 1, 3, 5000])
def test_numbering(spark, n):
    rows = spark.range(n).selectExpr("id * 7919 % 100003 - 40 AS id", "'x' AS url").repartition(5)
    got = {r.id: r.idx for r in view.numbered(rows).collect()}
    assert [got[i] for i in sorted(got)] == list(range(n))
    assert {r.idx: r.id for r in view.numbered(rows.union(spark.sql("SELECT CAST(NULL AS BIGINT), 'y'"))).collect()}[0] is None


def test_walk_stops(spark):
    rows = [(1, 1, s, 100 * s, "a" if s < 5 else "b") for s in range(1, 8)] + [(2, 1, s, 10 * s, "a") for s in range(1, 40)] + [(3, 1, s, 200 * s, "a") for s in range(1, 9)]
    kept = carousel.admitted(spark.createDataFrame(rows, "page_id bigint, pass_no int, step int, elapsed_ms int, identity string")).groupBy("page_id").count().collect()
    assert {r.page_id: r["count"] for r in kept} == {1: 4, 2: 30, 3: 4}
    two = [(1, 1, s, s, "a") for s in range(1, 33)] + [(1, 2, s, 40 + s, "a") for s in range(1, 4)]
    assert carousel.admitted(spark.createDataFrame(two, "page_id bigint, pass_no int, step int, elapsed_ms int, identity string")).count() == 30


def test_selectors_repeated_pages_and_drawings(spark):
    assert [u for u, *_ in extract(spark, '<link rel=PRELOAD as=image href=a.png><link rel=preload as=IMAGE href=b.png>')] == ["a.png"]
    pages = spark.createDataFrame([(1, "https://h.example/", "<img src=a.png><img src=b.png>")] * 2, "page_id bigint, url string, html string")
    images = scan.extract_images(pages)
    assert sorted((r.order, r.url[-5:]) for r in images.collect()) == [(0, "a.png"), (0, "a.png"), (1, "b.png"), (1, "b.png")]
    assert "Exchange" not in images._jdf.queryExecution().toString()
    assert I.fit(10, 5, 2048, drawing=True) == (2048, 1024) and I.fit(10, 5, 2048) == (10, 5)


def test_pixels_outside_a_widened_box_are_empty(spark):
    """A horizontal segment reaches half its stroke beyond its ends and sides, no further."""
    seg = F.array(F.struct(*[F.lit(v).alias(k) for k, v in zip(("ax", "ay", "bx", "by"), (0.25, 0.5, 0.75, 0.5), strict=True)]))
    grid = spark.range(256).selectExpr("id div 16 AS y", "id % 16 AS x")
    got = {(r.y, r.x): r.a for r in grid.select("y", "x", raster.coverage(seg, F.col("x"), F.col("y"), 16, 0.1).alias("a")).collect()}
    for (y, x), a in got.items():
        px, py = (x + 0.5) / 16, (y + 0.5) / 16
        if not (0.2 <= px <= 0.8 and 0.45 <= py <= 0.55):
            assert a == 0
    assert got[7, 8] == 204 and sum(a > 0 for a in got.values()) == 20  # (0.05 - 1 / 32) * 16 + 0.5 of 255


def test_log_store(spark, tmp_path):
    entries = spark.createDataFrame([(1, "current", 0, "ok", False), (1, "current", 1, "bad", True), (1, "previous", 0, "old", None)], "run_id int, section string, seq int, text string, is_error boolean")
    lines = [r.line for r in runlog.log_lines(entries).orderBy("line_no").collect()]
    assert lines == ["=== 今回の保存 ===", "ok", "[ERR] bad", "=== 前回の記録 ===", "old"]
    assert runlog.read_log(spark, str(tmp_path / "none")).count() == 0
    runlog.write_log(runlog.log_lines(entries), str(tmp_path / "log"))
    assert runlog.read_log(spark, str(tmp_path / "log")).where(runlog.is_error_line(F.col("line"))).count() == 1


def test_image_headers():
    png = I.png([[0, 255, 3]] * 2)
    assert I.header_size(png) == (3, 2) and png.endswith(b"IEND" + struct.pack(">I", 0xAE426082))
    assert I.header_size(b"GIF89a" + struct.pack("<HH", 7, 9)) == (7, 9)
    assert I.header_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 5, 6) + b"\x01") == (6, 5)
    assert I.header_size(b"RIFF0000WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")) == (100, 50)
    assert I.header_size(None) is None is I.header_size(b"\x89PNG\r\n\x1a\n") and I.fit(4000, 1000, 2048) == (2048, 512)


def test_raster(spark):
    s = lambda ax, ay, bx, by: F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("ax", "ay", "bx", "by"), (ax, ay, bx, by), strict=True)])
    d = lambda x, y, seg: one(spark, raster.segment_distance(F.lit(float(x)), F.lit(float(y)), seg), u=1)
    assert d(1, 1, s(0, 0, 2, 0)) == 1 and d(3, 4, s(0, 0, 0, 0)) == 5 and d(5, 4, s(0, 0, 2, 0)) == 5
    pixels = spark.createDataFrame([(1, y, x, (x + y) % 3) for y in range(4) for x in range(4)], "k int, y int, x int, alpha int")
    out = {(r.ty, r.tx): r.alpha for r in raster.downsample(pixels, 4, 2, ["k"]).collect()}
    assert out == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    corner = spark.range(1).select(raster.arc(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(math.pi), F.lit(math.pi / 2)).alias("p")).select("p", F.size(raster.polyline(F.col("p"))).alias("n")).first()
    assert corner.n == 8 and abs(corner.p[0].x + 2) < 1e-9 and abs(corner.p[8].y - 2) < 1e-9
