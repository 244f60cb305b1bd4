"""The registered queries over the given tables, and SQL that states their results on its own.

The pages hold no images, so markup is injected as an expression of page_id; image rows, snapshots and fetch results
for the view, the walk and the save are derived from pages and conversations in the same way.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, WHOLE, ExtractConfig
from ..functions import columns as C
from ..operators import carousel, controls, handoff, icons, raster, runlog, saving, scan, sweeps, view
from ..sources import html as H
from ..sources import images as I
from ..streaming import walk

ID = "CAST(page_id AS STRING)"
BS = "chr(92)"

#: Markup by page, as SQL that Spark and DuckDB read alike.
INJECTED = f"""html || '<img src="https://cdn.example.com/a/' || CAST(page_id % 7 AS STRING) || '.webp">'
 || CASE WHEN page_id % 2 = 0 THEN '<img src="/rel/' || {ID} || '.JPG?x=1">' ELSE '' END
 || CASE WHEN page_id % 3 = 0 THEN '<img src="https://Static.CDNinstagram.com/ui/x.png"><img src="https://h.example.com/rsrc.php/v3/y.png">' ELSE '' END
 || CASE WHEN page_id % 4 = 1 THEN '<script>x={{"u":"https:' || {BS} || '/' || {BS} || '/img.example.net' || {BS} || 'u002Fp' || {BS} || 'u002f' || {ID} || '.jpeg"}}</script>' ELSE '' END
 || CASE WHEN page_id % 5 = 2 THEN '<section><video poster="https://v.example.com/' || {ID} || '.png"></video></section>' ELSE '' END
 || CASE WHEN page_id % 5 = 3 THEN '<meta property="og:image" content="https://cdn.example.com/a/' || CAST(page_id % 7 AS STRING) || '.webp"><meta name="twitter:image" content="https://m.example.com/' || {ID} || '.gif">' ELSE '' END
 || CASE WHEN page_id % 6 = 4 THEN '<div style="background-image: url(https://bg.example.com/' || {ID} || '/1.png), url(https://bg.example.com/' || {ID} || '/2.svg)"></div>' ELSE '' END
 || CASE WHEN page_id % 6 = 1 THEN '<img data-original="https://lazy.example.com/' || {ID} || '.heic"><img srcset="https://s.example.com/a.jpg 320w, https://s.example.com/b.jpg 1600w, https://s.example.com/c' || {ID} || '.jpg 2x">' ELSE '' END
 || CASE WHEN page_id % 4 = 2 THEN '<a href="https://www.instagram.com/p/zzz/"><img src="https://other.example.com/' || {ID} || '.png"></a>' ELSE '' END"""
#: A third of the pages become permalinks of a carousel site.
POSTED = f"CASE WHEN page_id % 3 = 1 THEN 'https://www.instagram.com/u/p/C' || {ID} || '/?img_index=' || CAST(page_id % 6 AS STRING) ELSE url END"
MANY = "html || repeat('<i>https://many.example.com/x.png</i>', 850) || '<i>https://late.example.com/y.png</i>'"

TRACED = f"""{INJECTED} || '<style>.icon{{background:url(https://bg.example.com/icon.png);width:20px;height:20px}}</style>' || repeat('<i class="icon"></i>', CAST(page_id % 3 AS INT))
 || CASE WHEN page_id % 5 = 0 THEN '<img src="https://cdn.example.com/t51.2885-19/' || repeat('n', 30) || '.jpg">' ELSE '' END"""
NESTED = f"""html || '<section><div><video poster="https://v.example.com/' || {ID} || '.png"></video><p><img src="https://c.example.com/1.png"><span><img src="https://c.example.com/2.png"></span></p></div><img src="https://c.example.com/3.png"></section>'
 || '<a href="https://www.instagram.com/p/zzz/"><div><b><img src="https://l.example.com/1.png"></b></div></a><a href="/p/C' || {ID} || '/"><img src="https://l.example.com/2.png"></a><img src="https://l.example.com/3.png">'
 || CASE WHEN page_id % 2 = 0 THEN '<a href="/p/other/"><img src="https://l.example.com/3.png"><img src="https://l.example.com/4.png"></a>' ELSE '' END"""
STYLED = f"""html || '<style>/* .k0{{}} */ .k' || CAST(page_id % 3 AS STRING) || '{{background:url(https://bg.example.com/' || {ID} || '/c.png);width:40px;height:40px}} div.big{{height:80px}} #only{{background-image:url("https://bg.example.com/' || {ID} || '/i.png")!important}} @media screen{{.m, p > b{{background:url(https://bg.example.com/' || {ID} || '/m.png)}}}}</style>'
 || '<div class="k0 big"></div><div class="k1"></div><div class="x k2 y"></div><div id="only" class="m" style="background:url(https://no.example.com/n.png)"></div><div class="m" style="width:59px"></div><p><b>x</b></p>'"""
CHAINED = f"""html || '<style>[data-k~="' || {ID} || '"] > p b, i[title$=".x" i]{{background:url(https://bg.example.com/' || {ID} || '/1.png)}} p > b{{background:url(https://bg.example.com/' || {ID} || '/2.png)}} section .in u[lang|=EN]{{background-image:url(https://bg.example.com/' || CAST(page_id % 5 AS STRING) || '/3.png);width:20px;height:' || CAST(page_id % 2 * 40 + 50 AS STRING) || 'px}} p + b{{background:url(https://bg.example.com/no.png)}}</style>'
 || '<section data-k="a ' || {ID} || ' b"><p><span><b>1</b></span></p><div><p><b>2</b></p><span class="in"><u lang="en-GB">3</u></span></div></section><u lang="en">4</u><section data-k="' || {ID} || '0"><p><span><b>5</b></span></p></section>'
 || CASE WHEN page_id % 3 = 0 THEN '<i title="a.X">6</i>' ELSE '<i title="a.X "></i>' END"""
DECLARED = f"""html || '<picture><source srcset="https://s.example.com/1.png 1x, https://s.example.com/2.png 2x"><img src="https://i.example.com/0.png"></picture><source src="https://s.example.com/no.png"><div poster="https://p.example.com/' || {ID} || '.png"></div>'
 || '<link rel="PRELOAD x" as="image" href="https://l.example.com/1.png" imagesrcset="https://l.example.com/2.png 2x"><link rel="apple-touch-icon" href="https://l.example.com/3.png"><link rel="preload" as="script" href="https://l.example.com/no.png"><meta itemprop="image" content="https://m.example.com/1.png"><svg><image xlink:href="https://d.example.com/1.png"></image></svg>'
 || '<div><template shadowrootmode="open"><img src="https://h.example.com/1.png"><div><template shadowrootmode="open"><video poster="https://h.example.com/2.png"></video></template></div></template></div><template><img src="https://t.example.com/no.png"></template>'"""
FRAMED = f"""html || '<iframe src="/frame/' || {ID} || '"></iframe><iframe src="https://else.example.com/f"></iframe><iframe srcdoc="<img src=/s.png>"></iframe><img src="/own.png">'"""

IMAGES = """CAST(page_id AS BIGINT) AS id, 'https://cdn.example.com/d/' || CAST(page_id AS STRING) || CASE page_id % 6 WHEN 0 THEN '.HEIF' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.JPG' WHEN 3 THEN '' WHEN 4 THEN '.tiff' ELSE '.svg' END AS url,
 CAST((page_id * 37) % 1000 AS INT) * CASE WHEN page_id % 8 = 5 THEN 0 ELSE 1 END AS width, CAST((page_id * 53) % 900 AS INT) * CASE WHEN page_id % 8 = 5 THEN 0 ELSE 1 END AS height,
 CASE page_id % 9 WHEN 1 THEN 'source' WHEN 3 THEN 'video' WHEN 5 THEN 'meta' WHEN 7 THEN 'other' WHEN 8 THEN NULL ELSE 'dom' END AS origin"""
PIXELS = "SELECT CAST(page_id AS BIGINT) AS id, CAST((page_id * 71) % 1200 AS DOUBLE) AS w, CAST((page_id * 29) % 1300 AS DOUBLE) AS h FROM pages WHERE page_id % 3 = 0"


#: For queries whose SQL states the limit on matches of the source, and no other.
MATCHED = replace(WHOLE, source_matches=DEFAULT.source_matches)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _injected(spark: SparkSession, sf_dir: str, html: str = INJECTED) -> DataFrame:
    return _pages(spark, sf_dir).selectExpr("page_id", "url", f"{html} AS html")


def _images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Images, true pixel sizes, saved and selected ids."""
    p = _pages(spark, sf_dir)
    px = p.where("page_id % 3 = 0").selectExpr("CAST(page_id AS BIGINT) AS id", "CAST((page_id * 71) % 1200 AS DOUBLE) AS w", "CAST((page_id * 29) % 1300 AS DOUBLE) AS h")
    ids = lambda c: p.where(c).selectExpr("CAST(page_id AS BIGINT) AS id")
    return p.selectExpr(*_split(IMAGES)), px, ids("page_id % 11 = 0"), ids("page_id % 4 = 0")


def _split(select: str) -> list[str]:
    """Select items, split at top-level commas."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(select):
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "," and not depth:
            out.append(select[at:i])
            at = i + 1
    return [*out, select[at:]]


def source_scan_urls(spark, d):
    return scan.source_scan(_injected(spark, d)).select("page_id", "url", C.format_label(F.col("url")).alias("format"))


def source_scan_cap(spark, d):
    return _injected(spark, d, MANY).select("page_id", F.size(scan.source_matches(F.col("html"))).cast("bigint").alias("n_matches"), F.size(F.array_distinct(scan.source_matches(F.col("html")))).cast("bigint").alias("n_urls"))


def format_label_counts(spark, d):
    images = _images(spark, d)[0]
    return images.groupBy(C.format_label(F.col("url")).alias("format")).agg(F.count("*").alias("n"), F.count_if(F.lower(C.extension(F.col("url"))) == "svg").alias("n_svg"))


def ui_asset_skips(spark, d):
    """Two sweeps over the images, and the source once."""
    return scan.skips(sweeps.occurrences(_injected(spark, d), WHOLE)).select("page_id", F.col("n_assets").alias("n_skipped"))


SRCSETS = "CASE page_id % 5 WHEN 0 THEN 'a.jpg 320w, b.jpg 1600w, c' || CAST(page_id AS STRING) || '.jpg 2x' WHEN 1 THEN 'a.jpg 1x,b.jpg 1000w' WHEN 2 THEN 'a.jpg abc, b.jpg -5w' WHEN 3 THEN ' , x.png' ELSE '' END"


def srcset_best(spark, d):
    return _pages(spark, d).selectExpr("page_id", f"{SRCSETS} AS srcset").select("page_id", C.best_from_srcset(F.col("srcset")).alias("best"))


def lazy_attr_coalesce(spark, d):
    p = _pages(spark, d).selectExpr("page_id", "CASE WHEN page_id % 2 = 0 THEN '' ELSE NULL END AS a", "CASE WHEN page_id % 3 = 0 THEN url ELSE '' END AS b", "CASE WHEN page_id % 5 = 0 THEN 'z' END AS c")
    return p.select("page_id", C.first_non_empty(F.col("a"), F.col("b"), F.col("c")).alias("url"))


def page_key(spark, d):
    p = _pages(spark, d).selectExpr("page_id", f"{POSTED} AS url").withColumn("p", C.path(F.col("url")))
    return p.select("page_id", C.page_key(F.col("p")).alias("page_key"), C.is_permalink(F.col("p")).alias("permalink"), C.page_identity(F.col("url")).alias("identity"))


def host_allowlist(spark, d):
    h = _pages(spark, d).selectExpr(f"{POSTED} AS url").select(C.host(F.col("url")).alias("host"))
    return h.groupBy("host").agg(F.count("*").alias("n"), F.first(C.walks_carousels(F.col("host"))).alias("walks"))


def start_slide_plan(spark, d):
    p = _pages(spark, d).selectExpr("page_id", f"{POSTED} AS url").withColumn("slide", C.starting_slide(F.col("url")))
    return p.select("page_id", "slide", F.array_join(C.passes(F.col("slide")), ">").alias("passes"))


def resolve_anchor_urls(spark, d):
    return H.anchors(_pages(spark, d)).select("page_id", "pos", "href", "url")


def css_background_urls(spark, d):
    p = _pages(spark, d).selectExpr("page_id", "'background-image: url(\"https://bg.example.com/' || CAST(page_id AS STRING) || '.png\"), url(/two.gif)' AS style", "CAST((page_id * 7) % 90 AS DOUBLE) AS w", "CAST((page_id * 11) % 90 AS DOUBLE) AS h")
    return p.where(~C.is_sprite(F.col("w"), F.col("h"))).select("page_id", F.posexplode(C.css_urls(F.col("style"))).alias("pos", "url"))


def _occurrences(spark, d, html: str = INJECTED, config: ExtractConfig = WHOLE):
    return sweeps.occurrences(_pages(spark, d).selectExpr("page_id", f"{POSTED} AS url", f"{html} AS html"), config)


def _extracted(spark, d):
    return scan.images_of(_occurrences(spark, d))


def extract_images(spark, d):
    return _extracted(spark, d).select("page_id", "url", "width", "height", "origin")


def origin_counts(spark, d):
    return _extracted(spark, d).groupBy("origin").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages"))


def links_elsewhere(spark, d):
    return _extracted(spark, d).select("page_id", "url", (F.col("origin") == "other").alias("elsewhere"))


def rendered_names(spark, d):
    """File names of a page's own images, as lazily loaded ones with long names are added to each page."""
    more = " || '<img src=\"https://cdn.example.com/t51.2885-15/' || repeat('n', 8 + CAST(page_id % 40 AS INT)) || '.jpg?x=/y\"><img src=\"https://cdn.example.com/t51.2885-19/' || repeat('n', 8 + CAST(page_id % 40 AS INT)) || '.jpg\">'"
    return scan.rendered_names(scan.extract_images(_pages(spark, d).selectExpr("page_id", "url", f"html{more} AS html"), WHOLE))


def largest_image(spark, d):
    """Of the anchors' targets of each page, with sizes told from their length and place."""
    a = H.anchors(_pages(spark, d)).select("page_id", F.col("pos").cast("bigint").alias("order"), F.col("href").alias("url"), F.length("href").alias("width"), (F.col("pos") % 3 + 1).alias("height"))
    return scan.largest(a)


def sweep_counts(spark, d):
    return scan.sweep_counts(_occurrences(spark, d))


def payload_sizes(spark, d):
    pages = _pages(spark, d).selectExpr("page_id", f"{POSTED} AS url", f"CASE WHEN page_id % 10 = 0 THEN html ELSE {INJECTED} END AS html")
    return scan.payload(scan.extract_images(pages, WHOLE), pages).select("page_id", "page_url", F.size("images").cast("bigint").alias("n_images"))


GATES = view.Gates(video_posters=True, other_posts=True, size_tier=1)


def visible_images(spark, d):
    images, px, saved, _ = _images(spark, d)
    return view.numbered(view.visible(images, px, saved, GATES)).select("id", "url", "longest_side", "idx")


def hidden_counts(spark, d):
    images, _, saved, _ = _images(spark, d)
    return view.hidden_counts(images, saved, GATES)


def select_all_toggle(spark, d):
    images, px, saved, selected = _images(spark, d)
    shown = view.visible(images, px, saved, GATES)
    steps = {"all": view.select_all(selected, shown), "none": view.deselect(selected, shown), "saved": view.deselect(selected, saved), "toggled": view.toggle(selected, shown), "acting": shown.join(selected, "id", "left_semi").select("id")}
    out = None
    for k, rows in steps.items():
        one = rows.select(F.lit(k).alias("step"), "id")
        out = one if out is None else out.union(one)
    return out


def all_selected(spark, d):
    images, px, saved, selected = _images(spark, d)
    return view.all_selected(view.visible(images, px, saved, GATES), selected)


def save_tally(spark, d):
    images, _, _, selected = _images(spark, d)
    return view.save_tally(saving.saved(images.join(selected, "id", "left_semi"), _fetched(spark, d)))


def _saves(spark, d):
    """Conversations as runs of a save, turns as images."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").where("conv_id % 6 <> 5")
    results = turns.selectExpr("conv_id AS run_id", "turn AS seq", "'https://h.example/' || role || '/' || CAST(turn AS STRING) || '.png?x=/y' AS url", "turn % 3 <> 1 AS ok").withColumn("error", F.when(~F.col("ok"), F.format_string(saving.HTTP_ERROR, F.col("seq") + 500)))
    every = spark.read.parquet(f"{d}/conversations.parquet").groupBy(F.col("conv_id").alias("run_id")).agg(F.count_if(F.col("conv_id") % 6 != 5).alias("n_selected"))
    runs = every.selectExpr("run_id", "n_selected", "run_id % 5 <> 4 AS usage_text", "element_at(array('authorized', 'limited', 'denied', 'not_determined', 'other'), CAST(run_id % 7 % 5 AS INT) + 1) AS permission")
    return saving.outcomes(runs, results), results


def save_outcomes(spark, d):
    return _saves(spark, d)[0].select("run_id", "succeeded", "failed", "message")


def save_log(spark, d):
    return saving.save_log(*_saves(spark, d))


def badge_text(spark, d):
    images, px, _, _ = _images(spark, d)
    return view.with_pixels(images, px).select("id", view.badge(F.col("url")).alias("badge"), view.badge(F.col("url"), "  ").alias("info"), C.save_extension(F.col("url")).alias("extension"))


def carousel_dedup(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    snapshots = turns.selectExpr("conv_id AS page_id", "1 AS pass_no", "CAST(turn AS INT) + 1 AS step", "conv_id % 3 = 0 AS backward", "CAST(turn * 120 AS INT) AS elapsed_ms", "CASE WHEN conv_id % 10 = 0 AND turn >= 3 THEN 'gone' ELSE 'here' END AS identity", "role", "turn")
    kept = carousel.admitted(snapshots)
    found = kept.select("page_id", "pass_no", "step", "backward", F.posexplode(F.array(F.concat(F.lit("https://slide/"), F.col("role")), F.concat(F.lit("https://slide/"), (F.col("turn") % 4).cast("string")))).alias("n", "url"))
    return carousel.first_seen(found).select("page_id", "url", "step", "order")


POLLS = """conv_id AS page_id, turn AS seq, CAST(turn * 100 AS INT) AS elapsed_ms, CASE WHEN conv_id % 5 = 4 THEN 'https://h.example/' ELSE 'https://www.instagram.com/p/' || CASE WHEN conv_id % 5 = 3 AND turn >= 3 THEN 'gone' ELSE 'here' END || '/' || CASE WHEN conv_id % 3 = 0 THEN '?img_index=4' ELSE '' END END AS url,
 CAST(turn AS STRING) AS signature, conv_id % 7 <> 5 AS has_next, turn < 3 AS has_previous, array(struct('https://slide/' || role AS url, 'dom' AS origin), struct('https://slide/' || CAST(turn % 4 AS STRING) AS url, 'meta' AS origin)) AS images,
 array(struct('https://behind/' || CAST(turn AS STRING) AS url, 'dom' AS origin)) AS extra, array('https://source/x', 'https://slide/0') AS source"""


def slide_walk(spark, d):
    """Each conversation as a page that is walked, a poll a turn: back and forth, beyond a page, or nowhere."""
    polls = spark.read.parquet(f"{d}/conversations.parquet").selectExpr(*_split(POLLS))
    return walk.walked(polls).where("kind = 'image'").select("page_id", "url", "origin", "order")


def slide_change_points(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet").selectExpr("conv_id", "turn", "array(role, text, CAST(turn div 2 AS STRING)) AS shown")
    return carousel.change_points(turns, "conv_id", ["turn"], "shown").select("conv_id", "turn", "signature", "changed")


def run_log_lines(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").selectExpr("conv_id AS run_id", "CASE role WHEN 'system' THEN 'extraction' WHEN 'user' THEN 'current' ELSE 'previous' END AS section", "turn AS seq", "text", "turn % 4 = 2 AS is_error")
    return runlog.log_lines(rows)


def _drawn(spark, d):
    """A segment per page drawn on a 16 x 16 canvas."""
    p = _pages(spark, d).select("page_id", *[F.explode(F.sequence(F.lit(0), F.lit(15))).alias("y")])
    p = p.select("page_id", "y", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("x"))
    end = lambda k: (F.col("page_id") * k % 17 / 16.0).cast("double")
    segments = F.array(F.struct(F.lit(0.25).alias("ax"), end(3).alias("ay"), end(5).alias("bx"), F.lit(0.75).alias("by")))
    return p.select("page_id", "y", "x", raster.coverage(segments, F.col("x"), F.col("y"), 16, 0.1).alias("alpha"))


def raster_downsample(spark, d):
    """The drawings averaged down to 5 x 5."""
    return raster.downsample(_drawn(spark, d), 16, 5, ["page_id"]).select("page_id", "ty", "tx", "alpha")


def raster_grid(spark, d):
    """Two segments per page on a 64 x 64 canvas, by a grid of cells, averaged down to 8 x 8."""
    end = lambda k: (F.col("page_id") * k % 17 / 16.0).cast("double")
    lines = [(F.lit(0.25), end(3), end(5), F.lit(0.75)), (end(5), F.lit(0.75), F.lit(0.9375), end(7))]
    segments = _pages(spark, d).select("page_id", F.explode(F.array(*[F.struct(*[v.alias(k) for k, v in zip(("ax", "ay", "bx", "by"), s, strict=True)]) for s in lines])).alias("s")).select("page_id", "s.*")
    return raster.downsample_covered(raster.covered(segments, 64, 0.1, ["page_id"], 8), 64, 8, ["page_id"])


def thumbnail_pixels(spark, d):
    """The drawings as PNG files, decoded, shrunk to 4 x 4, encoded and decoded again."""
    files = raster.to_png(_drawn(spark, d), 16, ["page_id"]).select(F.col("page_id").alias("id"), F.lit(False).alias("drawing"), F.col("png").alias("content"))
    made = I.with_thumbnails(files, 4).select(F.col("id").alias("page_id"), "w", "thumb_h", F.posexplode(I.pixels_of("png")).alias("pos", "rgba"))
    return made.select("page_id", "w", "thumb_h", F.floor(F.col("pos") / 4).cast("int").alias("ty"), (F.col("pos") % 4).alias("tx"), F.col("rgba")[3].alias("alpha"))


CONTROLS = f"""html || CASE WHEN page_id % 7 = 0 THEN '<a href="/x"><button aria-label="Next">x</button></a><button aria-label="Next" style="color: red; display: none">y</button>' ELSE '' END
 || '<section><img src="a.png" width="10" height="20">' || CASE WHEN page_id % 2 = 0 THEN '<button aria-label=" Next ">n</button>' ELSE '' END || '</section>'
 || '<article><img src="b.png" width="' || CAST(page_id % 30 AS STRING) || '" height="10"><div role="Button" aria-label="戻る">p</div></article>'"""


def page_controls(spark, d):
    """The next and previous controls of each page and the gallery they belong to; two of four pages step forward first."""
    pages = _injected(spark, d, CONTROLS).withColumn("forward_first", F.col("page_id") % 4 < 2)
    found = controls.controls(H.elements(pages))
    at = F.filter("elements", lambda e: (e["tag"] == "img") & (e["container"] == F.col("scope")))
    return found.select("page_id", F.trim("next.label").alias("next_label"), F.col("previous.label").alias("previous_label"), F.get(at, F.lit(0))["height"].alias("picture_height"))


def attachments_received(spark, d):
    """Each conversation as a share of attachments: its turns, in two items, of types by role."""
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    kind = "CASE role WHEN 'user' THEN 'com.apple.property-list' WHEN 'assistant' THEN 'public.url' ELSE 'public.image' END"
    return handoff.received(turns.selectExpr("conv_id AS run_id", "CASE WHEN conv_id % 5 = 0 THEN turn + 1 WHEN conv_id % 7 = 3 THEN turn % 2 ELSE 0 END AS item", f"{kind} AS type", "turn AS seq", "CASE WHEN turn % 4 <> 2 THEN text END AS payload"))


ORIGINS = "CASE page_id % 5 WHEN 0 THEN 'source' WHEN 1 THEN 'video' WHEN 2 THEN 'meta' WHEN 3 THEN 'other' END"


def typed_rows(spark, d):
    """Three images of each page, one of which has no readable URL on some."""
    pages = _pages(spark, d).selectExpr("page_id", f"""array(struct(url, CAST(page_id % 9 AS INT) AS width, CAST(NULL AS INT) AS height, {ORIGINS} AS origin),
     struct(CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'https://h.example.com:port/a.png' ELSE 'https://[::1/a.png' END AS url, 1 AS width, 1 AS height, 'dom' AS origin), struct('/rel.png' AS url, NULL AS width, 7 AS height, 'odd' AS origin)) AS images""")
    return handoff.typed_rows(pages, ["page_id"])


def trace_lines(spark, d):
    """What the extraction says of each page, from its URL to the total; icons and long names are added to some."""
    return handoff.trace(_occurrences(spark, d, TRACED, MATCHED).withColumn("elapsed_ms", F.col("page_id").cast("int"))).select("page_id", F.array_join("lines", "\n").alias("lines"))


def received_lines(spark, d):
    """Images of each page as they arrive."""
    images = _extracted(spark, d)
    return handoff.received_lines(images.select("page_id", (F.col("origin") == "source").alias("is_from_source")), ["page_id"])


def contained_images(spark, d):
    """Covers below a video's parent, and images by the nearest link around them, in nested markup."""
    return scan.images_of(_occurrences(spark, d, NESTED)).select("page_id", "order", "url", "origin", "sweep")


def styled_backgrounds(spark, d):
    """Backgrounds as the cascade of style sheets and inline styles has them, and which are icons by their boxes."""
    rows = _occurrences(spark, d, STYLED).select("page_id", F.explode_outer("met").alias("m")).where(F.col("m.sweep") == sweeps.CSS)
    return rows.select("page_id", "m.url", "m.what")


def chained_selectors(spark, d):
    """Backgrounds by selectors with descendants, children and attributes, where the page's own rules take part too."""
    rows = _occurrences(spark, d, CHAINED).select("page_id", F.explode_outer("met").alias("m")).where(F.col("m.sweep") == sweeps.CSS)
    return rows.select("page_id", "m.url", "m.what")


def declared_images(spark, d):
    """Images that sources, posters, links, metas, drawings and shadow roots name."""
    return scan.images_of(_occurrences(spark, d, DECLARED)).select("page_id", "order", "url", "origin", "sweep")


def occurrence_counts(spark, d):
    """Every occurrence of an image URL by sweep and by what became of it."""
    rows = _occurrences(spark, d, config=MATCHED).select(F.explode_outer("met").alias("m")).where("m IS NOT NULL")
    return rows.groupBy(F.element_at(F.array(*map(F.lit, sweeps.NAMES)), F.col("m.sweep") + 1).alias("sweep"), F.col("m.what").alias("what")).agg(F.count("*").alias("n"))


def frame_images(spark, d):
    """Images of each page's frames: one of the same origin that was loaded, one of another, one with markup inline."""
    pages = _pages(spark, d).selectExpr("page_id", "url", f"{FRAMED} AS html")
    site = "regexp_extract(url, '^[a-z]+://[^/?#]+', 0)"
    loaded = _pages(spark, d).selectExpr("page_id", f"inline(array(struct({site} || '/frame/' || {ID} AS url, '<img src=\"f.png\"><iframe src=\"/frame/nested\"></iframe>' AS html), struct({site} || '/frame/nested' AS url, '<img src=\"n.png\">' AS html), struct('https://else.example.com/f' AS url, '<img src=\"x.png\">' AS html)))")
    return scan.extract_images(H.with_frames(pages, loaded), WHOLE).select("page_id", "order", "url", "origin")


def _fetched(spark, d):
    """A fetched row for most images: headers of WebP files of a size by page, drawings, or other bytes."""
    w, h = "CAST(id * 31 % 900 AS BIGINT)", "CAST(id * 17 % 700 AS BIGINT)"
    size = lambda c: f"lpad(hex({c} % 256), 2, '0') || lpad(hex({c} div 256), 2, '0') || '00'"
    drawing = f"""'<?xml version="1.0"?><svg width="' || ({w} + 1) || 'px" ' || CASE WHEN id % 4 = 1 THEN 'height="' || ({h} + 1) || '"' ELSE 'viewBox="0 0 1 ' || ({h} + 1) || '"' END || '/>'"""
    body = f"""CASE WHEN id % 7 = 3 THEN encode('<html>', 'UTF-8') WHEN id % 6 = 5 THEN encode({drawing}, 'UTF-8') ELSE unhex('5249464600000000574542505650385800000000' || '00000000' || {size(w)} || {size(h)}) END"""
    return _images(spark, d)[0].where("id % 5 <> 4").selectExpr("url", "CASE WHEN id % 8 = 2 THEN 404 ELSE 200 END AS status", f"{body} AS content")


def saved_files(spark, d):
    images, _, _, selected = _images(spark, d)
    return saving.saved(images.join(selected, "id", "left_semi"), _fetched(spark, d)).select("id", "seq", "ok", "error", "name", F.coalesce(F.length("content"), F.lit(0)).cast("bigint").alias("n_bytes"))


def thumbnail_states(spark, d):
    """What each cell shows and whether its thumbnail is still to fetch, when every third image has been asked for."""
    images = _images(spark, d)[0]
    made = saving.thumbnails(images.where("id % 3 = 0"), _fetched(spark, d))
    ready, failed = made.where("NOT failed"), made.where("failed")
    ask = saving.pending(images, ready, images.where("id % 10 = 1"), failed).select("id", F.lit(True).alias("to_fetch"))
    cells = saving.shown(images, ready, failed, images.where("id % 12 = 0")).join(ready.drop("failed"), "id", "left").join(ask, "id", "left")
    return cells.select("id", "shows", F.coalesce("to_fetch", F.lit(False)).alias("to_fetch"), "w", "h", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("thumb_w", "thumb_h")])


SVG = """CASE WHEN page_id % 10 = 9 THEN '<svg' ELSE '<svg xmlns="http://www.w3.org/2000/svg" width="' || CASE WHEN page_id % 2 = 0 THEN '4' ELSE '40px' END || '" viewBox="0 0 8 8" height="' || CASE WHEN page_id % 2 = 0 THEN '4' ELSE '40' END || '"><style>.s{stroke:lime}</style>'
 || '<rect x="' || CAST(length(html) % 5 / 4D AS STRING) || '" y="1" width="2.25" height="1.5" fill="#c86432"/><g opacity=".5" transform="translate(' || CAST(page_id % 3 AS STRING) || ' 4)"><path fill-rule="evenodd" d="M0 0h3v3H0zM1 1h1v1H1z" fill="blue"/></g>'
 || '<path class="s" d="M6,.5V7.5" stroke-width="' || CAST((length(url) % 3 + 1) / 2D AS STRING) || '"/></svg>' END"""


def saved_drawings(spark, d):
    """A drawing a page, saved as a PNG of 16 x 16 and read back: its pixels that aren't empty. A tenth is cut off."""
    drawings = _pages(spark, d).selectExpr("page_id AS id", "'https://h.example.com/' || CAST(page_id AS STRING) || '.svg' AS url", "200 AS status", f"encode({SVG}, 'UTF-8') AS content")
    files = saving.saved(drawings.select("id", "url"), drawings.select("url", "status", "content"), longest=16).where("ok")
    pixels = files.select(F.col("id").alias("page_id"), F.posexplode(I.pixels_of("content")).alias("pos", "rgba")).where("rgba[3] > 0")
    return pixels.selectExpr("page_id", "CAST(pos div 16 AS INT) AS y", "pos % 16 AS x", "rgba[0] AS red", "rgba[1] AS green", "rgba[2] AS blue", "rgba[3] AS alpha")


def status_texts(spark, d):
    rows = _images(spark, d)[0].withColumns({"state": F.element_at(F.array(*map(F.lit, ("idle", "saving", "finished"))), (F.col("id") % 3 + 1).cast("int")), "code": F.when(F.col("id") % 4 == 0, "denied").when(F.col("id") % 4 == 1, "limited").otherwise("new")})
    return rows.select("id", saving.status_text(F.col("state"), F.col("id"), F.col("id") + 5).alias("status"), saving.permission_text(F.col("code")).alias("permission"))


def run_log_text(spark, d):
    """Each page's run: a label that opens the log, and a line for two pages of three."""
    pages = _pages(spark, d)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 61)
    version = F.when(F.col("page_id") % 4 != 0, runlog.version_text(F.lit("1.2"), F.when(F.col("page_id") % 2 == 1, F.lit("7"))))
    labels = pages.select(F.col("page_id").alias("run_id"), runlog.run_label(F.when(F.col("page_id") > 3, F.col("page_id")), at, version).alias("label"))
    entries = pages.where("page_id % 3 <> 0").selectExpr("page_id AS run_id", "'current' AS section", "0 AS seq", "url AS text", "page_id % 3 = 1 AS is_error")
    return runlog.log_lines(entries, labels)


def icon_manifest(spark, d):
    """An icon set for each page, its slots at two scales of sizes by page."""
    slots = _pages(spark, d).select("page_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("slot")).withColumn("px", ((F.col("page_id") % 5 + 1) * 20 * F.greatest("slot", F.lit(1))).cast("int"))
    size = (F.col("page_id") % 5 + 1) * 20
    slots = slots.select("page_id", "slot", "px", F.lit("iphone").alias("idiom"), F.format_string("%dx%d", size, size).alias("size"), F.format_string("%dx", F.greatest("slot", F.lit(1))).alias("scale"))
    drawn = icons.sizes(slots, ["page_id"]).groupBy("page_id").agg(F.count("*").alias("n_sizes"))
    return icons.manifest(slots, ["page_id"]).join(drawn, "page_id")


def glyph_bounds(spark, d):
    """The icon's drawing, recentred at a scale by page: its segments and its box."""
    segments = _pages(spark, d).select("page_id", F.explode(icons.glyph()).alias("s")).select("page_id", "s.*")
    out = raster.recentre(segments, (F.col("page_id") % 4 + 1) / 4, ["page_id"])
    box = lambda f, g, c: F.round(f(g(f"a{c}", f"b{c}")), 9)
    return out.groupBy("page_id").agg(F.count("*").alias("n_segments"), *[box(f, g, c).alias(f"{n}_{c}") for n, f, g in (("low", F.min, F.least), ("high", F.max, F.greatest)) for c in "xy"])


QUERIES = {f.__name__: f for f in (source_scan_urls, source_scan_cap, format_label_counts, ui_asset_skips, srcset_best, lazy_attr_coalesce, page_key, host_allowlist, start_slide_plan, resolve_anchor_urls, css_background_urls, extract_images, origin_counts, links_elsewhere, rendered_names, largest_image, sweep_counts, occurrence_counts, contained_images, declared_images, styled_backgrounds, chained_selectors, frame_images, payload_sizes, visible_images, hidden_counts, select_all_toggle, all_selected, save_tally, save_outcomes, save_log, badge_text, carousel_dedup, slide_walk, slide_change_points, run_log_lines, raster_downsample, raster_grid, thumbnail_pixels, page_controls, attachments_received, typed_rows, trace_lines, received_lines, saved_files, saved_drawings, thumbnail_states, status_texts, run_log_text, icon_manifest, glyph_bounds)}
