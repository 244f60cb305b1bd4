"""The hand-over of a page's results: attachments in, one payload a run out, typed rows, and the lines of its trace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ExtractConfig
from ..functions import columns as C
from . import sweeps

# Types that count as property lists, and texts as users of the log know them.
PROPERTY_LISTS = ("com.apple.property-list", "com.apple.xml-property-list", "com.apple.binary-property-list")
NO_ITEM = "[ERR] 共有元からデータを受け取れませんでした"
NO_PROVIDER = "[ERR] property list 型の添付がありません"
NOTHING = "[ERR] 解析結果が空 (ページ側スクリプトが完了しなかった)"
RECEIVED = "受け取り %d件 (ページ内 %d / ソース内 %d)"
TRACE = {
    "url": "URL: %s",
    "slide": "開始スライド: %s枚目",
    "no_slide": "開始スライド: 不明 (1枚目とみなす)",
    "first": "img要素 %d個 / 初回スキャン %d件",
    "back": "戻り方向: 実行する (3枚目以降から共有)",
    "no_back": "戻り方向: 不要 (前のスライドは無いか既に取得済み)",
    "elsewhere": "カルーセル送りの対象サイトではないため実行しない",
    "no_previous": "「前へ」ボタンが無いため送りは未実行 / 次へへ",
    "no_next": "「次へ」ボタンが無いため送りは未実行",
    "source": "ソース走査: 一致 %d件 / 新規 %d件",
    "meta": "OGP画像: %d件",
    "video": "動画サムネイル: %d件",
    "sprites": "アイコン枠の背景画像を除外: %d件",
    "assets": "UI部品の画像を除外: %d件",
    "other": "別の投稿へのリンク内の画像: %d件",
    "not_judged": "別の投稿へのリンク内の画像: 判定なし (投稿ページではないため)",
    "sources": "取得元の内訳: %s",
    "names": "ページ内のファイル名(%d種): %s",
    "total": "合計 %d件 / 所要 %dms",
}

#: Brackets that aren't closed, and ports that aren't numbers.
_UNREADABLE = r"^[^/?#]*//(?:[^/?#@]*@)?+(?:\[[^\]/?#]*(?:[/?#]|$)|(?:\[[^\]]*\]|[^\[\]/?#:]*):[^/?#]*[^0-9/?#])"


def received(attachments: DataFrame) -> DataFrame:
    """attachments: (run_id, item, type, seq, payload). A row per run: (run_id, n_attachments, n_providers, payload, failure).

    Only the first item (0) counts, and of it property lists. The last one that arrived (seq) with a payload wins. A
    failure is a run without a first item, without a property list, or with none that holds a result; a result that
    names no images is none.
    """
    mine = F.col("item") == 0
    provider = mine & F.coalesce(F.col("type").isin(*PROPERTY_LISTS), F.lit(False))
    out = attachments.groupBy("run_id").agg(
        F.count_if(mine).alias("n_attachments"),
        F.count_if(provider).alias("n_providers"),
        F.max_by(F.when(provider, F.col("payload")), F.when(provider & F.col("payload").isNotNull(), F.col("seq"))).alias("payload"),
    )
    return out.withColumn("failure", F.when(F.col("n_attachments") == 0, NO_ITEM).when(F.col("n_providers") == 0, NO_PROVIDER).when(F.col("payload").isNull(), NOTHING))


def typed_rows(payloads: DataFrame, by: list[str]) -> DataFrame:
    """payloads: (by..., images: array of (url, width, height, origin)). A row per image that has a readable URL.

    ``id`` is the place in the array, so rows that go leave gaps. Missing sizes are 0; a missing origin is the page's
    own; the origin becomes four flags.
    """
    rows = payloads.select(*by, F.posexplode("images").alias("id", "image"))
    readable = (F.col("image.url") != "") & ~F.rlike("image.url", F.lit(_UNREADABLE))
    origin = F.coalesce(F.col("image.origin"), F.lit("dom"))
    flags = {"is_from_source": "source", "is_video_poster": "video", "is_page_meta": "meta", "is_other_post": "other"}
    sizes = [F.coalesce(F.col(f"image.{c}"), F.lit(0)).cast("int").alias(c) for c in ("width", "height")]
    return rows.where(readable).select(*by, "id", F.col("image.url").alias("url"), *sizes, *[(origin == v).alias(k) for k, v in flags.items()])


def received_lines(typed: DataFrame, by: list[str]) -> DataFrame:
    """(by..., line): how many typed images arrived, from the page itself and from its source."""
    source = F.count_if("is_from_source")
    return typed.groupBy(*by).agg(F.format_string(RECEIVED, F.count("*"), F.count("*") - source, source).alias("line"))


def trace(found: DataFrame, config: ExtractConfig = DEFAULT) -> DataFrame:
    """(page_id, lines): what the extraction says of each page.

    found: as sweeps.occurrences makes it, with elapsed_ms, and steps or none: an array of what the walk said. Without
    it, the page had no control to step with. Counts of nothing have no line, but for some that say so; sweeps come in
    the order in which they were first credited. Nothing is shuffled.
    """
    met, url = F.col("met"), F.col("url")
    kept = sweeps.kept(met)
    n = lambda test: F.size(F.filter(kept, test))
    line = lambda key, *values: F.format_string(TRACE[key], *values)
    some = lambda key, count: F.when(count > 0, line(key, count))
    walks, slide = F.coalesce(C.walks_carousels(C.host(url), config), F.lit(False)), C.starting_slide(url)
    known = F.regexp_extract(url, r"[?&]img_index=(\d+)", 1)
    back = F.coalesce(slide, F.lit(1)) >= 3
    still = F.when(~walks, F.array(F.lit(TRACE["elsewhere"]))).when(back, F.array(F.lit(TRACE["no_previous"]), F.lit(TRACE["no_next"]))).otherwise(F.array(F.lit(TRACE["no_next"])))
    steps = F.coalesce(F.col("steps"), still) if "steps" in found.columns else still
    judged = F.when(F.coalesce(C.is_permalink(C.path(url), config), F.lit(False)), line("other", n(lambda r: r["origin"] == "other"))).otherwise(TRACE["not_judged"])
    credits, names = sweeps.credits(met), sweeps.names(met)
    begun = F.array(
        line("url", F.coalesce(url, F.lit(""))),
        F.when(F.coalesce(known, F.lit("")) != "", line("slide", known)).otherwise(TRACE["no_slide"]),
        line("first", F.col("n_imgs"), n(lambda r: r["sweep"] != sweeps.RAW)),
        F.when(back, TRACE["back"]).otherwise(TRACE["no_back"]),
    )
    ended = F.array(
        line("source", F.col("n_source"), n(lambda r: r["sweep"] == sweeps.RAW)),
        some("meta", n(lambda r: r["origin"] == "meta")),
        some("video", n(lambda r: r["origin"] == "video")),
        some("sprites", F.col("n_sprites") * sweeps.SWEEPS_RUN),
        some("assets", sweeps.skipped_assets(met)),
        F.when(walks, judged),
        F.when(F.size(credits) > 0, line("sources", F.array_join(F.transform(credits, lambda c: F.concat_ws(" ", c["label"], c["n"].cast("string"))), " / "))),
        F.when(F.size(names) > 0, line("names", F.size(names), F.array_join(names, " / "))),
        line("total", F.size(kept), F.coalesce("elapsed_ms", F.lit(0))),
    )
    return found.select("page_id", F.array_compact(F.concat(begun, steps, ended)).alias("lines"))
