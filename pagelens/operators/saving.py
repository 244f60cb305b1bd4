"""Fetching and saving as joins: what is still to fetch, what a cell shows, and the bytes that a save writes.

There is no network here: fetched rows (url, status, content) are a table, or files with an index of their URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import images as I

# Texts as users know them.
UNDECODABLE = "画像を読み込めませんでした"
CANCELLED = "保存が中断されました"
HTTP_ERROR = "ダウンロード失敗 (HTTP %d)"
STATES = {"idle": "待機中", "saving": "保存中 %d/%d", "finished": "完了 成功%d 失敗%d"}
PERMISSIONS = {"not_determined": "未確認", "restricted": "制限あり", "denied": "拒否", "authorized": "許可", "limited": "一部のみ許可"}
LOG = {
    "none": "保存対象が0件です",
    "begin": "保存開始: %d件",
    "usage": "説明文の有無: あり",
    "no_usage": "説明文の有無: なし(致命的)",
    "permission": "権限状態: %s",
    "unasked": "未許可のため中止(本体アプリで許可が必要)",
    "denied": "写真へのアクセスが拒否されました",
    "ok": "OK: %s",
    "failed": "失敗: %s — %s",
    "end": "完了: 成功%d 失敗%d",
}
#: What the user is told when a save can't begin; {app}: the app's name.
MESSAGES = {
    "none": "画像が選択されていません",
    "no_usage": "アプリの設定不備です(写真アクセスの説明文が未設定)。開発者に報告してください。",
    "unasked": "先にホーム画面の「{app}」アプリを開き、「写真への保存を許可する」をタップしてください。",
    "denied": "写真へのアクセスが許可されていません。\n「設定」→「プライバシーとセキュリティ」→「写真」→「{app}」で許可してください。",
}
THUMBNAIL, FULL = 300, 2048


def fetched_files(spark: SparkSession, index: DataFrame, folder: str) -> DataFrame:
    """(url, status, content) of files below ``folder``; index: (url, status, path), paths relative to it.

    A URL whose file isn't there keeps its status, without content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.substring_index(F.concat(F.lit("/"), F.col("path")), f"{folder.rstrip('/')}/", -1)
    return index.join(files.select(name.alias("path"), "content"), "path", "left").select("url", "status", "content")


def pending(images: DataFrame, done: DataFrame, running: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Images still to fetch: none that is done or under way. Thumbnails that failed stay so (give ``failed``); full
    images are tried again."""
    for ids in (done, running) if failed is None else (done, running, failed):
        images = images.join(ids.select("id"), "id", "left_anti")
    return images


def _latest(fetched: DataFrame) -> DataFrame:
    """One row a URL: of repeated rows the highest status."""
    return fetched.groupBy("url").agg(F.max_by(F.struct("status", "content"), "status").alias("f"))


def thumbnails(images: DataFrame, fetched: DataFrame, longest: int = THUMBNAIL) -> DataFrame:
    """(id, w, h, thumb_w, thumb_h, failed, png) of images that were fetched, whatever the status said.

    w, h: the size in the header, before orientation. A thumbnail only ever shrinks, but for a drawing (SVG), which has no
    pixel size and is drawn to fit. Bytes without a size, PNG and GIF that can't be decoded whole, and drawings that can't
    be drawn have failed.
    """
    got = images.join(_latest(fetched), "url").select("id", _drawing(F.col("url")).alias("drawing"), F.col("f.content").alias("content"))
    return I.with_thumbnails(got, longest)


def _drawing(url: Column) -> Column:
    return F.coalesce(F.lower(C.extension(url)) == "svg", F.lit(False))


def shown(images: DataFrame, thumbnail_ids: DataFrame, failed: DataFrame, full_ids: DataFrame | None = None) -> DataFrame:
    """Adds ``shows``: the full image (a preview only), else the thumbnail, else the failure, else that it waits."""
    tables = {"full": full_ids, "thumbnail": thumbnail_ids, "failed": failed}
    pick = F.lit("waiting")
    for name, ids in reversed(tables.items()):
        if ids is not None:
            images = images.join(ids.select("id", F.lit(True).alias(f"__{name}")).distinct(), "id", "left")
            pick = F.when(F.col(f"__{name}"), name).otherwise(pick)
    return images.withColumn("shows", pick).drop(*[f"__{name}" for name in tables])


def decodable(content: Column) -> Column:
    """Whether bytes begin as PNG, GIF, JPEG, WebP, BMP or HEIF and AVIF files do."""
    start = F.hex(F.substring(content, 1, 12))
    heads = ("89504E470D0A1A0A", "474946383761", "474946383961", "FFD8FF", "424D")
    out = F.rlike(start, F.lit("^(52494646.{8}57454250|.{8}66747970)"))
    for h in heads:
        out |= F.startswith(start, F.lit(h))
    return F.coalesce(out, F.lit(False))


def file_name(key: Column, extension: Column, prefix: str) -> Column:
    """<prefix>-<uuid>.<extension>; the uuid is told from the key, so that a task run again writes the same name."""
    digest = F.md5(key.cast("string"))
    parts = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit(f"{prefix}-"), F.concat_ws("-", *parts), F.lit("."), extension)


def saved(images: DataFrame, fetched: DataFrame, prefix: str = "image", order: str = "id", longest: int = FULL) -> DataFrame:
    """(id, seq, ok, error, name, content) of every image, ``seq`` as ``order`` has it.

    A status beyond 2xx and bytes that are no image are errors; a missing fetch is a save cut off. Bytes are kept as
    they came, but for drawings (SVG), which are saved as PNG, ``longest`` pixels long. Only drawings pass through Python.
    """
    own = _drawing(F.col("url"))
    rows = images.join(_latest(fetched), "url", "left").withColumn("drawing", own)
    status = F.col("f.status")
    rows = rows.select("id", "url", F.col(order).alias("seq"), "drawing", F.col("f").isNull().alias("missing"), status.alias("status"), F.when(status.between(200, 299), F.col("f.content")).alias("content"))
    rows = rows.where(~F.col("drawing")).union(I.with_drawn(rows.where("drawing"), longest))
    drawing, status, content = F.col("drawing"), F.col("status"), F.col("content")
    error = (
        F.when(F.col("missing"), CANCELLED)
        .when(~status.between(200, 299), F.format_string(HTTP_ERROR, status))
        .when(~decodable(content), UNDECODABLE)
    )
    named = file_name(F.concat_ws(" ", F.col("id").cast("string"), "url"), F.when(drawing, "png").otherwise(C.save_extension(F.col("url"))), prefix)
    out = rows.select("id", "seq", error.alias("error"), named.alias("name"), "content")
    ok = F.col("error").isNull()
    return out.select("id", "seq", ok.alias("ok"), "error", F.when(ok, F.col("name")).alias("name"), F.when(ok, F.col("content")).alias("content"))


def write_library(rows: DataFrame, path: str, run_id: str = "0") -> bool:
    """Stores what a run saved, (seq, name, content), in save order over the files; no single task holds all.

    A run is stored once: False if it is there already, and nothing is written. Spark's committer moves a task's file
    into place when the task has ended well and marks the run when all have, so tasks that run again leave one row an
    image; what a run that was cut off left behind is replaced.
    """
    target = f"{path}/run_id={run_id}"
    if _committed(rows.sparkSession, target):
        return False
    rows.where("ok").select("seq", "name", "content").repartitionByRange("seq").sortWithinPartitions("seq").write.mode("overwrite").parquet(target)
    return True


def _committed(spark: SparkSession, folder: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def status_text(state: Column, done: Column, total: Column) -> Column:
    """done, total: images saved so far and in all, or those that succeeded and failed once it is finished."""
    return F.when(state == "saving", F.format_string(STATES["saving"], done, total)).when(state == "finished", F.format_string(STATES["finished"], done, total)).otherwise(STATES["idle"])


def permission_text(code: Column) -> Column:
    out = F.lit("不明")
    for k, v in PERMISSIONS.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def guard(runs: DataFrame) -> Column:
    """Why a save can't begin, by the first check that fails: a key of MESSAGES, or null.

    runs: (n_selected, usage_text: whether the app says why it needs photos, permission: a key of PERMISSIONS).
    """
    allowed = F.coalesce(F.col("permission").isin("authorized", "limited"), F.lit(False))
    return (
        F.when(F.coalesce("n_selected", F.lit(0)) == 0, "none")
        .when(~F.coalesce("usage_text", F.lit(False)), "no_usage")
        .when(F.col("permission") == "not_determined", "unasked")
        .when(~allowed, "denied")
    )


def _texts(key: Column, texts: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in texts.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def outcomes(runs: DataFrame, results: DataFrame, app: str = "pagelens") -> DataFrame:
    """(run_id, n_selected, usage_text, permission, stopped, succeeded, failed, message) of each run.

    results: (run_id, seq, ok, error), an image each. A run that can't begin saves nothing: all it selected has failed,
    and the message says why. Else the message is the last error in save order, if there was one.
    """
    tally = results.groupBy("run_id").agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("bad"), F.expr("max_by(error, seq) FILTER (WHERE NOT ok)").alias("last"))
    rows = runs.withColumn("stopped", guard(runs)).join(tally, "run_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    why = _texts(F.col("stopped"), {k: v.format(app=app) for k, v in MESSAGES.items()})
    held = F.col("stopped").isNotNull()
    return rows.select("run_id", "n_selected", "usage_text", "permission", "stopped", F.when(held, 0).otherwise(n(F.col("ok"))).alias("succeeded"), F.when(held, n(F.col("n_selected"))).otherwise(n(F.col("bad"))).alias("failed"), F.when(held, why).otherwise(F.col("last")).alias("message"))


def save_log(done: DataFrame, results: DataFrame) -> DataFrame:
    """(run_id, part, seq, line, is_error): the log of each save. Lines sort by part, then seq; no run is gathered for it.

    done: as `outcomes` makes it; results: (run_id, seq, url, ok, error). A run that can't begin has no lines of images.
    """
    stopped, line = F.col("stopped"), lambda part, text, wrong=False: F.struct(F.lit(part).alias("part"), text.alias("line"), F.lit(wrong).alias("is_error"))
    text = lambda key: F.lit(LOG[key])
    going = F.coalesce(stopped != "none", F.lit(True))
    asked = going & F.coalesce(stopped != "no_usage", F.lit(True))
    lines = F.array(
        F.when(stopped == "none", line(0, text("none"), True)),
        F.when(going, line(0, F.format_string(LOG["begin"], F.col("n_selected")))),
        F.when(stopped == "no_usage", line(1, text("no_usage"), True)).when(going, line(1, text("usage"))),
        F.when(asked, line(2, F.format_string(LOG["permission"], permission_text(F.col("permission"))))),
        F.when(stopped == "unasked", line(3, text("unasked"), True)).when(stopped == "denied", line(3, text("denied"), True)),
        F.when(stopped.isNull(), line(5, F.format_string(LOG["end"], F.col("succeeded"), F.col("failed")))),
    )
    own = done.select("run_id", F.explode(F.array_compact(lines)).alias("l")).select("run_id", "l.part", F.lit(0).cast("bigint").alias("seq"), "l.line", "l.is_error")
    name = F.coalesce(F.nullif(F.regexp_extract(C.path(F.col("url")), r"([^/]*)/*$", 1), F.lit("")), F.lit("/"))
    said = F.when(F.col("ok"), F.format_string(LOG["ok"], name)).otherwise(F.format_string(LOG["failed"], name, F.col("error")))
    images = results.join(done.where(stopped.isNull()).select("run_id"), "run_id", "left_semi")
    return own.union(images.select("run_id", F.lit(4).alias("part"), F.col("seq").cast("bigint").alias("seq"), said.alias("line"), (~F.col("ok")).alias("is_error")))
