"""SQL for DuckDB that states what the queries return, written apart from their code."""

from __future__ import annotations

from .queries import IMAGES, INJECTED, MANY, PIXELS, POSTED, SRCSETS, TRACED

# Patterns that results depend on.
RX = r"""(?i)https?://[^\s"''`<>{}\[\]]+?\.(?:jpe?g|png|gif|webp|heic|heif|bmp|svg|avif)(?:\?[^\s"''`<>{}\[\]]*)?"""
UI = r"(?i)/rsrc\.php/|static\.cdninstagram\.com|/static\.xx\.fbcdn\.net/"
MATCHES = f"list_slice(regexp_extract_all(replace(replace(replace(html, chr(92) || 'u002F', '/'), chr(92) || 'u002f', '/'), chr(92) || '/', '/'), '{RX}'), 1, 800)"
EXT = r"regexp_extract(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)/*$', 1), '[^.]\.([^.]+)$', 1)"
LABEL = f"CASE lower({EXT}) WHEN 'heic' THEN 'HEIF' WHEN 'heif' THEN 'HEIF' WHEN 'webp' THEN 'WebP' WHEN 'svg' THEN 'SVG' WHEN 'gif' THEN 'GIF' WHEN 'png' THEN 'PNG' WHEN 'jpg' THEN 'JPEG' WHEN 'jpeg' THEN 'JPEG' ELSE upper({EXT}) END"
I = f"i AS (SELECT {IMAGES} FROM pages), px AS ({PIXELS})"
VISIBLE = f"""{I}, v AS (SELECT i.*, w, h, coalesce(CAST(greatest(w, h) AS INT), greatest(width, height)) AS longest_side FROM i LEFT JOIN px USING (id)),
 shown AS (SELECT * FROM v WHERE id % 11 <> 0 AND coalesce(origin, 'dom') NOT IN ('source', 'meta') AND (longest_side = 0 OR longest_side >= 300))"""
N = "CAST(page_id AS VARCHAR)"
#: Bold text of a page that lies in a paragraph itself.
OWN_BOLD = "len(regexp_extract_all(html, '<p><b>'))"
#: What the injected markup yields, by page: sweep number, URL, origin.
EXPECTED = f"""x AS (SELECT page_id, page_id % 3 = 1 AS post, regexp_extract({POSTED}, '^[a-z]+://[^/?#]+') AS site FROM pages),
 e AS (SELECT page_id, 'video' AS sweep, 'https://v.example.com/' || {N} || '.png' AS url, 'video' AS origin FROM x WHERE page_id % 5 = 2
 UNION ALL SELECT page_id, 'img', 'https://cdn.example.com/a/' || (page_id % 7) || '.webp', 'dom' FROM x
 UNION ALL SELECT page_id, 'img', site || '/rel/' || {N} || '.JPG?x=1', 'dom' FROM x WHERE page_id % 2 = 0
 UNION ALL SELECT page_id, 'img', 'https://lazy.example.com/' || {N} || '.heic', 'dom' FROM x WHERE page_id % 6 = 1
 UNION ALL SELECT page_id, 'img', 'https://s.example.com/c' || {N} || '.jpg', 'dom' FROM x WHERE page_id % 6 = 1
 UNION ALL SELECT page_id, 'img', 'https://other.example.com/' || {N} || '.png', CASE WHEN post THEN 'other' ELSE 'dom' END FROM x WHERE page_id % 4 = 2
 UNION ALL SELECT page_id, 'link/meta', 'https://m.example.com/' || {N} || '.gif', 'meta' FROM x WHERE page_id % 5 = 3
 UNION ALL SELECT page_id, 'css', 'https://bg.example.com/' || {N} || '/' || f, 'dom' FROM x, (VALUES ('1.png'), ('2.svg')) t(f) WHERE page_id % 6 = 4
 UNION ALL SELECT page_id, 'raw source', 'https://img.example.net/p/' || {N} || '.jpeg', 'source' FROM x WHERE page_id % 4 = 1
 UNION ALL SELECT page_id, 'raw source', 'https://s.example.com/' || f, 'source' FROM x, (VALUES ('a.jpg'), ('b.jpg')) t(f) WHERE page_id % 6 = 1)"""
SNAPSHOTS = "s AS (SELECT conv_id AS page_id, CAST(turn AS INT) + 1 AS step, conv_id % 3 = 0 AS backward, role, turn FROM conversations WHERE turn + 1 <= 30 AND turn * 120 <= 900 AND NOT (conv_id % 10 = 0 AND turn >= 3))"
D = lambda k: f"(page_id * {k} % 17 / 16.0)"

DRAWN = f"""p AS (SELECT page_id, y, x, (x + 0.5) / 16 AS px, (y + 0.5) / 16 AS py, 0.25::DOUBLE AS ax, {D(3)}::DOUBLE AS ay, {D(5)}::DOUBLE - 0.25 AS dx, 0.75 - {D(3)}::DOUBLE AS dy FROM pages, range(16) a(y), range(16) b(x)),
 t AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0, least(1, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) END AS t FROM p),
 c AS (SELECT page_id, y, x, CASE WHEN px BETWEEN least(ax, ax + dx) - 0.05 AND greatest(ax, ax + dx) + 0.05 AND py BETWEEN least(ay, ay + dy) - 0.05 AND greatest(ay, ay + dy) + 0.05 THEN greatest(0, least(255, round_even(((0.05 - sqrt(pow(px - (ax + dx * t), 2) + pow(py - (ay + dy * t), 2))) * 16 + 0.5) * 255, 0))) ELSE 0 END::INT AS alpha FROM t)"""

RUNS = """g AS (SELECT conv_id AS run_id, CASE WHEN conv_id % 6 = 5 THEN 0 ELSE count(*) END AS n, count(*) FILTER (turn % 3 <> 1) AS good, count(*) FILTER (turn % 3 = 1) AS wrong, max(turn) FILTER (turn % 3 = 1) AS t,
 CASE WHEN conv_id % 6 = 5 THEN 'none' WHEN conv_id % 5 = 4 THEN 'usage' WHEN conv_id % 7 = 3 THEN 'unasked' WHEN conv_id % 7 % 5 > 1 THEN 'denied' END AS why FROM conversations GROUP BY conv_id),
 r AS (SELECT run_id, n, why, CASE WHEN why IS NULL THEN good ELSE 0 END::BIGINT AS ok, CASE WHEN why IS NULL THEN wrong ELSE n END::BIGINT AS bad, 'ダウンロード失敗 (HTTP ' || (t + 500) || ')' AS last FROM g)"""

SQL = {
    "source_scan_urls": f"WITH m AS (SELECT page_id, unnest({MATCHES}) AS url FROM (SELECT page_id, {INJECTED} AS html FROM pages)) SELECT DISTINCT page_id, url, {LABEL} AS format FROM m WHERE NOT regexp_matches(url, '{UI}')",
    "source_scan_cap": f"SELECT page_id, len({MATCHES})::BIGINT AS n_matches, len(list_distinct({MATCHES}))::BIGINT AS n_urls FROM (SELECT page_id, {MANY} AS html FROM pages)",
    "format_label_counts": f"WITH {I} SELECT {LABEL} AS format, count(*) AS n, count(*) FILTER (lower({EXT}) = 'svg') AS n_svg FROM i GROUP BY 1",
    "ui_asset_skips": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 2 * 2 + 2 ELSE 0 END::BIGINT AS n_skipped FROM pages",
    "srcset_best": f"SELECT page_id, CASE WHEN {SRCSETS} = '' THEN NULL ELSE CASE page_id % 5 WHEN 0 THEN 'c' || {N} || '.jpg' WHEN 3 THEN 'x.png' ELSE 'a.jpg' END END AS best FROM pages",
    "lazy_attr_coalesce": "SELECT page_id, CASE WHEN page_id % 3 = 0 AND url <> '' THEN url WHEN page_id % 5 = 0 THEN 'z' END AS url FROM pages",
    "page_key": rf"""WITH p AS (SELECT page_id, {POSTED} AS url FROM pages), q AS (SELECT *, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM p)
 SELECT page_id, CASE WHEN regexp_matches(path, '(?i)(?:^|/)(?:p|reel|reels|tv)/[^/?#]+') THEN 'post:' || regexp_extract(path, '(?i)(?:^|/)(?:p|reel|reels|tv)/([^/?#]+)', 1)
  ELSE 'path:' || coalesce(array_to_string(list_transform(list_slice(list_filter(string_split(path, '/'), lambda s: s <> ''), 1, 2), lambda s: '/' || s), ''), '') END AS page_key,
  regexp_matches(path, '(?i)(?:^|/)(?:p|reel|reels|tv)/[^/?#]+') AS permalink, regexp_replace(url, '[?#].*$', '') AS identity FROM q""",
    "host_allowlist": f"SELECT lower(regexp_extract({POSTED}, '://([^/?#:]*)', 1)) AS host, count(*) AS n, bool_or(lower(regexp_extract({POSTED}, '://([^/?#:]*)', 1)) IN ('instagram.com') OR lower(regexp_extract({POSTED}, '://([^/?#:]*)', 1)) LIKE '%.instagram.com') AS walks FROM pages GROUP BY 1",
    "start_slide_plan": "SELECT page_id, CASE WHEN page_id % 3 = 1 THEN page_id % 6 ELSE 1 END::INT AS slide, CASE WHEN page_id % 3 = 1 AND page_id % 6 >= 3 THEN 'previous>next' ELSE 'next' END AS passes FROM pages",
    "css_background_urls": f"SELECT page_id, pos::INT AS pos, CASE pos WHEN 0 THEN 'https://bg.example.com/' || {N} || '.png' ELSE '/two.gif' END AS url FROM pages, (VALUES (0), (1)) t(pos) WHERE NOT ((page_id * 7) % 90 < 60 AND (page_id * 11) % 90 < 60)",
    "extract_images": f"WITH {EXPECTED} SELECT page_id, url, 0 AS width, 0 AS height, origin FROM e",
    "origin_counts": f"WITH {EXPECTED} SELECT origin, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM e GROUP BY origin",
    "links_elsewhere": f"WITH {EXPECTED} SELECT page_id, url, origin = 'other' AS elsewhere FROM e",
    "rendered_names": "SELECT page_id, 1::BIGINT AS n_names, 't51.2885-15/' || CASE WHEN 12 + page_id % 40 > 30 THEN repeat('n', least(30, 8 + page_id % 40)::INT) || left('.jpg', greatest(0, 22 - page_id % 40)::INT) || '…' ELSE repeat('n', 8 + (page_id % 40)::INT) || '.jpg' END AS names FROM pages",
    "largest_image": """WITH a AS (SELECT page_id, unnest(l) AS url, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]+)"', 1) AS l FROM pages)),
 s AS (SELECT page_id, pos::BIGINT AS "order", url, length(url) * (pos % 3 + 1) AS area FROM a)
 SELECT page_id, "order", url, area::BIGINT AS area FROM s QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY area DESC, "order") = 1""",
    "sweep_counts": f"WITH {EXPECTED} SELECT CASE sweep WHEN 'video' THEN '動画' WHEN 'css' THEN 'CSS背景' ELSE sweep END AS label, count(*) AS n_new FROM e GROUP BY 1",
    "payload_sizes": f"WITH {EXPECTED} SELECT page_id, {POSTED} AS page_url, CASE WHEN page_id % 10 = 0 THEN 0 ELSE (SELECT count(*) FROM e WHERE e.page_id = pages.page_id) END::BIGINT AS n_images FROM pages",
    "visible_images": f"WITH {VISIBLE} SELECT id, url, longest_side, row_number() OVER (ORDER BY id) - 1 AS idx FROM shown",
    "hidden_counts": f"WITH {I}, l AS (SELECT origin, count(*) AS n FROM i WHERE id % 11 <> 0 GROUP BY origin) SELECT {', '.join(f'coalesce(max(n) FILTER (origin = {chr(39)}{o}{chr(39)}), 0)::BIGINT AS n_{o}' for o in ('source', 'video', 'meta', 'other'))}, TRUE AS has_hidden FROM l",
    "select_all_toggle": f"""WITH {VISIBLE}, sel AS (SELECT page_id::BIGINT AS id FROM pages WHERE page_id % 4 = 0)
 SELECT 'all' AS step, id FROM (SELECT id FROM sel UNION SELECT id FROM shown) UNION ALL SELECT 'none', id FROM sel WHERE id NOT IN (SELECT id FROM shown)
 UNION ALL SELECT 'saved', id FROM sel WHERE id % 11 <> 0 UNION ALL SELECT 'toggled', id FROM ((SELECT id FROM sel EXCEPT SELECT id FROM shown) UNION ALL (SELECT id FROM shown EXCEPT SELECT id FROM sel))
 UNION ALL SELECT 'acting', id FROM shown WHERE id % 4 = 0""",
    "all_selected": f"WITH {VISIBLE} SELECT coalesce(bool_and(id % 4 = 0), FALSE) AS all_selected FROM shown",
    "save_tally": f"WITH {I}, r AS (SELECT id, CASE WHEN id % 5 = 4 THEN '保存が中断されました' WHEN id % 8 = 2 THEN 'ダウンロード失敗 (HTTP 404)' WHEN id % 7 = 3 THEN '画像を読み込めませんでした' END AS error FROM i WHERE id % 4 = 0) SELECT count(*) FILTER (error IS NULL) AS succeeded, count(*) FILTER (error IS NOT NULL) AS failed, max_by(error, id) FILTER (error IS NOT NULL) AS message FROM r",
    "save_outcomes": f"WITH {RUNS} SELECT run_id, ok AS succeeded, bad AS failed, CASE why WHEN 'none' THEN '画像が選択されていません' WHEN 'usage' THEN 'アプリの設定不備です(写真アクセスの説明文が未設定)。開発者に報告してください。' WHEN 'unasked' THEN '先にホーム画面の「pagelens」アプリを開き、「写真への保存を許可する」をタップしてください。' WHEN 'denied' THEN '写真へのアクセスが許可されていません。' || chr(10) || '「設定」→「プライバシーとセキュリティ」→「写真」→「pagelens」で許可してください。' ELSE last END AS message FROM r",
    "save_log": f"""WITH {RUNS}
 SELECT run_id, 0 AS part, 0::BIGINT AS seq, CASE WHEN why = 'none' THEN '保存対象が0件です' ELSE '保存開始: ' || n || '件' END AS line, coalesce(why = 'none', FALSE) AS is_error FROM r
 UNION ALL SELECT run_id, 1, 0, CASE WHEN why = 'usage' THEN '説明文の有無: なし(致命的)' ELSE '説明文の有無: あり' END, coalesce(why = 'usage', FALSE) FROM r WHERE why IS DISTINCT FROM 'none'
 UNION ALL SELECT run_id, 2, 0, '権限状態: ' || ['許可', '一部のみ許可', '拒否', '未確認', '不明'][run_id % 7 % 5 + 1], FALSE FROM r WHERE coalesce(why NOT IN ('none', 'usage'), TRUE)
 UNION ALL SELECT run_id, 3, 0, CASE why WHEN 'unasked' THEN '未許可のため中止(本体アプリで許可が必要)' ELSE '写真へのアクセスが拒否されました' END, TRUE FROM r WHERE why IN ('unasked', 'denied')
 UNION ALL SELECT run_id, 4, turn, CASE WHEN turn % 3 <> 1 THEN 'OK: ' || turn || '.png' ELSE '失敗: ' || turn || '.png — ダウンロード失敗 (HTTP ' || (turn + 500) || ')' END, turn % 3 = 1 FROM r JOIN conversations ON conv_id = run_id WHERE why IS NULL
 UNION ALL SELECT run_id, 5, 0, '完了: 成功' || ok || ' 失敗' || bad, FALSE FROM r WHERE why IS NULL""",
    "badge_text": f"WITH {I}, b AS (SELECT id, {LABEL} AS label, {EXT} AS ext, CASE WHEN w IS NOT NULL THEN w::BIGINT || '×' || h::BIGINT WHEN width > 0 AND height > 0 THEN width || '×' || height END AS size FROM i LEFT JOIN px USING (id)) SELECT id, label || coalesce(' ' || size, '') AS badge, label || coalesce('  ' || size, '') AS info, CASE WHEN ext = '' THEN 'jpg' ELSE ext END AS extension FROM b",
    "carousel_dedup": f"""WITH {SNAPSHOTS}, f AS (SELECT page_id, step, backward, 0 AS n, 'https://slide/' || role AS url FROM s UNION ALL SELECT page_id, step, backward, 1, 'https://slide/' || (turn % 4) FROM s),
 k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY step, n) = 1)
 SELECT page_id, url, step, CASE WHEN backward THEN -(step * 1000) + row_number() OVER (PARTITION BY page_id, step ORDER BY n) - 1 ELSE row_number() OVER (PARTITION BY page_id ORDER BY step, n) - 1 END::BIGINT AS "order" FROM k""",
    "slide_walk": """WITH c AS (SELECT *, conv_id % 5 = 4 AS away, conv_id % 3 = 0 AS back, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
 -- the poll at which a walk ends: of another site at once; without a way on once it is needed; at a change of page; or never, with time up at the last poll
 t AS (SELECT *, least(last, CASE WHEN away THEN 0 WHEN conv_id % 7 = 5 THEN CASE WHEN back THEN 3 ELSE 0 END ELSE last END, CASE WHEN conv_id % 5 = 3 THEN 3 ELSE last END) AS ends FROM c),
 -- block 1 to 3: finds of the way back; it still counts if the walk ends before the turn
 f AS (SELECT conv_id, turn, k, url, origin, CASE WHEN away OR NOT back THEN 0 WHEN stage = 0 AND turn = 0 THEN 0 WHEN stage = 0 AND turn <= 3 THEN turn WHEN stage > 0 AND ends < 3 THEN ends + 1 WHEN stage > 0 AND ends = 3 AND conv_id % 5 = 3 THEN 3 ELSE 0 END AS block, stage FROM (
  SELECT *, 0 AS stage, unnest([1, 2, 3]) AS k, unnest(['https://slide/' || role, 'https://slide/' || (turn % 4), CASE WHEN turn = 0 THEN 'https://behind/0' END]) AS url, unnest(['dom', 'meta', 'dom']) AS origin FROM t WHERE turn <= ends AND NOT (conv_id % 5 = 3 AND turn = 3 AND ends = 3)
  UNION ALL SELECT *, 1, unnest([1, 2, 3]), unnest(['https://slide/' || role, 'https://slide/' || (turn % 4), 'https://behind/' || turn]), unnest(['dom', 'meta', 'dom']) FROM t WHERE turn = ends
  UNION ALL SELECT *, 2, unnest([1, 2]), unnest(['https://source/x', 'https://slide/0']), unnest(['source', 'source']) FROM t WHERE turn = ends)),
 k AS (SELECT * FROM f WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, url ORDER BY stage, turn, k) = 1)
 SELECT conv_id AS page_id, url, origin, CASE WHEN block > 0 THEN -1000 * block + row_number() OVER (PARTITION BY conv_id, block ORDER BY stage, turn, k) - 1 ELSE row_number() OVER (PARTITION BY conv_id, block ORDER BY stage, turn, k) - 1 END::BIGINT AS "order" FROM k""",
    "slide_change_points": "WITH s AS (SELECT conv_id, turn, '3:' || right(role, 24) || ',' || right(text, 24) || ',' || (turn // 2) || ',' AS signature FROM conversations) SELECT conv_id, turn, signature, lag(signature) OVER w IS NULL OR lag(signature) OVER w <> signature AS changed FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "run_log_lines": """WITH r AS (SELECT conv_id AS run_id, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS k, turn AS seq, CASE WHEN role = 'user' AND turn % 4 = 2 THEN '[ERR] ' ELSE '' END || text AS line FROM conversations),
 a AS (SELECT * FROM r UNION ALL SELECT DISTINCT run_id, k, -1, ['=== 読み込み ===', '=== 今回の保存 ===', '=== 前回の記録 ==='][k + 1] FROM r)
 SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY k, seq)::INT AS line_no, line FROM a""",
    "raster_downsample": f"""WITH {DRAWN},
 g AS (SELECT page_id, least(y // 3, 4) AS ty0, * EXCLUDE (page_id) FROM c)
 SELECT page_id, ty::INT AS ty, tx::INT AS tx, round_even(avg(alpha), 0)::INT AS alpha FROM (SELECT page_id, alpha, CASE WHEN y < 3 THEN 0 WHEN y < 6 THEN 1 WHEN y < 9 THEN 2 WHEN y < 12 THEN 3 ELSE 4 END AS ty, CASE WHEN x < 3 THEN 0 WHEN x < 6 THEN 1 WHEN x < 9 THEN 2 WHEN x < 12 THEN 3 ELSE 4 END AS tx FROM c) GROUP BY ALL""",
    "page_controls": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Next' END AS next_label, CASE WHEN NOT (page_id % 4 = 0 OR page_id % 30 <= 20) THEN '戻る' END AS previous_label, CASE WHEN page_id % 4 = 0 OR page_id % 30 <= 20 THEN 20 ELSE 10 END::DOUBLE AS picture_height FROM pages",
    "attachments_received": """WITH a AS (SELECT *, CASE WHEN conv_id % 5 = 0 THEN FALSE WHEN conv_id % 7 = 3 THEN turn % 2 = 0 ELSE TRUE END AS mine FROM conversations)
 SELECT conv_id AS run_id, count(*) FILTER (mine) AS n_attachments, count(*) FILTER (mine AND role = 'user') AS n_providers, max_by(text, turn) FILTER (mine AND role = 'user' AND turn % 4 <> 2) AS payload,
 CASE WHEN NOT bool_or(mine) THEN '[ERR] 共有元からデータを受け取れませんでした' WHEN NOT bool_or(mine AND role = 'user') THEN '[ERR] property list 型の添付がありません' WHEN max_by(text, turn) FILTER (mine AND role = 'user' AND turn % 4 <> 2) IS NULL THEN '[ERR] 解析結果が空 (ページ側スクリプトが完了しなかった)' END AS failure FROM a GROUP BY conv_id""",
    "typed_rows": """SELECT page_id, 0 AS id, url, (page_id % 9)::INT AS width, 0 AS height, page_id % 5 = 0 AS is_from_source, page_id % 5 = 1 AS is_video_poster, page_id % 5 = 2 AS is_page_meta, page_id % 5 = 3 AS is_other_post FROM pages WHERE url <> ''
 UNION ALL SELECT page_id, 2, '/rel.png', 0, 7, FALSE, FALSE, FALSE, FALSE FROM pages""",
    "trace_lines": f"""WITH {EXPECTED}, more AS (SELECT * FROM e UNION ALL SELECT page_id, 'img', 'https://cdn.example.com/t51.2885-19/' || repeat('n', 30) || '.jpg', 'dom' FROM x WHERE page_id % 5 = 0 UNION ALL SELECT page_id, 'raw source', 'https://bg.example.com/icon.png', 'source' FROM x),
 s AS (SELECT page_id, CASE sweep WHEN 'video' THEN '動画' WHEN 'css' THEN 'CSS背景' ELSE sweep END AS label, count(*) AS n, count(*) FILTER (origin = 'meta') AS meta, count(*) FILTER (origin = 'video') AS video, count(*) FILTER (origin = 'other') AS other,
 list_position(['video', 'img', 'source', 'poster', 'link/meta', 'svg', 'css', 'raw source'], sweep) AS k FROM more GROUP BY ALL),
 t AS (SELECT page_id, string_agg(label || ' ' || n, ' / ' ORDER BY k) FILTER (k < 8) AS sweeps, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (k = 8), 0)::BIGINT AS raw, sum(meta)::BIGINT AS meta, sum(video)::BIGINT AS video, sum(other)::BIGINT AS other FROM s GROUP BY page_id),
 u AS (SELECT page_id, {POSTED} AS url, page_id % 3 = 1 AS post, page_id % 6 AS slide, 1 + (page_id % 2 = 0)::INT + 2 * (page_id % 3 = 0)::INT + 2 * (page_id % 6 = 1)::INT + (page_id % 4 = 2)::INT + (page_id % 5 = 0)::INT AS imgs,
 len({MATCHES}) AS matches FROM (SELECT page_id, url, {TRACED} AS html FROM pages))
 SELECT page_id, concat_ws(chr(10), 'URL: ' || url, CASE WHEN post THEN '開始スライド: ' || slide || '枚目' ELSE '開始スライド: 不明 (1枚目とみなす)' END, 'img要素 ' || imgs || '個 / 初回スキャン ' || (n - raw) || '件',
 CASE WHEN post AND slide >= 3 THEN '戻り方向: 実行する (3枚目以降から共有)' ELSE '戻り方向: 不要 (前のスライドは無いか既に取得済み)' END,
 CASE WHEN NOT post THEN 'カルーセル送りの対象サイトではないため実行しない' END, CASE WHEN post AND slide >= 3 THEN '「前へ」ボタンが無いため送りは未実行 / 次へへ' END, CASE WHEN post THEN '「次へ」ボタンが無いため送りは未実行' END,
 'ソース走査: 一致 ' || matches || '件 / 新規 ' || raw || '件', CASE WHEN meta > 0 THEN 'OGP画像: ' || meta || '件' END, CASE WHEN video > 0 THEN '動画サムネイル: ' || video || '件' END, CASE WHEN page_id % 3 > 0 THEN 'アイコン枠の背景画像を除外: ' || 2 * (page_id % 3) || '件' END,
 CASE WHEN page_id % 3 = 0 THEN 'UI部品の画像を除外: 6件' END, CASE WHEN post THEN '別の投稿へのリンク内の画像: ' || other || '件' END, '取得元の内訳: ' || sweeps,
 CASE WHEN page_id % 5 = 0 THEN 'ページ内のファイル名(1種): t51.2885-19/' || repeat('n', 30) || '…' END, '合計 ' || n || '件 / 所要 ' || page_id || 'ms') AS lines FROM t JOIN u USING (page_id)""",
    "received_lines": f"WITH {EXPECTED} SELECT page_id, '受け取り ' || count(*) || '件 (ページ内 ' || count(*) FILTER (origin <> 'source') || ' / ソース内 ' || count(*) FILTER (origin = 'source') || ')' AS line FROM e GROUP BY page_id",
    "occurrence_counts": f"""WITH {EXPECTED}, p AS (SELECT page_id, url, {INJECTED} AS html FROM pages), m AS (SELECT page_id, unnest({MATCHES}) AS u FROM p),
 k AS (SELECT sweep, 'kept' AS what, count(*) AS n FROM e GROUP BY sweep),
 img AS (SELECT sum(CASE WHEN page_id % 3 = 0 THEN 2 ELSE 0 END)::BIGINT AS assets, sum(CASE WHEN page_id % 6 = 1 THEN 1 ELSE 0 END)::BIGINT AS twice, sum(CASE WHEN page_id % 5 = 2 THEN 1 ELSE 0 END)::BIGINT AS posters, sum(CASE WHEN page_id % 5 = 3 THEN 1 ELSE 0 END)::BIGINT AS og FROM pages)
 SELECT * FROM k UNION ALL SELECT 'img', 'ui asset', assets FROM img UNION ALL SELECT 'img', 'seen', twice FROM img UNION ALL SELECT 'poster', 'seen', posters FROM img UNION ALL SELECT 'link/meta', 'seen', og FROM img
 UNION ALL SELECT 'raw source', 'ui asset', count(*) FROM m WHERE regexp_matches(u, '{UI}') UNION ALL SELECT 'raw source', 'seen', count(*) FILTER (NOT regexp_matches(u, '{UI}')) - (SELECT n FROM k WHERE sweep = 'raw source') FROM m""",
    "contained_images": f"""WITH x AS (SELECT page_id, page_id % 3 = 1 AS post FROM pages),
 e AS (SELECT page_id, 0 AS o, 'https://v.example.com/' || {N} || '.png' AS url, 'video' AS origin, 'video' AS sweep FROM x UNION ALL SELECT page_id, 1, 'https://c.example.com/1.png', 'video', 'video' FROM x UNION ALL SELECT page_id, 2, 'https://c.example.com/2.png', 'video', 'video' FROM x
 UNION ALL SELECT page_id, 3, 'https://c.example.com/3.png', 'dom', 'img' FROM x UNION ALL SELECT page_id, 4, 'https://l.example.com/1.png', CASE WHEN post THEN 'other' ELSE 'dom' END, 'img' FROM x
 UNION ALL SELECT page_id, 5, 'https://l.example.com/2.png', 'dom', 'img' FROM x UNION ALL SELECT page_id, 6, 'https://l.example.com/3.png', 'dom', 'img' FROM x
 UNION ALL SELECT page_id, 7, 'https://l.example.com/4.png', CASE WHEN post THEN 'other' ELSE 'dom' END, 'img' FROM x WHERE page_id % 2 = 0)
 SELECT page_id, o::BIGINT AS "order", url, origin, sweep FROM e""",
    "styled_backgrounds": f"""SELECT page_id, 'https://bg.example.com/' || {N} || '/c.png' AS url, CASE WHEN page_id % 3 = 0 THEN 'kept' ELSE 'sprite' END AS what FROM pages
 UNION ALL SELECT page_id, 'https://bg.example.com/' || {N} || '/' || f, 'kept' FROM pages, (VALUES ('i.png'), ('m.png')) t(f)
 UNION ALL SELECT page_id, 'https://bg.example.com/' || {N} || '/m.png', 'seen' FROM (SELECT page_id, unnest(generate_series(0, {OWN_BOLD})) FROM pages)""",
    "chained_selectors": f"""WITH b AS (SELECT page_id, 'https://bg.example.com/' || {N} AS host FROM pages)
 SELECT page_id, host || '/1.png' AS url, 'kept' AS what FROM b UNION ALL SELECT page_id, host || '/1.png', 'seen' FROM b WHERE page_id % 3 = 0 UNION ALL SELECT page_id, host || '/2.png', 'kept' FROM b
 UNION ALL SELECT page_id, 'https://bg.example.com/' || CAST(page_id % 5 AS VARCHAR) || '/3.png', CASE WHEN page_id % 2 = 0 THEN 'sprite' ELSE 'kept' END FROM b
 UNION ALL SELECT page_id, 'https://bg.example.com/' || {N} || '/2.png', 'seen' FROM (SELECT page_id, unnest(generate_series(1, {OWN_BOLD})) FROM pages)""",
    "declared_images": f"""WITH l AS (SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'meta' ELSE 'dom' END AS origin FROM pages)
 SELECT page_id, o::BIGINT AS "order", CASE WHEN o = 2 THEN 'https://p.example.com/' || {N} || '.png' ELSE u END AS url, coalesce(k, origin) AS origin, s AS sweep FROM l,
 (VALUES (0, 'https://i.example.com/0.png', 'dom', 'img'), (1, 'https://s.example.com/2.png', 'dom', 'source'), (2, '', 'video', 'poster'), (3, 'https://l.example.com/1.png', NULL, 'link/meta'), (4, 'https://l.example.com/2.png', NULL, 'link/meta'), (5, 'https://l.example.com/3.png', NULL, 'link/meta'),
 (6, 'https://m.example.com/1.png', 'meta', 'link/meta'), (7, 'https://d.example.com/1.png', 'dom', 'svg'), (8, 'https://h.example.com/1.png', 'dom', 'img'), (9, 'https://h.example.com/2.png', 'video', 'video'),
 (10, 'https://s.example.com/1.png', 'source', 'raw source'), (11, 'https://s.example.com/no.png', 'source', 'raw source'), (12, 'https://l.example.com/no.png', 'source', 'raw source'), (13, 'https://t.example.com/no.png', 'source', 'raw source')) v(o, u, k, s)""",
    "frame_images": f"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') AS site FROM pages)
 SELECT page_id, o::BIGINT AS "order", site || CASE o WHEN 0 THEN '/own.png' WHEN 1 THEN '/frame/f.png' ELSE '/s.png' END AS url, 'dom' AS origin FROM p, (VALUES (0), (1), (2)) v(o)""",
    "resolve_anchor_urls": """WITH a AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') AS site, unnest(l) AS href, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '<a [^>]*href="([^"]+)"', 1) AS l FROM pages))
 SELECT page_id, pos::INT AS pos, href, site || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') AS url FROM a""",
    "saved_files": f"""WITH {I}, r AS (SELECT id, url, {EXT} AS ext, CASE WHEN id % 5 = 4 THEN '保存が中断されました' WHEN id % 8 = 2 THEN 'ダウンロード失敗 (HTTP 404)' WHEN id % 7 = 3 THEN '画像を読み込めませんでした' END AS error, md5(id || ' ' || url) AS m FROM i WHERE id % 4 = 0)
 SELECT id, id AS seq, error IS NULL AS ok, error, CASE WHEN error IS NULL THEN 'image-' || m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] || '.' || CASE WHEN id % 6 = 5 THEN 'png' WHEN ext = '' THEN 'jpg' ELSE ext END END AS name, CASE WHEN error IS NULL AND id % 6 <> 5 THEN 30 ELSE 0 END::BIGINT AS n_bytes FROM r""",
    "saved_drawings": """WITH p AS (SELECT page_id, (length(html) % 5) / 2.0::DOUBLE AS a, 2.0::DOUBLE * (page_id % 3) AS b, (length(url) % 3 + 1) / 2.0::DOUBLE AS w FROM pages WHERE page_id % 10 <> 9),
 s AS (SELECT page_id, a AS x0, a + 4.5 AS x1, 2 AS y0, 5 AS y1, 1.0::DOUBLE AS part, 200 AS red, 100 AS green, 50 AS blue FROM p UNION ALL SELECT page_id, b, b + 6, 8, 14, 0.5, 0, 0, 255 FROM p
 UNION ALL SELECT page_id, b + 2, b + 4, 10, 12, -0.5, 0, 0, 255 FROM p UNION ALL SELECT page_id, 12 - w, 12 + w, 1, 15, 1, 0, 255, 0 FROM p)
 SELECT page_id, y::INT AS y, x::INT AS x, red, green, blue, round_even(255 * sum(part * (least(x + 1, x1) - greatest(x, x0)) * (least(y + 1, y1) - greatest(y, y0))), 0)::INT AS alpha
 FROM s, range(16) r(y), range(16) c(x) WHERE least(x + 1, x1) > greatest(x, x0) AND least(y + 1, y1) > greatest(y, y0) GROUP BY page_id, y, x, red, green, blue HAVING alpha > 0""",
    "raster_grid": f"""WITH s AS (SELECT page_id, 0.25::DOUBLE AS ax, {D(3)}::DOUBLE AS ay, {D(5)}::DOUBLE AS ex, 0.75::DOUBLE AS ey FROM pages UNION ALL SELECT page_id, {D(5)}::DOUBLE, 0.75::DOUBLE, 0.9375::DOUBLE, {D(7)}::DOUBLE FROM pages),
 p AS (SELECT *, ex - ax AS dx, ey - ay AS dy, (x + 0.5) / 64 AS px, (y + 0.5) / 64 AS py FROM s, range(64) a(y), range(64) b(x)),
 t AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0, least(1, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) END AS t FROM p
  WHERE px BETWEEN least(ax, ex) - 0.05 AND greatest(ax, ex) + 0.05 AND py BETWEEN least(ay, ey) - 0.05 AND greatest(ay, ey) + 0.05),
 c AS (SELECT page_id, y, x, greatest(0, least(255, round_even(((0.05 - min(sqrt(pow(px - (ax + dx * t), 2) + pow(py - (ay + dy * t), 2)))) * 64 + 0.5) * 255, 0)))::INT AS alpha FROM t GROUP BY page_id, y, x)
 SELECT page_id, (y // 8)::INT AS ty, (x // 8)::INT AS tx, round_even(sum(alpha) / 64.0::DOUBLE, 0)::INT AS alpha FROM c WHERE alpha > 0 GROUP BY ALL""",
    "thumbnail_pixels": f"WITH {DRAWN} SELECT page_id, 16.0::DOUBLE AS w, 4::INT AS thumb_h, (y // 4)::INT AS ty, (x // 4)::INT AS tx, round_even(avg(alpha), 0)::INT AS alpha FROM c GROUP BY ALL",
    "thumbnail_states": f"""WITH {I}, p AS (SELECT id, id % 3 = 0 AND id % 5 <> 4 AS fetched, id % 7 <> 3 AS sized, id % 6 = 5 AS drawing, (id * 31 % 900 + 1)::DOUBLE AS pw, (id * 17 % 700 + 1)::DOUBLE AS ph FROM i),
 c AS (SELECT *, CASE WHEN drawing THEN 300.0::DOUBLE / greatest(pw, ph) ELSE least(1.0::DOUBLE, 300.0::DOUBLE / greatest(pw, ph)) END AS z FROM p)
 SELECT id, CASE WHEN id % 12 = 0 THEN 'full' WHEN fetched AND sized THEN 'thumbnail' WHEN fetched THEN 'failed' ELSE 'waiting' END AS shows, NOT fetched AND id % 10 <> 1 AS to_fetch,
 CASE WHEN fetched AND sized AND NOT drawing THEN pw END AS w, CASE WHEN fetched AND sized AND NOT drawing THEN ph END AS h, CASE WHEN fetched AND sized THEN greatest(1, round_even(pw * z, 0)) ELSE 0 END::INT AS thumb_w, CASE WHEN fetched AND sized THEN greatest(1, round_even(ph * z, 0)) ELSE 0 END::INT AS thumb_h FROM c""",
    "status_texts": "SELECT page_id::BIGINT AS id, CASE page_id % 3 WHEN 0 THEN '待機中' WHEN 1 THEN '保存中 ' || page_id || '/' || (page_id + 5) ELSE '完了 成功' || page_id || ' 失敗' || (page_id + 5) END AS status, CASE page_id % 4 WHEN 0 THEN '拒否' WHEN 1 THEN '一部のみ許可' ELSE '不明' END AS permission FROM pages",
    "run_log_text": """WITH l AS (SELECT page_id AS run_id, 1 AS k, '実行 #' || CASE WHEN page_id > 3 THEN page_id + 1 ELSE 1 END || '  ' || strftime(make_timestamp((1700000000 + page_id * 61) * 1000000), '%m/%d %H:%M:%S') || '  ' || CASE WHEN page_id % 4 = 0 THEN '?' WHEN page_id % 2 = 1 THEN 'v1.2 (7)' ELSE 'v1.2 (?)' END AS line FROM pages
 UNION ALL SELECT page_id, 2, '=== 今回の保存 ===' FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, 3, CASE WHEN page_id % 3 = 1 THEN '[ERR] ' ELSE '' END || url FROM pages WHERE page_id % 3 <> 0) SELECT run_id, k AS line_no, line FROM l""",
    "icon_manifest": """WITH s AS (SELECT page_id, (page_id % 5 + 1) * 20 AS n FROM pages), e AS (SELECT page_id, n, '{"filename":"icon-' || n || '.png","idiom":"iphone","scale":"1x","size":"' || n || 'x' || n || '"}' AS one, '{"filename":"icon-' || n * 2 || '.png","idiom":"iphone","scale":"2x","size":"' || n || 'x' || n || '"}' AS two FROM s)
 SELECT page_id, '{"images":[' || one || ',' || one || ',' || two || '],"info":{"author":"xcode","version":1}}' AS contents, 2::BIGINT AS n_sizes FROM e""",
    "glyph_bounds": "SELECT page_id, 22::BIGINT AS n_segments, round(0.5 - 0.345 * (page_id % 4 + 1) / 4, 9)::DOUBLE AS low_x, round(0.5 - 0.3975 * (page_id % 4 + 1) / 4, 9)::DOUBLE AS low_y, round(0.5 + 0.345 * (page_id % 4 + 1) / 4, 9)::DOUBLE AS high_x, round(0.5 + 0.3975 * (page_id % 4 + 1) / 4, 9)::DOUBLE AS high_y FROM pages",
}
