"""Queries on pages of more elements and image URLs than the limits of config.DEFAULT, against their SQL."""

import duckdb
import pytest

from pagelens.config import DEFAULT
from pagelens.plans import queries, sql

#: More elements than the limit, some of them bold; more matches than the limit, of no one's interest.
BOLD = "<p><b>x</b></p>" * (DEFAULT.styled_elements // 2 + 50)
NAMED = "<p>https://many.example.com/x.png</p>" * (DEFAULT.source_matches + 50)
ASSETS = "<p>https://h.example.com/rsrc.php/z.png</p>" * (DEFAULT.source_matches + 50)


@pytest.mark.parametrize("name,html", [("chained_selectors", BOLD), ("styled_backgrounds", BOLD), ("payload_sizes", BOLD + ASSETS), ("extract_images", BOLD + ASSETS), ("sweep_counts", BOLD + ASSETS), ("ui_asset_skips", NAMED), ("occurrence_counts", BOLD), ("trace_lines", BOLD)])
def test_whole_pages(spark, tmp_path, name, html):
    rows = [(i, f"https://h.example/{i}/", html if i % 2 else "<p>x</p>") for i in range(12)] + [(i, f"https://h.example/{i}/", html) for i in (20, 22, 24, 28)]
    rows.append((30, "https://h.example/30/", html * 9))  # what comes next is beyond element 32,768
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got, want = queries.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(sql.SQL[name]).df()
    shown = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df.notna(), None).values.tolist()))
    assert shown(got) == shown(want)
