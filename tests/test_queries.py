"""Every query that has SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from pagelens.plans import queries, sql

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, DIR).toPandas()
    assert len(got)
    if name in sql.SQL:
        con = duckdb.connect()
        for t in ("pages", "conversations"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
        want = con.sql(sql.SQL[name]).df()
        shown = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df.notna(), None).values.tolist()))
        assert sorted(got.columns) == sorted(want.columns) and shown(got) == shown(want)
