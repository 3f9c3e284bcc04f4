"""Queries over built media files against their SQL twins."""

import duckdb
import pytest

from marklens.plans import media_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", media_queries.QUERIES)
def test_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(media_queries.ORACLES[name])
    made = media_queries.QUERIES[name](spark, SF)
    assert sorted(made.columns) == sorted(want.columns)
    got = made.select(*want.columns).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want.fetchall())) != []
