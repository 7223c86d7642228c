"""The queries of filters and talks against their SQL on the smallest tables."""

import duckdb
import pytest

from fathomline.llm import queries


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_conversation_repair"])
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    got, want = queries.queries()[name](spark, small), con.sql(queries.oracle_sql()[name])
    assert got.columns == want.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
