import duckdb
import pytest

from palimpsest.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_rank_order_langid", "op9_html_tree_model", "op10_msd_exact_dedup"])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for table in ("documents", "pages"):
        c.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = c.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SF).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
