import duckdb
import pytest

from palimpsest.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ["events", "orders", "customer", "conversations", "part"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(float(r[i]) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in catalog.ORACLE:
        assert rows
        return
    want = duck.sql(catalog.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(rows, got.columns) == plain(want.fetchall(), want.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["key", "seq", "value"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
