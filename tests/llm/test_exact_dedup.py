import random

import pytest

from palimpsest.llm.exact_dedup import drop_exact_duplicates, exact_duplicates, radix_groups

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOW), []).append(i)
    out = []
    for members in groups.values():
        ids = [i for i in members if i is not None]
        out += [(i, max(ids, default=None), len(members)) for i in members]
    return sorted(out, key=str)


def rows():
    r = random.Random(1)
    base = ["", "É" * 40, "a" * 64, "a" * 65, "a" * 63, "b" * 64 * 32, "c" * 5000 + "d", "c" * 5000 + "e", "x" * 150_000, "x" * 150_001, None]
    texts = [r.choice(base) for _ in range(300)] + ["Hot Text " * 30] * 200 + [f"own {i}" for i in range(50)]
    r.shuffle(texts)
    return [*enumerate(t if r.random() < 0.5 or t is None else t.upper() if t.isascii() else t for t in texts), (None, "null id"), (None, "NULL id"), (7, "twice"), (7, "twice"), (900, "null ID")]


@pytest.mark.parametrize(("local_rows", "local_bytes"), [(0, 1 << 25), (256, 1 << 25), (256, 10_000)])
def test_equals_brute_force(spark, local_rows, local_bytes):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as gid", "2 as rest", "'x' as n")
    got = exact_duplicates(df, local_rows=local_rows, local_bytes=local_bytes).collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == brute(data)
    assert sum(r["kept"] for r in got) == len({k for k in ((t or "").translate(LOW) for _, t in data)})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_duplicates(df).collect() == []


def test_drop(spark):
    data = [(1, "A", 1), (2, "a", 2), (3, "b", 3), (4, None, 4), (5, "", 5), (6, "r", 6), (6, "R", 7)]
    df = spark.createDataFrame(data, "doc_id long, text string, _gone int")
    assert sorted(r[0] for r in drop_exact_duplicates(df).collect()) == [2, 3, 5, 6]


def test_drop_tells_rows_apart_that_repeat_an_id(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "n"), (None, "N"), (None, "a")], "doc_id long, text string")
    assert sorted(map(str, map(tuple, drop_exact_duplicates(df).collect()))) in (["(1, 'b')", "(2, 'a')", "(None, 'n')"], ["(1, 'b')", "(2, 'a')", "(None, 'N')"])


@pytest.mark.parametrize("local_rows", [0, 256])
def test_drop_is_certain_and_keeps_columns_of_any_name(spark, local_rows):
    r = random.Random(4)
    data = [(i % 5, f"t{i % 3}" + "x" * 70, i, f"v{i}", i / 2) for i in range(60)]
    kept = set()
    for parts in (1, 3, 5):
        r.shuffle(data)
        df = spark.createDataFrame(data, "doc_id long, text string, row int, `__low` string, `a.b` double").repartition(parts)
        got = drop_exact_duplicates(df, local_rows=local_rows)
        assert got.columns == df.columns
        kept.add(tuple(sorted(map(tuple, got.collect()))))
    assert len(kept) == 1 and len(kept.pop()) == 3


def test_radix_groups():
    assert sorted(map(sorted, radix_groups([b"ab", b"a", b"ab", b"", b"a" * 64, b"a" * 64], 1))) == [[0, 2], [1], [3], [4, 5]]
