import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import codec
from palimpsest.operators import batch, bloom, compaction, visibility
from palimpsest.operators.intervals import covered
from palimpsest.operators.names import unused
from palimpsest.operators.skew import hot_left_join
from palimpsest.sources import scratch

LOG = "key string, seq long, op int, value string"


def test_latest_both_ways_and_types(spark):
    rows = [("a", 1, 1, "x"), ("a", 3, 0, None), ("a", 2, 1, "y"), ("b", 4, 1, ""), ("c", 5, 0, None), ("c", 6, 1, "z")]
    log = spark.createDataFrame(rows, LOG)
    for how in ("hash", "window", "auto"):
        assert sorted(map(tuple, visibility.latest(log, how=how).collect())) == [("a", 3, 0, None), ("b", 4, 1, ""), ("c", 6, 1, "z")]
    assert sorted(r["key"] for r in visibility.live(log, 2).collect()) == ["a"]
    assert visibility.get(log, "a").collect() == [] and visibility.get(log, "a", 2).first()["value"] == "y"
    assert visibility.live(log.limit(0)).collect() == []


def test_unknown_operation(spark):
    bad = spark.createDataFrame([(0, 1, [(7, "k", "v")])], "batch_id long, base_seq long, ops array<struct<op:int,key:string,value:string>>")
    with pytest.raises(Exception, match="unknown operation"):
        batch.explode(bad).collect()


def test_concat_of_all_batches(spark):
    """Many batches of different lengths become one numbering, and no row gathers them."""
    sizes = [(7 * b) % 5 for b in range(300)]
    ops = [[(1, f"k{b}", f"{b}.{i}") for i in range(n)] for b, n in enumerate(sizes)]
    rows = [(b, 50 + sum(sizes[:b]), o) for b, o in enumerate(ops)]
    rows = rows[1::2] + rows[::2][::-1]
    df = spark.createDataFrame(rows, "batch_id long, base_seq long, ops array<struct<op:int,key:string,value:string>>")
    whole = batch.concat(df)
    want = [(0, i, key, 50 + i, op, value) for i, (op, key, value) in enumerate(x for o in ops for x in o)]
    assert [tuple(r) for r in batch.explode(whole).orderBy("pos").collect()] == want
    assert whole.agg(F.max(F.size("ops"))).first()[0] == max(sizes)
    assert batch.explode(batch.concat(df.limit(0))).collect() == []


def test_compaction_keeps_reads(spark):
    rows = [(k, 10 * i + j, (i * j + len(k)) % 3 and 1, f"{k}{i}{j}") for i in range(6) for j, k in enumerate("abcde")]
    log = spark.createDataFrame(rows, LOG)
    for oldest in (0, 25, 60):
        kept = compaction.keep_rule(log, oldest)
        for s in range(oldest, 61, 7):
            assert compaction.read_differences(visibility.live(kept, s), visibility.live(log, s)).isEmpty()


def test_covered_keys(spark):
    r = random.Random(2)
    ranges = [sorted((r.randrange(1000), r.randrange(1000))) for _ in range(40)] + [[5, 5], [2000, 2100], [2000, 2100]]
    ranges = [x for x in ranges if x[1] - x[0] < 60 or x[0] >= 2000]
    keys = list(range(-3, 2200)) + [7] * 500
    got = covered(spark.createDataFrame([(k,) for k in keys], "key long").repartition(5), spark.createDataFrame(ranges, "smallest long, largest long"))
    assert sorted(x[0] for x in got.collect()) == sorted(k for k in set(keys) if any(a <= k <= b for a, b in ranges))
    text = covered(spark.createDataFrame([("a",), ("b",), ("ba",), ("d",)], "key string"), spark.createDataFrame([("b", "c")], "smallest string, largest string"))
    assert sorted(x[0] for x in text.collect()) == ["b", "ba"]
    assert covered(spark.createDataFrame([("a",)], "key string"), spark.createDataFrame([], "smallest string, largest string")).collect() == []


def test_compaction_above_deeper_files_compares_no_pairs(spark, capsys):
    rows = [(k, s, s % 3 and 1, f"{k}{s}") for s in range(200) for k in (f"k{s * 7 % 40:02}",)]
    log = spark.createDataFrame(rows, LOG)
    deeper = spark.createDataFrame([("k05", "k09"), ("k08", "k15"), ("k30", "k30")], "smallest string, largest string")
    kept = compaction.keep_rule(log, 150, deeper)
    kept.explain("formatted")
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and len(set(re.findall(r"\((\d+)\) Window\n", plan))) <= 3
    newer = {}
    want = []
    for k, s, op, v in sorted(rows, key=lambda x: -x[1]):
        if newer.get(k, 10**9) > 150 and not (op == 0 and s <= 150 and not any(a <= k <= b for a, b in (("k05", "k09"), ("k08", "k15"), ("k30", "k30")))):
            want.append((k, s, op, v))
        newer[k] = s
    assert sorted(map(tuple, kept.collect())) == sorted(want)


def test_columns_of_the_user_keep_their_names(spark):
    log = spark.createDataFrame([("a", 1, 1, "x", 5, 6), ("a", 2, 1, "y", 7, 8)], LOG + ", place int, tag int")
    assert [r.asDict() for r in visibility.live(log).collect()] == [{"key": "a", "seq": 2, "value": "y", "place": 7, "tag": 8}]
    assert compaction.dedup_run(log).columns == log.columns == compaction.keep_rule(log, 1).columns
    assert unused(["Row", "_row"], "row", "x") == ["__row", "x"]


def test_bloom_has_no_false_negative(spark):
    keys = spark.createDataFrame([(x,) for x in ("a", "sd", "fghj", "kl", "z", "ggt", "")], "key string")
    bits, k = bloom.size_for(7, 10), bloom.probes(10)
    assert bloom.may_hold(keys, bloom.build(keys, bits, k), bits, k).count() == 7
    others = spark.range(2000).select(F.col("id").cast("string").alias("key"))
    assert bloom.may_hold(others, bloom.build(keys, bits, k), bits, k).count() < 200


def test_codecs(spark):
    numbers = [0, 1, 127, 128, 16383, 16384, 2**31, 2**56 - 1, 2**62]
    df = spark.createDataFrame([(n,) for n in numbers], "x long")
    got = df.select("x", codec.read_varint(codec.varint(F.col("x"))).alias("v"), codec.read_fixed(codec.fixed(F.col("x"), 8), 8).alias("f"), codec.varint_length(F.col("x")).alias("n")).collect()
    assert [(r["v"], r["f"]) for r in got] == [(n, n) for n in numbers]
    assert [r["n"] for r in got] == [max(1, -(-n.bit_length() // 7)) for n in numbers]
    data = spark.createDataFrame([(b"123456789",), (b"",), (None,), (b"\x00" * 32,)], "b binary")
    assert [r[0] for r in data.select(codec.crc32c("b")).collect()] == [0xE3069283, 0, None, 0x8A9136AA]


def test_hot_join(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(600)], "k string, i long")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    got = hot_left_join(left, right, ["k"], "n", 600, F.col("i"), slots=4).collect()
    assert len(got) == 600 and all(r["n"] == (400 if r["k"] == "hot" else 1) for r in got)
    partial = hot_left_join(left, right.filter("k = 'k0'"), ["k"], "n", 600, F.col("i")).filter("n is not null")
    assert [r["k"] for r in partial.collect()] == ["k0"]


def test_scratch_tables_go_with_their_lifetime(spark):
    with scratch.lifetime():
        one = scratch.Scratch(spark, "one")
        kept = one.keep(spark.range(3).toDF("x"), "t")
        assert kept.count() == 3
    with pytest.raises(Exception, match="(?i)not.*exist"):
        kept.count()
    made = []
    with scratch.collecting(made):
        two, three = scratch.Scratch(spark, "two"), scratch.Scratch(spark, "three")
        a, b = two.keep(spark.range(3).toDF("x"), "t"), three.keep(spark.range(4).toDF("x"), "t")
    scratch.release(made, a.filter("x > 0"))
    assert made == [two] and a.count() == 3
    with pytest.raises(Exception, match="(?i)not.*exist"):
        b.count()
    scratch.release(made)
    assert made == []
