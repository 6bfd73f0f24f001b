"""Connected components by alternating large-star and small-star steps.

Each step replaces a node's links by links to its least neighbour, which keeps
components and makes them stars within a logarithmic number of rounds in practice.
Links stay in tables; nothing of their number reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.skew import hot_left_join
from palimpsest.sources.scratch import Scratch


def _to_least(links: DataFrame, total: int) -> DataFrame:
    """(u, v, least): every link with the least of u and its neighbours."""
    least = links.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n"))
    return hot_left_join(links, least, ["u"], "n", total, F.col("v")).select("u", "v", F.least("u", "least").alias("least"))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: long); root is the least node of its component."""
    edges = scratch.keep(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "e0")
    n, turn = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first(), 0
    while n[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, 2 * n[0]).filter("v > u and v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        large = scratch.keep(large, f"s{turn}")
        small = _to_least(large, large.count())
        small = small.select("u", F.col("least").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("least").alias("v")))
        new = scratch.keep(small.filter("u <> v").distinct(), f"e{turn + 1}")
        m = new.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        scratch.drop(f"e{turn}", f"s{turn}")
        edges, turn = new, turn + 1
        if m == n:
            break
        n = m
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
