"""Bloom filters over user keys, as DataFrames.

A filter is a table of 64-bit words. Positions come from one 64-bit hash by double
hashing. Building is a grouped OR that combines before the shuffle; probing is a join on
words. There are no false negatives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def probes(bits_per_key: float) -> int:
    return max(1, min(30, int(bits_per_key * 0.69)))


def positions(key: Column, bits: int, k: int) -> Column:
    h = F.xxhash64(key)
    step = F.shiftrightunsigned(h, 33).bitwiseOR(F.lit(1).cast("long"))
    base = F.shiftrightunsigned(h, 1)
    return F.array(*((base + i * step) % bits for i in range(k)))


def size_for(n: int, bits_per_key: float) -> int:
    return max(64, -(-int(n * bits_per_key) // 64) * 64)


def build(keys: DataFrame, bits: int, k: int, column: str = "key") -> DataFrame:
    """(word, mask) of the words that have a bit set."""
    at = keys.select(F.explode(positions(F.col(column), bits, k)).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    return at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(bit).alias("mask"))


def may_hold(rows: DataFrame, words: DataFrame, bits: int, k: int, column: str = "key") -> DataFrame:
    """Rows of ``rows`` whose key the filter may hold; each different key is probed once."""
    at = rows.select(column).distinct().select(column, F.explode(F.array_distinct(positions(F.col(column), bits, k))).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    hit = at.withColumn("word", F.floor(F.col("at") / 64)).join(words, "word", "left")
    hit = hit.withColumn("set", F.coalesce(F.col("mask").bitwiseAND(bit) != 0, F.lit(False)))
    passing = hit.groupBy(column).agg(F.bool_and("set").alias("all")).filter("all").select(column)
    return rows.join(passing, column, "left_semi")
