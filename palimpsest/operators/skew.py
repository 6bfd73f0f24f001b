"""Joins whose key may be held by a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 256


def hot_left_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, salt: Column, slots: int = SLOTS) -> DataFrame:
    """Left outer join with ``right``, which has one row per key and in ``weight`` the rows of ``left`` that hold it.

    A key with more than ``total / slots`` rows is hot. Weights add up to ``total`` at
    most, so there are fewer than ``slots`` of them however large the input: these rows of
    ``right`` are broadcast. Left rows of a hot key then spread over the shuffle by
    ``salt`` (any column that varies within a key), with a null key that matches nothing.
    Key columns must not be null. The cold part is a merge join at every size: a plan that
    turned to a broadcast for small inputs would say nothing about large ones.
    """
    payload = [c for c in right.columns if c not in on]
    limit = total / slots
    hot = right.filter(F.col(weight) > limit)
    cold = right.filter(F.col(weight) <= limit)
    hot = F.broadcast(hot.select(*(F.col(c).alias(f"_h_{c}") for c in on), F.struct(*payload).alias("_hot")))
    cold = cold.select(*(F.col(c).alias(f"_c_{c}") for c in on), F.lit(0).alias("_c_salt"), F.struct(*payload).alias("_cold"))
    joined = left.join(hot, [F.col(c) == F.col(f"_h_{c}") for c in on], "left").drop(*(f"_h_{c}" for c in on))
    is_hot = F.col("_hot").isNotNull()
    for c in on:
        joined = joined.withColumn(f"_k_{c}", F.when(~is_hot, F.col(c)))
    joined = joined.withColumn("_k_salt", F.when(is_hot, F.pmod(F.hash(salt), F.lit(1 << 20)) + 1).otherwise(F.lit(0)))
    joined = joined.join(cold.hint("merge"), [*(F.col(f"_k_{c}").eqNullSafe(F.col(f"_c_{c}")) for c in on), F.col("_k_salt") == F.col("_c_salt")], "left")
    got = F.coalesce("_hot", "_cold")
    return joined.select(*left.columns, *(got[c].alias(c) for c in payload))
