"""Which keys lie in any of many ranges, by one sweep over sorted ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.scratch import Scratch


def covered(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """The different keys of ``keys`` (key) that a range of ``ranges`` (smallest, largest; both ends belong to it) holds.

    Keys and ends are range-partitioned and sorted together; the ranges open at a key are
    those begun before it less those ended, and partitions exchange one row each for what
    is open at their border. No key is compared with a range. The placed rows are kept,
    so that both readings see the same partitions.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = [("smallest", 0, 1), ("largest", 2, -1)]  # at one key, ranges begin before the key and end after it
    events = keys.select(F.col("key").alias("at"), F.lit(1).alias("turn"), F.lit(0).alias("step")).distinct()
    for end, turn, step in ends:
        events = events.unionByName(ranges.select(F.col(end).alias("at"), F.lit(turn).alias("turn"), F.lit(step).alias("step")))
    placed = events.repartitionByRange(parts, "at").withColumn("part", F.spark_partition_id())
    placed = Scratch(keys.sparkSession, "covered").keep(placed, "placed")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    border = placed.groupBy("part").agg(F.sum("step").alias("step")).select("part", F.coalesce(F.sum("step").over(before), F.lit(0)).alias("before"))
    own = F.sum("step").over(Window.partitionBy("part").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = placed.withColumn("own", own).filter("turn = 1").join(F.broadcast(border), "part")
    return held.filter(F.col("before") + F.col("own") > 0).select(F.col("at").alias("key"))
