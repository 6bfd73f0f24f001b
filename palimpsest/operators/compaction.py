"""What a compaction keeps of the versions it merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.codec import op_of, tag
from palimpsest.model import DELETE, MAX_SEQ
from palimpsest.operators.intervals import covered
from palimpsest.operators.names import unused


def merge(runs: list[DataFrame]) -> DataFrame:
    """All versions of several runs; order is made where it is needed."""
    return reduce(DataFrame.unionByName, runs)


def keep_rule(log: DataFrame, oldest: int, deeper: DataFrame | None = None) -> DataFrame:
    """The versions that some read at a sequence number >= ``oldest`` can tell the absence of.

    A version goes if the next newer one of its key is itself visible at ``oldest``. A
    deletion that is visible there goes too, unless a file of ``deeper`` (smallest,
    largest) below the merged levels may hold its key. The keys of such deletions come
    from an aggregate without values and are found in the ranges by a sweep; the versions
    themselves are ranked once and meet those keys where the ranking has put them.
    """
    order = Window.partitionBy("key").orderBy(F.col("seq").desc(), F.col("op").desc())
    (next_newer, in_deeper) = unused(log.columns, "newer", "deeper")
    newer = F.coalesce(F.lag("seq").over(order), F.lit(MAX_SEQ))
    marked = log.withColumn(next_newer, newer).filter(F.col(next_newer) > oldest).drop(next_newer)
    dead = (F.col("op") == DELETE) & (F.col("seq") <= oldest)
    if deeper is None:
        return marked.filter(~dead)
    newest = log.filter(F.col("seq") <= oldest).groupBy("key").agg(F.max(tag(F.col("seq"), F.col("op"))).alias("tag"))
    held = covered(newest.filter(op_of(F.col("tag")) == DELETE).select("key"), deeper).withColumn(in_deeper, F.lit(True))
    # a merge join keeps the ranking's partitions; the held keys alone are shuffled to it
    return marked.join(held.hint("merge"), "key", "left").filter(~dead | F.col(in_deeper)).select(*log.columns)


def dedup_run(log: DataFrame) -> DataFrame:
    """A flush without snapshots: the newest version of each key, deletions kept."""
    (place,) = unused(log.columns, "place")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("seq").desc(), F.col("op").desc()))
    return log.withColumn(place, rank).filter(F.col(place) == 1).drop(place)


def read_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys that two live views give differently; none if a compaction was right."""
    x = a.select("key", F.struct(*[c for c in a.columns if c != "key"]).alias("x"))
    y = b.select("key", F.struct(*[c for c in a.columns if c != "key"]).alias("y"))
    return x.join(y, "key", "full_outer").filter(~F.col("x").eqNullSafe(F.col("y")))
