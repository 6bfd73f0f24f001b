"""Reads: the newest version of each key that a snapshot sees, unless it is a deletion.

All of it goes from DataFrame to DataFrame; the store and the queries share it. The order
of steps matters: visibility first, then the newest version, and only then are deletions
taken out, or a deleted key's older version would come back.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.codec import op_of, seq_of, tag
from palimpsest.model import PUT, newest_first, payload
from palimpsest.operators.names import unused

_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def as_of(log: DataFrame, seq: int | None = None) -> DataFrame:
    """The versions that a snapshot sees. The bound is on a plain column, so it reaches the scan."""
    return log if seq is None else log.filter(F.col("seq") <= seq)


def latest(log: DataFrame, seq: int | None = None, how: str = "auto") -> DataFrame:
    """The newest visible version of each key, deletions included.

    ``hash`` keeps a running maximum of packed tags and the values beside it, which a hash
    aggregate can do where values have a fixed width; it combines before the shuffle, so a
    hot key sends one row per task. ``window`` ranks versions, and the rank limit
    cuts them before the shuffle too; it takes any type. ``auto`` prefers the first.
    """
    log = as_of(log, seq)
    values = payload(log)
    fixed = all(isinstance(log.schema[c].dataType, _FIXED) and not isinstance(log.schema[c].dataType, T.DecimalType) for c in values)
    if how == "hash" or how == "auto" and fixed:
        (packed,) = unused(log.columns, "tag")
        tagged = log.select("key", *values, tag(F.col("seq"), F.col("op")).alias(packed))
        newest = tagged.groupBy("key").agg(F.max(packed).alias(packed), *(F.max_by(c, packed).alias(c) for c in values))
        return newest.select("key", seq_of(F.col(packed)).alias("seq"), op_of(F.col(packed)).alias("op"), *values)
    order = Window.partitionBy("key").orderBy(F.col("seq").desc(), F.col("op").desc())
    (place,) = unused(log.columns, "place")
    return log.withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).select("key", "seq", F.col("op").cast("int").alias("op"), *values)


def live(log: DataFrame, seq: int | None = None) -> DataFrame:
    """Keys that exist with their values: (key, seq, value...)."""
    return latest(log, seq).filter(F.col("op") == PUT).drop("op")


def tombstones(log: DataFrame, seq: int | None = None) -> DataFrame:
    """Keys whose newest version is a deletion."""
    return latest(log, seq).filter(F.col("op") != PUT).select("key", "seq")


def get(log: DataFrame, key: Any, seq: int | None = None) -> DataFrame:
    """At most one row; filters and the ordered limit leave a top-1 over one key's versions."""
    found = as_of(log.filter(F.col("key") == F.lit(key)), seq)
    return found.orderBy(F.col("seq").desc(), F.col("op").desc()).limit(1).filter(F.col("op") == PUT).drop("op")


def multi_get(log: DataFrame, keys: DataFrame, seq: int | None = None) -> DataFrame:
    """Each row of ``keys`` (key) with its value and whether it was found; repeated keys give a row each.

    The log is cut to the wanted keys first. That join is left to the optimizer, which
    broadcasts a small side and shuffles a large one.
    """
    wanted = keys.select("key")
    hits = live(log.join(wanted.distinct(), "key", "left_semi"), seq)
    return wanted.join(hits, "key", "left").withColumn("found", F.col("seq").isNotNull())


def between(low: Any = None, high: Any = None) -> Column:
    """low <= key < high; an end that isn't given is open."""
    bound = F.lit(True)
    if low is not None:
        bound = bound & (F.col("key") >= F.lit(low))
    return bound if high is None else bound & (F.col("key") < F.lit(high))


def scan(log: DataFrame, low: Any = None, high: Any = None, reverse: bool = False, limit: int | None = None, seq: int | None = None) -> DataFrame:
    """Live keys of a range in order, forward or back, all or the first ``limit``."""
    rows = live(log.filter(between(low, high)), seq).orderBy(F.col("key").desc() if reverse else F.col("key").asc())
    return rows if limit is None else rows.limit(limit)


def seek(log: DataFrame, targets: DataFrame, before: bool = False, seq: int | None = None) -> DataFrame:
    """For each row of ``targets`` (target) the first live key >= it, or with ``before`` the last one < it.

    Keys and targets are merged and sorted once: a running extreme carries the nearest key
    to each target.
    """
    keys = live(log, seq)
    values = [c for c in keys.columns if c != "key"]
    # an inequality join would compare all pairs; of sorted rows only neighbours matter
    both = keys.select(F.col("key").alias("at"), F.lit(1).alias("is_key")).unionByName(targets.select(F.col("target").alias("at"), F.lit(0).alias("is_key")).distinct())
    found = _carry(both, before)
    return targets.join(found, targets["target"].eqNullSafe(found["at"]), "left").select("target", "key").join(keys, "key", "left").select("target", "key", *values)


def _carry(rows: DataFrame, before: bool) -> DataFrame:
    """(at, key) of rows with is_key = 0: the nearest ``at`` of a row with is_key = 1 on one side.

    Rows are range-partitioned; within a partition a running extreme finds the key, and the
    partitions' own extremes (a row each) serve rows at the border.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, "at").withColumn("part", F.spark_partition_id())
    edges = placed.filter("is_key = 1").groupBy("part").agg((F.max if before else F.min)("at").alias("edge"))
    side = Window.orderBy("part")
    far = (F.max("edge").over(side.rowsBetween(Window.unboundedPreceding, -1))) if before else (F.min("edge").over(side.rowsBetween(1, Window.unboundedFollowing)))
    every = placed.select("part").distinct().join(edges, "part", "left").select("part", far.alias("border"))
    w = Window.partitionBy("part").orderBy("at")
    key = F.when(F.col("is_key") == 1, F.col("at"))
    if before:
        strictly = Window.partitionBy("part").orderBy("at", F.col("is_key").asc()).rowsBetween(Window.unboundedPreceding, -1)
        own = F.max(key).over(strictly)
    else:
        own = F.min(key).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    near = placed.withColumn("own", own).filter("is_key = 0").select("part", "at", "own")
    return near.join(F.broadcast(every), "part", "left").select("at", F.coalesce("own", "border").alias("key"))


def first_last(log: DataFrame, seq: int | None = None) -> DataFrame:
    """The first and the last live key with their values."""
    keys = live(log, seq)
    first = keys.orderBy(F.col("key").asc()).limit(1).withColumn("which", F.lit("first"))
    return first.unionByName(keys.orderBy(F.col("key").desc()).limit(1).withColumn("which", F.lit("last")))


def neighbours(log: DataFrame, seq: int | None = None) -> DataFrame:
    """Each live key with the one before and the one after it, as a cursor would step."""
    keys = live(log, seq).select("key")
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = keys.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id())
    ends = placed.groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    order = Window.orderBy("part")  # a row per partition
    ends = ends.select("part", F.lag("hi").over(order).alias("lower"), F.lead("lo").over(order).alias("upper"))
    w = Window.partitionBy("part").orderBy("key")
    near = placed.select("part", "key", F.lag("key").over(w).alias("p"), F.lead("key").over(w).alias("n"))
    return near.join(F.broadcast(ends), "part").select("key", F.coalesce("p", "lower").alias("prev_key"), F.coalesce("n", "upper").alias("next_key"))


def history(log: DataFrame, low: Any = None, high: Any = None) -> DataFrame:
    """Every version of a key range with its rank, 1 for the newest of its key."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("seq").desc(), F.col("op").desc()))
    return log.filter(between(low, high)).withColumn("version", rank)


def entries(log: DataFrame) -> DataFrame:
    """The raw log in its order, old versions and deletions included."""
    return log.orderBy(*newest_first())


def op_counts(log: DataFrame) -> DataFrame:
    """Puts and deletes of each key."""
    return log.groupBy("key").agg(F.count_if(F.col("op") == PUT).alias("puts"), F.count_if(F.col("op") != PUT).alias("deletes"))
