"""Atomic batches: ordered puts and deletes that commit under consecutive sequence numbers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.model import DELETE, PUT
from palimpsest.sources.scratch import Scratch


class Op(NamedTuple):
    op: int
    key: bytes
    value: bytes | None


def as_bytes(x: bytes | str) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


class WriteBatch:
    """Operations in order; of several on one key the last decides."""

    def __init__(self) -> None:
        self.ops: list[Op] = []

    def put(self, key: bytes | str, value: bytes | str) -> WriteBatch:
        self.ops.append(Op(PUT, as_bytes(key), as_bytes(value)))
        return self

    def delete(self, key: bytes | str) -> WriteBatch:
        self.ops.append(Op(DELETE, as_bytes(key), None))
        return self

    def append(self, other: WriteBatch) -> WriteBatch:
        self.ops += other.ops
        return self

    def clear(self) -> None:
        self.ops = []

    def __len__(self) -> int:
        return len(self.ops)

    def __iter__(self) -> Iterator[Op]:
        return iter(self.ops)

    @property
    def byte_size(self) -> int:
        return sum(len(o.key) + len(o.value or b"") for o in self.ops)


def explode(batches: DataFrame) -> DataFrame:
    """Batches (batch_id, base_seq, ops: array<struct<op, key, value>>) as log rows with seq = base_seq + position.

    With a column ``at``, a row is a piece of a batch and ``at`` the position of its first
    operation. An operation that is neither put nor delete fails the query.
    """
    at = F.col("at") if "at" in batches.columns else F.lit(0)
    rows = batches.select("batch_id", "base_seq", at.alias("at"), F.posexplode("ops").alias("pos", "o")).withColumn("pos", F.col("at") + F.col("pos"))
    checked = F.when(F.col("o.op").isin(DELETE, PUT), F.col("o.op").cast("int")).otherwise(F.raise_error(F.lit("unknown operation in batch")).cast("int"))
    return rows.select("batch_id", "pos", F.col("o.key").alias("key"), (F.col("base_seq") + F.col("pos")).alias("seq"), checked.alias("op"), F.col("o.value").alias("value"))


def concat(batches: DataFrame, by: str = "batch_id") -> DataFrame:
    """Batches joined in order of ``by`` to one, in pieces for ``explode``: (batch_id, base_seq, at: long, ops), a row per batch.

    Batches are range-partitioned and numbered within their partition; partitions exchange
    one row each, what is before them. The placed rows are kept, so both readings see the same.
    """
    parts = int(batches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = F.greatest(F.coalesce(F.size("ops"), F.lit(0)), F.lit(0)).cast("long")
    placed = batches.select(F.col(by).alias("by"), "base_seq", "ops", n.alias("n")).repartitionByRange(parts, "by").withColumn("part", F.spark_partition_id())
    placed = Scratch(batches.sparkSession, "concat").keep(placed, "placed")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    ends = placed.groupBy("part").agg(F.sum("n").alias("n"), F.min("base_seq").alias("least"))
    ends = ends.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.min("least").over(Window.partitionBy()).alias("base"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("by", "ops").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = placed.withColumn("own", own).join(F.broadcast(ends), "part")
    return pieces.select(F.lit(0).cast("long").alias("batch_id"), F.col("base").alias("base_seq"), (F.col("before") + F.col("own")).alias("at"), "ops")


def count_check(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(batch_id, expected, found, ok): batches whose rows are not as many as their header says are corrupt."""
    found = rows.groupBy("batch_id").agg(F.count("*").alias("found"))
    both = headers.join(found, "batch_id", "full_outer")
    return both.select("batch_id", "expected", F.coalesce("found", F.lit(0)).alias("found"), (F.coalesce("expected", F.lit(-1)) == F.coalesce("found", F.lit(0))).alias("ok"))


def last_op_wins(rows: DataFrame) -> DataFrame:
    """Per batch and key the operation that counts."""
    return rows.groupBy("batch_id", "key").agg(F.max("pos").alias("pos"), F.max_by("op", "pos").alias("op"))
