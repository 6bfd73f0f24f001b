"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by their leading bytes, the groups by the bytes that follow,
and so on until a group has one member or its texts have ended. Equality is what
is left when no byte tells two texts apart; no digest decides it.

The radix is a string of bytes that gets longer from level to level (64, 2048, 65536, a
megabyte).
At a level, children are counted with a map-side combine, so a group that holds a
third of all rows sends one row per task; documents then look up their child in a join
that is safe for hot keys. Of the groups that are still open, those of up to
``LOCAL_ROWS`` rows and ``LOCAL_BYTES`` bytes go to one task each, which splits them
further in the same way; only larger ones take another level over the cluster. Each
level is a written table, so lost executors cost a re-read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.workers import lean
from palimpsest.operators.names import unused
from palimpsest.operators.skew import hot_left_join
from palimpsest.sources.scratch import Scratch

FIRST_WIDTH, GROWTH, MAX_WIDTH, LOCAL_ROWS, LOCAL_BYTES = 64, 32, 1 << 20, 256, 32 << 20
_RESULT = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string, row long"


@lean
def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = pc.ascii_lower(pc.fill_null(batch.column(1), "")).cast(pa.binary())
        sha = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in text], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), sha, text, *batch.columns[2:]], ["doc_id", "text_sha256", "rest", "tie", "row"])


def radix_groups(texts: list[bytes], width: int = FIRST_WIDTH) -> list[list[int]]:
    """Indices of equal texts, by splitting on successive bytes."""
    done, todo = [], [(list(range(len(texts))), 0, width)]
    while todo:
        group, at, w = todo.pop()
        buckets: dict[bytes, list[int]] = {}
        for i in group:
            buckets.setdefault(texts[i][at : at + w], []).append(i)
        for digit, members in buckets.items():
            if len(members) == 1 or len(digit) < w:
                done.append(members)
            else:
                todo.append((members, at + w, min(w * GROWTH, MAX_WIDTH)))
    return done


@lean
def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Splits the groups (gid) of a partition sorted by gid to their end; a group may go on in the next batch."""

    def split(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        at = 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end][3] == rows[at][3]:
                end += 1
            group = rows[at:end]
            for members in radix_groups([r[4] for r in group]):
                top = max((group[i] for i in members), key=lambda r: (r[0] is not None, r[0] or 0, r[5], r[2]))
                out += [(group[i][0], top[0], len(members), group[i][2] == top[2], group[i][1], group[i][2]) for i in members]
            at = end
        kinds = {"doc_id": pa.int64(), "keep_id": pa.int64(), "group_size": pa.int64(), "kept": pa.bool_(), "text_sha256": pa.string(), "row": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * len(kinds), kinds.values())], list(kinds))

    held: list[tuple] = []
    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns))
        if held:
            cut = len(held)
            while cut and held[cut - 1][3] == held[-1][3]:
                cut -= 1
            yield split(held[:cut])
            held = held[cut:]
    yield split(held)


def _marked(base: DataFrame, scratch: Scratch, local_rows: int, local_bytes: int) -> DataFrame:
    """One row per row of ``base`` (doc_id, text, tie, row: unique), with ``row``; of equal rows by id the one with the largest tie and row is kept."""
    base = base.select(F.col("doc_id").cast("long"), "text", F.col("tie").cast("long"), F.col("row").cast("long"))
    active = base.mapInArrow(_normalise, "doc_id long, text_sha256 string, rest binary, tie long, row long")
    active = scratch.keep(active.withColumn("gid", F.lit(0).cast("long")), "l0")
    done = None
    level, width = 0, FIRST_WIDTH
    total = active.count()
    while total:
        active = active.withColumn("digit", F.substring("rest", 1, width))
        children = (
            active.groupBy("gid", "digit")
            .agg(F.count("*").alias("n"), F.sum(F.octet_length("rest").cast("long")).alias("bytes"), F.max(F.struct(F.col("doc_id"), F.col("tie"), F.col("row"))).alias("top"))
            .filter("n > 1")
            .select("gid", "digit", "n", "bytes", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row"))
        )
        children = scratch.keep(children, f"c{level}")
        split = hot_left_join(active.withColumn("rest", F.expr(f"substring(rest, {width + 1})")), children, ["gid", "digit"], "n", total, F.col("row"))
        is_open = F.col("n").isNotNull() & (F.octet_length("digit") == width)
        split = split.select(
            "doc_id",
            "text_sha256",
            "row",
            F.coalesce("keep_row", "row").alias("gid"),
            F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).alias("group_size"),
            F.when(is_open, (F.col("n") <= local_rows) & (F.col("bytes") <= local_bytes)).alias("small"),  # of a group that goes on
            F.when(is_open, F.col("rest")).alias("rest"),
            F.when(is_open, F.col("tie")).alias("tie"),
        )
        split = scratch.keep(split, f"l{level + 1}")
        scratch.drop(f"c{level}")
        if level == 0:
            scratch.drop("l0")
        scratch.sweep()
        ended = split.filter("small is null").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("gid")).alias("kept"), "text_sha256", "row")
        small = split.filter("small").select("doc_id", "text_sha256", "row", "gid", "rest", "tie")
        small = small.repartition("gid").sortWithinPartitions("gid").mapInArrow(_finish, _RESULT)
        ended = ended.unionByName(small)
        done = ended if done is None else done.unionByName(ended)
        active = split.filter("not small").select("doc_id", "text_sha256", "row", "gid", "rest", "tie")
        level, width, total = level + 1, min(width * GROWTH, MAX_WIDTH), active.count()
    if done is None:
        done = active.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "row")
    return done


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", local_rows: int = LOCAL_ROWS, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with
    the largest id stays. A null text counts as empty, and empty texts equal each
    other. Rows with a null id are rows like others: they stay only where no member has
    an id. Of rows that repeat id and text, one stays. Other columns of ``docs`` are not
    read. An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).alias("tie"), F.monotonically_increasing_id().alias("row"))
    return _marked(base, Scratch(docs.sparkSession, "exact"), local_rows, local_bytes).drop("row")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", local_rows: int = LOCAL_ROWS, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts one row, the one with the largest id.

    Rows are told apart by a number that they are written with first, so repeated and
    null ids are no hindrance. Of rows that repeat id and text the one stays whose
    columns have the largest hash, whatever the layout of the input (maps aren't hashed;
    rows equal in all the rest are in no order). Columns may have any name.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    (row,) = unused(docs.columns, "row")
    rows = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    base = rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(*hashed).alias("tie"), F.col(row).alias("row"))
    gone = _marked(base, scratch, local_rows, local_bytes).filter("not kept").select(F.col("row").alias(f"{row}_"))
    return rows.join(gone, rows[row] == gone[f"{row}_"], "left_anti").select(*(f"`{c}`" for c in docs.columns))
