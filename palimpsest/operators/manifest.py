"""Analytics over file metadata: (level, num, file_size, smallest, largest) a row per file.

Metadata is small beside the data it describes, but it grows with it: interval joins
between files are on buckets of a few ranges, not on all pairs, and nothing is broadcast
here without the optimizer's own check of its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.model import LEVEL0_FILES, LEVEL1_BYTES


def file_stats(log: DataFrame, by: list[str]) -> DataFrame:
    """What a writer records of each file: key range, sequence range, entries."""
    return log.groupBy(*by).agg(F.min("key").alias("smallest"), F.max("key").alias("largest"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.count("*").alias("entries"))


def _cells(low: Column, high: Column, width: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of files (a_num, b_num) with a common key; numeric keys.

    Ranges are cut into cells as wide as the average range. A pair meets in several cells
    but is kept only in the one where its common part begins.
    """
    width = a.unionByName(b).agg(F.greatest(F.avg(F.col("largest") - F.col("smallest")), F.lit(1.0))).first()[0] or 1.0
    x = a.select(F.col("num").alias("a_num"), F.col("smallest").alias("a_lo"), F.col("largest").alias("a_hi"), _cells(F.col("smallest"), F.col("largest"), F.lit(width)).alias("cell"))
    y = b.select(F.col("num").alias("b_num"), F.col("smallest").alias("b_lo"), F.col("largest").alias("b_hi"), _cells(F.col("smallest"), F.col("largest"), F.lit(width)).alias("cell"))
    met = x.join(y, "cell").filter("a_lo <= b_hi and b_lo <= a_hi")
    return met.filter(F.floor(F.greatest("a_lo", "b_lo") / F.lit(width)) == F.col("cell")).select("a_num", "b_num")


def covering(keys: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of ``keys`` with every file whose range holds the key; numeric keys, by cells as above."""
    width = files.agg(F.greatest(F.avg(F.col("largest") - F.col("smallest")), F.lit(1.0))).first()[0] or 1.0
    cells = files.withColumn("cell", _cells(F.col("smallest"), F.col("largest"), F.lit(width)))
    met = keys.withColumn("cell", F.floor(F.col("key") / F.lit(width))).join(cells, "cell")
    return met.filter("key between smallest and largest").drop("cell")


def lookup_order(keys: DataFrame, files: DataFrame) -> DataFrame:
    """The files a lookup of each key would open, in order: by level, the newest first."""
    order = Window.partitionBy("key").orderBy("level", F.col("num").desc())
    return covering(keys, files).withColumn("turn", F.row_number().over(order))


def apply_edit(base: DataFrame, deleted: DataFrame, added: DataFrame) -> DataFrame:
    """A version after an edit: the files that weren't deleted, and the new ones."""
    return base.join(deleted, ["level", "num"], "left_anti").unionByName(added)


def obsolete(on_disk: DataFrame, live: DataFrame) -> DataFrame:
    """Files on disk that no version needs."""
    return on_disk.join(live.select("num").distinct(), "num", "left_anti")


def missing(live: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Files a version needs that aren't on disk: the store is corrupt."""
    return live.join(on_disk.select("num").distinct(), "num", "left_anti")


def level_sizes(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))


def level_scores(files: DataFrame) -> DataFrame:
    """How full each level is: level 0 by its files, the others by bytes against a capacity that grows tenfold."""
    score = F.when(F.col("level") == 0, F.col("files") / F.lit(float(LEVEL0_FILES))).otherwise(F.col("bytes") / (F.lit(float(LEVEL1_BYTES)) * F.pow(F.lit(10.0), F.col("level") - 1)))
    return level_sizes(files).withColumn("score", score)


def fullest_level(files: DataFrame) -> DataFrame:
    return level_scores(files).agg(F.max_by("level", "score").alias("level"), F.max("score").alias("score"))


def key_range(files: DataFrame, *by: str) -> DataFrame:
    """The least and the largest key of all files, or of those that agree in ``by``."""
    return files.groupBy(*by).agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"))


def order_check(files: DataFrame) -> DataFrame:
    """Files of a level with whether each begins after the one before ends; a level's files come together in one task."""
    w = Window.partitionBy("level").orderBy("smallest", "num")
    return files.withColumn("previous", F.lag("largest").over(w)).withColumn("ok", F.coalesce(F.col("previous") < F.col("smallest"), F.lit(True)))


def cut_by_size(entries: DataFrame, size: str, limit: int, group: str, order: list[str]) -> DataFrame:
    """Numbers the blocks of each group's entries by the running sum of sizes before them."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("block", F.floor(F.coalesce(F.sum(size).over(w), F.lit(0)) / limit))


def pressure(files: DataFrame, slow: int = 8, stop: int = 12) -> DataFrame:
    """What a writer would do at this many level-0 files."""
    n = files.agg(F.count_if(F.col("level") == 0).alias("level0"))
    return n.withColumn("action", F.when(F.col("level0") >= stop, "stop").when(F.col("level0") >= slow, "slow").otherwise("go"))
