"""The data model: a log of versions (key, seq, op, value), its order and its limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELETE, PUT = 0, 1
MAX_SEQ = (1 << 56) - 1
LEVELS = 7
LEVEL0_FILES = 4  # at which level 0 has a score of 1
LEVEL1_BYTES = 10 << 20  # in analytics of small files; ten times more for each level below
FILE_BYTES = 256 << 20
SLOW_FILES, STOP_FILES = 8, 12  # of level 0, at which writers help to compact, and wait until it is done
GROUP_BYTES = 1 << 20  # of batches that are logged together
GRANDPARENT_FILES = 10  # overlap, in target file sizes, beyond which a file isn't just moved
KEYS = ["key", "seq", "op"]


class Corruption(Exception):
    """Stored data contradicts itself."""


def newest_first() -> list[Column]:
    """The order of the log: by key, then the newest version first, then puts before deletes."""
    return [F.col("key").asc(), F.col("seq").desc(), F.col("op").desc()]


def payload(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c not in KEYS]
