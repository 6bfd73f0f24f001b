"""Intermediate tables in the shared folder that the cluster names.

A long job cuts its lineage by writing a step as Parquet where every executor
can read it again, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset and Spark runs in one process, a temporary one."""
    named = spark.conf.get(_CONF, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"{_CONF} isn't set: tables between steps need a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="palimpsest-"))
    return _own[0]


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_collectors: list[list[Scratch]] = []


@contextlib.contextmanager
def collecting(made: list[Scratch]) -> Iterator[None]:
    """What is made within is listed in ``made``, so that ``release`` can delete it once its readers are done."""
    _collectors.append(made)
    try:
        yield
    finally:
        _collectors.remove(made)


@contextlib.contextmanager
def lifetime() -> Iterator[None]:
    """Deletes at its end the tables made within; frames over them must have been read or written by then."""
    made: list[Scratch] = []
    try:
        with collecting(made):
            yield
    finally:
        release(made)


def release(made: list[Scratch], reader: DataFrame | None = None) -> None:
    """Deletes the tables of ``made``, but for those that ``reader`` still reads, and takes them off the list."""
    files = reader.inputFiles() if reader is not None and made else []
    for scratch in [s for s in made if not any(s.name in f for f in files)]:
        scratch.delete()
        made.remove(scratch)


class Scratch:
    """Numbered Parquet tables under one unique folder.

    ``keep`` writes a frame and returns it reread, ``drop`` deletes a table that
    nothing reads any more. What is left goes at the end of a ``lifetime`` or, since a
    returned frame still reads it, when the driver's Python exits.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, f"{name}-{uuid.uuid4().hex}"
        self.path = f"{shared_dir(spark)}/{self.name}"
        for made in _collectors:
            made.append(self)
        atexit.register(self.delete)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.path}/{name}")

    def sweep(self) -> None:
        """Frees the disk of shuffles whose results have been kept: Spark does so once its driver's heap is collected."""
        gc.collect()
        self.spark._jvm.System.gc()

    def delete(self) -> None:
        atexit.unregister(self.delete)
        try:
            if self.spark.sparkContext._jsc is not None:
                delete(self.spark, self.path)
        except Exception:  # the session or its JVM is gone, and with it the means to delete
            pass
