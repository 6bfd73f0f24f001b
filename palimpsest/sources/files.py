"""Small files of a store (manifests, pointers, locks, write-ahead logs) on any Hadoop file system."""

from __future__ import annotations

import re
import time
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def uri(self, name: str) -> str:
        return str(self._path(name).toString())

    def make(self, name: str = "") -> None:
        self.fs.mkdirs(self._path(name))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def size(self, name: str) -> int:
        return int(self.fs.getContentSummary(self._path(name)).getLength())

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, text: str, overwrite: bool = True) -> None:
        """Without ``overwrite`` this fails if the file exists, in one step."""
        out = self.fs.create(self._path(name), overwrite)
        try:
            out.write(bytearray(text.encode()))
            if hasattr(out, "hsync"):
                out.hsync()
        finally:
            out.close()

    def replace(self, name: str, text: str) -> None:
        """The file has the old text or the new one, never part of it."""
        self.write(f"{name}.dbtmp", text)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context.rename(self._path(f"{name}.dbtmp"), self._path(name), options)

    def rename(self, name: str, to: str) -> bool:
        """Whether it was there to be renamed."""
        try:
            return bool(self.fs.rename(self._path(name), self._path(to)))
        except Py4JJavaError:
            return False

    def age(self, name: str) -> float | None:
        """Seconds since a file was last written; None if it isn't there."""
        try:
            return time.time() - self.fs.getFileStatus(self._path(name)).getModificationTime() / 1000
        except Py4JJavaError:
            return None

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class FileName(NamedTuple):
    kind: str  # log, table, values, temp, manifest, current, lock, info, old_info
    number: int | None = None


_NUMBERED = {"log": "log", "sst": "table", "ldb": "table", "dbtmp": "temp", "v_sst": "values"}
_ENDINGS = {"log": "log", "table": "sst", "temp": "dbtmp", "values": "v_sst"}


def name_of(kind: str, number: int | None = None) -> str:
    if kind == "manifest":
        return f"MANIFEST-{number:06d}"
    if kind in ("info", "old_info"):
        return "LOG" if kind == "info" else "LOG.old"
    ending = _ENDINGS.get(kind)
    return f"{number:06d}.{ending}" if ending else kind.upper()


def parse_name(name: str) -> FileName | None:
    """What a file of a store is; None for a stranger. Numbers are decimal, zeros before them or not."""
    if name in ("CURRENT", "LOCK"):
        return FileName(name.lower())
    if m := re.fullmatch(r"MANIFEST-(\d+)", name):
        return FileName("manifest", int(m[1]))
    if name in ("LOG", "LOG.old"):
        return FileName("info" if name == "LOG" else "old_info")
    if m := re.fullmatch(r"(\d+)\.(log|sst|ldb|dbtmp|v_sst)", name):
        return FileName(_NUMBERED[m[2]], int(m[1]))
    return FileName("temp") if name.endswith(".dbtmp") else None
