"""The encodings of versions and files, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tag(seq: Column, op: Column) -> Column:
    """A sequence number and an operation in one long; later versions have larger tags."""
    return F.shiftleft(seq.cast("long"), 8).bitwiseOR(op.cast("long"))


def seq_of(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 8)


def op_of(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(255).cast("long")).cast("int")


def varint_length(x: Column) -> Column:
    """Bytes that a non-negative long takes as a varint."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(x)) / 7)).cast("int")


def _byte(x: Column) -> Column:
    return F.lpad(F.hex(x), 2, "0")


def varint(x: Column) -> Column:
    """A non-negative long as a varint: seven bits a byte, the lowest first."""
    n = varint_length(x)
    byte = F.transform(F.sequence(F.lit(0), n - 1), lambda i: _byte(F.call_function("shiftrightunsigned", x, 7 * i).bitwiseAND(F.lit(127)) + F.when(i < n - 1, 128).otherwise(0)))
    return F.unhex(F.array_join(byte, ""))


def read_varint(data: Column) -> Column:
    """The number that a binary column begins with as a varint."""
    byte = F.transform(F.sequence(F.lit(1), F.least(F.octet_length(data), F.lit(10))), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
    first_end = F.array_position(F.transform(byte, lambda b: b < 128), True).cast("int")
    return F.aggregate(F.slice(F.transform(byte, lambda b, i: F.call_function("shiftleft", b.bitwiseAND(F.lit(127).cast("long")), 7 * i)), F.lit(1), first_end), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def fixed(x: Column, width: int) -> Column:
    """A number as ``width`` little-endian bytes."""
    digits = F.substring(F.lpad(F.hex(x.cast("long")), 16, "0"), 17 - 2 * width, 2 * width)
    return F.unhex(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in range(width - 1, -1, -1))))


def read_fixed(data: Column, width: int) -> Column:
    """The unsigned number that ``width`` little-endian bytes hold (64 bits as a signed long)."""
    hexed = F.hex(data)
    turned = F.concat(*(F.substring(hexed, 2 * i + 1, 2) for i in range(width - 1, -1, -1)))
    high, low = F.conv(F.substring(F.lpad(turned, 16, "0"), 1, 8), 16, 10).cast("long"), F.conv(F.substring(F.lpad(turned, 16, "0"), 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def length_prefixed(data: Column) -> Column:
    """Bytes after their number as a varint."""
    return F.concat(varint(F.octet_length(data).cast("long")), data.cast("binary"))


def shared_prefix(a: Column, b: Column) -> Column:
    """Bytes that two keys begin with in common; 0 where one is null."""
    x, y = F.hex(a.cast("binary")), F.hex(b.cast("binary"))
    n = F.least(F.length(x), F.length(y)) / 2
    differs = F.filter(F.sequence(F.lit(0), n.cast("int")), lambda i: (i == n) | (F.substring(x, 2 * i + 1, F.lit(2)) != F.substring(y, 2 * i + 1, F.lit(2))))
    return F.coalesce(F.array_min(differs), F.lit(0))


def shortest_separator(a: Column, b: Column) -> Column:
    """A short key s with a <= s < b, for an index between two blocks; a itself where none shorter than it is found."""
    x, n = F.hex(a.cast("binary")), shared_prefix(a, b)
    at = [F.conv(F.substring(F.hex(k.cast("binary")), 2 * n + 1, F.lit(2)), 16, 10).cast("int") for k in (a, b)]
    differs = (n < F.least(F.octet_length(a), F.octet_length(b))) & (at[0] + 1 < at[1])
    return F.when(differs, F.unhex(F.concat(F.substring(x, F.lit(1), 2 * n), _byte(at[0] + 1)))).otherwise(a.cast("binary"))


def _crc32c_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)
    return t


_TABLE = _crc32c_table()


def crc32c_bytes(values: list[bytes]) -> np.ndarray:
    """Castagnoli checksums, byte position by byte position over all values at once."""
    lens = np.fromiter(map(len, values), np.int64, len(values))
    order = np.argsort(-lens, kind="stable")
    flat, starts = np.frombuffer(b"".join(values), np.uint8), np.cumsum(lens) - lens
    crc, live = np.full(len(values), 0xFFFFFFFF, np.uint32), len(values)
    lens_, starts_ = lens[order], starts[order]
    for i in range(int(lens.max(initial=0))):
        live = int(np.searchsorted(-lens_[:live], -i, "left"))
        c = crc[:live]
        crc[:live] = _TABLE[(c ^ flat[starts_[:live] + i]) & 0xFF] ^ (c >> 8)
    out = np.empty_like(crc)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


@F.pandas_udf(T.LongType())
def crc32c(data: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """CRC-32C of a binary column, for which Spark has no function; null stays null."""
    for series in data:
        got = pd.Series(crc32c_bytes([x or b"" for x in series]).astype("int64"), index=series.index).astype("Int64")
        yield got.where(series.notna(), None)
