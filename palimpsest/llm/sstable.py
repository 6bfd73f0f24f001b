"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of identifier:

    data blocks    entries: varint shared, varint rest, varint bytes; key rest; token ids
                   (keys are prefix-compressed, in full again at each block's start)
    block index    per block: varint length of its last key, the key, then little-endian
                   offset u64, size u32, entries u32, tokens before it in the shard u64
    Bloom filter   over identifiers, ten bits each, seven probes by double hashing
    footer         offsets and sizes of index and filter, documents, tokens, id width, magic

A key is the identifier as eight bytes that sort as the numbers do, or empty for null.
Looking one up asks the filter, then searches the index, then reads one block (and the
blocks after it while they begin with the same key).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.tokens import largest_id, shared
from palimpsest.llm.workers import lean
from palimpsest.sources.scratch import Scratch

MAGIC, BLOCK_BYTES, BITS_PER_KEY, PROBES, SHARD_ROWS = b"PLMPSST2", 1 << 16, 10, 7, 1 << 20
_FOOTER = struct.Struct("<QIQIQQB7x8s")
_ENTRY = struct.Struct("<QIIQ")


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            return n, at


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, a row for each probe; half the hash leaves room for the steps."""
    base, step = hashes >> np.uint64(1), (hashes >> np.uint64(33)) | np.uint64(1)
    return np.stack([(base + np.uint64(i) * step) % np.uint64(bits) for i in range(PROBES)]).astype(np.int64)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a Hadoop address and the path in it; S3 has other names for Arrow."""
    scheme, colon, rest = uri.partition(":")
    return pafs.FileSystem.from_uri(f"s3:{rest}" if colon and scheme in ("s3a", "s3n") else uri)


class Writer:
    """Writes entries that come in key order; block by block, so memory is a block, the index and eight bytes for each different key."""

    def __init__(self, out, width: int):
        self.out, self.width, self.dtype, self.top = out, width, "<u2" if width == 2 else "<u4", (1 << 8 * width) - 1
        self.block, self.entries, self.last = bytearray(), 0, b""
        self.index, self.hashes = bytearray(), array("Q")
        self.offset = self.docs = self.tokens = self.tokens_before = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) > self.top:
            raise ValueError(f"id {int(ids.max())} doesn't fit in {self.width} bytes")
        key, value = key_of(doc_id), ids.astype(self.dtype).tobytes()
        shared = 0
        if self.entries:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if not self.docs or key != self.last:
            self.hashes.append(xxhash.xxh64_intdigest(key))
        self.last, self.entries, self.docs, self.tokens = key, self.entries + 1, self.docs + 1, self.tokens + len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._cut()

    def _cut(self) -> None:
        if self.entries:
            self.index += _varint(len(self.last)) + self.last + _ENTRY.pack(self.offset, len(self.block), self.entries, self.tokens_before)
            self.out.write(bytes(self.block))
            self.offset += len(self.block)
            self.block, self.entries, self.tokens_before = bytearray(), 0, self.tokens

    def close(self) -> None:
        self._cut()
        bits = max(64, len(self.hashes) * BITS_PER_KEY)
        bloom = np.zeros((bits + 7) // 8 * 8, np.uint8)
        hashes = np.frombuffer(self.hashes, np.uint64)
        for at in range(0, len(hashes), 1 << 16):
            bloom[_probes(hashes[at : at + (1 << 16)], bits).ravel()] = 1
        packed = struct.pack("<Q", bits) + np.packbits(bloom).tobytes()
        self.out.write(bytes(self.index) + packed)
        at = self.offset + len(self.index)
        self.out.write(_FOOTER.pack(self.offset, len(self.index), at, len(packed), self.docs, self.tokens, self.width, MAGIC))


class Table:
    """Reads a shard: whole by ``scan``, one document by ``get``."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        at, n, bloom_at, bloom_n, self.docs, self.tokens, width, magic = _FOOTER.unpack(file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.dtype = "<u2" if width == 2 else "<u4"
        self.keys: list[bytes] = []
        self.blocks: list[tuple[int, int, int, int]] = []
        index, i = file.read_at(n, at), 0
        while i < n:
            k, i = _read_varint(index, i)
            self.keys.append(index[i : i + k])
            self.blocks.append(_ENTRY.unpack_from(index, i + k))
            i += k + _ENTRY.size
        bloom = file.read_at(bloom_n, bloom_at)
        self.bits, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]

    def _block(self, b: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        offset, size, entries, start = self.blocks[b]
        data, at, key = self.file.read_at(size, offset), 0, b""
        for _ in range(entries):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            ids = np.frombuffer(data[at + rest : at + rest + n], self.dtype)
            at += rest + n
            yield key, start, ids
            start += len(ids)

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, tokens before it in the shard, ids)."""
        for b in range(len(self.blocks)):
            for key, start, ids in self._block(b):
                yield id_of(key), start, ids

    def may_hold(self, key: bytes) -> bool:
        at = _probes(np.array([xxhash.xxh64_intdigest(key)], np.uint64), self.bits).ravel().tolist()
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in at)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier."""
        key, found = key_of(doc_id), []
        if self.may_hold(key):
            for b in range(bisect_left(self.keys, key), len(self.blocks)):
                entries = list(self._block(b))
                found += [ids for k, _, ids in entries if k == key]
                if entries[-1][0] > key:
                    break
        return found


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", control: bool = True) -> DataFrame:
    """Encodes documents and writes a shard for each range of identifiers; (shard, path, docs, tokens, start), a row each.

    Rows are range-partitioned by identifier into as many shards as shuffles have
    partitions, or more where a shard would have over ``SHARD_ROWS`` rows. A task writes under a name of its own and reports it, so of attempts that
    are repeated or lost only the one that counts is listed. ``start`` is the tokens of all
    shards before it, summed on the driver over one row per shard. Ids take two bytes where
    the vocabulary's largest one fits, else four.
    """
    spark = docs.sparkSession
    width = 2 if max(largest_id(tokenizer_path), end_id) < 1 << 16 else 4
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // SHARD_ROWS))

    @lean
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(tokenizer_path, end_id, control)
        shard = TaskContext.get().partitionId()
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{shard:06d}-{uuid.uuid4().hex}.sst"
        with fs.open_output_stream(f"{root}/{name}") as out:
            writer = Writer(out, width)
            for batch in batches:
                for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1))):
                    writer.add(doc, ids)
            writer.close()
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{folder}/{name}", "docs": writer.docs, "tokens": writer.tokens}], pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows = sorted(ordered.mapInArrow(write, "shard long, path string, docs long, tokens long").collect())
    start, out = 0, []
    for row in rows:
        out.append((row["shard"], row["path"], row["docs"], row["tokens"], start))
        start += row["tokens"]
    return spark.createDataFrame(out, "shard long, path string, docs long, tokens long, start long")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards."""

    @lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, name = file_system(path)
                with fs.open_input_file(name) as file:
                    rows = []
                    for doc, start, ids in Table(file).scan():
                        rows.append((doc, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    n = max(1, manifest.count())
    each = manifest.repartitionByRange(n, "shard").select("path", "start")
    return each.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def written_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes shards to the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text is the end id alone. Documents without an id come first; rows
    that repeat an id follow each other by text. A control token's string in a text is that
    token, as in the library's plain call. Columns but id and text are not read. An empty
    table makes empty shards.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    return read_shards(write_shards(docs, f"{scratch.path}/sst", tokenizer_path, end_id))
