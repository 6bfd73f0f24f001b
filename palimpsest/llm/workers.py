"""Bounded memory in Python workers that live from task to task."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

ROWS, BYTES = 1000, 8 << 20


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS, limit: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a bounded number and, but for single rows beyond it, of bounded bytes, so that what is made of a batch stays small."""
    for batch in batches:
        todo = [batch.slice(at, rows) for at in range(0, max(1, batch.num_rows), rows)][::-1]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > limit:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def give_back() -> None:
    """Returns freed memory to the system; allocators keep it otherwise, beside the next task's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gets its rows in slices and gives memory back at its end."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(slices(batches))
        finally:
            give_back()

    return run
