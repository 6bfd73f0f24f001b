"""Packing token sequences by bounded-space online best-fit.

Each partition keeps a fixed number of open windows. A document's full windows go out
at once; the rest goes to the window where it fits best. Where none fits, the fullest is
topped up with the beginning of the document (unless its gap is under ``MIN_PIECE``) and
emitted, and the rest tries again. What is still open at the end of the partitions is
merged, by groups of partitions, then groups of groups, until one is left. Memory is the
open windows; nothing is shuffled but what is merged.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.tokens import shared
from palimpsest.llm.workers import lean
from palimpsest.sources.scratch import Scratch

LENGTH, OPEN_WINDOWS, MIN_PIECE, FAN_IN, FULL = 1024, 64, 8, 64, 0.95
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, is_open boolean"
_NAMES = [c.split()[0] for c in _PIECE.split(", ")]


class Windows:
    """The open windows of one partition and the pieces in them."""

    def __init__(self, length: int = LENGTH, count: int = OPEN_WINDOWS, min_piece: int = MIN_PIECE, first_id: int = 0):
        self.length, self.count, self.min_piece, self.next_id = length, count, min_piece, first_id
        self.open: list[tuple[int, int]] = []  # (free, sequence_id), sorted
        self.held: dict[int, list] = {}  # by sequence_id

    def _fresh(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, n: int) -> Iterator[tuple[int, int, int, int, bool]]:
        """(start, length, sequence_id, offset, whether that closes the window) of a document of n tokens."""
        at = 0
        while at < n:
            rest = n - at
            if rest >= self.length:
                yield at, self.length, self._fresh(), 0, True
                at += self.length
                continue
            i = bisect_left(self.open, (rest, -1))
            if i < len(self.open):
                free, sequence = self.open.pop(i)
            elif len(self.open) < self.count:
                free, sequence = self.length, self._fresh()
            else:
                free, sequence = self.open.pop(0)  # the fullest goes out
                top_up = free if free >= self.min_piece else 0
                yield at, top_up, sequence, self.length - free, True
                at += top_up
                continue
            yield at, rest, sequence, self.length - free, free == rest
            if free > rest:
                insort(self.open, (free - rest, sequence))
            return


def merged(frame: pd.DataFrame, length: int) -> pd.DataFrame:
    """Pieces of open windows in as few windows as best-fit by decreasing length needs; ids are those of windows they come from."""
    ids = sorted(frame["sequence_id"].unique().tolist())
    new = frame.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True], ignore_index=True)
    spaces: list[tuple[int, int]] = []
    window, offset, used = [], [], 0
    for n in new["length"].tolist():
        i = bisect_left(spaces, (n, -1))
        if i < len(spaces):
            free, w = spaces.pop(i)
        else:
            free, w, used = length, used, used + 1
        window.append(w)
        offset.append(length - free)
        if free > n:
            insort(spaces, (free - n, w))
    return new.assign(sequence_id=[ids[w] for w in window], offset=offset) if used <= len(ids) else frame


def _merger(length: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        new = merged(frame, length)
        filled = new.groupby("sequence_id")["length"].transform("sum")
        return new.assign(is_open=False if last else filled < FULL * length)[_NAMES]

    return merge


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, length: int = LENGTH, windows: int = OPEN_WINDOWS, min_piece: int = MIN_PIECE, id_col: str = "doc_id", text_col: str = "text", control: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Rows that repeat an id are documents of
    their own, and so are rows with a null one. Each token lies in one piece; a sequence's
    pieces follow each other without gap from offset 0. With ``control`` a control token's
    string in a text is that token, as in the library's plain call; without, it is text.
    Columns but id and text are not read. An empty table gives no piece.
    """
    scratch = Scratch(docs.sparkSession, "packing")

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.bool_() if c == "is_open" else pa.int64()) for i, c in enumerate(_NAMES)], _NAMES)

    @lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(tokenizer_path, end_id, control)
        space = Windows(length, windows, min_piece, TaskContext.get().partitionId() << 40)
        held = space.held
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1))):
                data = ids.astype("<u4").tobytes()
                for at, n, sequence, offset, closes in space.place(len(ids)):
                    pieces = held.setdefault(sequence, [])
                    if n:
                        pieces.append((doc, at, n, zlib.crc32(data[4 * at : 4 * (at + n)]), len(ids), sequence, offset, False))
                    if closes:
                        rows += held.pop(sequence)
            yield table(rows)
        yield table([(*row[:-1], True) for pieces in held.values() for row in pieces])

    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(place, _PIECE)
    pieces = scratch.keep(pieces, "pieces")
    done, todo = pieces.filter("not is_open"), pieces.filter("is_open")
    parts = (todo.agg(F.max(F.shiftright("sequence_id", 40))).first()[0] or 0) + 1
    span = 1
    while True:
        span *= FAN_IN
        last = span >= parts

        group = F.floor(F.shiftright("sequence_id", 40) / span)
        todo = scratch.keep(todo.groupBy(group).applyInPandas(_merger(length, last), _PIECE), f"merged{span}")
        done = done.unionByName(todo.filter("not is_open"))
        if last:
            return done.drop("is_open")
        todo = todo.filter("is_open")
