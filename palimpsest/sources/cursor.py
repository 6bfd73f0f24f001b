"""A cursor over ordered rows that are read page by page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row

from palimpsest.operators.batch import as_bytes


class Cursor:
    """Stands at a live key or at none. A step within the page costs nothing; one beyond it reads the next page.

    ``scan(low=, high=, reverse=, limit=)`` gives rows (key, seq, value) with low <= key <
    high in order; the driver holds one page.
    """

    def __init__(self, scan: Callable[..., DataFrame], page: int):
        self._scan, self._page = scan, page
        self._rows: list[Row] = []
        self._at = -1

    def _load(self, low: bytes | None, high: bytes | None, reverse: bool) -> bool:
        rows = self._scan(low=low, high=high, reverse=reverse, limit=self._page).collect()
        self._rows = rows[::-1] if reverse else rows
        self._at = (len(rows) - 1 if reverse else 0) if rows else -1
        return self.valid

    @property
    def valid(self) -> bool:
        return 0 <= self._at < len(self._rows)

    @property
    def key(self) -> bytes:
        return bytes(self._row["key"])

    @property
    def value(self) -> bytes:
        return bytes(self._row["value"])

    @property
    def _row(self) -> Row:
        if not self.valid:
            raise LookupError("the cursor stands at no key")
        return self._rows[self._at]

    def seek_to_first(self) -> bool:
        return self._load(None, None, False)

    def seek_to_last(self) -> bool:
        return self._load(None, None, True)

    def seek(self, key: bytes | str) -> bool:
        """To the first key that isn't less; each move tells whether the cursor stands at a key after it."""
        return self._load(as_bytes(key), None, False)

    def next(self) -> bool:
        if self._at + 1 < len(self._rows):
            self._at += 1
            return True
        return self._load(self.key + b"\x00", None, False)  # the least key that is greater

    def prev(self) -> bool:
        if self._at > 0:
            self._at -= 1
            return True
        return self._load(None, self.key, True)
