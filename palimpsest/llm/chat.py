"""Chat formatting: from records of many layouts to marked-up turns with a loss mask.

A record's layout is known by its schema fingerprint: the hash of its sorted nested
field paths, of which only those count that some layout names. The fingerprint selects a
declarative mapping to canonical (role, text) turns. A fingerprint that no layout has
goes to the layout that covers most of its fields, which is found once for each
fingerprint, so extra fields change nothing even if another layout names them.

Turns are written one row each, since formatting needs nothing but the turn: a
conversation's text is its rows' texts in order. Control strings inside texts and roles
are escaped, so reading back gives what went in. Reading streams each conversation in
order and keeps only running hashes, however many turns it has.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.workers import lean
from palimpsest.sources.scratch import Scratch

OPEN, CLOSE, LEARNT = "<|im_start|>", "<|im_end|>", "assistant"
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}


class Turn(NamedTuple):
    """A turn of a mapping: its role (a field if it begins with $, else the role itself) and the fields joined to its text."""

    role: str
    texts: tuple[str, ...]
    optional: bool = False  # left out where its text is empty


class Layout(NamedTuple):
    name: str
    each: str  # the list whose elements are turns; empty where the record itself has them
    turns: tuple[Turn, ...]
    order: str = ""  # in a layout of one record a turn: the field that orders them
    before: tuple[Turn, ...] = ()  # turns that the record has beside its list

    def paths(self) -> frozenset[str]:
        fields = {f for t in self.turns for f in (*t.texts, *([t.role[1:]] if t.role[0] == "$" else []))} | ({self.order} - {""})
        beside = {f for t in self.before for f in t.texts}
        return frozenset(f"{self.each}[].{f}" if self.each else f for f in fields) | beside


_SYSTEM = Turn("system", ("system",), optional=True)
_ASKS = {"instruction": ("instruction", "input"), "prompt": ("prompt",), "question": ("question",)}
_ANSWERS = {"instruction": ("output", "response"), "prompt": ("completion", "response"), "question": ("answer",)}
LAYOUTS = [
    Layout("turn_rows", "", (Turn("$role", ("text",)),), "turn"),
    *(
        Layout(f"{name}_{'_'.join(f for t in before for f in t.texts)}".rstrip("_"), each, turns, "", before)
        for name, each, turns in (("messages", "messages", (Turn("$role", ("content",)),)), ("from_value", "conversations", (Turn("$from", ("value",)),)))
        for before in ((), (_SYSTEM,), (Turn("user", ("prompt",), optional=True),), (_SYSTEM, Turn("user", ("prompt",), optional=True)))
    ),
    *(
        Layout("_".join([*(t.role for t in system), *asked, answer]), "", (*system, Turn("user", asked), Turn("assistant", (answer,))))
        for ask, fields in _ASKS.items()
        for asked in ([fields, fields[:1]] if len(fields) > 1 else [fields])
        for answer in _ANSWERS[ask]
        for system in ((), (_SYSTEM,))
    ),
]
_NAMED = frozenset(p for layout in LAYOUTS for p in layout.paths())
#: Fields without which a record isn't in a layout: that of its roles, or its question and its answer.
_NEEDED = {layout.name: frozenset(layout.paths() - {f for t in (*layout.turns, *layout.before) if t.optional for f in t.texts} - {"input"}) for layout in LAYOUTS}


def fingerprint(paths: set[str] | frozenset[str]) -> str:
    return xxhash.xxh64_hexdigest("\n".join(sorted(p for p in paths if p in _NAMED)))


BY_FINGERPRINT: dict[str, Layout | None] = {fingerprint(layout.paths()): layout for layout in LAYOUTS}
_met: dict[str, Layout | None] = {}  # other fingerprints; there are no more than subsets of the named fields, and few occur


def layout_of(paths: set[str] | frozenset[str]) -> Layout | None:
    """The layout of a record with these field paths; None where none has all it needs.

    Of several the one that covers most fields, then the one that lacks fewest, then the first in ``LAYOUTS``.
    """
    known = fingerprint(paths)
    if known in BY_FINGERPRINT:
        return BY_FINGERPRINT[known]
    if known not in _met:
        fit = [layout for layout in LAYOUTS if _NEEDED[layout.name] <= paths]
        if len(_met) > 10_000:
            _met.clear()
        _met[known] = max(fit, key=lambda layout: (len(layout.paths() & paths), -len(layout.paths() - paths)), default=None)
    return _met[known]


def record_paths(value: Any, depth: int = 2) -> set[str]:
    """Nested field paths of a parsed JSON value down to ``depth`` levels, as deep as layouts go; elements of lists are []."""
    found: set[str] = set()
    todo: list[tuple[Any, str, int]] = [(value, "", depth)]
    while todo:
        x, at, left = todo.pop()
        if at:
            found.add(at)
        if isinstance(x, dict) and left:
            todo += [(v, f"{at}.{k}" if at else k, left - 1) for k, v in x.items()]
        elif isinstance(x, list) and left:
            todo += [(v, f"{at}[]", left) for v in x if not isinstance(v, list)]
    return found


def _text(value: Any) -> str:
    """A value as text: null is empty, parts of a message are joined by lines, and what isn't text is JSON."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list) and all(isinstance(p, str) or isinstance(p, dict) and isinstance(p.get("text"), str) for p in value):
        return "\n".join(p if isinstance(p, str) else p["text"] for p in value)
    return json.dumps(value, ensure_ascii=False)


def _turns(layout: Layout, record: dict) -> Iterator[tuple[str, str]]:
    items = record[layout.each] if layout.each else [record]
    for turns, of in ((layout.before, [record]), (layout.turns, items)):
        for item in of:
            for turn in turns:
                role = _text(item.get(turn.role[1:])) if turn.role[0] == "$" else turn.role
                text = "\n\n".join(t for t in (_text(item.get(f)) for f in turn.texts) if t)
                if text or not turn.optional:
                    yield ROLES.get(role, role), text


def canonical_turns(record: Any) -> tuple[str | None, list[tuple[str, str]]]:
    """(layout name, turns) of a parsed record; no name and no turn where no layout fits.

    A list of turns fits only if every element is an object: of one that isn't, what it
    says and who says it can't be told, and a conversation isn't read in part.
    """
    layout = layout_of(record_paths(record)) if isinstance(record, dict) else None
    if layout is None or layout.each and not (isinstance(record[layout.each], list) and all(isinstance(x, dict) for x in record[layout.each])):
        return None, []
    return layout.name, list(_turns(layout, record))


def records_to_turns(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Rows (conv_id, turn, role, text, layout) of JSON records of any known layout.

    A record that is null, no JSON, nested too deeply to be read, or of an unknown layout
    gives one row without turn, role, text and layout, so none is lost and none stops the
    others.
    """

    @lean
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    name, turns = canonical_turns(json.loads(raw)) if raw else (None, [])
                except (ValueError, RecursionError):
                    name, turns = None, []
                rows += [(key, i, role, text, name) for i, (role, text) in enumerate(turns)] or [(key, None, None, None, None)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", "turn", "role", "text", "layout"])

    return records.select(F.col(id_col).cast("long").alias("conv_id"), F.col(json_col).alias("raw")).mapInArrow(convert, "conv_id long, turn long, role string, text string, layout string")


def rows_to_turns(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Rows (conv_id, turn, role, text) of a table that has a row for each turn; the schema's fingerprint selects the mapping.

    A table is in such a layout if it has its fields, whatever others it has beside them.
    """
    named = {f.name for f in rows.schema.fields}
    layout = layout_of(named)
    if layout is None or not layout.order:
        layout = next((x for x in LAYOUTS if x.order and x.paths() <= named), None)
    if layout is None:
        raise ValueError(f"no layout of one row a turn has the fields {sorted(rows.columns)}")
    turn = layout.turns[0]
    return rows.select(F.col(id_col).cast("long").alias("conv_id"), F.col(layout.order).cast("long").alias("turn"), F.coalesce(F.col(turn.role[1:]), F.lit("")).alias("role"), F.coalesce(F.col(turn.texts[0]), F.lit("")).alias("text"))


_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """``text`` without control strings: a backslash goes before each backslash and into each ``<|``."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role) if "\\" in role else role


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The marked-up turn and the span of its text under the loss mask (empty where nothing is learnt)."""
    head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
    end = len(head) + len(body) if role == LEARNT else len(head)
    return f"{head}{body}{CLOSE}\n", len(head), end


def parse_turn(formatted: str) -> tuple[str, str]:
    head, body = formatted.removeprefix(OPEN).split("\n", 1)
    return unescape_role(head), unescape(body.removesuffix(f"{CLOSE}\n"))


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, formatted, loss_start, loss_end) of each turn; offsets are code points within ``formatted``."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [format_turn(r or "", t or "") for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            marked = [pa.array([d[i] for d in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *marked], ["conv_id", "turn", "formatted", "loss_start", "loss_end"])

    return turns.select("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, turn long, formatted string, loss_start long, loss_end long")


class _Digest:
    def __init__(self, conv: int | None):
        self.conv, self.turns, self.chars, self.loss_chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int, end: int) -> None:
        role, text = parse_turn(formatted)
        learnt = unescape(formatted[start:end])
        self.turns, self.chars, self.loss_chars = self.turns + 1, self.chars + len(formatted), self.loss_chars + len(learnt)
        self.all.update(f"{role}\n{text}\n".encode())
        self.loss.update(learnt.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digest(formatted: DataFrame) -> DataFrame:
    """What formatted turns hold, a row for each conversation; turns by number, equal or null numbers by their text."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now: _Digest | None = None
        for batch in batches:
            rows = []
            for conv, text, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv != conv:
                    rows += [now.row()] if now else []
                    now = _Digest(conv)
                now.add(text, start, end)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
        rows = [now.row()] if now else []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").select("conv_id", "formatted", "loss_start", "loss_end")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted_and_read(rows: DataFrame) -> DataFrame:
    """Formats a table of turns, writes it to the shared folder and reads it back: a row for each conversation.

    Null roles and texts are empty. Turns without a number come first; turns that share
    one are in order of what they say; repeated rows are turns of their own. Rows without
    a conversation are one conversation. Other columns are not read.
    """
    scratch = Scratch(rows.sparkSession, "chat")
    return digest(scratch.keep(format_turns(rows_to_turns(rows)), "formatted"))
