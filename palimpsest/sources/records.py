"""Records of a write-ahead log: a line each, with a checksum before what it says."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

from palimpsest.functions.codec import crc32c_bytes
from palimpsest.model import Corruption
from palimpsest.operators.batch import Op


def _sum(text: str) -> str:
    return f"{int(crc32c_bytes([text.encode()])[0]):08x}"


def encode(seq: int, ops: list[Op]) -> str:
    """A batch whose operations have the numbers from ``seq`` on."""
    say = lambda b: None if b is None else base64.b64encode(b).decode()
    text = json.dumps({"seq": seq, "ops": [(o.op, say(o.key), say(o.value)) for o in ops]})
    return f"{_sum(text)} {text}\n"


def _decode(line: str) -> tuple[int, list[Op]]:
    sum_, _, text = line.partition(" ")
    if sum_ != _sum(text):
        raise ValueError("checksum differs")
    record = json.loads(text)
    return record["seq"], [Op(o, base64.b64decode(k), None if v is None else base64.b64decode(v)) for o, k, v in record["ops"]]


def read(log: str, name: str, offset: int = 0) -> Iterator[tuple[int, list[Op]]]:
    """(first sequence number, operations) of the records that begin at ``offset`` or after it.

    The last record may be cut off: it was never committed. Damage before it is corruption.
    """
    at = 0
    while at < len(log):
        stop = log.find("\n", at)
        whole = stop >= 0
        line, begin = log[at : stop if whole else len(log)], at
        at = stop + 1 if whole else len(log)
        if not line or begin < offset:
            continue
        try:
            yield _decode(line)
        except (ValueError, KeyError, TypeError) as e:
            if at < len(log):
                raise Corruption(f"{name} is damaged at {begin}") from e
            return
