"""Personal data: expressions propose spans, checksums confirm them, context words adjust the score.

All of it is DataFrame expressions. Positions come from splitting a text at the
matches: the pieces between them and the matches themselves alternate, so running
lengths are offsets in code points. Before an expression runs, a cheaper test says
whether a text can hold a match at all.

The expressions scan in linear time and constant stack: repeated groups are
possessive, and where a run of characters could be entered at any point, a match may
begin only at the run's start or where the last match ended, which finds the same
leftmost matches.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.names import unused

BASE = ("email", "ip", "card", "phone")
CONTEXT_CHARS = 40
THRESHOLD = 0.6


def _digits(hit: Column) -> Column:
    return F.translate(hit, " -", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits ends in its Luhn check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number (upper case, no blanks) leaves 1 by mod 97 when its first four characters go last."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, F.lit(1), F.lit(4)))
    value = F.transform(F.split(turned, ""), lambda c: F.ascii(c) - F.when(c >= "A", 55).otherwise(48))
    return F.aggregate(value, F.lit(0), lambda r, v: F.when(v > 9, (r * 100 + v) % 97).otherwise((r * 10 + v) % 97)) == 1


def _card(hit: Column) -> Column:
    digits = _digits(hit)
    return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)


def _phone(hit: Column) -> Column:
    return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(10, 15)


def _ip(hit: Column) -> Column:
    return F.forall(F.split(hit, "[.]"), lambda part: part.rlike("^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))


def _iban(hit: Column) -> Column:
    code = F.replace(hit, F.lit(" "), F.lit(""))
    return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(False)


class Kind(NamedTuple):
    name: str
    may_hold: Callable[[Column], Column]
    pattern: str
    confirm: Callable[[Column], Column]
    score: float  # without context
    context: str  # words before it that raise its score by 0.3


_MAIL = "A-Za-z0-9._%+-"
KINDS = [
    Kind("email", lambda t: t.contains("@"), rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda h: F.lit(True), 0.7, "e-?mail|mail|contact|write"),
    Kind("ip", lambda t: t.rlike(r"[0-9]\.[0-9]"), r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip, 0.6, "ip|address|host|server"),
    Kind("card", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), r"[0-9](?:[\x20-]?[0-9])++", _card, 0.7, "card|visa|credit|payment|pay"),
    Kind("phone", lambda t: t.contains("+"), r"\+[0-9][\x20().0-9-]+[0-9]", _phone, 0.6, "phone|telephone|call|tel|mobile|fax"),
    # numbers that the base expressions run together with their neighbours, and then drop
    Kind("card", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,4})(?![0-9])", _card, 0.7, "card|visa|credit|payment|pay"),
    Kind("phone", lambda t: t.contains("+"), r"\+[0-9]{1,3}[ -]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])", _phone, 0.6, "phone|telephone|call|tel|mobile|fax"),
    Kind("iban", lambda t: t.rlike("[A-Z]{2}[0-9]{2}[ ]?[A-Z0-9]{4}"), r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban, 0.6, "iban|account|bank"),
    Kind("ssn", lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda h: F.lit(True), 0.3, "ssn|social"),
]


def _spans(text: Column, at: int, kind: Kind) -> Column:
    """array<struct<start, k, end, score>> of a kind's confirmed matches, in page order."""
    empty = F.expr("cast(array() as array<struct<start:int,k:int,end:int,score:double>>)")
    zero = F.struct(F.lit(0).alias("pos"), empty.alias("found"))
    steps = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        before = F.lower(F.substring(text, F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_CHARS))))
        score = F.lit(kind.score) + F.when(before.rlike(rf"\b(?:{kind.context})s?\b"), 0.3).otherwise(0.0)
        span = F.struct(start.alias("start"), F.lit(at).alias("k"), end.alias("end"), score.alias("score"))
        found = F.when(x["hit"].isNotNull() & kind.confirm(x["hit"]), F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct(F.coalesce(end, start).alias("pos"), found.alias("found"))

    return F.when(kind.may_hold(text), F.aggregate(steps, zero, step, lambda acc: acc["found"])).otherwise(empty)


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "pii", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a column ``out``: array<struct<start, k, end, score>> by start, then kind; ``k`` counts in ``KINDS``.

    Offsets are in code points, the end exclusive. The four kinds of ``BASE`` keep every
    confirmed match whatever its score; others need ``threshold``, which a social
    security number reaches with a context word only. Cards and phones that a base
    expression ran together with their neighbours are added. Context words are whole ones:
    "tel" isn't in "telling". A null text has no span.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(*(_spans(text, i, kind) for i, kind in enumerate(KINDS)))
    marked = docs.withColumn(out, F.array_sort(found))
    again = {i: BASE.index(kind.name) for i, kind in enumerate(KINDS) if i >= len(BASE) and kind.name in BASE}

    def sure(s: Column) -> Column:
        base = F.lit(None).cast("int")
        for i, k in again.items():
            base = F.when(s["k"] == i, k).otherwise(base)
        known = base.isNotNull() & F.exists(out, lambda b: (b["k"] == base) & (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return (s["k"] < len(BASE)) | ((s["score"] >= threshold) & ~known)

    return marked.withColumn(out, F.filter(out, sure))


def spans_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with spans replaced by <KIND>; of spans that overlap, the first names the whole.

    Texts without a span, null ones included, stay as they are.
    """
    (out,) = unused(docs.columns, "pii")
    marked = with_spans(docs, text_col, out, threshold)
    text = F.col(text_col)
    names = F.array(*(F.lit(f"<{k.name.upper()}>") for k in KINDS))
    zero = F.struct(F.lit(0).alias("pos"), F.expr("cast(array() as array<string>)").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        clear = s["start"] >= acc["pos"]
        gap = F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"])
        parts = F.when(clear, F.concat(acc["parts"], F.array(gap, F.get(names, s["k"])))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), parts.alias("parts"))

    masked = F.aggregate(out, zero, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["pos"] + 1, F.length(text))))
    return marked.withColumn(text_col, F.when(F.size(out) > 0, masked).otherwise(text)).drop(out)
