"""SentencePiece BPE by vectorised merge rounds.

New words of many texts lie in one flat array of symbols. Words are cut where no piece
holds the two characters that meet there, since no merge can reach over that place. In a
round every segment finds the least rank among its neighbouring pairs (a segmented
minimum) and merges all pairs that have it, the leftmost first, all segments at once; the
array is compacted, ranks are looked up again only beside a merge, and segments in which
no pair is left drop out.

Merging several pairs of a segment in one round is what the library does one by one, as
long as a merge only makes pairs of a higher rank; where one makes a lower or equal rank
with its neighbours, nothing after it is merged in that round.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.tokens import WordEncoder
from palimpsest.llm.workers import lean

_NONE = np.int64(1 << 40)
_MARK = "▁"  # stands for a blank


_USER_DEFINED = 4


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer: numbers, and the bytes of the rest."""

    def number(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (data[at] & 127) << shift
            if data[at] < 128:
                return n, at + 1
            at, shift = at + 1, shift + 7

    at = 0
    while at < len(data):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
            yield tag >> 3, value
            continue
        size, at = number(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
        yield tag >> 3, data[at : at + size]
        at += size


def _has_user_defined(model: bytes) -> bool:
    """Whether a model has pieces (field 1) of the user (type, field 3, is 4), which are matched before any merge."""
    return any((3, _USER_DEFINED) in _fields(piece) for n, piece in _fields(model) if n == 1)


class Merges:
    """The tables of a BPE model: symbols (pieces, and characters that only occur within pieces), pairs and their ranks."""

    def __init__(self, processor):
        n = processor.get_piece_size()
        normal = [i for i in range(n) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i))]
        if any(processor.is_unused(i) for i in normal):
            raise ValueError("models with unused pieces aren't supported")
        if _has_user_defined(processor.serialized_model_proto()):
            raise ValueError("models with pieces of the user aren't supported")
        piece = {processor.id_to_piece(i): i for i in normal}
        self.byte_ids = [processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = processor.unk_id()
        self.fallback = all(processor.is_byte(i) for i in self.byte_ids)
        self.symbol = dict(piece)
        for p in list(piece):
            for c in p:
                self.symbol.setdefault(c, len(self.symbol) + n)
        self.text_of = {i: s for s, i in self.symbol.items()}
        self.pieces = n
        scores = sorted({processor.get_score(i) for i in normal}, reverse=True)
        rank_of = {score: r for r, score in enumerate(scores)}  # equal scores share a rank, so that the leftmost of them goes first
        rank = {i: rank_of[processor.get_score(i)] for i in normal}
        self.size = n + len(self.symbol) + 1
        pairs = {}
        for p, i in piece.items():
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = (rank[i], i)
        # results that may make a pair of their own rank or a lower one
        lowest: dict[int, int] = {}
        for key, (r, _) in pairs.items():
            for part in divmod(key, self.size):
                lowest[part] = min(lowest.get(part, r), r)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.results = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.may_stop = np.array([lowest.get(i, int(_NONE)) <= r for r, i in zip(self.ranks.tolist(), self.results.tolist())], bool)
        self.meet = np.unique(np.array([self._bigram(a, b) for p in piece for a, b in zip(map(ord, p), map(ord, p[1:]))], np.int64))
        self.inner_mark = any(_MARK in p.lstrip(_MARK) for p in piece)
        self.lone_newline = not any("\n" in p and len(p) > 1 for p in piece)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Positions in the pair tables, -1 where there is no such pair; negative symbols have none."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), at, -1)

    def _ids(self, symbols: list[int]) -> list[int]:
        out = []
        for s in symbols:
            if 0 <= s < self.pieces:
                out.append(s)
            elif self.fallback:
                out += [self.byte_ids[b] for b in (chr(-s - 1) if s < 0 else self.text_of[s]).encode()]
            else:
                out.append(self.unknown)
        return out

    @staticmethod
    def _bigram(a, b):
        return (a << 21) | b

    def _segments(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words and the number of each one's segment."""
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        chars, at = np.unique(text, return_inverse=True)
        symbols = np.array([self.symbol.get(chr(c), -c - 1) for c in chars.tolist()], np.int64)[at] if len(chars) else text
        new = np.zeros(len(text), bool)
        new[np.cumsum([0, *map(len, words)])[:-1]] = True
        met = self._bigram(text[:-1], text[1:])
        place = np.searchsorted(self.meet, met)
        place[place == len(self.meet)] = 0
        new[1:] |= self.meet[place] != met if len(self.meet) else True
        return symbols, np.cumsum(new) - 1

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        if not all(words):
            full = iter(self.encode([w for w in words if w]))
            return [next(full) if w else [] for w in words]
        if not words:
            return []
        sym, owner = self._segments(words)
        first = owner[np.cumsum([0, *map(len, words)])[:-1]]  # each word's first segment
        segments = int(owner[-1]) + 1
        # pair[i] is the table position of symbols i and i + 1 of a segment
        pair = np.full(len(sym), -1)
        pair[:-1] = np.where(owner[:-1] == owner[1:], self.lookup(sym[:-1], sym[1:]), -1)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            rank = np.where(pair >= 0, self.ranks[pair], _NONE)
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            over = np.repeat(least == _NONE, sizes)
            if over.any():
                done.append((owner[over], sym[over]))
                sym, owner, pair, rank = sym[~over], owner[~over], pair[~over], rank[~over]
                sizes, least = sizes[least != _NONE], least[least != _NONE]
                if not len(sym):
                    break
            hit = self._together(np.flatnonzero(rank == np.repeat(least, sizes)), sym, owner, pair)
            sym[hit] = self.results[pair[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            hit = moved[hit]
            sym, owner, pair = sym[keep], owner[keep], pair[keep]
            last = len(sym) - 1
            pair[hit] = -1
            right = hit[hit < last]
            right = right[owner[right] == owner[right + 1]]
            pair[right] = self.lookup(sym[right], sym[right + 1])
            left = hit[hit > 0] - 1
            left = left[owner[left] == owner[left + 1]]
            pair[left] = self.lookup(sym[left], sym[left + 1])
        owners, symbols = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        symbols = symbols[np.argsort(owners, kind="stable")]
        ends = np.cumsum(np.bincount(owners, minlength=segments))[np.append(first[1:], segments) - 1].tolist()
        plain = bool(((symbols >= 0) & (symbols < self.pieces)).all())
        values, out, at = symbols.tolist(), [], 0
        for end in ends:
            out.append(values[at:end] if plain else self._ids(values[at:end]))
            at = end
        return out

    def _together(self, hit: np.ndarray, sym: np.ndarray, owner: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Of the pairs with their segment's least rank those that merge in one round: the leftmost of what overlaps, up to one that stops the round."""
        of = owner[hit]
        new = np.concatenate([[True], of[1:] != of[:-1]])  # a segment's first
        apart = new | np.concatenate([[True], np.diff(hit) > 1])
        run = np.maximum.accumulate(np.where(apart, np.arange(len(hit)), 0))
        kept = (np.arange(len(hit)) - run) % 2 == 0  # of neighbours that overlap every other one
        hit, new = hit[kept], new[kept]
        if new.all():
            return hit
        may = np.flatnonzero(self.may_stop[pair[hit]])
        stops = np.zeros(len(hit), bool)
        if len(may):
            at, made = hit[may], self.results[pair[hit[may]]]
            rank = self.ranks[pair[at]]
            beside = np.maximum(at - 1, 0)
            left = np.where((at > 0) & (owner[beside] == owner[at]), sym[beside], -1)
            follows = (may > 0) & (hit[may - 1] == at - 2)  # the one before has just become a symbol
            left[follows] = self.results[pair[hit[may[follows] - 1]]]
            beside = np.minimum(at + 2, len(sym) - 1)
            right = np.where((at + 2 < len(sym)) & (owner[beside] == owner[at]), sym[beside], -1)
            for a, b in ((left, made), (made, right)):
                found = self.lookup(a, b)
                stops[may] |= (found >= 0) & (self.ranks[found] <= rank)
        if not stops.any():
            return hit
        before = np.cumsum(stops) - stops
        start = np.maximum.accumulate(np.where(new, np.arange(len(hit)), 0))
        return hit[before == before[start]]


def piece_encoder(processor) -> WordEncoder:
    """Encodes texts as ``processor`` does (identity normalisation, a blank put before the text), with its end id last."""
    merges = Merges(processor)
    if processor.normalize("a ﬁ\t b ") != "▁a▁ﬁ\t▁b▁":
        raise ValueError("models that normalise texts aren't supported")
    words = re.compile(f"{_MARK}*[^{_MARK}\n]+|{_MARK}+|\n" if merges.lone_newline else f"{_MARK}*[^{_MARK}]+|{_MARK}+").findall

    def split(text: str) -> list[str]:
        text = processor.normalize(text) if text else ""
        return [text] if merges.inner_mark else words(text)

    def split_column(texts: pa.Array) -> pa.ListArray:
        """Blanks begin words, and new lines stand alone."""
        marked = pc.replace_substring(pc.binary_join_element_wise(" ", texts, ""), " ", f"\x01{_MARK}")
        return pc.split_pattern(pc.replace_substring(marked, "\n", "\x01\n\x01"), "\x01")

    plain = merges.lone_newline and not merges.inner_mark
    return WordEncoder(split, merges.encode, processor.eos_id(), f"  |^ |^$|{_MARK}|\x01" if plain else "", split_column)


_kept: dict[str, tuple] = {}


def _shared(path: str) -> tuple:
    if path not in _kept:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        _kept[path] = processor, piece_encoder(processor)
    return _kept[path]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; with ``keep_ids`` also ids and decoded.

    Ids begin and end with the model's begin and end ids; an empty or null text has these
    two alone. Decoding is the library's. Rows that repeat an id give a row each; columns
    but id and text are not read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor, encoder = _shared(model_path)
        begin = np.array([processor.bos_id()], np.uint32)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1))):
                ids = np.concatenate([begin, ids])
                listed = ids.tolist()
                text = processor.decode(listed)
                row = (doc, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                rows.append((*row, listed, text) if keep_ids else row)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: 6 if keep_ids else 4]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names[: len(types)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
