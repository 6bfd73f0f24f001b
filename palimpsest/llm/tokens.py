"""Encoding whole texts by words that recur.

A tokenizer's pre-tokens never reach over a certain kind of boundary, so a text's ids
are those of its parts. Parts that were seen before come from a table in each Python
worker; only new ones go through the library. The table is emptied when it holds too
many words or bytes, and long parts are never kept in it. Which boundaries hold is read
from the tokenizer's file; a file of an unknown kind encodes whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_WORDS, CACHED_BYTES, KEPT_BYTES, BATCH_BYTES = 500_000, 32 << 20, 1024, 4_000_000


class _Index(dict):
    """Numbers words in the order they are met and lists the new ones."""

    def __init__(self) -> None:
        self.new: list = []

    def __missing__(self, word):
        self.new.append(word)
        n = self[word] = len(self)
        return n


class WordEncoder:
    """Encodes texts by words, of which ``encode`` finds the ids one by one; ``end`` is appended to each text.

    Texts of which ``slow`` (a pattern) finds nothing are split by ``split_column``, which
    works on Arrow columns; the others by ``split``. Words of a batch are counted out by
    Arrow before each different one is looked up. Texts of which ``alone`` finds something
    go through ``whole`` as they are.
    """

    def __init__(
        self,
        split: Callable[[str], list[str]],
        encode: Callable[[list[str]], list[list[int]]],
        end: int,
        slow: str,
        split_column: Callable[[pa.Array], pa.ListArray],
        limit: int = CACHED_WORDS,
        alone: str = "",
        whole: Callable[[str], list[int]] | None = None,
    ):
        self.split, self.encode_words, self.end, self.slow, self.split_column, self.limit = split, encode, end, slow, split_column, limit
        self.alone, self.whole = alone, whole
        self._clear()

    def _clear(self) -> None:
        self.index, self.bytes = _Index(), 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lens = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _learn(self) -> None:
        new, self.index.new = self.index.new, []
        if not new:
            return
        ids = self.encode_words(new)
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        at, need = len(self.index) - len(new), int(lens.sum())
        if self.used + need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need, len(self.flat)), np.uint32)])
        while len(self.index) > len(self.lens):
            self.starts, self.lens = np.concatenate([self.starts, self.starts]), np.concatenate([self.lens, self.lens])
        self.flat[self.used : self.used + need] = np.fromiter(chain.from_iterable(ids), np.uint32, need)
        self.starts[at : at + len(new)] = self.used + np.cumsum(lens) - lens
        self.lens[at : at + len(new)] = lens
        self.used += need
        self.bytes += sum(map(len, new)) + 4 * need

    def _number(self, words: pa.Array) -> tuple[np.ndarray, Callable[[], None]]:
        """The table's numbers of different words, and what forgets the long ones, which have the last numbers."""
        long = pc.greater(pc.binary_length(words), KEPT_BYTES).to_numpy(zero_copy_only=False)
        listed, at = words.to_pylist(), np.zeros(len(words), np.int64)
        if not long.any():
            at[:] = np.fromiter(map(self.index.__getitem__, listed), np.int64, len(listed))
            self._learn()
            return at, lambda: None
        big = [w for w, is_long in zip(listed, long.tolist()) if is_long]
        short = [w for w, is_long in zip(listed, long.tolist()) if not is_long]
        at[~long] = np.fromiter(map(self.index.__getitem__, short), np.int64, len(short))
        self._learn()
        used, held = self.used, self.bytes
        at[long] = np.fromiter(map(self.index.__getitem__, big), np.int64, len(big))
        self._learn()

        def forget() -> None:
            for w in big:
                del self.index[w]
            self.used, self.bytes = used, held
            if len(self.flat) > CACHED_BYTES:
                self._clear()

        return at, forget

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers, the end id last; null is an empty text."""
        if len(self.index) > self.limit or self.bytes > CACHED_BYTES:
            self._clear()
        texts = pc.fill_null(texts, "")
        last = np.array([self.end], np.uint32)
        out: list[np.ndarray] = [last] * len(texts)
        rest = np.arange(len(texts))
        if self.whole is not None:
            alone = pc.match_substring_regex(texts, self.alone).to_numpy(zero_copy_only=False)
            for doc in np.flatnonzero(alone).tolist():
                out[doc] = np.concatenate([np.array(self.whole(texts[doc].as_py()), np.uint32), last])
            if alone.any():
                rest, texts = rest[~alone], texts.filter(pa.array(~alone))
        slow = pc.match_substring_regex(texts, self.slow).to_numpy(zero_copy_only=False)
        order = rest[np.concatenate([np.flatnonzero(~slow), np.flatnonzero(slow)])]
        lists = self.split_column(texts.filter(pa.array(~slow)))
        by_hand = [self.split(t) for t in texts.filter(pa.array(slow)).to_pylist()]
        counts = np.concatenate([pc.list_value_length(lists).to_numpy(zero_copy_only=False), np.array([len(w) for w in by_hand], np.int64)]).astype(np.int64)
        words = pa.chunked_array([lists.flatten(), pa.array([w for ws in by_hand for w in ws], pa.string())]).combine_chunks().dictionary_encode()
        numbers, forget = self._number(words.dictionary)
        at = numbers[words.indices.to_numpy(zero_copy_only=False)]
        lens = self.lens[at]
        upto = np.concatenate([[0], np.cumsum(lens)])
        ids = self.flat[np.repeat(self.starts[at] - upto[:-1], lens) + np.arange(upto[-1])]
        forget()
        begin = 0
        for doc, end in zip(order.tolist(), upto[np.cumsum(counts)].tolist()):
            out[doc] = np.concatenate([ids[begin:end], last])
            begin = end
        return out

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """``encode`` over slices of a bounded number of bytes."""
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < len(texts):
            end = int(np.searchsorted(size, (size[begin - 1] if begin else 0) + BATCH_BYTES)) + 1
            yield from self.encode(texts.slice(begin, end - begin))
            begin = end


def _tokenizer(path: str, control: bool):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not control
    return tokenizer


def _any_of(strings: list[str]) -> str:
    """A pattern that finds any of the strings in any case; with none, one that finds nothing."""
    return "(?i)" + "|".join(re.sub(r"([^\w])", lambda m: f"\\x{{{ord(m[1]):x}}}", s) for s in strings) if strings else r"[^\x{0}-\x{10FFFF}]"


_SPACE = "\\t-\\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Before white space that follows something else, a byte-level pre-token always ends.
_BYTE_LEVEL_PARTS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_CUT = "\x01"
_WIDE_SPACE = "".join(f"\\x{{{c:x}}}" for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def cut_before(texts: pa.Array, *marks: str) -> pa.Array:
    """``texts`` with a cut before each of the marks."""
    for mark in marks:
        texts = pc.replace_substring(texts, mark, _CUT + mark)
    return texts


_GPT2 = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # what a byte-level pre-tokenizer means
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _parts_at_blanks(file: dict) -> bool:
    """Whether a file is a byte-level BPE whose ids are in order of its merges."""
    pre, vocab = file["pre_tokenizer"] or {}, file["model"]["vocab"]
    merged = ("".join(m) if isinstance(m, list) else m.replace(" ", "") for m in file["model"]["merges"])
    plain = file["normalizer"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
    return plain and not file["model"]["end_of_word_suffix"] and all(vocab.get(m) == 256 + i for i, m in enumerate(merged))


def _drops_blanks(file: dict) -> bool:
    """Whether a file lower-cases texts and takes words without white space, each with an end mark."""
    steps = [(n["type"], (n.get("pattern") or {}).get("Regex")) for n in (file["normalizer"] or {}).get("normalizers", [])]
    pres = [(p["type"], (p.get("pattern") or {}).get("Regex"), p.get("behavior"), p.get("invert"), p.get("use_regex")) for p in (file["pre_tokenizer"] or {}).get("pretokenizers", [])]
    wanted = [("Split", _WORDS, "Removed", True, None), ("ByteLevel", None, None, None, False)]
    return steps == [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)] and pres == wanted and file["model"]["end_of_word_suffix"] == "</w>"


def _by_texts(tokenizer, end: int, limit: int) -> WordEncoder:
    """For any file: each text is one word."""
    whole = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    nothing = pa.array([[]], pa.list_(pa.string()))
    return WordEncoder(lambda text: [text], lambda words: list(map(whole, words)), end, "", lambda texts: nothing.slice(0, 0), limit, "", whole)


def byte_level(file: dict, tokenizer, end: int, control: bool, limit: int) -> WordEncoder:
    """A rank encoder over the same vocabulary does the merges, which gives the library's ids in less time."""
    import tiktoken

    added = [t["content"] for t in file["added_tokens"]]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in added}
    encode = tiktoken.Encoding("ranks", pat_str=_GPT2, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    # where no white space comes before a blank or a new line, each of them begins a part
    slow = f"[\\t-\\r {_WIDE_SPACE}][ \\n]|{_CUT}"
    split_column = lambda texts: pc.split_pattern(cut_before(texts, " ", "\n"), _CUT)
    whole = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    return WordEncoder(_BYTE_LEVEL_PARTS.findall, lambda words: list(map(encode, words)), end, slow, split_column, limit, _any_of(added), whole if control else None)


def lower_words(file: dict, tokenizer, end: int, control: bool, limit: int) -> WordEncoder:
    """Words are what stands between ASCII blanks."""
    last = {i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")}

    def encode(words: list[str]) -> list[list[int]]:
        """Words of letters are one pre-token each, so they go as one text, whose ids are cut where a pre-token ends."""
        letters = [w for w in words if w.isalpha() and w.lower().isalpha()]
        ids = tokenizer.encode(" ".join(letters), add_special_tokens=False).ids
        ends = [i + 1 for i, x in enumerate(ids) if x in last]
        if len(ends) == len(letters):
            found = {w: ids[a:b] for w, a, b in zip(letters, [0, *ends], ends)}
        else:
            found = {}
        rest = [w for w in words if w not in found]
        found.update(zip(rest, (e.ids for e in tokenizer.encode_batch_fast(rest, add_special_tokens=False))))
        return [found[w] for w in words]

    def split_column(texts: pa.Array) -> pa.ListArray:
        """Marks that end a word (but for the apostrophe, which begins contractions) are a pre-token of their own, so the word is known without them."""
        apart = pc.replace_substring_regex(pc.ascii_lower(texts), r"(\pL)([!-&(-/:-@\[-`{-~]+)(\s|$)", r"\1 \2\3")
        return pc.ascii_split_whitespace(apart)

    whole = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    # the one letter whose small form ends in a mark, which would run together with marks after it
    return WordEncoder(lambda text: [text], encode, end, chr(0x130), split_column, limit, _any_of([t["content"] for t in file["added_tokens"]]), whole if control else None)


def encoder(path: str, end: int, control: bool = True, limit: int = CACHED_WORDS) -> WordEncoder:
    """An encoder with the ids of the tokenizers library for a file of its own; ``end`` is appended to each text.

    With ``control`` a control token's string in a text is that token, as the library's
    plain call has it; without, it is ordinary text, so that no text can forge one.
    """
    file, tokenizer = json.load(open(path, encoding="utf-8")), _tokenizer(path, control)
    if file["model"]["type"] == "BPE" and not file["model"].get("dropout") and not any(file["model"].get(k) for k in ("unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        if _parts_at_blanks(file):
            return byte_level(file, tokenizer, end, control, limit)
        if _drops_blanks(file):
            return lower_words(file, tokenizer, end, control, limit)
    return _by_texts(tokenizer, end, limit)


def largest_id(path: str) -> int:
    """The largest id of a tokenizers file."""
    file = json.load(open(path, encoding="utf-8"))
    return max([*file["model"]["vocab"].values(), *(t["id"] for t in file["added_tokens"])])


_kept: dict[tuple, WordEncoder] = {}


def shared(path: str, end: int, control: bool = True) -> WordEncoder:
    """One encoder for each Python worker."""
    key = (path, end, control)
    if key not in _kept:
        _kept[key] = encoder(path, end, control)
    return _kept[key]
