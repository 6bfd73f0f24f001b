import functools
import hashlib
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest

from palimpsest.llm.packing import Windows, merged, pack
from palimpsest.llm.pieces import Merges, _has_user_defined, encode_decode, piece_encoder
from palimpsest.llm import tokens
from palimpsest.llm.sstable import Table, Writer, file_system, id_of, key_of, read_shards, write_shards, written_and_read
from palimpsest.llm.tokens import encoder
from palimpsest.llm.workers import slices
from palimpsest.llm.vocabularies import vocabulary

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")
BYTE, WORD, PIECE = (vocabulary(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def texts():
    r = random.Random(0)
    odd = [None, "", " ", "  ", "a  b", "\n\n x\ty", "▁▁ a▁b", "😀 ﬁ é é ", "x" * 300 + " " + "ab" * 500, "<s> </s> <0x41> <unk>", "\x00\x1c a\xa0b c", "日本語 テキスト", "it's I'LL don't  'S", "a" * 70_000, "12345 678\r\n  \n  foo \n bar   ", "<|endoftext|> <|startoftext|>", "hi <|startoftext|> there", "a<|endoftext|>b <|ENDOFTEXT|>", "<|endoftext|>", "<|endoftext|", "!\x1c? \x85x", "İ. İstanbul ΑΣ Σ ǅ ŉ'ß ⅷ²", "\x01a \x01 b"]
    odd += ["".join(r.choice(" \n\tab'sé1!▁İ́, ") for _ in range(r.randrange(60))) for _ in range(300)]
    return odd + ["The quick brown fox. " * 50] * 20


@functools.cache
def library(path, control=True):
    t = tokenizers.Tokenizer.from_file(path)
    if not control:
        t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@functools.cache
def expected(path, control):
    encode = library(path, control)
    return [encode(t) for t in texts()]


@pytest.mark.parametrize("limit", [10, 400_000])
def test_encoders_equal_the_libraries(limit):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    ours = [(encoder(path, end, control, limit), expected(path, control)) for path, end in ((BYTE, 0), (WORD, 1)) for control in (True, False)]
    for own, want in (*ours, (piece_encoder(sp), [sp.encode(t or "") for t in texts()])):
        column = pa.array(texts())
        for _ in range(2):
            got = [x.tolist() for part in (column.slice(0, 100), column.slice(100)) for x in own.encode_all(part)]
            assert got == [[*ids, own.end] for ids in want]
    assert list(encoder(BYTE, 0).encode_all(pa.array([], pa.string()))) == []


def test_control_strings_are_the_plain_library_s():
    assert library(WORD)("hi <|startoftext|> there")[1] == 49406 and library(BYTE)("<|endoftext|>") == [50256]
    assert next(encoder(BYTE, 0).encode_all(pa.array(["<|endoftext|>"]))).tolist() == [50256, 0]
    assert 50256 not in next(encoder(BYTE, 0, control=False).encode_all(pa.array(["<|endoftext|>"]))).tolist()


def test_files_of_another_kind_encode_whole_texts(tmp_path):
    file = json.load(open(BYTE))
    file["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(file))
    path = str(tmp_path / "other.json")
    encode = library(path)
    assert [x.tolist() for x in encoder(path, 7).encode_all(pa.array(texts()))] == [[*encode(t), 7] for t in texts()]


def test_word_table_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_BYTES", 20_000)
    own, want, r = encoder(BYTE, 0), library(BYTE), random.Random(3)
    for _ in range(30):
        batch = [" ".join("".join(r.choice("abcdefg") for _ in range(r.choice([3, 8, 5000]))) for _ in range(20)) for _ in range(5)]
        assert [x.tolist() for x in own.encode_all(pa.array(batch))] == [[*want(t), 0] for t in batch]
        assert max(map(len, own.index), default=0) <= tokens.KEPT_BYTES and len(own.flat) <= 1 << 17


def test_slices_are_bounded_in_bytes():
    batch = pa.record_batch({"x": ["a" * n for n in (10, 5000, 10, 10, 9000, 10)]})
    parts = list(slices([batch], rows=4, limit=1000))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert all(p.num_rows == 1 or p.nbytes <= 1000 for p in parts)
    assert [p.num_rows for p in slices([batch.slice(0, 0)])] == [0]


def test_rounds_equal_the_library_on_long_words():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    merges, r = Merges(sp), random.Random(5)
    words = ["▁" + "".join(r.choice(alphabet) for _ in range(n)) for alphabet in ("aabetnos", "ab", "a", "thein", "xé日@") for n in (1, 2, 63, 64, 65, 500, 20_000)]
    words += ["▁" + "".join(r.choice("aabetnosrh") for _ in range(r.randrange(1, 90))) for _ in range(2000)]
    assert merges.encode(words) == [sp.encode(w[1:]) for w in words]
    assert merges.encode([]) == []


def test_pieces_of_the_user_are_refused():
    assert _has_user_defined(b"\x0a\x05\x0a\x01x\x18\x04") and not _has_user_defined(b"\x0a\x05\x0a\x01x\x18\x01")


def test_ids_too_large_for_their_width(tmp_path):
    with pytest.raises(ValueError, match="fit"):
        Writer(None, 2).add(1, np.array([65536], np.uint32))
    assert isinstance(file_system(f"file://{tmp_path}")[0], pafs.LocalFileSystem)


def frame(spark):
    data = texts()[:60]
    rows = [(3 * i - 40, t, "x") for i, t in enumerate(data)] + [(None, "no id", "x"), (5000, "twice", "x"), (5000, "twice again", "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def test_sentencepiece_operator(spark):
    rows, df = frame(spark)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = []
    for i, t, _ in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    got = encode_decode(df, PIECE, keep_ids=True).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted(want, key=str)
    assert all(sp.decode(r["ids"]) == r["decoded"] for r in got)
    assert encode_decode(df.limit(0), PIECE).collect() == []


def test_shards(spark, tmp_path):
    rows, df = frame(spark)
    want, start = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library(WORD)(t), 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, written_and_read(df, WORD).collect()), key=str) == sorted(want, key=str)
    manifest = write_shards(df, str(tmp_path / "sst"), WORD)
    assert sum(r["docs"] for r in manifest.collect()) == len(rows)
    seen = {}
    for r in manifest.collect():
        fs, name = pafs.FileSystem.from_uri(r["path"])
        with fs.open_input_file(name) as f:
            table = Table(f)
            mine = [(i, ids.tolist()) for i, _, ids in table.scan()]
            for i, _ in mine:
                assert [x.tolist() for x in table.get(i)] == [ids for j, ids in mine if j == i]
            assert table.get(10**12) == [] and sum(table.may_hold(key_of(x)) for x in range(10**6, 10**6 + 500)) < 50
            seen.update(mine)
    assert seen[-40] == [*library(WORD)(rows[0][1]), 1]
    assert read_shards(write_shards(df.limit(0), str(tmp_path / "none"), WORD)).collect() == []
    assert [id_of(key_of(x)) for x in (None, -(2**63), -1, 0, 2**63 - 1)] == [None, -(2**63), -1, 0, 2**63 - 1]
    assert sorted([5, -3, 0, None], key=key_of) == [None, -3, 0, 5]


def check_pieces(pieces, tokens, length):
    """Every token in one piece, and no gap or overflow in a sequence."""
    by_sequence = {}
    cover = {}
    for p in pieces:
        doc = tokens[p["doc_id"]]
        assert p["length"] > 0 and p["doc_tokens"] == len(doc)
        assert p["ids_crc32"] == zlib.crc32(doc[p["start"] : p["start"] + p["length"]].tobytes())
        cover.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for doc, ids in tokens.items():
        at = 0
        for start, n in sorted(cover[doc]):
            assert start == at
            at += n
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(by_sequence)


@pytest.mark.parametrize(("length", "windows"), [(1024, 64), (16, 2)])
def test_packing(spark, length, windows):
    rows, df = frame(spark)
    tokens = {i: np.array([*library(BYTE)(t), 0], "<u4") for i, t, _ in rows if i not in (None, 5000)}
    got = pack(df.filter("doc_id is not null and doc_id <> 5000"), BYTE, length=length, windows=windows).collect()
    n = check_pieces(got, tokens, length)
    total = sum(map(len, tokens.values()))
    assert n * length <= 1.02 * total + 2 * length
    assert len(pack(df, BYTE).select("sequence_id", "offset").distinct().collect()) == pack(df, BYTE).count()
    assert pack(df.limit(0), BYTE).collect() == []


def test_windows_are_bounded():
    r, space = random.Random(1), Windows(64, 4, 3)
    used = {}
    for _ in range(2000):
        n = r.randrange(1, 150)
        at = 0
        for start, length, sequence, offset, _ in space.place(n):
            assert start == at and offset == used.get(sequence, 0)
            used[sequence] = offset + length
            at += length
        assert at == n and len(space.open) <= 4
    closed = [u for s, u in used.items() if s not in {x for _, x in space.open}]
    assert all(64 - 3 < u <= 64 for u in closed)


def test_merging_leftovers():
    import pandas as pd

    r = random.Random(2)
    rows = [(s, o, n) for s in range(50) for o, n in [(0, r.randrange(1, 40)), ]]
    f = pd.DataFrame(rows, columns=["sequence_id", "offset", "length"])
    new = merged(f, 64)
    assert new.groupby("sequence_id")["length"].sum().max() <= 64 and new["sequence_id"].nunique() < 30
    assert sorted(new["length"]) == sorted(f["length"])
