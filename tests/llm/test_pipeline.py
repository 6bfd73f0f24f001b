import random

import numpy as np
import pytest

import corpus_pipeline
from palimpsest.llm import simhash as simhash_module
from tests.llm.test_pii import brute as pii_brute
from tests.llm.test_simhash import brute_fingerprint, changed, shingles, vocabulary
from tests.llm.test_tokens import BYTE, check_pieces, library

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents():
    r = random.Random(12)
    words = {lang: ["".join(r.choice(letters) for _ in range(r.randrange(2, 8))) for _ in range(600)] for lang, letters in (("en", "thednorsai"), ("de", "schneiertäü"))}
    rows = []
    for lang, vocabulary in words.items():
        for n in (3, 40, 200, 900):
            for _ in range(4):
                rows.append((" ".join(r.choice(vocabulary) for _ in range(n)), lang))
    rows += [(t.upper() if t.isascii() else t, lang) for t, lang in rows[:6]]  # copies
    rows += [(t + " ende", lang) for t, lang in rows[8:20]]  # near copies
    rows += [(t + " mail me@example.com now 4111 1111 1111 1111", lang) for t, lang in rows[24:28]]
    rows += [("1234 5678", "en"), (None, "en"), ("", None), ("!?", "de")]
    r.shuffle(rows)
    return [(7 * i, t, lang, f"s{i % 3}", len(t or "")) for i, (t, lang) in enumerate(rows)]


def brute(rows):
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    newest = {}
    for r in sorted(rows):
        newest[r[1].translate(LOW)] = r
    rows = sorted(newest.values())
    parent = {r[0]: r[0] for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(rows):
        for b in rows[:n]:
            x, y = shingles(a[1]), shingles(b[1])
            if len(x & y) >= 0.8 * len(x | y):
                p, q = root(a[0]), root(b[0])
                parent[max(p, q)] = min(p, q)
    rows = [r for r in rows if root(r[0]) == r[0]]
    out = {}
    for r in rows:
        text, at, parts = r[1], 0, []
        for span in filter(None, pii_brute(text).split(",")):
            kind, start, end = span.split(":")
            if int(start) >= at:
                parts.append(text[at : int(start)] + f"<{kind.upper()}>")
            at = max(at, int(end))
        out[r[0]] = "".join(parts) + text[at:]
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def test_equals_brute_force(spark, sf_dir):
    want = brute(documents())
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    tokens = {i: np.array([*library(BYTE)(t), 0], "<u4") for i, t in want.items()}
    assert {p["doc_id"] for p in pieces} == set(want)
    check_pieces(pieces, tokens, 1024)


def test_stages_keep_columns_and_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"]: tuple(r) for r in docs.collect()}
    want = brute(documents())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    after = {r["doc_id"]: tuple(r) for r in docs.collect()}
    assert set(after) == set(want)
    for i, row in after.items():
        assert row[1] == want[i] and row[4] == len(want[i])
        if "<EMAIL>" not in row[1]:
            assert row == before[i]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("prefixes", [False, True])
def test_near_goes_by_fingerprints_first(spark, monkeypatch, prefixes):
    """Without candidates by shingles it still drops what is alike and within two bits; with them, all that is alike."""

    def nothing(batches):
        for _ in batches:
            pass
        yield from ()

    if not prefixes:
        monkeypatch.setattr(simhash_module, "_prefixes", lambda similarity: nothing)
    r = random.Random(31)
    words = vocabulary(r)
    docs = []
    for i in range(12):
        base = [r.choice(words) for _ in range(900)]
        docs += [" ".join(base), *(changed(r, base, words, n) for n in (1, 1, 12)), " ".join([*base[:300], *["x"] * 2000])]
        docs.append(" ".join(base + base[:450]))  # one set but for five shingles, another fingerprint
    docs += [" ".join([r.choice(words) for _ in range(300)] + ["x"] * 2000) for _ in range(4)]  # one fingerprint, other texts
    sets, fps = [shingles(t) for t in docs], [brute_fingerprint(t) for t in docs]
    least, kinds = list(range(len(docs))), {True: 0, False: 0}
    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                close = (fps[i] ^ fps[j]).bit_count() <= 2
                kinds[close] += 1
                if close or prefixes:
                    a, b = sorted((least[i], least[j]))
                    least = [a if x == b else x for x in least]
    assert kinds[True] > 5 and kinds[False] > 5 and len({f for f in fps if fps.count(f) > 3}) == 1
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert {d["doc_id"] for d in corpus_pipeline.near(spark, df, "").collect()} == set(least)
