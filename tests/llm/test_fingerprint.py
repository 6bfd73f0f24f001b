import hashlib
import re
import unicodedata

import pytest

from palimpsest.llm.fingerprint import edited_fingerprints, fingerprints

WS = re.compile("[" + "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0x1680, 0x2028, 0x2029))) + "]+")


def canon(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return WS.sub(" ", t).strip(" ")


def data():
    texts = [None, "", "  ", "Straße ﬁx A", "STRASSE\n fix a", "Café au lait", "café AU lait ", "x" * 50_000, "①", "1", "ab", "abc", "😀😀😀 z"]
    return [(3 * i, t) for i, t in enumerate(texts * 3)] + [(5, "tie b"), (5, "tie a")]


@pytest.mark.parametrize(("bits", "bucket_rows"), [(128, 4096), (128, 4), (1, 10)])
def test_equals_brute_force(spark, bits, bucket_rows):
    rows = sorted(data(), key=lambda r: (-r[0], r[1] or ""))
    df = spark.createDataFrame(data(), "doc_id long, text string").selectExpr("*", "1 as g", "2 as h1", "'z' as edited")
    got = edited_fingerprints(df, bits=bits, bucket_rows=bucket_rows).collect()
    want = {}
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 3
        e = t[: len(t) - k] + nxt[:k]
        want.setdefault(d, []).append((len(t), hashlib.sha256(e.encode()).hexdigest(), float(canon(e) == canon(t)), float(canon(nxt) == canon(t))))
    have = {}
    for r in got:
        have.setdefault(r["doc_id"], []).append((r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    by_text = {}
    for r in got:
        if r["doc_id"] != 5:
            by_text.setdefault(canon(data()[r["doc_id"] // 3][1] or ""), set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert len(set.union(*by_text.values())) == len(by_text)


def test_small_tables(spark):
    assert edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = edited_fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()[0]
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()


def test_keeps_columns(spark):
    df = spark.createDataFrame([(1, "A", "x"), (2, "a", "y")], "doc_id long, text string, canon string")
    got = fingerprints(df).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "canon", "fingerprint"}
    assert got[0]["fingerprint"] == got[1]["fingerprint"]
