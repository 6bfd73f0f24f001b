import hashlib
import re

import duckdb
import pytest

from palimpsest.llm import queries
from palimpsest.llm.pii import BASE, KINDS, redact, spans_text, with_spans

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def valid(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    return {
        "email": True,
        "ip": kind == "ip" and all(int(x) <= 255 for x in hit.split(".")),
        "card": 14 <= len(d) <= 19 and luhn(d),
        "phone": 10 <= len(d) <= 15,
    }[kind]


def brute(text):
    text = text or ""
    spans = [(m.start(), k, m.end()) for k, kind in enumerate(BASE) for m in re.finditer(PATTERNS[kind], text) if valid(kind, m[0])]
    return ",".join(f"{BASE[k]}:{s}:{e}" for s, k, e in sorted(spans))


TEXTS = [
    None,
    "",
    "no data here",
    "a@b.com_x@y.z é ü 4111 1111 1111 1111 and 4111111111111112",
    "ip 1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.255 1.2.3",
    "+1 (017) 555-5036 +12 +1234567890123456 +1-2-3-4-5-6-7-8-9-0.",
    "x" * 2000 + "@" + "a." * 2000 + "b 1" + "2 3-4" * 2000,
    "😀 mail me: jöe@exa-mple.co.uk, card 3782 822463 10005😀",
    "1" * 3000,
    "a" * 3000,
    "IBAN DE89 3704 0044 0532 0130 00 and bank GB82WEST12345698765432 but DE89 3704 0044 0532 0130 01",
    "my ssn is 123-45-6789, part 123-45-6789" + "." * 50 + "123-45-6789",
]


def test_base_spans_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, pii_ string")
    got = {r[0]: r[1] for r in with_spans(df).selectExpr("doc_id", "filter(pii, s -> s.k < 4) as b").select("doc_id", spans_text(__import__("pyspark").sql.functions.col("b"))).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_added_spans(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r["doc_id"]: r["pii"] for r in with_spans(df).collect()}
    assert [(s["start"], s["end"]) for s in got[10] if KINDS[s["k"]].name == "iban"] == [(5, 32), (42, 64)]
    assert [s["start"] for s in got[11] if KINDS[s["k"]].name == "ssn"] == [10, 28]
    joined = "7536784127813050 4845168114407329 x +1 (826) 555-4081 190.137.223.204 and 4845168114407329, +1 (826) 555-4081"
    got2 = with_spans(spark.createDataFrame([(0, joined)], "doc_id long, text string")).first()["pii"]
    assert [joined[s["start"] : s["end"]] for s in got2] == ["7536784127813050", "4845168114407329", "+1 (826) 555-4081", "190.137.223.204", "4845168114407329", "+1 (826) 555-4081"]
    assert all(s["score"] > 0.8 for s in got[10] if KINDS[s["k"]].name == "iban")


def test_spans_are_in_order_of_start_and_kind_as_listed():
    names = [k.name for k in KINDS]
    assert names.index("iban") > max(i for i, n in enumerate(names) if n in BASE)


def test_context_words_are_whole(spark):
    texts = ["lorem ipsum 1.2.3.4", "ip 1.2.3.4", "IPs: 1.2.3.4", "the telling +1 826 555 4081", "tel. +1 826 555 4081", "shipping 1.2.3.4"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [round(s["score"], 1) for s in r["pii"]] for r in with_spans(df).collect()}
    assert got == {0: [0.6], 1: [0.9], 2: [0.9], 3: [0.6], 4: [0.9], 5: [0.6]}


def test_very_long_runs(spark):
    """Brute force would take quadratic time here."""
    runs = ["a" * 300_000, "1" * 300_000, "x" * 100_000 + "@" + "a." * 100_000 + "b", "1.2.3" * 60_000, "+1" * 100_000, "2 3-4" * 60_000, "A1" * 150_000]
    got = with_spans(spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")).collect()
    assert [(s["start"], s["end"]) for r in got if r["doc_id"] == 2 for s in r["pii"]] == [(0, 300_002)]


def test_redact(spark):
    df = spark.createDataFrame([(0, TEXTS[7], 1), (1, None, 2), (2, "clean", 3)], "doc_id long, text string, PII int").selectExpr("*", "PII as __pii")
    assert redact(df).columns == df.columns and {(r["PII"], r["__pii"]) for r in redact(df).collect()} == {(1, 1), (2, 2), (3, 3)}
    rows = {r["doc_id"]: r["text"] for r in redact(df).collect()}
    assert rows == {0: "😀 mail me: jö<EMAIL>, card <CARD>😀".replace("jö<EMAIL>", TEXTS[7][11:13] + "<EMAIL>"), 1: None, 2: "clean"}


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_brute_force(spark, sf):
    d = f"/root/testdata/{sf}"
    want = {}
    for i, t in duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall():
        want[i] = hashlib.sha256(brute(t).encode()).hexdigest()
    got = queries.op3_pii_checksum_context(spark, d).collect()
    assert {r["doc_id"]: r["base_sha256"] for r in got} == want
    assert sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in got) > 0


def test_query_counts_by_kind(spark, tmp_path):
    """Whatever order the kinds come in, and however often."""
    texts = [*TEXTS, "+1 (826) 555-4081", "card 4111 1111 1111 1111, then a@b.com and c@d.org", "1.2.3.4 and 4.3.2.1, a@b.com, +1 (826) 555-4081"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for d, rows in ((tmp_path, enumerate(texts)), ("/root/testdata/sf0.001", duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall())):
        want = {i: [sum(x.startswith(f"{kind}:") for x in brute(t).split(",")) for kind in BASE] for i, t in rows}
        assert {r["doc_id"]: [r[f"n_{kind}"] for kind in BASE] for r in queries.op3_pii_checksum_context(spark, str(d)).collect()} == want
