import zlib

import duckdb

from palimpsest.llm.langid import drop_unknown, identify, profile, train, with_language

SF = "/root/testdata/sf0.001"


def test_profile_is_by_frequency():
    grams = profile("Aba aba!\n1 abaA")
    text = [" aba aba abaa "]
    want = {}
    for n in (1, 2, 3):
        for i in range(len(text[0]) - n + 1):
            g = text[0][i : i + n]
            if g != " ":
                want[g] = want.get(g, 0) + 1
    decode = lambda g: "".join(chr((int(g) >> s) & 0x1FFFFF) for s in (42, 21, 0)).lstrip("\0")
    got = [decode(g) for g in grams]
    assert sorted(got) == sorted(want) and [want[g] for g in got] == sorted(want.values(), reverse=True)
    assert len(profile("12 !")) == len(profile("")) == 0 and len(profile("a b c d e f g", 5)) == 5


def test_held_out_accuracy(spark):
    labels = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    got = identify(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    apart = [r for r in got if r["held_out"]]
    assert len(got) == len(labels) and sum(r["lang_pred"] == labels[r["doc_id"]] for r in apart) >= 0.97 * len(apart)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_texts(spark):
    learn = [(i, t, lang, 0) for i, (t, lang) in enumerate([("the house and the garden " * 20, "en"), ("das haus und der garten ist " * 20, "de")] * 4)]
    odd = [(100, None, "en", 0), (101, "", "en", 0), (102, "12 34 !?", "en", 0), (103, "x" * 300_000, None, 0), (104, "日本語", None, 0), (None, "the and the", None, 0), (105, "the the and", None, 0), (105, "the the and", None, 0)]
    df = spark.createDataFrame(learn + odd, "doc_id long, text string, lang string, score int")
    got = [tuple(r) for r in identify(df).select("doc_id", "lang_pred", "score").collect()]
    by = {i: (p, s) for i, p, s in got}
    assert len(got) == len(learn) + len(odd)
    assert by[100] == by[101] == by[102] == ("und", 0.0) and by[104][0] in ("de", "en") and by[105][0] == by[None][0] == "en"
    kept = drop_unknown(df)
    # what has no letter, or is like no profile, goes
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.filter("doc_id > 99 or doc_id is null").orderBy("doc_id").collect()] == [None, 105, 105]


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = train(empty)
    assert model.langs == [] and identify(empty).collect() == []
    some = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    assert with_language(some, train(some)).first()["lang_pred"] == "und"


def test_copies_do_not_thin_the_sample(spark):
    """A language of many rows but few different texts is learnt from all of these."""
    texts = ["the house and the garden", "a dog went over the hill", "rain fell on the old town"]
    rows = [(t, "en") for t in texts for _ in range(400)] + [("das haus und der garten", "de")]
    df = spark.createDataFrame(rows, "text string, lang string")
    copied, once = train(df, per_lang=10), train(df.distinct(), per_lang=10)
    assert copied.langs == once.langs == ["de", "en"]
    assert (copied.grams == once.grams).all() and (copied.rank == once.rank).all() and (copied.lang == once.lang).all()


def test_languages_of_one_text_each_in_many_copies(spark):
    df = spark.range(60_000).selectExpr("id as doc_id", "concat('lang', id % 6) as lang", "concat('words of language ', repeat(chr(int(97 + id % 6)), 5)) as text")
    model = train(df)
    assert model.langs == [f"lang{i}" for i in range(6)]
    got = with_language(df, model).groupBy("lang_pred").count().collect()
    assert {r[0]: r[1] for r in got} == {f"lang{i}": 10_000 for i in range(6)}


def test_texts_are_learnt_whole_and_languages_without_limit(spark):
    late = "x " * 30_000 + "zq " * 90_000  # what is frequent comes after a long beginning
    rows = [(late, "late")] + [(f"{chr(0x4E00 + 2 * i)}{chr(0x4E01 + 2 * i)} words {i}", f"l{i:03}") for i in range(700)]
    model = train(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.langs) == 701 and model.predict("zq zq")[0] == "late" and model.predict(rows[600][0])[0] == rows[600][1]


def test_predictions_equal_a_plain_out_of_place_distance(spark):
    """Profiles and distances by dictionaries, over all texts of a small table."""
    rows = duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet'").fetchall()

    def ranked(texts, size):
        counts = {}
        for text in texts:
            words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text).split()
            line = f" {' '.join(words)} " if words else ""
            for n in (1, 2, 3):
                for i in range(len(line) - n + 1):
                    g = line[i : i + n]
                    if g != " ":
                        counts[g] = counts.get(g, 0) + 1
        return {g: r for r, g in enumerate(sorted(counts, key=lambda g: (-counts[g], sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))))[:size])}

    size = 400
    learn = {}
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 5 and text is not None and lang is not None:
            learn.setdefault(lang, set()).add(text)
    profiles = {lang: ranked(texts, size) for lang, texts in learn.items()}
    got = {r["doc_id"]: r for r in identify(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for i, text, _ in rows:
        own = ranked([text or ""], size)
        distance = {lang: sum(abs(p[g] - r) if g in p else size for g, r in own.items()) for lang, p in profiles.items()}
        best = min(sorted(distance), key=distance.get) if own else "und"
        assert got[i]["lang_pred"] == best
        assert abs(got[i]["score"] - (1 - distance[best] / (size * len(own)) if own else 0)) < 1e-12
