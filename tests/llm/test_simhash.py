import random

import numpy as np
import pytest
import xxhash

from palimpsest.llm import simhash as simhash_module
from palimpsest.llm.simhash import DISTANCE, Frequent, drop_near_duplicates, fingerprint_links, in_chain, near_duplicates, similar_groups, simhash
from palimpsest.sources.scratch import Scratch

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    import re

    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().translate(LOW))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items):
    """(id, fingerprint) to id -> least id linked."""
    parent = {i: i for i, _ in items}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(items):
        for j, b in items[:n]:
            if (a ^ b).bit_count() <= DISTANCE:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in items}


def texts():
    r = random.Random(4)
    words = ["".join(r.choice("abcdeÉé") for _ in range(r.randrange(1, 7))) for _ in range(80)]
    base = [" ".join(r.choice(words) for _ in range(400)) for _ in range(12)]
    near = [b.replace(r.choice(words), "Zz", 1) for b in base for _ in range(5)]
    return base + near + ["", None, " \n\t", "one", "ONE", "one two", "a\x0bb c", "x\x1cy z", "\xa0 a"] + base[:3] + [base[0].upper().replace("É", "é")]


def test_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, fp string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicates(df).collect()}
    fps = {i: brute_fingerprint(t or "") for i, t in rows}
    groups = brute_components(list(fps.items()))
    assert got == {i: (f"{fps[i]:016x}", groups[i]) for i, _ in rows}
    assert len(set(groups.values())) < len(rows) - 15  # some are linked


@pytest.mark.parametrize("bucket", [1, 3, 128])
def test_links_lose_nothing(spark, bucket):
    """Fingerprints crowded into few buckets, so that the way for full ones is taken too."""
    r = random.Random(bucket)
    seeds = [r.getrandbits(64) for _ in range(5)]
    fps = {s for seed in seeds for s in [seed, *(seed ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (r.getrandbits(1) << r.randrange(64)) for _ in range(25))]}
    fps |= {seeds[0] ^ (1 << b) for b in range(20)}
    items = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in items]
    links = fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), Scratch(spark, "test"), bucket).collect()
    of = {s: f for s, f in zip(signed, items)}
    assert all((of[a["u"]] ^ of[a["v"]]).bit_count() <= DISTANCE for a in links)
    parent = {f: f for f in items}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in links:
        x, y = root(of[a["u"]]), root(of[a["v"]])
        parent[max(x, y)] = min(x, y)
    assert {f: root(f) for f in items} == brute_components([(f, f) for f in items])


def test_chains_hold_all_close_pairs():
    r = np.random.default_rng(0)
    x = np.zeros(3000, np.uint64)
    for _ in range(2):
        x ^= np.uint64(1) << r.integers(0, 64, 3000).astype(np.uint64)
    assert in_chain(x).all()
    assert in_chain(r.integers(0, 2**63, 3000).astype(np.uint64)).mean() < 0.01


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).collect() == [] and similar_groups(empty).collect() == []
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "other words")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["component_id"] for r in got), key=str) == [1, 1, 1, None]


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_similar_groups(spark):
    """Against brute force on the likeness of shingle sets; pairs just at the bound may lack a chain, so they are not near it here."""
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    base = [[r.choice(words) for _ in range(n)] for n in (20, 60, 150, 400, 1500) for _ in range(3)]
    docs = [" ".join(b) for b in base]
    for b in base:
        for share in (0.01, 0.3):
            docs.append(" ".join(r.choice(words) if r.random() < share else w for w in b))
        docs.append(" ".join([*b, "tail"]))
    docs += ["", "short", "short", "Short", "a b", "A  b", None]
    rows = list(enumerate(docs))
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in rows:
        for j, b in rows[:i]:
            x, y = shingles(a or ""), shingles(b or "")
            if len(x & y) >= 0.8 * len(x | y):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    want = {i: root(i) for i, _ in rows}
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, u int")
    assert {g["doc_id"]: g["component_id"] for g in similar_groups(df).collect()} == want
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(k["doc_id"] for k in kept.collect()) == sorted(set(want.values()))


def test_simhash_of_long_text():
    t = "word " * 70_000 + "other " * 1000
    assert simhash(t.encode()) == brute_fingerprint(t)


def groups_of(spark, docs, **more):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return {g["doc_id"]: g["component_id"] for g in similar_groups(df, **more).collect()}


def brute_groups(docs):
    sets = [shingles(t) for t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) >= 0.8 * len(x | y):
                links += 1
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in range(len(docs))}, links


def vocabulary(r, n=2000):
    return ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def changed(r, text, words, n):
    text = list(text)
    for at in r.sample(range(len(text)), n):
        text[at] = r.choice(words)
    return " ".join(text)


def test_variants_of_one_text(spark):
    """Links that only the exact likeness confirms aren't thinned before it: most pairs here are under 0.8, some over."""
    r = random.Random(21)
    words = vocabulary(r)
    base = [r.choice(words) for _ in range(300)]
    docs = [changed(r, base, words, 4) for _ in range(100)]
    want, links = brute_groups(docs)
    assert 20 < links < 1000
    assert groups_of(spark, docs) == want


def test_large_family(spark):
    """More variants of one template than a block holds, most pairs of which are not alike."""
    r = random.Random(22)
    words = vocabulary(r)
    base = [r.choice(words) for _ in range(60)]
    docs = [changed(r, base, words, r.choice((1, 2, 2, 3))) for _ in range(1100)]
    want, links = brute_groups(docs)
    assert links < 0.2 * len(docs) ** 2 / 2 and len(set(want.values())) > 20
    assert groups_of(spark, docs) == want


@pytest.mark.parametrize("more", [{"hot": 3, "run": 5, "block": 4}, {"hot": 40, "run": 1 << 16, "block": 7}])
def test_hot_shingles_keys_and_copies(spark, monkeypatch, more):
    """Shingles that many texts hold, keys in several runs, blocks with guests in several chunks, texts in many copies: no link is lost."""
    monkeypatch.setattr(simhash_module, "CHUNK", 3)
    r = random.Random(29)
    words = vocabulary(r)
    docs = []
    for size in (60, 90, 30):  # templates of their own, whose families share a passage
        shared, base = words[:20], [r.choice(words) for _ in range(size)]
        docs += [changed(r, base + shared, words, r.choice((1, 2, 3, 8))) for _ in range(45)]
    docs += [" ".join(words[:60])] * 30 + [" ".join(words[:60]).upper()] * 5 + [" ".join(words[:58])] * 12 + ["", "one two", None] * 3
    docs = [d or "" for d in docs]
    r.shuffle(docs)
    want, links = brute_groups(docs)
    assert links > 500 and groups_of(spark, docs, **more) == want


def test_frequent_items():
    r, seen, counts = random.Random(5), Frequent(50), {}
    for _ in range(40):
        items = [r.randrange(10_000) for _ in range(200)] + [7, 9] * 20
        for x in items:
            counts[x] = counts.get(x, 0) + 1
        seen.add(np.array(items, np.uint64))
    got = dict(zip(seen.items.tolist(), seen.counts.tolist()))
    total = sum(counts.values())
    assert len(got) <= 50 and all(counts[x] - total / 50 <= n <= counts[x] for x, n in got.items())
    assert {7, 9} <= set(got)


def test_appended_and_replaced_passages(spark):
    """Likeness of 0.8 to 0.85 by one passage; all such pairs are found."""
    r = random.Random(23)
    words = vocabulary(r, 20_000)
    docs = []
    for i in range(300):
        base = [r.choice(words) for _ in range(204)]
        if i % 2:
            other = base + [r.choice(words) for _ in range(r.randrange(36, 50))]
        else:
            n = r.randrange(13, 18)
            at = r.randrange(20, 160)
            other = [*base[:at], *(r.choice(words) for _ in range(n)), *base[at + n :]]
        docs += [" ".join(base), " ".join(other)]
    got = groups_of(spark, docs)
    for i in range(0, len(docs), 2):
        x, y = shingles(docs[i]), shingles(docs[i + 1])
        assert 0.8 <= len(x & y) / len(x | y) < 0.86
        assert got[i] == got[i + 1] == i


def test_one_word_repeated_is_not_a_copy(spark):
    """Texts of which one word makes up most aren't alike by that."""
    r = random.Random(24)
    words = vocabulary(r)
    articles = [" ".join(r.choice(words) for _ in range(40)) for _ in range(2)]
    docs = ["a a a b", "a a a c", *(t + " -" * 100 for t in articles), articles[0].upper() + " -" * 100]
    assert groups_of(spark, docs) == {0: 0, 1: 1, 2: 2, 3: 3, 4: 2}


def test_repeats_count_once(spark):
    """A line repeated 5 or 100 times is the same set of shingles but for the words around it."""
    r = random.Random(25)
    words = vocabulary(r)
    article, line = ([r.choice(words) for _ in range(n)] for n in (600, 12))
    docs = [" ".join(article + line * n) for n in (5, 100)]
    assert groups_of(spark, docs) == {0: 0, 1: 0}
