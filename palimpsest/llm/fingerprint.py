"""Canonical exact digests of documents.

A text is brought to a canonical form (Unicode NFKC, full case folding, white space
folded to single blanks) and hashed by two chained 64-bit xxhashes to 128 bits. Equal
hashes only make a bucket: inside it canonical texts are compared byte by byte, and
different texts of one bucket get different fingerprints.

All of it is DataFrame expressions; normalisation and case folding call the ICU
functions that Spark brings along for its collations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.skew import hot_left_join
from palimpsest.sources.scratch import Scratch

BROADCAST_ROWS = 1_000_000  # of 16 bytes each
BUCKET_ROWS, MAX_BUCKETS = 4096, 1 << 16
_BLANKS = [*map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0x1680, 0x2028, 0x2029))]  # white space that NFKC leaves


def canonical(text: Column) -> Column:
    """NFKC, case folding and NFKC again, since folding may undo it; then blanks. Null counts as empty."""

    def nfkc(c: Column) -> Column:
        return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))

    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(F.coalesce(text, F.lit(""))), F.lit(True))
    c = nfkc(folded)
    for blank in _BLANKS:
        c = F.replace(c, F.lit(blank), F.lit(" "))
    return F.trim(F.regexp_replace(c, " {2,}", " "))


def _hashes(canon: Column, bits: int) -> list[Column]:
    h = [F.xxhash64(canon), F.xxhash64(F.lit("second"), canon)]
    return h if bits == 128 else [F.pmod(h[0], F.lit(1 << bits)), F.lit(0).cast("long")]


def _hex(h1: Column, h2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


def with_fingerprint(docs: DataFrame, text_col: str = "text", salt_col: str = "doc_id", bits: int = 128, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with __h1, __h2 (the bucket) and __rank, by which different texts of a bucket are told apart.

    Buckets of one row need no comparison. The others' rows are found by a join (a
    broadcast if the buckets are few enough, else a shuffle that is safe for hot keys),
    and equal texts are collapsed before they are shuffled, so a group of copies sends one
    text per task. ``bits`` narrows the hash for tests.
    """
    scratch = scratch or Scratch(docs.sparkSession, "fingerprint")
    canon = docs.select(F.col(salt_col).alias("salt"), canonical(F.col(text_col)).alias("canon"))
    canon = canon.select("salt", "canon", *(h.alias(f"h{i + 1}") for i, h in enumerate(_hashes(F.col("canon"), bits))))
    buckets = scratch.keep(canon.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    few = buckets.count() <= BROADCAST_ROWS
    shared = canon.join(F.broadcast(buckets), ["h1", "h2"], "left_semi") if few else hot_left_join(canon, buckets, ["h1", "h2"], "n", docs.count(), F.xxhash64("salt", "canon")).filter("n is not null")
    texts = shared.select("h1", "h2", "canon").distinct()
    clash = texts.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2")
    clash = scratch.keep(clash, "clash")
    h = [x.alias(f"__h{i + 1}") for i, x in enumerate(_hashes(F.col("__canon"), bits))]
    out = docs.withColumn("__canon", canonical(F.col(text_col))).select(*docs.columns, "__canon", *h)
    if clash.isEmpty():
        return out.drop("__canon").withColumn("__rank", F.lit(0))
    ranks = texts.join(clash, ["h1", "h2"], "left_semi").withColumn("__rank", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("canon")) - 1)
    ranks = scratch.keep(ranks.filter("__rank > 0").select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("canon").alias("__canon"), "__rank"), "ranks")
    return out.join(ranks, ["__h1", "__h2", "__canon"], "left").select(*docs.columns, "__h1", "__h2", F.coalesce("__rank", F.lit(0)).alias("__rank"))


def _name(h1: Column, h2: Column, rank: Column) -> Column:
    return F.concat(_hex(h1, h2), F.when(rank > 0, F.concat(F.lit("-"), rank.cast("string"))).otherwise(F.lit("")))


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with a column ``fingerprint``: equal exactly where canonical texts are equal."""
    marked = with_fingerprint(docs, text_col, id_col)
    return marked.select(*docs.columns, _name(F.col("__h1"), F.col("__h2"), F.col("__rank")).alias("fingerprint"))


def _count_above(bounds: list[int], x: Column) -> Column:
    """How many of the sorted ``bounds`` exceed x, by blocks of about their square root."""
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]

    def longs(values: list[int]) -> Column:
        return F.expr("cast(array(" + ",".join(f"{v}L" for v in values) + ") as array<bigint>)")

    lasts = longs([b[-1] for b in blocks])
    block = F.size(F.filter(lasts, lambda b: b <= x))  # whole blocks that don't exceed it
    inside = F.get(F.array(*(longs(b) for b in blocks)), block)
    not_above = block * step + F.coalesce(F.size(F.filter(inside, lambda b: b <= x)), F.lit(0))
    return F.when(block >= len(blocks), 0).otherwise(len(bounds) - not_above)


def with_next(docs: DataFrame, order_col: str, columns: list[str], tie: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` with next_<c> of the next row by descending ``order_col``; after the last comes the first.

    Rows that repeat a value follow each other by ``tie``; rows without one come last.
    Rows go to buckets of consecutive values, cut at quantiles (at most ``MAX_BUCKETS``,
    which the driver holds), and each bucket's first rows go to the bucket before as well,
    so every row finds its successor in its own bucket and rows are shuffled once.
    """
    spark = docs.sparkSession
    order = F.col(order_col)
    n = docs.count()
    wanted = min(MAX_BUCKETS, max(1, n // bucket_rows))
    cuts = [i / wanted for i in range(1, wanted)]
    bounds = sorted(set(docs.agg(F.percentile_approx(order, cuts, 20 * wanted)).first()[0] or [])) if cuts else []
    bucket = F.coalesce(_count_above(bounds, order), F.lit(len(bounds))) if bounds else F.lit(0)
    placed = docs.withColumn("__bucket", bucket)
    heads = sorted((r[0], r[1]) for r in placed.select("__bucket", order_col).groupBy("__bucket").agg(F.max(order_col)).collect())
    before = [(heads[i][1], heads[i - 1][0]) for i in range(len(heads))]
    guests = F.broadcast(spark.createDataFrame(before, "__head long, __guest int")) if before else spark.createDataFrame([], "__head long, __guest int")
    placed = placed.join(guests, order.eqNullSafe(guests["__head"]), "left")
    at = F.array_compact(F.array(F.struct(F.lit(0).alias("g"), F.col("__bucket").alias("b")), F.when(F.col("__guest").isNotNull(), F.struct(F.lit(1).alias("g"), F.col("__guest").alias("b")))))
    placed = placed.select(*docs.columns, F.explode(at).alias("__at")).select(*docs.columns, "__at.g", "__at.b")
    w = Window.partitionBy("b").orderBy("g", order.desc_nulls_last(), tie)
    return placed.select(*docs.columns, "g", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns)).filter("g = 0").drop("g")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 128, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Each document's fingerprint beside that of an edited text, whose last third is the next document's beginning.

    Likeness of exact digests is 1 where they are equal, else 0. A null text is empty.
    Rows that repeat an id follow each other by text. A table of one row is its own next.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = with_fingerprint(texts, "text", "doc_id", bits)
    marked = with_next(marked, "doc_id", ["text", "__h1", "__h2", "__rank"], "text", bucket_rows)
    n = F.length("text")
    k = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_text", F.lit(1), k))
    out = marked.select("*", n.cast("long").alias("n_chars"), edited.alias("edited"))
    out = out.withColumn("e_canon", canonical(F.col("edited")))
    out = out.select("*", *(h.alias(f"e{i + 1}") for i, h in enumerate(_hashes(F.col("e_canon"), bits))))
    same_bucket = (F.col("__h1") == F.col("e1")) & (F.col("__h2") == F.col("e2"))
    out = out.withColumn("same", F.when(same_bucket, canonical(F.col("text")) == F.col("e_canon")).otherwise(False))
    own = _name(F.col("__h1"), F.col("__h2"), F.col("__rank"))
    following = _name(F.col("next___h1"), F.col("next___h2"), F.col("next___rank"))
    other = F.concat(_hex(F.col("e1"), F.col("e2")), F.when(same_bucket, F.lit("-e")).otherwise(F.lit("")))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        own.alias("fingerprint"),
        F.when(F.col("same"), own).otherwise(other).alias("edited_fingerprint"),
        F.col("same").cast("double").alias("near_edited"),
        (own == following).cast("double").alias("near_next"),
    )
