"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent character n-grams (n = 1 to 3, words padded by a
blank) in order of frequency. A document's profile is compared to each language's by
the out-of-place distance: the sum over the document's n-grams of how far their ranks
differ, an n-gram the language lacks counting as far as can be.

Counting is done on whole texts in flat arrays: letters become code points, all else
becomes single blanks, and an n-gram is three code points of 21 bits in one integer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.workers import lean

PROFILE, SAMPLE_PER_LANG = 400, 1000
UNKNOWN = "und"
_BLANK = 0x20
_BITS = 21
PARTS = 16  # of a language's sample, counted apart


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a blank."""
    table = np.full(0x110000, _BLANK, np.uint64)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    """Lower-case letters with one blank between words and at both ends; empty where there is no letter."""
    if not _TABLE:
        _TABLE.append(_letters())
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.concatenate([[np.uint64(_BLANK)], _TABLE[0][raw], [np.uint64(_BLANK)]]).astype(np.uint64)
    blank = x == _BLANK
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[0] = True
    x = x[keep]
    return x if len(x) > 2 else x[:0]


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a text, sorted, and how often each occurs."""
    x = _codes(text)
    if not len(x):
        return x, np.zeros(0, np.int64)
    b = np.uint64(_BITS)
    two = (x[:-1] << b) | x[1:]
    three = (two[:-1] << b) | x[2:]
    grams = np.sort(np.concatenate([x[x != _BLANK], two, three]))
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[starts], np.diff(np.append(starts, len(grams)))


def _most(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The n-grams by descending frequency; ties by n-gram, so that ranks are certain."""
    if len(grams) > size:  # what can't be among the first goes before the exact sort
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.argsort(-counts, kind="stable")[:size]]


def profile(text: str, size: int = PROFILE) -> np.ndarray:
    """A text's most frequent n-grams in order."""
    return _most(*_counts(text), size)


class Model(NamedTuple):
    langs: list[str]
    grams: np.ndarray  # sorted n-grams of all profiles
    starts: np.ndarray  # where each one's entries begin, and the end
    lang: np.ndarray  # entries: the number of a language that has it
    rank: np.ndarray  # and its rank there
    size: int

    @staticmethod
    def of(profiles: dict[str, np.ndarray], size: int) -> Model:
        langs = sorted(profiles)
        gram = np.concatenate([profiles[n] for n in langs] or [np.zeros(0, np.uint64)]).astype(np.uint64)
        lang = np.repeat(np.arange(len(langs)), [len(profiles[n]) for n in langs])
        rank = np.concatenate([np.arange(len(profiles[n])) for n in langs] or [np.zeros(0, np.int64)])
        order = np.lexsort((lang, gram))
        grams, starts = np.unique(gram[order], return_index=True)
        return Model(langs, grams, np.append(starts, len(gram)), lang[order], rank[order], size)

    def predict(self, text: str | None) -> tuple[str, float]:
        own = profile(text or "", self.size)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        # every n-gram counts as far as can be, but for the languages that have it
        distance = np.full(len(self.langs), self.size * len(own), np.int64)
        if len(self.grams):
            at = np.searchsorted(self.grams, own)
            at[at == len(self.grams)] = 0
            place = np.flatnonzero(self.grams[at] == own)
            begin, n = self.starts[at[place]], self.starts[at[place] + 1] - self.starts[at[place]]
            entry = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
            nearer = self.size - np.abs(self.rank[entry] - np.repeat(place, n))
            distance -= np.bincount(self.lang[entry], nearer, len(self.langs)).astype(np.int64)
        best = int(np.argmin(distance))
        return self.langs[best], float(1 - distance[best] / (self.size * len(own)))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Profiles of every language from at most ``per_lang`` of its different texts, read whole.

    The sample is the different texts least by hash, all of them where a language has
    few, so it doesn't depend on the layout of the input and copies change nothing. A
    limit on the hash, ten standard deviations above what is wanted, cuts rows before
    they move. N-grams are counted by parts of a language's texts; the driver gets a
    profile's worth of rows for each language. A language whose texts have no letter
    isn't learnt.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    hashed = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    # different hashes are counted, so copies combine before the shuffle
    texts = hashed.groupBy("lang").agg(F.count_distinct("h").alias("texts")).collect()
    wanted = per_lang + 10 * per_lang**0.5 + 50
    limits = [(r["lang"], int(min(2**63 - 1, 2**64 * wanted / r["texts"] - 2**63))) for r in texts]
    limits = F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, top long"))  # a row for each language
    near = hashed.join(limits, "lang").filter("h <= top").select("lang", "h", "text").dropDuplicates(["lang", "h"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    sample = near.withColumn("rank", rank).filter(F.col("rank") <= per_lang).select("lang", "text", F.pmod("h", F.lit(PARTS)).alias("part"))

    def count(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        each = [_counts(t) for t in frame["text"]]
        grams, at = np.unique(np.concatenate([g for g, _ in each]), return_inverse=True)
        n = np.bincount(at, np.concatenate([c for _, c in each]), len(grams)).astype(np.int64)
        return pd.DataFrame({"lang": key[0], "gram": grams.astype(np.uint64).view(np.int64), "n": n})

    counted = sample.groupBy("lang", "part").applyInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    first = counted.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= size)
    got = first.select("lang", "rank", "gram").toPandas().sort_values(["lang", "rank"])
    return Model.of({lang: part["gram"].to_numpy(np.int64).view(np.uint64) for lang, part in got.groupby("lang")}, size)


def with_language(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) of each row; only the text is read to predict.

    A text without a letter, null and empty ones included, is ``und`` with score 0. Equal
    distances go to the first language by name. The score is 1 less the distance's share
    of the largest one possible. Rows that repeat give a row each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a profile of n-grams for each language

    @lean
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(predict, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Whether a document belongs to the fifth that is never learnt from; a null id counts as its empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document, learning from those that aren't held out."""
    model = train(docs.filter(~held_out()))
    return with_language(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def drop_unknown(docs: DataFrame, least_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose text is in a language: it has letters, and some profile shares n-grams with it."""
    model = train(docs.filter(~held_out()))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    at = docs.columns.index("text")

    @lean
    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = (model.predict(t.as_py()) for t in batch.column(at))
            yield batch.filter(pa.array([lang != UNKNOWN and score > least_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(known, docs.schema)
