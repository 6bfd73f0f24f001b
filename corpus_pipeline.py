"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what
it returns is written as Parquet and read again as the next one's input. All but the last
return the columns of documents. The tables that a stage's operator made on its way go as
the next stage begins.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.exact_dedup import drop_exact_duplicates
from palimpsest.llm.langid import drop_unknown
from palimpsest.llm.packing import pack
from palimpsest.llm.pii import redact
from palimpsest.llm.simhash import drop_near_duplicates
from palimpsest.llm.vocabularies import vocabulary
from palimpsest.sources.scratch import Scratch, collecting, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_made = threading.local()  # lists of what each stage of a thread's runs has made, by the stage's place


def _stage(place: int) -> Callable[[Stage], Stage]:
    """A stage that first deletes what those before it have left, but for what its input still reads: their results have been written."""

    def wrap(work: Stage) -> Stage:
        @functools.wraps(work)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            kept: list[list[Scratch]] = _made.__dict__.setdefault("kept", [[] for _ in range(5)])
            for made in kept[:place]:
                release(made, docs)
            with collecting(kept[place]):
                return work(spark, docs, sf_dir)

        return run

    return wrap


@_stage(0)
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no language: without a letter, or like no profile."""
    return drop_unknown(docs)


@_stage(1)
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the document with the largest id."""
    return drop_exact_duplicates(docs)


@_stage(2)
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: SimHash on the ring, then shared shingles for those beyond its distance."""
    return drop_near_duplicates(docs)


@_stage(3)
def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; ``n_chars`` follows the text."""
    masked = redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else masked


@_stage(4)
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs documents into sequences; a row per piece."""
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("personal", personal), ("packing", packed)]

#: Language profiles and tokens can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
