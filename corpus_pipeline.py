"""From raw documents to token ids: the stages of a training corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.llm import decontaminate, language, lines, near, pieces, simhash
from cairnfield.llm._common import SOME_BYTES, staged, table

MODEL = "piece_bpe_32k.model"
#: A run of fewer than three lines is cut if it has more words than this.
LONG_RUN = 50
#: Spark's setting for the bytes of rows that a Python worker is handed at once.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(stage: Callable) -> Callable:
    """The stage, whose rows come to Python in batches of SOME_BYTES, not of 10000 rows of any
    size, which executors and their workers would hold twice over. The session keeps the setting,
    as plans are run after the stage returns; it changes no result."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_BYTES, str(SOME_BYTES))
        return stage(spark, docs, sf_dir)

    return run


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars after the text was changed."""
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


@_small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language; those without a letter or unlike all languages go."""
    return language.accepted(docs, language.fit(docs))


@_small_batches
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts runs of three or more lines, or of over 50 words, that occur before; every
    document stays."""
    return _recounted(lines.remove(docs, words=LONG_RUN))


@_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, 5-word shingles, similarity 0.8: the fingerprints' links of
    op8 are checked exactly, then what they don't reach."""
    return simhash.one_of_each(docs, near.grouped)


@_small_batches
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of benchmark items; documents that are mostly such passages go."""
    return _recounted(decontaminate.remove(docs, table(spark, sf_dir, "benchmark")))


@_small_batches
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    coded = pieces.encode(docs, public_tokenizers.path(MODEL), keep=("doc_id", "lang", "source", "text"))
    exact = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("round_trip"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", encoding),
]

#: Language models and token ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
