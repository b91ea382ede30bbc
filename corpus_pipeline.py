"""Corpus pipeline: documents through quality rules, near-copy removal, repeat removal, mixing and BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are
written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import bpe, jaccard_join, mixing, quality, suffix_dedup
from tempora.llm.shared import written


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: rows that go to Python at a time: Spark's 10,000 are 33 MB of texts of 3 KB, of which a task holds several copies in
#: the JVM and in Python, and some stages send a text twice
BATCH_ROWS = 2_000


def in_small_batches(stage: Stage) -> Stage:
    """The stage, in a session whose batches to Python have so many rows at most; a lower setting stays."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:  # 0 and less: no bound
            spark.conf.set(rows, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality_filter(docs)


#: words of a shingle and percent of Jaccard similarity from which documents are near copies
NEAR_WORDS, NEAR_PERCENT = 5, 80


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram Jaccard similarity."""
    return jaccard_join.drop_near_copies(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


#: bytes of a string that is not to occur twice: passages of 50 words have some 290 bytes and more
REPEAT_BYTES = 240


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of that length that occur more than once."""
    out = suffix_dedup.drop_repeats(docs, size=REPEAT_BYTES)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of the labelled domains ask for."""
    labels = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mix(docs, labels, mixing.TARGETS, anchor="good")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids beside the columns of the documents."""
    return bpe.encode(docs)


STAGES = [
    ("quality rules", in_small_batches(quality_rules)),
    ("n-gram Jaccard join", in_small_batches(near_copies)),
    ("suffix-array dedup", in_small_batches(repeated_passages)),
    ("mixing to target weights", in_small_batches(mixed)),
    ("BPE encoding", in_small_batches(encoded)),
]

#: SQL cannot express the learned mixing or BPE merges; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
