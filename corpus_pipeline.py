"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and what its predecessor kept; all but the last return the
columns of ``documents``. Small side tables (labels, benchmark) are read from sf_dir.

In every stage other columns than the five are left behind, a null or empty text is an empty
document and a long one is read whole, documents that share a doc_id or have none are told apart by
their texts, and an empty table gives one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veldspar.llm import decontam, line_dedup, packing, quality, simhash
from veldspar.llm.common import shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more; the model learns from their labels.

    Each row goes or stays by its own text, so rows that repeat do so together. Without labels all score 0.5 and go.
    """
    return quality.keep_good(docs.select(*COLUMNS), quality.train_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier one: one edit for each ten characters apart, two at most.

    Blank lines stay. The first of a class is that of the smallest doc_id, a null one before all. Rows that agree in
    doc_id and text keep their lines alike; null texts stay null.
    """
    return line_dedup.drop_repeated_lines(docs.select(*COLUMNS))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id, a null one last, and of those the least hash of the text.

    Null and empty texts are copies of one another.
    """
    return simhash.keep_one_each(docs.select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``; each row goes or stays by its own text, null texts stay."""
    return decontam.keep_clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens; a null or empty text is its end id alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_near_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: Trained models, tokenizers and fingerprints aren't SQL: tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's result is a table in the shared folder, from which the next reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
