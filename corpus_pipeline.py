"""A training-corpus pipeline: five operators of ``graphloom.llm`` in a row over ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and returns all columns of ``docs``; the last one adds the
token ids. Each stage works on all rows that the one before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, jaccard, langid, pii
from graphloom.llm._common import materialize
from graphloom.session import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or too far from every language's centroids, go; each row by its own text,
    so rows that repeat an id are judged apart and nulls go. Labels of the rows are what is learned from."""
    ship(spark)
    return langid.keep_identified(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the row of the smallest doc_id stays, null ids last;
    of rows that repeat an id and a text one stays. Texts without words all stay."""
    ship(spark)
    return jaccard.keep_representatives(docs, n=5, threshold=(8, 10))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark passages go, each row by its own text; null and
    empty texts stay."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; ``n_chars`` follows the text (null for null). All rows
    and columns stay."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType)) if "n_chars" in clean.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) to the columns; null texts have none."""
    ship(spark)
    return bpe.with_ids(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("byte_bpe", encode),
]

#: Hash sets, centroids and merges aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
