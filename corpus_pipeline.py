"""A training corpus from raw documents: languages, near duplicates, leaks, secrets, packing.

Every stage takes the documents that the one before kept, written as Parquet and read again; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.llm import decontamination, language, near_duplicates, packing, secrets
from lurewatch.llm.common import read
from lurewatch.llm.queries import tokenizer_path
from lurewatch.session import stage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or in the script of no language of the corpus, go."""
    return language.in_known_language(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links the one with the smallest id stays."""
    return near_duplicates.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontamination.clean_of_passages(docs, read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, their secrets are masked and ``n_chars`` follows."""
    masked = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    size = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
    return masked.withColumn("n_chars", size.cast(dict(docs.dtypes)["n_chars"]))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

# Language, similarity and packing are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
