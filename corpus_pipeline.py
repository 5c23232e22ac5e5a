"""The corpus pipeline: quality classifier, near-duplicates, benchmark decontamination, secrets, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents: the classifier drops what it rejects, one document of each
near-duplicate group stays, documents with a benchmark item go, secrets are masked in the text. The last adds domain,
n_tokens and epoch and has a row for each copy that the mixture takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontam, mixing, neardup, quality, secrets
from quarry.llm.common import read, store


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts, rows and columns unchanged. A null text is judged as the empty one; rows that
    repeat, or have no id, are judged by their texts; an empty table stays empty."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of the smallest id. Texts without a word stay all, null ones too; of
    rows that repeat one stays; an empty table stays empty."""
    return neardup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item at 0.75 or more. Null and empty texts stay; rows that repeat share their fate;
    an empty table, or benchmark, drops nothing."""
    return decontam.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a mask and n_chars brought up to date. Null and empty texts stay as
    they are; an empty table stays empty."""
    return secrets.mask_secrets(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mixture takes, with domain, n_tokens and epoch. Null texts have no tokens, null languages and
    sources are branches named unknown; rows that repeat are documents each; an empty table gives an empty mixture."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("mixture", mixture_stage),
]

#: The classifier is not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store(docs, f"pipeline{i}")
    return docs
