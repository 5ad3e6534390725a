"""Corpus pipeline: quality filter, exact dedup, near-duplicate removal, decontamination, BPE encoding.

Each stage takes the documents that the one before kept, as Parquet in the shared folder, and its decision
takes effect on all of them. The first four return the columns of `documents`; the last returns one row
per document that is left: doc_id, n_tokens, ids_sha256, decoded_sha256.

Every stage judges each row by its own text. Null text counts as empty; empty texts are scored like others,
are copies of each other, have no shingles (so they are near nothing), no benchmark words and no tokens.
Rows that repeat an id with different texts stay or go one by one, as do rows without an id. Of rows equal
in what a stage compares, ties included, exactly one stays: that with the smallest id, nulls last. Empty
tables pass through. Other columns are kept, whatever their names, but for the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stockyard.llm import bpe, decontamination, exact_dedup, quality, similarity_join
from stockyard.llm.common import stored, table
from stockyard.llm.entries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on their labels, scores 0.3 or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, white space aside, the document with the smallest id."""
    return exact_dedup.deduplicate(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.75 or more, the one with the smallest id."""
    return similarity_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return bpe.encode(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: SQL has neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
