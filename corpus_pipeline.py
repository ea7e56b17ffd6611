"""Corpus pipeline: five stages over ``documents``, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm import decontam, jaccard_join, line_dedup, packing, quality
from lexweave.llm.common import materialize, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null texts are judged as empty; null and repeated ids like any other; an
    empty table gives an empty one. Other columns stay, whatever their names (so in all stages but the last)."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines aligned with an earlier document go, and documents that have nothing else. Rows with a null id or text, and
    empty texts, stay as they are; of rows that repeat an id one is shortened; an empty table gives an empty one."""
    return line_dedup.without_emptied(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the least doc_id. Null ids, null and empty texts stay;
    rows that repeat an id stay or go together; an empty table gives an empty one."""
    return jaccard_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go. Null ids and texts stay; rows that repeat an id go together; an empty
    table, of documents or items, is fine."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def cost_balanced_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences: null texts as empty ones, repeated rows each on their own, null ids as they
    are; an empty table gives no rows."""
    return packing.pack_with_public_vocabulary(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", cost_balanced_packing),
]

#: A trained model, hashing and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
