"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, pieces.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents. Defined results for odd rows are those of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import decontamination, minhash, pii, quality_rules, sentencepieces
from veilspark.llm.common import stored, table

#: No SQL: MinHash components, template windows and piece lattices cannot be stated in it.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    return quality_rules.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least doc_id."""
    return minhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the name of their kind."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Scores and ids of each text's n best segmentations, best first, in the column pieces beside the columns of documents."""
    return sentencepieces.listed(docs)


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("pii", redact),
    ("sentencepieces", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each result is stored before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
