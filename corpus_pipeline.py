"""The corpus pipeline: stages over documents, each by an operator of leadloom.llm.

quality   rejects what fails the rules (operator 6)
near      keeps one document of each near-duplicate group, the smallest id (operator 9)
repeats   removes byte strings that repeat among what is left (operator 3)
private   masks personal data (operator 8)
pack      packs the texts into training sequences (operator 4)

All but the last return the columns of documents; the last returns pieces, by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadloom.llm import jaccard, packing, pii, quality, substrings
from leadloom.llm.common import read_table, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, read_table(spark, sf_dir, "labels"))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.dedup(docs)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("near", keep_one_of_near), ("repeats", remove_repeats), ("private", mask_private), ("pack", pack)]

#: No SQL: a trained model and tokenizers take part. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again for the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
