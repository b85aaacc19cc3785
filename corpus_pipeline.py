"""The corpus pipeline: five stages from raw documents to a mixed training corpus, each written and reread.

All stages keep the columns of their input, whatever their names, take whole texts of any length, and give an empty table
for an empty one. Null ids are rows like any other. Null and empty texts: the quality stage keeps them if the score of
an empty text is 0.5 or more, the language stage drops them, as they have no language; deduplication and decontamination
keep them; the mix takes them 0 times. Repeated rows: one stays after deduplication. Ties: see the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import decontam, jaccard, language, mixing, quality
from pagemill.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labelled rows of its input."""
    return quality.keep_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that makes up most of the text."""
    return language.keep_languages(docs, language.fit_languages(docs))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by five-word shingles and a similarity of 0.8 or more."""
    return jaccard.keep_one(docs, 5, 80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
]

# Classifiers and near-duplicate groups can't be expressed in SQL; a test compares run() with plain_pipeline().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
