"""The corpus pipeline: five operators, each on all that the one before it kept.

Nulls in any column, empty and blank texts, rows without id, repeated rows and
very long texts go through every stage, and stay unless its decision is
against them: a text without words is judged by its score alone, has no line
to lose, is like no other text, contains no item and has size 0 in the mix.
Empty tables give an empty result.  Further columns pass through; those that
the mix makes (size, source_size, target, repetitions, taken, repetition) are
replaced where a table has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from mapweave.llm.common import Scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.5 or more."""
    return quality.drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates; n_chars follows the text."""
    left = line_dedup.drop_recurring_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their repetitions in the mix."""
    return mixing.mix(docs)


def source_repetition(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix carried out: one row for each repetition, none for documents that it leaves out."""
    return mixing.repeated(source_mixing(spark, docs, sf_dir))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("minhash_near_dedup", near_deduplication),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_repetition),
]

#: Trained rules, templates and connected components aren't stated in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again, and a stage's own tables go when it is done."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before = len(Scratch.open)
        docs = scratch.store(stage(spark, docs, sf_dir))
        Scratch.clear_since(before)
    return docs
