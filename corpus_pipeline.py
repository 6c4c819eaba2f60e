"""The corpus pipeline: stages that each call one of the training-data operators.

Every stage works on all rows that the one before it kept and defines nulls, empty
and long texts, ties, repeated rows, empty tables and clashing extra columns as its
operator does. All stages but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor.llm import decontaminate, mixing, quality, simhash, toxicity
from corridor.llm.common import fold, table
from corridor.scratch import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base limits or that a learned rule rejects go."""
    return quality.passing(docs, table(spark, sf_dir, "labels"))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity reaches one half go."""
    columns = docs.columns
    wrapped = docs.select(F.struct(*columns).alias("row"), "doc_id", "text")
    scored = toxicity.score(wrapped, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return scored.where("score < 0.5").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays: three-word shingles, three bits at most (as ``op4``)."""
    return simhash.deduplicate(docs, shingle=simhash.SHINGLE, radius=simhash.RADIUS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. Small pieces, since the workers of the stages before still hold memory."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), piece=1 << 20)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources drawn to their target weights: a row per draw, with its shard, place, pass and words."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("source mixing", mixture),
]

#: SQL cannot express learned rules, trees or retrieval.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents, each written and read again; the last is returned."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
