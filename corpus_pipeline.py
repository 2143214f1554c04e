"""Corpus pipeline: the stages a document passes on its way into the training mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_crf, mixing, phrase_index, simhash, sparse_suffix
from tidemark.llm.common import WorkTables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, fitted on ``labels``, rejects go."""
    model = line_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_crf.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the smallest id."""
    return simhash.one_per_group(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay only in the document with the smallest id; ``n_chars`` follows the text."""
    cut = sparse_suffix.without_repeats(docs).select(*docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which ten consecutive words of a benchmark item occur go."""
    return phrase_index.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left."""
    return mixing.taken(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

# A trained classifier is among the stages, so no SQL gives the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder and read again."""
    tables = WorkTables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tables.write(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
