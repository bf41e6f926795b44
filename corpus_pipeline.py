"""Corpus pipeline: from raw documents to a training order, in five stages.

Each stage reads what its predecessor wrote as Parquet and keeps the columns of ``documents`` but
for the last, which returns the mix. A stage's decisions take effect: rejected documents go,
dropped lines are gone from the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import decontam, langid, lines, minhash, mixing
from shelfwise.llm.common import table
from shelfwise.session import scratch_path

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; learnt from a sample of the labelled ones."""
    return langid.accepted(docs.select(DOCUMENT), langid.train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from every document but the first that has them."""
    return lines.rewrite(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the smallest doc_id."""
    return minhash.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of what the other stages kept: every reading of a document, in training order."""
    return mixing.readings(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

ORACLE_SQL = None  # SQL can state neither the trained machines, nor near-duplicate classes, nor alignments


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows rest in the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
