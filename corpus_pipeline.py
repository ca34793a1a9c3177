"""From raw documents to a training mix: quality, near-duplicates, decontamination, pseudonyms, mixing.

Each stage takes the documents that the one before kept, as a written table, and returns documents with the same
columns; the last returns the mix, one row per document with the words taken of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.llm import decontamination, minhash, mixing, pseudonyms, quality_rules
from punctual.llm.tables import rows_of, saved, table

#: Jaccard similarity of five-word shingles, in per cent, from which two documents are near-duplicates.
NEAR = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rules, or the rules in the light of their host, reject."""
    return rows_of(docs, quality_rules.judge(docs).filter("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id."""
    return minhash.one_of_each(docs, percent=NEAR)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    judged = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return rows_of(docs, judged.filter(~F.col("contaminated")))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With pseudonyms in place of private values."""
    told = pseudonyms.pseudonymise(docs, pseudonyms.EXAMPLE_KEY).drop("n_private")
    if "n_chars" in docs.columns:
        told = told.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return told.select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: doc_id, source, size, source_size, target, and the words taken of each document."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("pseudonyms", private),
    ("mixing", mixed),
]

#: Links of similar sets and the balanced draw are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
