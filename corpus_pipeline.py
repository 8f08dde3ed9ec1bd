"""Corpus pipeline: quality rules, line dedup, near-duplicates, leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
again as the next stage's ``docs``. All but the last keep the columns of ``documents``.

Defined cases: rows that repeat a key share its fate in the first stage and are one document in
the third, where one row of each group stays; other columns are carried through; an empty table
passes every stage and packs into nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from gaugeworks.llm.shared import shared_folder


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the rules reject go."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: lines with an equal or near earlier line go, and documents left without any."""
    return line_dedup.clean(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each group of linked fingerprints stays.

    Shingles are of five words here; fingerprints link at 4 of 64 bits.
    """
    return simhash.first_of_each(docs, shingle=5)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a benchmark item go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the pieces of what is left, in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", rules), ("line_dedup", lines), ("near_duplicates", near_duplicates),
    ("decontamination", leaks), ("packing", packed),
]

#: Edit joins, fingerprints and token ids have no SQL form; the stages are tested against brute
#: force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = f"{shared_folder(spark)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
