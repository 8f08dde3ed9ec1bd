"""One registered query per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import (
    collocations,
    crf,
    decontaminate,
    filter_audit,
    gam,
    line_dedup,
    mixing,
    ngram_lm,
    packing,
    quality_rules,
    reshard,
    simhash,
    sql,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_leaks(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").alias("n_items"),
        F.col("leaks.item_id").alias("item_ids"), F.col("leaks.edits").alias("edits"))


def op3_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From an uneven layout (by source) to 24 shards of equal bytes."""
    old = F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(24))
    rows = reshard.rewrite(_table(spark, sf_dir, "documents"), old, 24)
    return rows.select(
        F.col("_key").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("_old").alias("old_shard"))


def _remainder(key: str, parts: int) -> Column:
    return F.crc32(F.col(key).cast("string")) % parts


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"),
                     held_out=_remainder("doc_id", 5) == 0)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = warc.write(_table(spark, sf_dir, "pages"))
    return warc.read(written).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropped line numbers as text, ``1,4``."""
    rows = line_dedup.report(_table(spark, sf_dir, "documents"))
    return rows.withColumn("dropped", F.array_join(F.col("dropped").cast("array<string>"), ","))


def op7_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.identify(_table(spark, sf_dir, "documents"), held_out=_remainder("doc_id", 4) == 2)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op10_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(_table(spark, sf_dir, "documents"), held_out=_remainder("doc_id", 5) == 1)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_simhash, op2_decontamination, op3_reshard, op4_quality_gam, op5_warc, op6_line_dedup, op7_language_crf,
        op8_quality_rules, op9_packing, op10_ngram_lm, op11_mixing, op12_collocations,
        op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return sql.oracles()
