"""Log files as tables: one row per line with its time and level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import labels

STAMP = r"(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})"


def parse_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Adds ``ts`` (UTC, null without a stamp), ``level`` and ``is_error``."""
    day = F.regexp_extract(column, STAMP, 1)
    clock = F.regexp_extract(column, STAMP, 2)
    return lines.withColumns({
        "ts": F.try_to_timestamp(F.concat(day, F.lit(" "), clock), F.lit("yyyy-MM-dd HH:mm:ss")),
        "level": labels.log_level(column),
        "is_error": labels.is_error_line(column),
    })


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text logs with file name and order.

    ``line_no`` rises with the position in the file: text splits are numbered in order and
    lines within a split follow each other, so it orders lines without gathering a file.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"), F.col("value").alias("line"))
    numbered = raw.withColumn("line_no", F.struct("_block", "_seq")).drop("_block", "_seq")
    return parse_lines(numbered)
