"""Helpers of the training-data operators: words, kept tables, clash-free columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.session import checkpoint_root

#: Runs of anything but blank and the control characters 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"
BREAK = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, _UPPER, _UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK), "")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share; gone when the session ends."""
    folder = f"{checkpoint_root(spark)}/llm-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def kept_table(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage like a reliable checkpoint and is read by column; lost executors cost
    only the tasks that ran on them.
    """
    folder = shared_folder(df.sparkSession)
    df.write.option("compression", compression).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
