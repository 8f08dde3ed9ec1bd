"""Registered queries: each reads the given tables whole and, where SQL can say the same,
carries an equivalent statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; naive timestamps are read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    for column in naive:
        df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df


def plain(df: DataFrame) -> DataFrame:
    """Dates as text and timestamps as microseconds, so results compare across engines."""
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind == "date":
            df = df.withColumn(field.name, F.col(field.name).cast("string"))
        elif kind == "timestamp":
            df = df.withColumn(field.name, F.unix_micros(field.name))
    return df
