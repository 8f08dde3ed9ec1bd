"""An append-only archive by day that reads only the days a batch touches.

Layout below ``path``, one folder a batch:

* ``batch=<id>/day=<day>``: the rows that the batch added;
* ``_zones/batch=<id>``: the zone map, for each of these days the number of rows and the least and
  greatest value of every key column;
* ``_ledger/batch=<id>``: one row, written last. A batch without it does not exist for readers, so a
  run that broke off leaves nothing behind, and a batch that has it writes nothing when it runs again.

A key can only be stored already in a folder whose day and key ranges meet those of the batch. The
zone map names these folders; no other is listed or read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gaugeworks.operators.ordered import earliest_by
from gaugeworks.session import cut_lineage
from gaugeworks.sinks.tables import read_or_empty

_LEDGER = "batch string, rows long"


def _zone_schema(schema: StructType, keys: Sequence[str]) -> str:
    kinds = {k: schema[k].dataType.simpleString() for k in keys}
    ranges = ", ".join(f"`least_{k}` {t}, `greatest_{k}` {t}" for k, t in kinds.items())
    return f"batch string, day date, rows long, {ranges}"


def zones(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of rows and key ranges per day."""
    return rows.groupBy("day").agg(
        F.count(F.lit(1)).alias("rows"),
        *[f(k).alias(f"{name}_{k}") for k in keys for name, f in (("least", F.min), ("greatest", F.max))])


def _committed(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    ledger = read_or_empty(spark, f"{path}/_ledger", _LEDGER)
    return read_or_empty(spark, f"{path}/_zones", _zone_schema(schema, keys)).join(
        ledger.select("batch"), "batch", "left_semi")


def _folder(path: str, batch: str, day) -> str:
    name = "__HIVE_DEFAULT_PARTITION__" if day is None else day.isoformat()
    return f"{path}/batch={batch}/day={name}"


def touched_folders(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str]) -> list[str]:
    """Folders that may hold a key of ``incoming``, which has a ``day``.

    One name a folder comes to the driver, as any read of files needs. Keys with a null are never
    equal to a stored one, so days without any instant are not asked for.
    """
    own = zones(incoming, keys).drop("rows")
    own = own.select("day", *[F.col(f"{side}_{k}").alias(f"_{side}_{k}") for k in keys for side in ("least", "greatest")])
    meets = reduce(lambda a, b: a & b, [
        (F.col(f"least_{k}") <= F.col(f"_greatest_{k}")) & (F.col(f"_least_{k}") <= F.col(f"greatest_{k}")) for k in keys])
    found = _committed(spark, path, incoming.schema, keys).join(own, "day").filter(meets).select("batch", "day").collect()
    return sorted(_folder(path, r["batch"], r["day"]) for r in found)


def _read(spark: SparkSession, path: str, folders: list[str], schema: StructType) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).select(*schema.names)


def append_days(
    incoming: DataFrame, path: str, batch: str, keys: Sequence[str], order: Sequence[Column | str],
    *, ts: str = "ts",
) -> None:
    """Insert-or-ignore of a batch: the first row of every key that the archive does not hold.

    Batches are appended one after the other; running one again adds nothing.
    """
    spark, keys = incoming.sparkSession, list(keys)
    done = read_or_empty(spark, f"{path}/_ledger", _LEDGER).filter(F.col("batch") == batch)
    if not done.isEmpty():
        return
    first = cut_lineage(earliest_by(incoming.withColumn("day", F.to_date(ts)), keys, order))
    known = _read(spark, path, touched_folders(spark, path, first, keys), first.schema)
    fresh = first.join(known.select(*keys), keys, "left_anti").select(*first.columns)
    # Rows of a day meet, so that a day is a few files and not one from every task; large days are split.
    fresh.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch}")
    # Read back by key columns alone; an empty batch leaves no files.
    added = read_or_empty(spark, f"{path}/batch={batch}", first.schema)
    zones(added, keys).write.mode("overwrite").parquet(f"{path}/_zones/batch={batch}")
    rows = read_or_empty(spark, f"{path}/_zones/batch={batch}", _zone_schema(first.schema, keys)).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    rows.write.mode("overwrite").parquet(f"{path}/_ledger/batch={batch}")


def read_archive(
    spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], *, first_day=None, last_day=None,
) -> DataFrame:
    """Rows of all batches in the ledger with their ``day``, from ``first_day`` to ``last_day`` if given.

    ``schema`` is that of the rows as they came in. Days outside are neither listed nor read.
    """
    found = _committed(spark, path, schema, keys)
    if first_day is not None:
        found = found.filter(F.col("day") >= F.lit(first_day))
    if last_day is not None:
        found = found.filter(F.col("day") <= F.lit(last_day))
    folders = [_folder(path, r["batch"], r["day"]) for r in found.select("batch", "day").collect()]
    return _read(spark, path, sorted(folders), StructType([*schema.fields]).add("day", "date"))
