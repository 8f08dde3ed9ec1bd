"""Keyed writes on plain tables: insert-or-ignore, upserts, archives, rolling windows.

Every rule is a function from frames to the frame to append or to publish, so it also runs
inside ``foreachBatch``. Duplicates inside a batch are reduced by mergeable aggregates
before any shuffle, so a key that fills a third of a batch ships one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.ordered import earliest_by, latest_by
from gaugeworks.session import cut_lineage


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """The parquet table at ``path``, or no rows when nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def rows_to_insert(
    stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column | str]
) -> DataFrame:
    """First incoming row of each key that the store does not hold yet."""
    first = earliest_by(incoming, keys, order)
    known = stored.select(*keys).distinct()
    return first.join(known, list(keys), "left_anti").select(*incoming.columns)


def insert_counts(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: ``inserted`` and ``skipped`` of an insert-or-ignore.

    Incoming rows are counted per key first, so the join sees each key once.
    """
    per_key = incoming.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    known = stored.select(*keys).distinct().withColumn("_known", F.lit(True))
    flagged = per_key.join(known, list(keys), "left")
    fresh = F.col("_known").isNull()
    zero = F.lit(0).cast("long")
    return flagged.agg(
        F.count_if(fresh).alias("inserted"),
        F.coalesce(F.sum(F.when(fresh, F.col("_n") - 1).otherwise(F.col("_n"))), zero).alias(
            "skipped"),
    )


def flag_new(
    stored: DataFrame, incoming: DataFrame, key: str, order: Sequence[Column | str]
) -> DataFrame:
    """First row per non-empty key with ``is_new``; rows with an empty key are dropped,
    because one empty key would stand for many different items."""
    named = incoming.filter(F.coalesce(F.col(key), F.lit("")) != "")
    first = earliest_by(named, [key], order)
    known = stored.select(key).distinct().withColumn("_known", F.lit(True))
    return first.join(known, key, "left").select(
        *incoming.columns, F.col("_known").isNull().alias("is_new")
    )


def append_new(
    incoming: DataFrame,
    path: str,
    keys: Sequence[str],
    order: Sequence[Column | str],
    partition_by: Sequence[str] = (),
) -> None:
    """Insert-or-ignore into a parquet table; running it again for the same batch adds nothing."""
    stored = read_or_empty(incoming.sparkSession, path, incoming.schema)
    fresh = rows_to_insert(stored, incoming, keys, order)
    writer = fresh.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def upsert_seen(
    stored: DataFrame, incoming: DataFrame, keys: Sequence[str], *, seen: str = "seen_at"
) -> DataFrame:
    """Merged table: payload of the latest sighting, first_seen kept, last_seen refreshed.

    ``stored`` carries first_seen / last_seen, ``incoming`` a single ``seen`` instant.
    """
    fresh = incoming.withColumn("first_seen", F.col(seen)).withColumn("last_seen", F.col(seen))
    payload = [c for c in incoming.columns if c not in keys and c != seen]
    columns = [*keys, *payload, "first_seen", "last_seen"]
    both = stored.select(*columns, F.lit(0).alias("_side")).unionByName(
        fresh.select(*columns, F.lit(1).alias("_side"))
    )
    merged = both.groupBy(*keys).agg(
        F.max_by(F.struct(*payload), F.struct("last_seen", "_side")).alias("_p"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
    return merged.select(*keys, "_p.*", "first_seen", "last_seen")


def upsert_latest(
    stored: DataFrame, incoming: DataFrame, keys: Sequence[str], version: str, *,
    overwrite: bool = True,
) -> DataFrame:
    """Latest version per key. Without ``overwrite`` stored keys win (seed import)."""
    if not overwrite:
        fresh = rows_to_insert(stored, incoming, keys, [version])
        return stored.unionByName(fresh.select(*stored.columns))
    both = stored.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    return latest_by(both, keys, ["_side", version]).drop("_side")


def publish(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a table by a frame that may itself read it."""
    writer = cut_lineage(df).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def within_retention(
    df: DataFrame, now: Column, *, days: float = 0, hours: float = 0, ts: str = "ts"
) -> DataFrame:
    """Rows with ``ts >= now - retention``; on a day-partitioned table it also prunes."""
    micros = int((days * 24 + hours) * 3_600_000_000)
    return df.filter(F.col(ts) >= F.timestamp_micros(F.unix_micros(now) - micros))


def archive_rows(
    archive: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("site_id", "ts"),
    order: Sequence[Column | str] = ("ts",), enabled: bool = True,
) -> DataFrame:
    """Rows an append-only archive gains: exact duplicates by key never enter twice."""
    if not enabled:
        return incoming.limit(0)
    return rows_to_insert(archive, incoming, keys, order)


def bootstrap_rows(archive: DataFrame, rolling: DataFrame, ts: str = "ts") -> DataFrame:
    """Rolling rows with a timestamp, only while the archive is still empty."""
    if not archive.isEmpty():
        return rolling.limit(0)
    return rolling.filter(F.col(ts).isNotNull())


def roll_window(
    current: DataFrame, incoming: DataFrame, now: Column, *, keys: Sequence[str] = ("site_id", "ts"),
    days: float = 14, ts: str = "ts",
) -> DataFrame:
    """Rolling table after an append: inside the window, each key once, stored rows first."""
    kept = within_retention(current, now, days=days, ts=ts)
    fresh = within_retention(incoming, now, days=days, ts=ts)
    added = rows_to_insert(kept, fresh, keys, [ts])
    return kept.unionByName(added.select(*kept.columns))


def rewrite_rolling(
    incoming: DataFrame, name: str, now: Column, *, keys: Sequence[str] = ("site_id", "ts"),
    days: float = 14, ts: str = "ts",
) -> None:
    """Add rows to the day-partitioned table ``name`` and drop what left the window.

    Only the days the batch touches are read and rewritten (their names, at most one a day of
    the calendar, become literals that prune the partitions); expired days are dropped as whole
    partitions, which reads and writes no data.
    """
    spark = incoming.sparkSession
    fresh = within_retention(incoming, now, days=days, ts=ts).withColumn("day", F.to_date(ts))
    if not spark.catalog.tableExists(name):
        first = earliest_by(fresh, keys, [ts])
        first.select(*fresh.columns).write.partitionBy("day").format("parquet").saveAsTable(name)
        return
    current = spark.table(name)
    touched = [r["day"] for r in fresh.select("day").distinct().collect()]
    if touched:
        merged = roll_window(current.filter(F.col("day").isin(touched)), fresh.select(*current.columns), now,
                             keys=keys, days=days, ts=ts)
        # The rows replace what they are read from, hence the cut. The overwrite mode is an option of
        # this write; tables know it as a setting of the session alone.
        folder = spark.sql(f"DESCRIBE FORMATTED {name}").filter("col_name = 'Location'").first()["data_type"]
        cut_lineage(merged).select(*current.columns).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)
        days_named = " ".join(f"PARTITION (day='{day}')" for day in touched)
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {days_named}")
        spark.catalog.refreshTable(name)
    cutoff = F.to_date(F.timestamp_micros(F.unix_micros(now) - int(days * 86_400_000_000)))
    partitions = spark.sql(f"SHOW PARTITIONS {name}")
    stale = partitions.filter(
        F.to_date(F.regexp_extract("partition", r"day=(\d{4}-\d{2}-\d{2})", 1)) < cutoff
    )
    for row in stale.collect():  # partition names only, one per expired day
        day = row["partition"].split("=", 1)[1]
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (day='{day}')")


def ledger_rows(ledger: DataFrame, alerts: DataFrame, keys=("watch_id", "event_dedupe_key")):
    """Ledger rows to add; an empty event key is never recorded."""
    named = alerts.filter(F.coalesce(F.col(keys[1]), F.lit("")) != "")
    if set(ledger.columns) != set(keys):
        return rows_to_insert(ledger, named.select(*ledger.columns), keys, list(keys))
    # Rows are their keys alone: both sides are reduced in one shuffle, and no join is needed. A
    # null is no key that the ledger could hold.
    held = F.lit(True)
    for key in keys:
        held = held & F.col(key).isNotNull()
    both = named.select(*keys, F.lit(True).alias("_new")).unionByName(
        ledger.filter(held).select(*keys, F.lit(False).alias("_new")))
    return both.groupBy(*keys).agg(F.min("_new").alias("_new")).filter("_new").select(*ledger.columns)


def cascade_delete(
    parents: DataFrame, children: DataFrame, doomed: DataFrame, key: str
) -> tuple[DataFrame, DataFrame]:
    """Both tables without the doomed parents and their children."""
    ids = doomed.select(key).distinct()
    return parents.join(ids, key, "left_anti"), children.join(ids, key, "left_anti")


def ended_report(searches: DataFrame, status: str = "status") -> DataFrame:
    """Dry run of the prune: the rows it would delete."""
    return searches.filter(F.lower(F.trim(F.col(status))) == "ended")
