"""Keyed state as batch jobs: throttling, alert decisions, lifecycles, pending batches.

What a keyed processor does row by row is written here as prefix questions ("the last
marker before this row") over time buckets, so one key never has to fit into one task. The
streaming forms in ``gaugeworks.streaming`` give the same answers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gaugeworks.operators.ordered import (
    DAY_SECONDS,
    bucket_of,
    carry_last,
    carry_last_of,
    carry_last_with_ties,
    latest_by,
)
from gaugeworks.session import cut_lineage

# ---- throttle ------------------------------------------------------------------------


def accepted_chain(times: np.ndarray, first: int, interval: int) -> np.ndarray:
    """Positions accepted from ``first`` on: each is the next one at least ``interval`` later."""
    picked = []
    at = first
    while at < len(times):
        picked.append(at)
        at = int(np.searchsorted(times, times[at] + interval))
    return np.array(picked, dtype=int)


def _next_starts(paths: DataFrame, keys: list[str], step: int, bucket_seconds: int) -> DataFrame:
    """``(keys, _from, _to)``: for each start of a path the first start at least ``step`` after
    the path's end, if there is one. It always lies in a later bucket."""
    none = F.lit(None).cast("long")
    ends = paths.select(*keys, F.timestamp_micros(F.col("_end") + step).alias("_at"), F.lit(0).alias("_kind"),
                        F.col("_start").alias("_from"), none.alias("_start"))
    starts = paths.select(*keys, F.timestamp_micros("_start").alias("_at"), F.lit(1), none, "_start")
    found = carry_last(ends.union(starts), keys, ["_at", "_kind"], F.col("_start"), "_to",
                       backwards=True, bucket_seconds=bucket_seconds)
    return found.filter("_from IS NOT NULL AND _to IS NOT NULL").select(*keys, "_from", "_to")


def _reached(first: DataFrame, jumps: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, _entry)``: all that can be reached from ``first`` over ``jumps`` from ``_from`` to
    ``_to``, which are doubled until none is left."""
    reached, jumps = cut_lineage(first), cut_lineage(jumps)
    # Most starts follow no path's end; jumps from these are never taken.
    met = jumps.select(*keys, F.col("_to").alias("_from")).union(reached.withColumnRenamed("_entry", "_from"))
    jumps = cut_lineage(jumps.join(met.distinct(), [*keys, "_from"], "left_semi"))
    while not jumps.isEmpty():
        ahead = reached.withColumnRenamed("_entry", "_from").join(jumps, [*keys, "_from"])
        reached = cut_lineage(reached.union(ahead.select(*keys, F.col("_to").alias("_entry"))))
        further = jumps.select(*keys, F.col("_from").alias("_to"), F.col("_to").alias("_far"))
        jumps = cut_lineage(jumps.join(further, [*keys, "_to"]).select(*keys, "_from", F.col("_far").alias("_to")))
    return reached


def throttle(
    df: DataFrame,
    keys: Sequence[str],
    interval_seconds: float,
    *,
    ts: str = "ts",
    bucket_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Instants accepted per key: the first one, then each at least the interval after the
    last accepted one.

    The choice is greedy, so it is not a window function. It is cut into three steps: every
    (key, bucket) works out where it would end for each instant it might start at (only the
    instants of its first interval qualify), these rows are chained by pointer doubling, and
    every bucket then marks its own rows from its known start. No step holds a whole key.
    """
    keys = list(keys)
    step = int(interval_seconds * 1_000_000)
    width = bucket_seconds * 1_000_000
    rows = df.select(*keys, F.unix_micros(ts).alias("_us")).distinct().withColumn(
        "_b", bucket_of(F.timestamp_micros("_us"), bucket_seconds))

    @pandas_udf("starts array<long>, ends array<long>")
    def transfer(bucket: pd.Series, times: pd.Series) -> pd.DataFrame:
        starts, ends = [], []
        for b, t in zip(bucket, times):
            last = np.searchsorted(t, t + step)
            last = np.where(last < len(t), last, np.arange(len(t)))
            while not np.array_equal(further := last[last], last):
                last = further  # twice as many steps each time
            stop = int(np.searchsorted(t, b * width + step)) + 1
            starts.append(t[:stop])
            ends.append(t[last[:stop]])
        return pd.DataFrame({"starts": starts, "ends": ends})

    @pandas_udf("array<long>")
    def mark(times: pd.Series, entry: pd.Series) -> pd.Series:
        return pd.Series([
            t[accepted_chain(t, int(np.searchsorted(t, e)), step)] for t, e in zip(times, entry)])

    # A bucket's array is bounded by its width and the sampling rate.
    buckets = rows.groupBy(*keys, "_b").agg(F.sort_array(F.collect_list("_us")).alias("_times"))
    tables = buckets.withColumn("_t", transfer("_b", "_times"))
    paths = tables.select(*keys, F.explode(F.arrays_zip(
        F.col("_t.starts").alias("start"), F.col("_t.ends").alias("end"))).alias("_z")).select(
        *keys, F.col("_z.start").alias("_start"), F.col("_z.end").alias("_end"))
    entries = _reached(rows.groupBy(*keys).agg(F.min("_us").alias("_entry")),
                       _next_starts(cut_lineage(paths), keys, step, bucket_seconds), keys).withColumn(
        "_b", bucket_of(F.timestamp_micros("_entry"), bucket_seconds))
    started = buckets.join(entries, [*keys, "_b"])
    kept = started.select(*keys, F.explode(mark("_times", "_entry")).alias("_us"))
    return kept.select(*keys, F.timestamp_micros("_us").alias(ts))


# ---- alerts --------------------------------------------------------------------------

def severity_of(status: Column) -> Column:
    return F.when(status == "ok", "healthy").when(status.isin("critical", "error"), "critical").otherwise(status)


def fingerprint_of(codes: Column) -> Column:
    """Issue codes joined by a bar; ``healthy`` without any."""
    return F.when(F.size(F.coalesce(codes, F.array().cast("array<string>"))) == 0, "healthy").otherwise(
        F.array_join(codes, "|"))


def _carried(keys: list[str], ts: str, tie: str | None, bucket_seconds: int):
    """How the last payloads before a row are found, with or without an order inside an instant."""
    if tie is None:
        return lambda rows, payloads: carry_last_of(rows, keys, [ts], payloads, bucket_seconds=bucket_seconds)
    return lambda rows, payloads: carry_last_with_ties(
        rows, keys, ts, tie, payloads, bucket_seconds=bucket_seconds)


def alert_decisions(
    results: DataFrame,
    keys: Sequence[str] = ("backup_id",),
    *,
    ts: str = "ts",
    tie: str | None = None,
    bucket_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """``decision`` (alert, recovery, none) per result, in time order of its key.

    Input: keys, ts, status, issue_codes and ``delivered`` (whether a message for this row
    gets through). An unhealthy row alerts unless its fingerprint was the last one sent. A
    healthy row is a recovery when something was wrong or sent before and no recovery was
    the last thing sent. Only delivered messages change what counts as last sent.

    A delivered bad row, or a delivered healthy row right after a bad one, sends something
    for certain. From the first such row on, every delivered row leaves its fingerprint (or
    ``healthy``) as the last one sent: it either sends it or repeats it. So two prefix
    lookups after the previous severity are enough, and they share one pass. A whole number ``tie``
    orders the rows of one instant, of which there may then be any number.
    """
    keys = list(keys)
    carried = _carried(keys, ts, tie, bucket_seconds)
    rows = results.withColumns({
        "severity": severity_of(F.col("status")), "fingerprint": fingerprint_of(F.col("issue_codes"))})
    rows = carried(rows, {"_prev": F.col("severity")})
    healthy = F.col("severity") == "healthy"
    was_bad = F.coalesce(F.col("_prev").isin("warning", "critical"), F.lit(False))
    sent = F.coalesce("delivered", F.lit(False))
    mark = F.when(healthy, F.lit("healthy")).otherwise(F.col("fingerprint"))
    rows = carried(rows, {
        "_opened": F.when(sent & (~healthy | was_bad), F.lit(True)), "_mark": F.when(sent, mark)})
    rows = rows.withColumn("last_sent", F.when(F.col("_opened").isNotNull(), F.col("_mark")))
    last = F.col("last_sent")
    decision = (
        F.when(~healthy, F.when(last == F.col("fingerprint"), "none").otherwise("alert"))
        .when(last == "healthy", "none")
        .when(was_bad | last.isNotNull(), "recovery").otherwise("none"))
    return rows.withColumn("decision", decision).drop("_prev", "_opened", "_mark")


# ---- lifecycle -----------------------------------------------------------------------

STATES = ("active", "paused", "ended")


def lifecycle(
    commands: DataFrame,
    keys: Sequence[str] = ("search_id",),
    *,
    ts: str = "ts",
    target: str = "target",
    initial: str = "active",
    tie: str | None = None,
    bucket_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Each command with the state it met and whether it was accepted.

    Active and paused lead to any other state, ended to none, and the same state is
    rejected. So the state a command meets is ``ended`` once any earlier command said so,
    else the last valid target before it, else the initial state. A whole number ``tie`` orders the
    commands of one instant, of which there may then be any number.
    """
    keys = list(keys)
    valid = F.when(F.col(target).isin(*STATES), F.col(target))
    rows = _carried(keys, ts, tie, bucket_seconds)(
        commands, {"_last": valid, "_over": F.when(F.col(target) == "ended", F.lit(True))})
    met = F.when(F.lit(initial == "ended") | F.col("_over").isNotNull(), "ended").otherwise(
        F.coalesce("_last", F.lit(initial)))
    rows = rows.withColumn("state_before", met).drop("_last", "_over")
    accepted = (F.col("state_before") != "ended") & F.col(target).isin(*STATES) & (
        F.col(target) != F.col("state_before"))
    return rows.withColumn("accepted", accepted).withColumn(
        "state_after", F.when(accepted, F.col(target)).otherwise(F.col("state_before")))


# ---- pending batches -----------------------------------------------------------------

TTL_MINUTES = 60


def pending_batches(
    saves: DataFrame, now: Column, keys: Sequence[str] = ("chat_key",), *, ts: str = "saved_at",
    ttl_minutes: float = TTL_MINUTES,
) -> DataFrame:
    """Latest batch per key while it has not expired; an expired one is absent."""
    latest = latest_by(saves, keys, [ts])
    expires = F.timestamp_micros(F.unix_micros(ts) + int(ttl_minutes * 60_000_000))
    return latest.withColumn("expires_at", expires).filter(F.col("expires_at") > now)


def remove_items(batches: DataFrame, targets: str, name_key, items: str = "items", key_field: str = "normalized_key"):
    """Items without those named by 1-based position or by name in a comma list."""
    parts = F.filter(F.transform(F.split(targets, ","), lambda t: F.trim(t)), lambda t: t != "")
    numbers = F.transform(F.filter(parts, lambda t: t.rlike(r"^\d+$")), lambda t: t.cast("int"))
    names = F.transform(F.filter(parts, lambda t: ~t.rlike(r"^\d+$")), name_key)
    out = batches.withColumn("_n", numbers).withColumn("_k", names)
    kept = F.filter(
        items, lambda x, i: ~F.array_contains(F.col("_n"), i + 1) & ~F.array_contains(F.col("_k"), x[key_field]))
    return out.withColumn(items, kept).drop("_n", "_k")
