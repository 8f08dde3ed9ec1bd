"""Stream operators as queries over batch frames.

The same functions serve streams and batches; successive batches are played one after the other.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.plans.bindings import (
    HOUR,
    SQL_I,
    SQL_NOW,
    SQL_Z,
    intervals,
    now,
    zones,
)
from gaugeworks.plans.registry import plain, query, table
from gaugeworks.session import shared_scratch
from gaugeworks.sinks import tables as sinks
from gaugeworks.sinks.archive import append_days, read_archive
from gaugeworks.streaming import samples as streams


def _archived(spark, rows, part, keys, order, ts):
    """A written archive after three successive batches, ``part`` saying which row is in which; the
    second batch is sent twice."""
    path = shared_scratch(spark, "archive")
    for number in (0, 1, 1, 2):
        append_days(rows.filter(part == number), path, f"{number:012d}", keys, order, ts=ts)
    return read_archive(spark, path, rows.schema, keys)


@query("x02_archive", f"""
WITH a AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id % 3, event_id) = 1)
SELECT user_id AS site_id, epoch_us(ts) AS ts, event_id, ts >= {SQL_NOW} - INTERVAL 336 HOUR AS rolling FROM a""")
def x02(spark, sf):
    """Every batch is stored once per key, whatever it repeats; the rolling view is the archive's
    last two weeks."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("site_id"), "ts", "event_id")
    repeated = e.union(e.filter("event_id % 3 = 0").withColumn("event_id", F.col("event_id") + 1_000_000_000))
    archive = _archived(spark, repeated, F.col("event_id") % 1_000_000_000 % 3, ["site_id", "ts"], ["event_id"], "ts")
    rolling = sinks.roll_window(archive.limit(0), archive, now()).select(
        "site_id", "ts", F.lit(True).alias("rolling"))
    return plain(archive.join(rolling, ["site_id", "ts"], "left").select(
        "site_id", "ts", "event_id", F.coalesce("rolling", F.lit(False)).alias("rolling")))


@query("x03_stream_sessions", f"""
WITH {SQL_Z}, c AS (SELECT site_id, zone, ts FROM z WHERE action = 'COOLING'),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY site_id, zone ORDER BY ts) < INTERVAL 36 HOUR THEN 0 ELSE 1 END AS fresh FROM c),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY site_id, zone ORDER BY ts) AS k FROM g)
SELECT site_id, zone, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) AS session_end, count(*) AS sample_count FROM n GROUP BY site_id, zone, k""")
def x03(spark, sf):
    return plain(streams.cooling_sessions(zones(spark, sf), gap="36 hours"))


@query("x04_stream_windows", """
WITH h AS (SELECT user_id AS host, ts, value / 5 AS cpu, value / 50 AS load, value / 7 AS mem FROM events),
w AS (SELECT *, make_timestamp((epoch_us(ts) // 21600000000 - k) * 21600000000) AS a FROM h, range(4) t(k))
SELECT host, epoch_us(a) AS window_start, epoch_us(a + INTERVAL 24 HOUR) AS window_end, max(cpu) AS cpu_peak, max(load) AS load_peak, max(mem) AS memory_peak,
  count_if(cpu > 70) * 60.0 AS saturated_minutes, count(*) AS sample_count FROM w GROUP BY host, a""")
def x04(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("host"), "ts", (F.col("value") / 5).alias("cpu_percent"),
        (F.col("value") / 50).alias("load_1"), (F.col("value") / 7).alias("memory_used_percent"))
    return plain(streams.host_windows(
        rows, length="24 hours", slide="6 hours", threshold=70.0, sample_seconds=HOUR))


@query("x07_late", f"""
WITH {SQL_I} SELECT site_id, provider, epoch_us(start_ts) AS start_ts, epoch_us(end_ts) AS end_ts, round(kwh, 9) AS kwh FROM i""")
def x07(spark, sf):
    """Intervals that come days late and again enter the table once."""
    rows = intervals(spark, sf)
    day = F.day("start_ts")
    keys = ["site_id", "provider", "start_ts", "end_ts"]
    late = _archived(spark, rows.union(rows.filter(day % 2 == 0)), day % 3, keys, ["start_ts"], "start_ts")
    return plain(late.select(*rows.columns).withColumn("kwh", F.round("kwh", 9)))
