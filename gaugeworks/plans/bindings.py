"""How the operators' inputs are read from the given tables, with the SQL twins.

``events`` stands in for telemetry: the user is the site, the event type the channel, the
value the power. Samples lie hours apart, so gaps and tolerances are given in hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.timekeys import utc_literal
from gaugeworks.plans.registry import table

NOW = "2024-01-29 18:00:00"
CHANNELS = ("click", "error", "purchase", "signup", "view")
HVAC_CHANNELS = ("click", "view")
INTERVAL_MINUTES = 360
HOUR = 3600
# Odd factors keep the stand-in values away from rounding ties, which engines break apart.
WATTS = 3.14159
KWH = 0.01047197


def now():
    return utc_literal(NOW)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("site_id"), "ts", F.col("event_type").alias("channel"),
        (F.col("value") * WATTS).alias("power_w"),
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("site_id"), "ts",
        F.when(F.col("value") < 100, "downstairs").otherwise("upstairs").alias("zone"),
        F.when(kind == "view", "COOLING").when(kind == "purchase", "HEATING")
        .when(kind == "error", F.lit(None).cast("string")).otherwise("OFF").alias("action"),
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = INTERVAL_MINUTES * 60_000_000
    start = F.floor(F.unix_micros("ts") / width) * width
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("site_id"), F.timestamp_micros(start).alias("start_ts"))
        .agg((F.sum("value") * KWH).alias("kwh"))
        .select(
            "site_id", F.lit("meter").alias("provider"), "start_ts",
            F.timestamp_micros(F.unix_micros("start_ts") + width).alias("end_ts"), "kwh",
        )
    )


# SQL twins of the bindings above (January: local zone is UTC-6 throughout).
SQL_NOW = f"TIMESTAMP '{NOW}'"
SQL_S = f"""s AS (
  SELECT user_id AS site_id, ts, event_type AS channel, value * {WATTS} AS power_w,
         CAST(ts - INTERVAL 6 HOUR AS DATE) AS day
  FROM events)"""
SQL_T = f"""{SQL_S},
t AS (SELECT site_id, ts, any_value(day) AS day, sum(power_w) AS power_w
      FROM s GROUP BY site_id, ts)"""
SQL_Z = """z AS (
  SELECT user_id AS site_id, ts,
         CASE WHEN value < 100 THEN 'downstairs' ELSE 'upstairs' END AS zone,
         CASE event_type WHEN 'view' THEN 'COOLING' WHEN 'purchase' THEN 'HEATING'
              WHEN 'error' THEN NULL ELSE 'OFF' END AS action
  FROM events)"""
SQL_I = f"""i AS (
  SELECT user_id AS site_id, 'meter' AS provider,
         make_timestamp((epoch_us(ts) // 21600000000) * 21600000000) AS start_ts,
         make_timestamp((epoch_us(ts) // 21600000000 + 1) * 21600000000) AS end_ts,
         sum(value) * {KWH} AS kwh
  FROM events GROUP BY ALL)"""
