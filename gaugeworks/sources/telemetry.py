"""JSON-lines telemetry: zone, power and host samples, from files or a stream of lines.

Every decoder takes a frame with a text column ``value`` (``spark.read.text`` or
``spark.readStream.text``) and drops lines that are blank, not JSON objects, or without a
usable timestamp. Nested maps are read as ``map<string,string>`` first, so that one odd
entry costs that entry and not its line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _object(line: Column) -> Column:
    """The line when it is a JSON object, else null."""
    return F.when(F.trim(line).startswith("{"), line)


def _entries(values: Column, schema: str) -> Column:
    """Entries of a raw map that are objects, parsed."""
    raw = F.coalesce(values, F.create_map().cast("map<string,string>"))
    objects = F.map_filter(raw, lambda k, v: F.trim(v).startswith("{"))
    return F.transform_values(objects, lambda k, v: F.from_json(v, schema))


ZONE_ENTRY = (
    "temperature double, humidity double, mode string, action string, setpoint double, online boolean"
)
POWER_ENTRY = (
    "voltage_v double, power_w double, current_a double, energy_forward_kwh double, "
    "energy_forward_kwh_inferred double, online boolean, source string"
)


def zone_records(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per line: ``keep`` columns, ``ts`` and ``zones`` (map of zone to readings)."""
    parsed = F.from_json(_object(F.col("value")), "timestamp string, thermostats map<string,string>")
    out = lines.withColumn("_p", parsed).withColumn("ts", F.col("_p.timestamp").try_cast("timestamp"))
    return out.filter(F.col("ts").isNotNull()).select(
        *keep, "ts", _entries(F.col("_p.thermostats"), ZONE_ENTRY).alias("zones"))


def zone_samples(lines: DataFrame, keep: Sequence[str] = ("site_id",)) -> DataFrame:
    """Long form: one row per line and zone."""
    return zone_records(lines, keep).select(*keep, "ts", F.explode("zones").alias("zone", "_e")).select(
        *keep, "ts", "zone", "_e.action", F.col("_e.temperature").cast("int").alias("temperature"),
        F.col("_e.humidity").cast("int").alias("humidity"), "_e.mode",
        F.col("_e.setpoint").cast("int").alias("setpoint"), "_e.online")


def power_records(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per line with source (null when empty), limited (default false), channels."""
    parsed = F.from_json(
        _object(F.col("value")),
        "timestamp string, source string, limited boolean, appliances map<string,string>")
    out = lines.withColumn("_p", parsed).withColumn("ts", F.col("_p.timestamp").try_cast("timestamp"))
    return out.filter(F.col("ts").isNotNull()).select(
        *keep, "ts", F.nullif("_p.source", F.lit("")).alias("source"),
        F.coalesce("_p.limited", F.lit(False)).alias("limited"),
        _entries(F.col("_p.appliances"), POWER_ENTRY).alias("channels"))


def power_samples(lines: DataFrame, keep: Sequence[str] = ("site_id",)) -> DataFrame:
    """Long form: one row per line and channel."""
    rows = power_records(lines, keep).select(
        *keep, "ts", "source", "limited", F.explode("channels").alias("channel", "_e"))
    return rows.select(
        *keep, "ts", "source", "limited", "channel", "_e.power_w", "_e.voltage_v", "_e.current_a",
        "_e.energy_forward_kwh", "_e.energy_forward_kwh_inferred", "_e.online")


_HOST_REQUIRED = ("load_1", "load_5", "load_15")
_HOST_OPTIONAL = (
    ("memory_used_percent", "double"), ("memory_used_bytes", "long"), ("memory_total_bytes", "long"),
    ("cpu_percent", "double"), ("cpu_temp_celsius", "double"), ("cpu_total_jiffies", "long"),
    ("cpu_idle_jiffies", "long"), ("cpu_threads", "int"), ("network_rx_bps", "double"),
    ("network_tx_bps", "double"),
)


def flexible_timestamp(text: Column) -> Column:
    """ISO text or epoch seconds."""
    return F.coalesce(
        F.timestamp_micros((text.try_cast("double") * 1_000_000).cast("long")),
        text.try_cast("timestamp"))


def host_samples(lines: DataFrame, keep: Sequence[str] = ("host",)) -> DataFrame:
    """Flat host samples. The three loads are required; any other value that is present
    must be a number, or the line is dropped."""
    names = [*_HOST_REQUIRED, *[n for n, _ in _HOST_OPTIONAL]]
    schema = "timestamp string, " + ", ".join(f"{n} string" for n in names)
    rows = lines.withColumn("_p", F.from_json(_object(F.col("value")), schema))
    fine = flexible_timestamp(F.col("_p.timestamp")).isNotNull()
    columns = []
    for name in _HOST_REQUIRED:
        value = F.col(f"_p.{name}").try_cast("double")
        fine = fine & value.isNotNull()
        columns.append(value.alias(name))
    for name, kind in _HOST_OPTIONAL:
        number = F.col(f"_p.{name}").try_cast("double")
        fine = fine & (F.col(f"_p.{name}").isNull() | number.isNotNull())
        columns.append(number.cast(kind).alias(name))
    return rows.filter(fine).select(
        *keep, flexible_timestamp(F.col("_p.timestamp")).alias("ts"), *columns)
