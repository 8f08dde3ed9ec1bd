"""Host metrics: peak windows, saturation, operating issues, network rates, sensors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.ordered import top_n

SATURATION_PERCENT = 90.0


def metric_windows(
    samples: DataFrame,
    now: Column,
    keys: Sequence[str] = ("host",),
    *,
    sample_seconds: float = 60.0,
    threshold: float = SATURATION_PERCENT,
) -> DataFrame:
    """Peaks, temperatures and saturation minutes per host over 1 h, 24 h and the UTC day.

    One aggregate over rows of the last 24 hours; every window is a condition inside it.
    """
    hour_ago = F.col("ts") >= now - F.expr("INTERVAL 1 HOUR")
    today = F.col("ts") >= F.date_trunc("DAY", now)
    rows = samples.filter((F.col("ts") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") <= now))
    minutes = sample_seconds / 60.0

    def peak(column: str, when: Column | None = None) -> Column:
        return F.max(F.col(column) if when is None else F.when(when, F.col(column)))

    hot = F.col("cpu_percent") > threshold
    recent = F.when(hour_ago, F.col("ts"))
    any_recent = F.count_if(hour_ago) > 0
    return rows.groupBy(*keys).agg(
        peak("memory_used_percent", hour_ago).alias("memory_percent_1h"),
        peak("memory_used_percent").alias("memory_percent_24h"),
        peak("memory_used_bytes", hour_ago).alias("memory_bytes_1h"),
        peak("memory_used_bytes").alias("memory_bytes_24h"),
        peak("load_1", hour_ago).alias("load_1h"), peak("load_1").alias("load_24h"),
        peak("cpu_percent", hour_ago).alias("cpu_1h"), peak("cpu_percent").alias("cpu_24h"),
        peak("cpu_temp_celsius", today).alias("temp_high_today"),
        peak("cpu_temp_celsius").alias("temp_high_24h"),
        F.round(F.avg(F.when(hour_ago, F.col("cpu_temp_celsius"))), 4).alias("temp_avg_1h"),
        F.when(any_recent, F.count_if(hour_ago & hot) * minutes).alias("saturated_minutes_1h"),
        (F.count_if(hot) * minutes).alias("saturated_minutes_24h"),
        F.max_by("cpu_percent", recent).alias("cpu_now"),
        F.max_by("cpu_temp_celsius", recent).alias("temp_now"),
        F.max_by("cpu_threads", "ts").alias("cpu_threads"),
        F.count(F.lit(1)).alias("sample_count"), F.count_if(hour_ago).alias("sample_count_1h"),
    )


def operating_issues(
    windows: DataFrame,
    *,
    temp_warn: float = 80, temp_fail: float = 90, minutes_warn: float = 10,
    minutes_fail: float = 30,
) -> DataFrame:
    """``issues``: severity and message for temperature and saturation, empty when fine."""
    temp, minutes = F.col("temp_now"), F.col("saturated_minutes_1h")
    shown = F.concat(F.format_string("%.0f", temp), F.lit("°C"))
    spent = F.when(minutes < 1, F.lit("<1 min")).otherwise(F.format_string("%.0f min", minutes))

    def issue(severity: str, message: Column) -> Column:
        return F.struct(F.lit(severity).alias("severity"), message.alias("message"))

    heat = F.when(temp >= temp_fail, issue("FAIL", F.concat(F.lit("CPU temperature critical: "), shown))).when(
        temp >= temp_warn, issue("WARN", F.concat(F.lit("CPU temperature high: "), shown)))
    busy = F.concat(F.lit("CPU above 90% for "), spent, F.lit(" in the last hour"))
    load = F.when(minutes >= minutes_fail, issue("FAIL", busy)).when(
        minutes >= minutes_warn, issue("WARN", busy))
    return windows.withColumn("issues", F.array_compact(F.array(heat, load)))


# Fields that may hold a rate, first usable one wins.
RECEIVE_FIELDS = ("bytes_recv_rate", "bytes_recv_rate_per_sec", "speed_recv", "rx", "cumulative_rx")
SEND_FIELDS = ("bytes_sent_rate", "bytes_sent_rate_per_sec", "speed_sent", "tx", "cumulative_tx")


def network_rate(entry: Column, fields: Sequence[str]) -> Column:
    """First non-negative rate of a ``map<string,string>`` interface entry."""
    values = [F.try_element_at(entry, F.lit(f)).try_cast("double") for f in fields]
    return F.coalesce(*[F.when(v >= 0, v) for v in values])


def network_totals(interfaces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Receive and send rate per key without loopback; null when no rate was seen.

    Input: keys, ``entry`` map with ``interface_name`` or ``name``.
    """
    name = F.lower(F.coalesce(
        F.nullif(F.try_element_at("entry", F.lit("interface_name")), F.lit("")),
        F.try_element_at("entry", F.lit("name")), F.lit("")))
    rows = interfaces.withColumn("_loop", name.isin("lo", "loopback"))
    rx = F.when(~F.col("_loop"), network_rate(F.col("entry"), RECEIVE_FIELDS))
    tx = F.when(~F.col("_loop"), network_rate(F.col("entry"), SEND_FIELDS))
    return rows.groupBy(*keys).agg(F.sum(rx).alias("rx_bps"), F.sum(tx).alias("tx_bps"))


# Which labels name the CPU package, a core, and the order of preference.
PACKAGE_LABEL = r"(?i)package|x86_pkg|pkg_temp|cpu.?package"
CORE_LABEL = r"(?i)core\s*\d|coretemp"
LABEL_PRIORITY = (
    "x86_pkg_temp", "package id 0", "package id", "cpu", "core 0", "coretemp", "k10temp", "acpitz",
)
CPU_LABEL = r"(?i)(pkg|package|coretemp|k10temp|x86_pkg|cpu|acpitz)"


def label_rank(label: Column) -> Column:
    lower = F.lower(F.trim(label))
    rank = F.when(lower.rlike(CPU_LABEL), len(LABEL_PRIORITY)).otherwise(len(LABEL_PRIORITY) + 1)
    for i in reversed(range(len(LABEL_PRIORITY))):
        rank = F.when(lower.contains(LABEL_PRIORITY[i]), i).otherwise(rank)
    return rank


def cpu_temperature(sensors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Value of the best-labelled core temperature. Input: keys, type, label, value, position."""
    usable = sensors.filter((F.col("type") == "temperature_core") & F.col("value").isNotNull())
    rank = F.struct(label_rank(F.coalesce("label", F.lit(""))), F.col("position"))
    return usable.groupBy(*keys).agg(F.min_by("value", rank).alias("cpu_temp_celsius"))


def sensor_summary(sensors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Package (or hottest), hottest core and hottest sensor, a sensor named once.

    Input: keys, label, value, position; three filtered maxima in one aggregate.
    """
    rows = sensors.filter(F.col("value").isNotNull())
    hot = F.struct(F.col("value").alias("v"), (-F.col("position")).alias("p"))
    item = F.struct("label", "value")
    core = F.col("label").rlike(CORE_LABEL)
    package = F.col("label").rlike(PACKAGE_LABEL)
    picked = rows.groupBy(*keys).agg(
        F.min_by(item, F.when(package, F.col("position"))).alias("_pkg"),
        F.max_by(item, F.when(core, hot)).alias("_core"), F.max_by(item, hot).alias("_top"))

    def row(name: str, sensor: Column) -> Column:
        return F.when(sensor.isNotNull(), F.struct(
            F.lit(name).alias("role"), sensor["label"].alias("label"), sensor["value"].alias("value")))

    three = F.array_compact(F.array(
        row("CPU Package", F.coalesce("_pkg", "_top")), row("Core Max", F.col("_core")),
        row("Highest System Temp", F.col("_top"))))
    labels = F.transform(F.col("_rows"), lambda r: r["label"])
    once = F.filter("_rows", lambda r, i: F.array_position(labels, r["label"]) == i + 1)
    return picked.withColumn("_rows", three).select(*keys, F.inline(once))


def top_processes(processes: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    """Busiest ``n`` processes per snapshot. Input: keys, name, username, cpu_percent, pid."""
    named = processes.filter(F.col("cpu_percent").isNotNull()).withColumn(
        "name", F.coalesce(F.nullif("name", F.lit("")), F.nullif("username", F.lit("")), F.lit("unknown")))
    return top_n(named, keys, [F.col("cpu_percent").desc(), F.col("pid").asc()], max(1, n))
