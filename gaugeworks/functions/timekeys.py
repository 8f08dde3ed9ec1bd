"""Calendar keys, windows and labels. Instants are UTC; zones matter only for buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_ZONE = "America/Chicago"


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def local_time(ts: Column | str, tz: str = DEFAULT_ZONE) -> Column:
    return F.from_utc_timestamp(_c(ts), tz)


def local_day(ts: Column | str, tz: str = DEFAULT_ZONE) -> Column:
    return F.to_date(local_time(ts, tz))


def local_hour(ts: Column | str, tz: str = DEFAULT_ZONE) -> Column:
    return F.hour(local_time(ts, tz))


def local_month(ts: Column | str, tz: str = DEFAULT_ZONE) -> Column:
    return F.date_format(local_time(ts, tz), "yyyy-MM")


def day_start(day: Column | str, tz: str = DEFAULT_ZONE) -> Column:
    """UTC instant of local midnight; days with a clock change keep their 23 or 25 hours."""
    return F.to_utc_timestamp(_c(day).cast("timestamp"), tz)


def day_end(day: Column | str, tz: str = DEFAULT_ZONE) -> Column:
    return F.to_utc_timestamp(F.date_add(_c(day), 1).cast("timestamp"), tz)


def utc_literal(value: str) -> Column:
    """``2024-01-30 12:00:00`` as a UTC instant, whatever the session zone is."""
    return F.lit(f"{value}Z").cast("timestamp")


def days_cutoff(now: Column, days: int, tz: str = DEFAULT_ZONE) -> Column:
    """Local midnight that starts the last ``days`` local days, today included."""
    return day_start(F.date_sub(local_day(now, tz), days - 1), tz)


def completed_days(now: Column, days: int, tz: str = DEFAULT_ZONE, include_today: bool = False):
    """(first day, last day) of a look-back over finished local days."""
    if days < 1:
        raise ValueError("days must be at least 1")
    today = local_day(now, tz)
    last = today if include_today else F.date_sub(today, 1)
    return F.date_sub(last, days - 1), last


NAMED_WINDOWS = ("last_24h", "today", "yesterday")


def named_windows(spark: SparkSession, now: str, tz: str = DEFAULT_ZONE) -> DataFrame:
    """Three rows: ``window``, ``window_start``, ``window_end``, half-open in UTC."""
    instant = utc_literal(now)
    today = day_start(local_day(instant, tz), tz)
    yesterday = day_start(F.date_sub(local_day(instant, tz), 1), tz)
    rows = F.array(
        F.struct(F.lit("last_24h").alias("window"),
                 (instant - F.expr("INTERVAL 24 HOURS")).alias("window_start"),
                 instant.alias("window_end")),
        F.struct(F.lit("today").alias("window"), today.alias("window_start"),
                 instant.alias("window_end")),
        F.struct(F.lit("yesterday").alias("window"), yesterday.alias("window_start"),
                 today.alias("window_end")),
    )
    return spark.range(1).select(F.inline(rows))


def tag_named_windows(df: DataFrame, ts: str, now: str, tz: str = DEFAULT_ZONE) -> DataFrame:
    """One output row per (row, named window holding it): a map-side explode, no join."""
    instant = utc_literal(now)
    today = day_start(local_day(instant, tz), tz)
    yesterday = day_start(F.date_sub(local_day(instant, tz), 1), tz)
    t = F.col(ts)
    hit = F.array_compact(F.array(
        F.when((t >= instant - F.expr("INTERVAL 24 HOURS")) & (t < instant), F.lit("last_24h")),
        F.when((t >= today) & (t < instant), F.lit("today")),
        F.when((t >= yesterday) & (t < today), F.lit("yesterday")),
    ))
    lower = F.least(instant - F.expr("INTERVAL 24 HOURS"), yesterday)
    return df.filter((t >= lower) & (t < instant)).withColumn("window", F.explode(hit))


def time_label(ts: Column | str, tz: str = DEFAULT_ZONE) -> Column:
    """``2:35 PM``"""
    return F.date_format(local_time(ts, tz), "h:mm a")


def datetime_label(ts: Column | str, tz: str = DEFAULT_ZONE) -> Column:
    """``Jun 30, 2:35 PM``"""
    return F.date_format(local_time(ts, tz), "MMM d, h:mm a")


def interval_label(start: Column | str, end: Column | str, tz: str = DEFAULT_ZONE) -> Column:
    """``9 PM–9:15 PM``: full hours drop their minutes."""

    def short(ts: Column | str) -> Column:
        local = local_time(ts, tz)
        return F.when(F.minute(local) == 0, F.date_format(local, "h a")).otherwise(
            F.date_format(local, "h:mm a")
        )

    return F.concat(short(start), F.lit("–"), short(end))


# Size suffixes and their factors, binary ones first.
SIZE_FACTORS = (
    ("Ki", 1024), ("Mi", 1024**2), ("Gi", 1024**3), ("Ti", 1024**4),
    ("K", 1000), ("M", 1000**2), ("G", 1000**3), ("T", 1000**4),
)


def size_to_bytes(text: Column | str) -> Column:
    """``12Gi`` or ``1.5G`` to bytes; null when it is not a size."""
    value = F.trim(_c(text))
    suffix = F.regexp_extract(value, r"([KMGT]i?)$", 1)
    factors = F.create_map(*[F.lit(x) for pair in SIZE_FACTORS for x in pair])
    number = F.regexp_replace(value, r"[KMGT]i?$", "").try_cast("double")
    factor = F.when(suffix == "", F.lit(1)).otherwise(F.element_at(factors, suffix))
    return (number * factor).try_cast("long")


def rate_label(bps: Column | str) -> Column:
    """Bytes per second as B/s, KB/s or MB/s."""
    value = _c(bps)
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(value >= 1024 * 1024, F.format_string("%.1f MB/s", value / (1024 * 1024)))
        .when(value >= 1024, F.format_string("%.1f KB/s", value / 1024))
        .otherwise(F.format_string("%.0f B/s", value))
    )


def gigabytes_label(size: Column | str) -> Column:
    return F.when(_c(size).isNotNull(), F.format_string("%.1f GB", _c(size) / float(1024**3)))


def mean_kw(kwh: Column | str, interval_minutes: int = 15) -> Column:
    """Energy of one interval as the mean power over it."""
    if interval_minutes <= 0:
        raise ValueError("interval_minutes must be positive")
    return F.round(_c(kwh) * F.lit(60.0 / interval_minutes), 4)
