"""Sample-series operators: integration, coverage, gaps, counters, kW series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gaugeworks.functions.timekeys import DEFAULT_ZONE, day_end, day_start, local_day, mean_kw
from gaugeworks.operators.ordered import (
    DAY_SECONDS,
    carry_last,
    gap_sessions,
    latest_by,
    seconds_between,
    with_halo,
)

MAX_GAP_SECONDS = 300
POLL_SECONDS = 60
CYCLE_GAP_SECONDS = 15 * 60
COOLING = "COOLING"
HEATING = "HEATING"


def add_local_day_window(df: DataFrame, ts: str = "ts", tz: str = DEFAULT_ZONE) -> DataFrame:
    """Tag each row with its local day and that day's UTC bounds."""
    day = local_day(ts, tz)
    return (
        df.withColumn("day", day)
        .withColumn("window_start", day_start("day", tz))
        .withColumn("window_end", day_end("day", tz))
    )


def channel_totals(
    samples: DataFrame,
    keys: Sequence[str],
    *,
    ts: str = "ts",
    channel: str = "channel",
    watts: str = "power_w",
    channels: Sequence[str] | None = None,
) -> DataFrame:
    """Sum of the valid readings of the wanted channels at each timestamp.

    Timestamps without any valid reading drop out here, before anything looks at the next
    row; that is what makes a per-channel and an all-channel result differ.
    """
    valid = samples.filter(F.col(watts).isNotNull())
    if channels is not None:
        valid = valid.filter(F.col(channel).isin(*channels))
    return valid.groupBy(*keys, ts).agg(F.sum(watts).alias(watts))


def integrate_power(
    series: DataFrame,
    keys: Sequence[str],
    *,
    ts: str = "ts",
    watts: str = "power_w",
    window_start: str = "window_start",
    window_end: str = "window_end",
    max_gap_seconds: int = MAX_GAP_SECONDS,
    tail_seconds: int = 2 * POLL_SECONDS,
    bucket_seconds: int = DAY_SECONDS,
    digits: int = 4,
) -> DataFrame:
    """kWh per key and window by the rectangular rule with a gap guard.

    ``series`` has one row per (keys, ts) and carries its window bounds. Each reading holds
    until the next one; a step longer than ``max_gap_seconds`` counts nothing, an equal one
    counts. The window's last reading holds for ``tail_seconds``, at most to the window end.
    """
    by = [*keys, window_start, window_end]
    rows = series.filter((F.col(ts) >= F.col(window_start)) & (F.col(ts) < F.col(window_end)))
    rows = with_halo(rows, ts, bucket_seconds=bucket_seconds, before=max_gap_seconds)
    order = Window.partitionBy(*by, "_bucket").orderBy(ts)
    rows = rows.withColumn("_step", seconds_between(F.lead(ts).over(order), F.col(ts)))
    own = rows.filter("_own")
    held = F.when(F.col("_step") <= max_gap_seconds, F.col(watts) * F.col("_step"))
    last_ts = F.max(ts)
    tail = F.least(seconds_between(F.col(window_end), last_ts), F.lit(float(tail_seconds)))
    tail_joules = F.when(tail <= max_gap_seconds, F.max_by(watts, ts) * tail).otherwise(F.lit(0.0))
    return own.groupBy(*by).agg(
        F.round((F.coalesce(F.sum(held), F.lit(0.0)) + tail_joules) / 3.6e6, digits).alias("kwh"),
        F.count(F.lit(1)).alias("sample_count"),
    )


def daily_energy(
    samples: DataFrame,
    keys: Sequence[str] = ("site_id",),
    *,
    channels: Sequence[str] | None = None,
    tz: str = DEFAULT_ZONE,
    **options,
) -> DataFrame:
    """Integrated kWh per key and local day over the sum of ``channels``."""
    totals = add_local_day_window(channel_totals(samples, keys, channels=channels), tz=tz)
    return integrate_power(totals, [*keys, "day"], **options)


def expected_samples(start: Column, end: Column, poll_seconds: float) -> Column:
    return seconds_between(end, start) / F.lit(float(poll_seconds))


def coverage_pct(count: Column, expected: Column, *, capped: bool) -> Column:
    """Share of the expected rows that exist; 0 where fewer than one is expected."""
    share = F.lit(100.0) * count / expected
    if capped:
        share = F.least(F.lit(100.0), share)
    return F.when(expected < 1, F.lit(0.0)).otherwise(F.round(share, 1))


def interval_coverage(
    intervals: DataFrame,
    keys: Sequence[str] = ("site_id",),
    *,
    interval_minutes: int = 15,
    tz: str = DEFAULT_ZONE,
) -> DataFrame:
    """Percentage of each local day covered by intervals (may exceed 100)."""
    tagged = add_local_day_window(intervals, "start_ts", tz)
    expected = expected_samples(F.col("window_start"), F.col("window_end"), interval_minutes * 60)
    return (
        tagged.groupBy(*keys, "day", "window_start", "window_end")
        .agg(F.count(F.lit(1)).alias("interval_count"))
        .withColumn("coverage_pct", coverage_pct(F.col("interval_count"), expected, capped=False))
        .drop("window_start", "window_end")
    )


def sample_coverage(
    samples: DataFrame,
    keys: Sequence[str] = ("site_id", "channel"),
    *,
    poll_seconds: int = POLL_SECONDS,
    watts: str = "power_w",
    tz: str = DEFAULT_ZONE,
) -> DataFrame:
    """Percentage of each local day with a reading; a null reading is no coverage, 0 W is."""
    tagged = add_local_day_window(samples, "ts", tz)
    expected = expected_samples(F.col("window_start"), F.col("window_end"), poll_seconds)
    return (
        tagged.groupBy(*keys, "day", "window_start", "window_end")
        .agg(F.count(watts).alias("reading_count"))
        .withColumn("coverage_pct", coverage_pct(F.col("reading_count"), expected, capped=True))
        .drop("window_start", "window_end")
    )


def first_gap(
    df: DataFrame,
    keys: Sequence[str],
    *,
    ts: str = "ts",
    threshold_seconds: float = MAX_GAP_SECONDS,
    bucket_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """First gap above the threshold per key: ``gap_start``, ``gap_end``, ``gap_seconds``."""
    stamps = df.select(*keys, ts).distinct()
    stamps = carry_last(stamps, keys, [ts], F.col(ts), "_prev", bucket_seconds=bucket_seconds)
    gap = seconds_between(F.col(ts), F.col("_prev"))
    found = stamps.filter(gap > threshold_seconds)
    return found.groupBy(*keys).agg(
        F.min("_prev").alias("gap_start"),
        F.min(ts).alias("gap_end"),
        F.min_by(gap, ts).alias("gap_seconds"),
        F.count(F.lit(1)).alias("gap_count"),
    )


def channel_quality(
    samples: DataFrame,
    keys: Sequence[str] = ("site_id",),
    *,
    channels: Sequence[str],
    labels: dict[str, str] | None = None,
    poll_seconds: int = POLL_SECONDS,
    coverage_threshold: float = 95.0,
    edge_seconds: int = 15 * 60,
    max_gap_seconds: int = MAX_GAP_SECONDS,
    tz: str = DEFAULT_ZONE,
    days: DataFrame | None = None,
    clean: bool = False,
) -> DataFrame:
    """Failure messages per (key, local day, channel); an empty array is a clean channel.

    Checks coverage, distance of the first and last reading from the day's bounds, and the
    first inner gap. Every (key, day) seen in ``samples`` (or listed in ``days``) is judged
    for every channel, so a silent channel is reported as well. ``clean`` adds a column of that name
    for those who need no texts: whether there is no failure.
    """
    tagged = add_local_day_window(samples, "ts", tz)
    by = [*keys, "day"]
    readings = tagged.filter(F.col("power_w").isNotNull() & F.col("channel").isin(*channels))
    # One row per instant before the window: copies of a reading never fill its partition.
    readings = readings.groupBy(*by, "channel", "ts").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*by, "channel").orderBy("ts")
    stepped = readings.withColumn("_gap", seconds_between(F.col("ts"), F.lag("ts").over(order)))
    wide_gap = F.when(F.col("_gap") > max_gap_seconds, F.col("ts"))
    stats = stepped.groupBy(*by, "channel").agg(
        F.sum("_n").alias("reading_count"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min_by("_gap", wide_gap).alias("first_wide_gap"),
    )
    # A row a day holds the few channels as a map, so the days join before they are laid out by channel.
    measures = F.struct("reading_count", "first_ts", "last_ts", "first_wide_gap")
    stats = stats.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("channel", measures))).alias("_stats"))
    base = days if days is not None else tagged.select(*by).distinct()
    joined = base.select(*by).withColumns(
        {"window_start": day_start("day", tz), "window_end": day_end("day", tz)}).join(stats, by, "left")
    joined = joined.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    joined = joined.withColumn("_of", F.try_element_at("_stats", F.col("channel"))).select(
        *by, "window_start", "window_end", "channel", "_of.*")
    count = F.coalesce(F.col("reading_count"), F.lit(0))
    expected = expected_samples(F.col("window_start"), F.col("window_end"), poll_seconds)
    coverage = coverage_pct(count, expected, capped=True)
    names = labels or {c: c for c in channels}
    label = F.element_at(F.create_map(*[F.lit(x) for c in channels for x in (c, names[c])]),
                         F.col("channel"))
    first_off = seconds_between(F.col("first_ts"), F.col("window_start"))
    last_off = seconds_between(F.col("window_end"), F.col("last_ts"))
    allowed = edge_seconds // 60

    def minutes(seconds: Column) -> Column:
        return F.format_string("%.0f", seconds / 60)

    faults = (
        (coverage < coverage_threshold,
         F.concat(label, F.lit(": "), F.when(coverage == 0, "0.0").otherwise(F.format_string("%.1f", coverage)),
                  F.lit(f"% coverage (need ≥ {coverage_threshold:.0f}%)"))),
        (count == 0, F.concat(label, F.lit(": no samples in window"))),
        (first_off > edge_seconds,
         F.concat(label, F.lit(": first sample "), minutes(first_off),
                  F.lit(f" min after window start (need ≤ {allowed} min)"))),
        (last_off > edge_seconds,
         F.concat(label, F.lit(": last sample "), minutes(last_off),
                  F.lit(f" min before window end (need ≤ {allowed} min)"))),
        (F.col("first_wide_gap").isNotNull(),
         F.concat(label, F.lit(": internal gap of "), minutes(F.col("first_wide_gap")),
                  F.lit(f" min (max {max_gap_seconds // 60} min)"))),
    )
    messages = F.array_compact(F.array(*[F.when(found, message) for found, message in faults]))
    flag = [(~reduce(or_, [F.coalesce(found, F.lit(False)) for found, _ in faults])).alias("clean")] if clean else []
    return joined.select(
        *by, "channel", count.alias("reading_count"), coverage.alias("coverage_pct"),
        messages.alias("failures"), *flag,
    )


def missing_intervals(
    intervals: DataFrame,
    keys: Sequence[str] = ("site_id",),
    *,
    interval_minutes: int = 15,
    range_start: Column | None = None,
    range_end: Column | None = None,
) -> DataFrame:
    """Expected interval starts that have no row, per key.

    The grid runs from the range start (seconds dropped) in fixed steps, end excluded. Only
    its size and the number of distinct starts on it are needed, so the grid is never built.
    """
    step = interval_minutes * 60 * 1_000_000
    bounds = intervals.groupBy(*keys).agg(
        (range_start if range_start is not None else F.min("start_ts")).alias("_from"),
        (range_end if range_end is not None else F.max("end_ts")).alias("_to"),
    )
    origin = F.unix_micros(F.date_trunc("minute", F.col("_from")))
    bounds = bounds.withColumn("_origin", origin).withColumn("_stop", F.unix_micros("_to"))
    starts = intervals.select(*keys, "start_ts").distinct().join(bounds, list(keys))
    offset = F.unix_micros("start_ts") - F.col("_origin")
    on_grid = (offset >= 0) & (offset % step == 0) & (F.unix_micros("start_ts") < F.col("_stop"))
    span = F.col("_stop") - F.col("_origin")
    expected = F.greatest(F.lit(0), F.ceil(span / F.lit(step))).cast("long")
    return starts.groupBy(*keys).agg(
        F.first(expected).alias("expected_count"),
        (F.first(expected) - F.count_if(on_grid)).alias("missing_count"),
    )


def cooling_sessions(
    zones: DataFrame,
    keys: Sequence[str] = ("site_id", "zone"),
    *,
    action: str = COOLING,
    gap_seconds: float = CYCLE_GAP_SECONDS,
    bucket_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Cooling cycles per zone; other rows never end a cycle before the gap does."""
    rows = zones.filter(F.col("action") == action).select(*keys, "ts")
    sessions = gap_sessions(rows, keys, "ts", gap_seconds, bucket_seconds=bucket_seconds)
    minutes = seconds_between(F.col("session_end"), F.col("session_start")) / 60
    return sessions.withColumn("duration_minutes", minutes)


def cooling_bands(
    zones: DataFrame,
    keys: Sequence[str] = ("site_id",),
    *,
    action: str = COOLING,
    gap_seconds: float = CYCLE_GAP_SECONDS,
    bucket_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Periods in which any zone of the site cools."""
    rows = zones.filter(F.col("action") == action).select(*keys, "ts").distinct()
    return gap_sessions(rows, keys, "ts", gap_seconds, bucket_seconds=bucket_seconds)


def counter_rates(
    counters: DataFrame,
    keys: Sequence[str] = ("host",),
    *,
    ts: str = "ts",
    total: str = "cpu_total_jiffies",
    idle: str = "cpu_idle_jiffies",
    bucket_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Busy share between consecutive counter rows, 0..100; null unless the total grew."""
    pair = F.struct(F.col(total).alias("total"), F.col(idle).alias("idle"))
    out = carry_last(counters, keys, [ts], pair, "_prev", bucket_seconds=bucket_seconds)
    d_total = F.col(total) - F.col("_prev.total")
    d_idle = F.col(idle) - F.col("_prev.idle")
    share = F.lit(100.0) * (d_total - d_idle) / d_total
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), share))
    return out.withColumn("busy_percent", F.when(d_total > 0, clamped)).drop("_prev")


def has_data(
    samples: DataFrame, start: Column, end: Column, *, minimum: int,
    keys: Sequence[str] = ("site_id",), ts: str = "ts",
) -> DataFrame:
    """Whether a key has at least ``minimum`` distinct instants in ``[start, end)``."""
    inside = (F.col(ts) >= start) & (F.col(ts) < end)
    return samples.select(*keys, ts).distinct().groupBy(*keys).agg(
        (F.count_if(inside) >= minimum).alias("has_data"))


def load_pressure(load: Column, threads: Column) -> Column:
    return F.when(threads > 0, load / threads)


def kw_series(
    samples: DataFrame,
    keys: Sequence[str] = ("site_id",),
    *,
    channels: Sequence[str] | None = None,
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """Summed kW per timestamp in the closed window; rows without a reading drop out."""
    rows = samples
    if start is not None:
        rows = rows.filter(F.col("ts") >= start)
    if end is not None:
        rows = rows.filter(F.col("ts") <= end)
    totals = channel_totals(rows, keys, channels=channels)
    return totals.select(*keys, "ts", F.round(F.col("power_w") / 1000.0, 4).alias("kw"))


def channel_kw_series(
    samples: DataFrame,
    keys: Sequence[str] = ("site_id",),
    *,
    channels: Sequence[str] | None = None,
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """One kW row per reading and channel; 0.0 W stays, null goes, no shuffle."""
    rows = samples.filter(F.col("power_w").isNotNull())
    if channels is not None:
        rows = rows.filter(F.col("channel").isin(*channels))
    if start is not None:
        rows = rows.filter(F.col("ts") >= start)
    if end is not None:
        rows = rows.filter(F.col("ts") <= end)
    return rows.select(*keys, "channel", "ts", F.round(F.col("power_w") / 1000.0, 4).alias("kw"))


def interval_kw_series(intervals: DataFrame, interval_minutes: int = 15) -> DataFrame:
    return intervals.withColumn("avg_kw", mean_kw(F.coalesce("kwh", F.lit(0.0)), interval_minutes))


def latest_record(df: DataFrame, keys: Sequence[str], ts: str = "ts", *ties: str) -> DataFrame:
    return latest_by(df, keys, [ts, *ties])
