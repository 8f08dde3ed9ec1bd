"""Energy analytics per site: totals, profiles, peaks, trends, reconciliation, shares.

Every function takes whole tables keyed by site and returns one frame; nothing loops over
sites or days. ``intervals`` has the INTERVAL schema, ``samples`` POWER_SAMPLE, ``zones``
ZONE_SAMPLE (see ``gaugeworks.schemas``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gaugeworks.functions import timekeys as tk
from gaugeworks.operators import joins, series
from gaugeworks.operators.ordered import DAY_SECONDS, bucket_of, gap_sessions, seconds_between, top_n
from gaugeworks.session import cut_lineage

SITE = ("site_id",)
UNMONITORED = "unmonitored"


def steady_round(value: Column, digits: int) -> Column:
    """Round a difference of rounded numbers; binary noise goes first."""
    return F.round(F.round(value, 9), digits)


# ---- totals and profiles -------------------------------------------------------------

def range_scan(
    intervals: DataFrame,
    start: Column | None = None,
    end: Column | None = None,
    provider: str | None = None,
    whole: bool = False,
) -> DataFrame:
    """Intervals starting in ``[start, end)``; ``whole`` also needs ``end_ts <= end``."""
    out = intervals
    if provider is not None:
        out = out.filter(F.col("provider") == provider)
    if start is not None:
        out = out.filter(F.col("start_ts") >= start)
    if end is not None:
        out = out.filter(F.col("end_ts") <= end if whole else F.col("start_ts") < end)
    return out


def daily_totals(
    intervals: DataFrame,
    keys: Sequence[str] = SITE,
    *,
    tz: str = tk.DEFAULT_ZONE,
    now: Column | None = None,
    days: int | None = None,
) -> DataFrame:
    rows = intervals
    if days is not None:
        rows = rows.filter(F.col("start_ts") >= tk.days_cutoff(now, days, tz))
    return rows.groupBy(*keys, tk.local_day("start_ts", tz).alias("day")).agg(
        F.round(F.sum("kwh"), 4).alias("kwh")
    )


def monthly_totals(intervals: DataFrame, keys: Sequence[str] = SITE, *, tz=tk.DEFAULT_ZONE):
    return intervals.groupBy(*keys, tk.local_month("start_ts", tz).alias("month")).agg(
        F.round(F.sum("kwh"), 4).alias("kwh")
    )


def hourly_profile(intervals: DataFrame, keys: Sequence[str] = SITE, *, tz=tk.DEFAULT_ZONE):
    return intervals.groupBy(*keys, tk.local_hour("start_ts", tz).alias("hour")).agg(
        F.round(F.avg("kwh"), 4).alias("avg_kwh")
    )


def average_daily_usage(
    intervals: DataFrame, days: int, now: Column, keys: Sequence[str] = SITE, *,
    tz=tk.DEFAULT_ZONE, digits: int = 4,
) -> DataFrame:
    """Mean of the days present in the last ``days`` local days; null for silent sites."""
    daily = daily_totals(intervals, keys, tz=tz, now=now, days=days)
    means = daily.groupBy(*keys).agg(
        F.round(F.avg("kwh"), digits).alias("avg_kwh"), F.count(F.lit(1)).alias("day_count")
    )
    sites = intervals.select(*keys).distinct()
    return sites.join(means, list(keys), "left").withColumn(
        "day_count", F.coalesce("day_count", F.lit(0).cast("long"))
    )


def range_bounds(intervals: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    return intervals.groupBy(*keys).agg(
        F.min("start_ts").alias("range_start"),
        F.max("end_ts").alias("range_end"),
        F.count(F.lit(1)).alias("interval_count"),
    )


def window_total(
    intervals: DataFrame, start: Column, end: Column, keys: Sequence[str] = SITE
) -> DataFrame:
    """kWh of rows starting in ``[start, end)``; sites without such rows get 0."""
    inside = (F.col("start_ts") >= start) & (F.col("start_ts") < end)
    total = F.sum(F.when(inside, F.coalesce("kwh", F.lit(0.0))).otherwise(0.0))
    return intervals.groupBy(*keys).agg(F.round(total, 4).alias("kwh"))


def peak_interval(
    intervals: DataFrame, keys: Sequence[str] = SITE, *, interval_minutes: int = 15
) -> DataFrame:
    """Highest interval per key, the earliest on ties, as one aggregate."""
    rank = F.struct(F.col("kwh"), -F.unix_micros("start_ts"))
    top = intervals.groupBy(*keys).agg(
        F.max_by(F.struct("start_ts", "end_ts", "kwh"), rank).alias("_top")
    )
    return top.select(
        *keys, "_top.start_ts", "_top.end_ts", F.round("_top.kwh", 4).alias("kwh"),
        tk.mean_kw("_top.kwh", interval_minutes).alias("peak_kw"),
    )


def top_intervals(
    intervals: DataFrame, n: int = 5, keys: Sequence[str] = SITE, *, interval_minutes: int = 15
) -> DataFrame:
    ranked = top_n(intervals, keys, [F.col("kwh").desc(), F.col("start_ts").asc()], n)
    return ranked.select(
        *keys, "rank", "start_ts", "end_ts", F.round("kwh", 4).alias("kwh"),
        tk.mean_kw("kwh", interval_minutes).alias("peak_kw"),
    )


def anomalies(
    intervals: DataFrame,
    *,
    threshold_kwh: float | None = None,
    n: int = 5,
    keys: Sequence[str] = SITE,
    interval_minutes: int = 15,
) -> DataFrame:
    """Rows at or above the threshold together with the top ``n``, each (start, end) once.

    Two narrow passes instead of one rank over everything: the top rows come from a
    group-limited window, the threshold rows from a plain filter.
    """
    columns = [*keys, "start_ts", "end_ts", "kwh"]
    picked = top_n(intervals, keys, [F.col("kwh").desc(), F.col("start_ts").asc()], n)
    out = picked.select(*columns)
    if threshold_kwh is not None:
        over = intervals.filter(F.col("kwh") >= threshold_kwh).select(*columns)
        out = over.unionByName(out)
    once = out.groupBy(*keys, "start_ts", "end_ts").agg(F.max("kwh").alias("kwh"))
    return once.select(
        *keys, "start_ts", "end_ts", F.round("kwh", 4).alias("kwh"),
        tk.mean_kw("kwh", interval_minutes).alias("peak_kw"),
    )


def weekly_if_long(
    daily: DataFrame, keys: Sequence[str] = SITE, *, max_points: int = 120
) -> DataFrame:
    """Daily points, or Monday weeks for keys with more than ``max_points`` days."""
    sizes = daily.groupBy(*keys).agg(F.count(F.lit(1)).alias("_points"))
    joined = daily.join(sizes, list(keys))
    week = F.to_date(F.date_trunc("WEEK", F.col("day")))
    start = F.when(F.col("_points") > max_points, week).otherwise(F.col("day"))
    return joined.groupBy(*keys, start.alias("day")).agg(F.round(F.sum("kwh"), 4).alias("kwh"))


def summary(
    intervals: DataFrame,
    keys: Sequence[str] = SITE,
    *,
    interval_minutes: int = 15,
) -> DataFrame:
    """One row per site: count, range, total, peak and missing intervals.

    The daily, hourly and anomaly parts of the report stay long frames
    (:func:`daily_totals`, :func:`hourly_profile`, :func:`anomalies`).
    """
    rank = F.struct(F.col("kwh"), -F.unix_micros("start_ts"))
    base = intervals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("interval_count"),
        F.min("start_ts").alias("range_start"),
        F.max("end_ts").alias("range_end"),
        F.round(F.sum("kwh"), 4).alias("total_kwh"),
        F.max_by("start_ts", rank).alias("peak_start"),
        tk.mean_kw(F.max("kwh"), interval_minutes).alias("peak_kw"),
    )
    missing = series.missing_intervals(intervals, keys, interval_minutes=interval_minutes)
    return base.join(missing.select(*keys, "missing_count"), list(keys))


# ---- zone runtime --------------------------------------------------------------------

def zone_runtime(
    zones: DataFrame,
    keys: Sequence[str] = ("site_id", "window", "zone"),
    *,
    sample_minutes: float = 5.0,
) -> DataFrame:
    """Minutes per action class; a null action is no sample."""
    rows = zones.filter(F.col("action").isNotNull())
    cooling = F.count_if(F.col("action") == series.COOLING) * sample_minutes
    heating = F.count_if(F.col("action") == series.HEATING) * sample_minutes
    n = F.count(F.lit(1))
    idle = F.count_if(~F.col("action").isin(series.COOLING, series.HEATING)) * sample_minutes
    return rows.groupBy(*keys).agg(
        cooling.alias("cooling_minutes"), heating.alias("heating_minutes"),
        idle.alias("idle_minutes"),
        F.round(100.0 * cooling / (n * sample_minutes), 4).alias("percent_cooling"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        n.alias("sample_count"),
    )


def household_runtime(
    zones: DataFrame,
    keys: Sequence[str] = ("site_id", "window"),
    *,
    sample_minutes: float = 5.0,
) -> DataFrame:
    """Minutes in which any zone, or every zone, of the site cools."""
    cools = F.col("action") == series.COOLING
    per_ts = (
        zones.filter(F.col("action").isNotNull())
        .groupBy(*keys, "ts")
        .agg(F.bool_or(cools).alias("_any"), F.bool_and(cools).alias("_all"))
    )
    any_minutes = F.count_if("_any") * sample_minutes
    n = F.count(F.lit(1))
    return per_ts.groupBy(*keys).agg(
        any_minutes.alias("any_cooling_minutes"),
        (F.count_if("_all") * sample_minutes).alias("all_cooling_minutes"),
        F.round(100.0 * any_minutes / (n * sample_minutes), 4).alias("percent_any_cooling"),
        n.alias("sample_count"),
    )


def cycle_stats(
    sessions: DataFrame,
    samples: DataFrame,
    keys: Sequence[str] = SITE,
    *,
    compressor: str,
    short_minutes: float = 10,
    long_minutes: float = 90,
    cell_seconds: int = 3600,
) -> DataFrame:
    """Cycle counts and lengths per site with the mean positive compressor power inside."""
    per_site = sessions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cycle_count"),
        F.round(F.sum("duration_minutes"), 1).alias("total_runtime_minutes"),
        F.round(F.avg("duration_minutes"), 1).alias("avg_cycle_minutes"),
        F.round(F.max("duration_minutes"), 1).alias("longest_cycle_minutes"),
        F.count_if(F.col("duration_minutes") < short_minutes).alias("short_cycle_count"),
        F.count_if(F.col("duration_minutes") > long_minutes).alias("long_cycle_count"),
    )
    power = samples_in_sessions(
        sessions, samples, keys, channel=compressor, cell_seconds=cell_seconds
    )
    means = power.groupBy(*keys).agg(
        F.round(F.avg("power_w") / 1000.0, 3).alias("avg_compressor_kw")
    )
    return per_site.join(means, list(keys), "left")


def samples_in_sessions(
    sessions: DataFrame,
    samples: DataFrame,
    keys: Sequence[str] = SITE,
    *,
    channel: str | None = None,
    cell_seconds: int = 3600,
) -> DataFrame:
    """Positive readings inside closed ``[session_start, session_end]``."""
    rows = samples.filter(F.col("power_w") > 0)
    if channel is not None:
        rows = rows.filter(F.col("channel") == channel)
    spans = sessions.select(*keys, "session_start", "session_end")
    return joins.range_join(
        rows.select(*keys, "ts", "power_w"), spans, keys,
        start="session_start", end="session_end", closed=True, cell_seconds=cell_seconds,
    )


# ---- reconciliation, breakdown, trends -----------------------------------------------

def channel_energy(
    samples: DataFrame, keys: Sequence[str] = ("site_id", "day"), **options
) -> DataFrame:
    """kWh per channel and window; ``samples`` carries window_start / window_end."""
    by = [*keys, "channel", "window_start", "window_end"]
    per_ts = samples.filter(F.col("power_w").isNotNull()).groupBy(*by, "ts").agg(
        F.sum("power_w").alias("power_w")
    )
    return series.integrate_power(per_ts, [*keys, "channel"], **options)


def reconcile_daily(
    intervals: DataFrame,
    samples: DataFrame,
    *,
    channels: Sequence[str] | None = None,
    tz: str = tk.DEFAULT_ZONE,
    **options,
) -> DataFrame:
    """Whole-site meter total against the sum of its monitored channels, per day.

    The two measure different things, so the comparison is flagged unavailable while both
    totals are reported; the remainder exists only where both are positive.
    """
    meter = daily_totals(intervals, tz=tz).withColumnRenamed("kwh", "meter_kwh")
    tagged = series.add_local_day_window(samples, tz=tz)
    if channels is not None:
        tagged = tagged.filter(F.col("channel").isin(*channels))
    per_channel = channel_energy(tagged, **options)
    monitored = per_channel.filter(F.col("kwh") > 0).groupBy("site_id", "day").agg(
        F.round(F.sum("kwh"), 4).alias("monitored_kwh")
    )
    both = meter.join(monitored, ["site_id", "day"], "full_outer")
    known = (F.col("meter_kwh") > 0) & (F.col("monitored_kwh") > 0)
    rest = F.round(F.greatest(F.col("meter_kwh") - F.col("monitored_kwh"), F.lit(0.0)), 4)
    return both.withColumn("remainder_kwh", F.when(known, rest)).withColumn(
        "comparable", F.lit(False)
    )


def breakdown(
    intervals: DataFrame,
    samples: DataFrame,
    windows: DataFrame,
    *,
    hvac_channels: Sequence[str],
    keys: Sequence[str] = SITE,
    **options,
) -> DataFrame:
    """Energy per site in its window: totals, remainder, HVAC share, channels as a map.

    ``windows``: one row per site with window_start / window_end. The map holds one entry
    per channel of a site, a set fixed by its wiring, never by the number of samples.
    """
    meter = (
        intervals.join(windows, list(keys))
        .filter((F.col("start_ts") >= F.col("window_start"))
                & (F.col("start_ts") < F.col("window_end")))
        .groupBy(*keys).agg(F.round(F.sum("kwh"), 4).alias("meter_kwh"))
    )
    per_channel = channel_energy(samples.join(windows, list(keys)), keys, **options).filter("kwh > 0")
    hvac = F.sum(F.when(F.col("channel").isin(*hvac_channels), F.col("kwh")).otherwise(0.0))
    rolled = per_channel.groupBy(*keys).agg(
        F.round(F.sum("kwh"), 4).alias("monitored_kwh"),
        F.round(hvac, 4).alias("hvac_kwh"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", "kwh")))).alias(
            "channel_kwh"
        ),
    )
    out = windows.select(*keys).join(meter, list(keys), "left").join(rolled, list(keys), "left")
    m = F.coalesce("meter_kwh", F.lit(0.0))
    s = F.coalesce("monitored_kwh", F.lit(0.0))
    h = F.coalesce("hvac_kwh", F.lit(0.0))
    return out.select(
        *keys, m.alias("meter_kwh"), "channel_kwh", s.alias("monitored_kwh"),
        F.when((m > 0) & (s > 0), F.round(F.greatest(m - s, F.lit(0.0)), 4)).alias(
            "remainder_kwh"),
        h.alias("hvac_kwh"),
        F.when((m > 0) & (h > 0), F.round(100.0 * h / m, 1)).alias("hvac_pct"),
        (m > 0).alias("has_meter"), (s > 0).alias("has_samples"),
    )


def calendar(sites: DataFrame, now: Column, days: int, tz: str = tk.DEFAULT_ZONE) -> DataFrame:
    """Dense (site, day) rows for the last ``days`` local days, today included."""
    today = tk.local_day(now, tz)
    span = F.sequence(F.date_sub(today, days - 1), today)
    return sites.withColumn("day", F.explode(span)).withColumn("is_today", F.col("day") == today)


def daily_trends(
    intervals: DataFrame,
    samples: DataFrame,
    zones: DataFrame,
    now: Column,
    *,
    days: int = 7,
    tz: str = tk.DEFAULT_ZONE,
    hvac_channels: Sequence[str],
    channels: Sequence[str] | None = None,
    interval_minutes: int = 15,
    poll_seconds: int = series.POLL_SECONDS,
    zone_minutes: float = 5.0,
    min_coverage: float = 50.0,
    sites: DataFrame | None = None,
    **options,
) -> DataFrame:
    """One row per site and local day; a day below the coverage limit is null, not zero.

    The calendar is dense and every source is reduced to (site, day) before joining it, so
    only day rows are joined.
    """
    since = tk.days_cutoff(now, days, tz)
    until = tk.day_end(tk.local_day(now, tz), tz)
    intervals = intervals.filter((F.col("start_ts") >= since) & (F.col("start_ts") < until))
    samples = samples.filter((F.col("ts") >= since) & (F.col("ts") < until))
    zones = zones.filter((F.col("ts") >= since) & (F.col("ts") < until))
    by = ["site_id", "day"]
    meter = intervals.groupBy("site_id", tk.local_day("start_ts", tz).alias("day")).agg(
        F.sum("kwh").alias("_kwh"), F.count(F.lit(1)).alias("_intervals"),
        F.max("kwh").alias("_max_kwh"),
    )
    records = samples.select("site_id", "ts").distinct().groupBy(
        "site_id", tk.local_day("ts", tz).alias("day")
    ).agg(F.count(F.lit(1)).alias("_records"))
    total = series.daily_energy(samples, SITE, channels=channels, tz=tz, **options)
    hvac = series.daily_energy(samples, SITE, channels=hvac_channels, tz=tz, **options)
    cooling = (
        zones.groupBy("site_id", "ts")
        .agg(F.coalesce(F.bool_or(F.col("action") == series.COOLING), F.lit(False)).alias("_any"))
        .groupBy("site_id", tk.local_day("ts", tz).alias("day"))
        .agg((F.count_if("_any") * zone_minutes).alias("cooling_minutes"))
    )
    if sites is None:
        sites = (
            intervals.select("site_id").unionByName(samples.select("site_id"))
            .unionByName(zones.select("site_id")).distinct()
        )
    out = calendar(sites, now, days, tz).join(meter, by, "left").join(records, by, "left")
    out = out.join(total.select(*by, F.col("kwh").alias("_all")), by, "left")
    out = out.join(hvac.select(*by, F.col("kwh").alias("_hvac")), by, "left")
    out = out.join(cooling, by, "left")
    length = seconds_between(tk.day_end("day", tz), tk.day_start("day", tz))
    meter_cov = series.coverage_pct(
        F.coalesce("_intervals", F.lit(0)), length / (interval_minutes * 60), capped=False
    )
    sample_cov = series.coverage_pct(
        F.coalesce("_records", F.lit(0)), length / poll_seconds, capped=True
    )
    adequate = (meter_cov >= min_coverage) | (F.col("is_today") & (F.col("_intervals") >= 1))
    adequate = F.coalesce(adequate, F.lit(False))
    sampled = sample_cov >= min_coverage
    return out.select(
        *by, "is_today",
        F.when(adequate, F.round("_kwh", 2)).alias("meter_kwh"),
        F.when(sampled, F.round("_all", 2)).alias("sampled_kwh"),
        F.when(sampled, F.round(F.coalesce("_hvac", F.lit(0.0)), 2)).alias("hvac_kwh"),
        F.round("cooling_minutes", 0).alias("cooling_minutes"),
        F.round(tk.mean_kw("_max_kwh", interval_minutes), 2).alias("peak_kw"),
        meter_cov.alias("meter_coverage_pct"), sample_cov.alias("sample_coverage_pct"),
        adequate.alias("adequate_coverage"),
    )


def valid_day_shares(
    intervals: DataFrame,
    samples: DataFrame,
    now: Column,
    *,
    channels: Sequence[str],
    labels: dict[str, str] | None = None,
    look_back: int = 14,
    tz: str = tk.DEFAULT_ZONE,
    interval_minutes: int = 15,
    poll_seconds: int = series.POLL_SECONDS,
    meter_threshold: float = 90.0,
    channel_threshold: float = 95.0,
    edge_seconds: int = 15 * 60,
    max_gap_seconds: int = series.MAX_GAP_SECONDS,
    sites: DataFrame | None = None,
    meter_label: str = "SMT",
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Most recent complete local day that is fully valid, as shares of the meter total.

    Returns ``(slices, diagnostics)``: slices has one row per site, channel and remainder of
    the chosen day; diagnostics has one row per site with the best day of each source and
    yesterday's failures. All look-back days are judged at once and ``max`` picks the day.
    """
    today = tk.local_day(now, tz)
    first = F.date_sub(today, look_back)
    lower, upper = tk.day_start(first, tz), tk.day_start(today, tz)
    intervals = intervals.filter((F.col("start_ts") >= lower) & (F.col("start_ts") < upper))
    samples = samples.filter(
        (F.col("ts") >= lower) & (F.col("ts") < upper) & F.col("channel").isin(*channels)
    )
    if sites is None:
        sites = intervals.select("site_id").unionByName(samples.select("site_id")).distinct()
    by = ["site_id", "day"]
    days = sites.withColumn("day", F.explode(F.sequence(first, F.date_sub(today, 1))))
    meter = intervals.groupBy("site_id", tk.local_day("start_ts", tz).alias("day")).agg(
        F.round(F.sum("kwh"), 4).alias("_meter"), F.count(F.lit(1)).alias("_n")
    )
    length = seconds_between(tk.day_end("day", tz), tk.day_start("day", tz))
    meter_cov = series.coverage_pct(
        F.coalesce("_n", F.lit(0)), length / (interval_minutes * 60), capped=False
    )
    days = days.join(meter, by, "left").withColumn("meter_coverage_pct", meter_cov)
    options_of_quality = {
        "channels": channels, "labels": labels, "poll_seconds": poll_seconds, "coverage_threshold": channel_threshold,
        "edge_seconds": edge_seconds, "max_gap_seconds": max_gap_seconds, "tz": tz}
    quality = series.channel_quality(samples, days=days, clean=True, **options_of_quality)
    per_day = quality.groupBy(*by).agg(
        F.min("coverage_pct").alias("worst_channel_coverage_pct"), F.bool_and("clean").alias("_clean"))
    # All days are judged; only the failures of the latest one are told, so only they are written out.
    latest = F.greatest(first, F.date_sub(today, 1))
    position = F.array_position(F.array(*[F.lit(c) for c in channels]), F.col("channel"))
    told = series.channel_quality(
        samples.filter((F.col("ts") >= tk.day_start(latest, tz)) & (F.col("ts") < tk.day_end(latest, tz))),
        days=sites.withColumn("day", latest), **options_of_quality,
    ).groupBy("site_id").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct(position.alias("p"), F.col("failures").alias("f")))),
        lambda x: x["f"])).alias("_failures"))
    # Both results are made of these: few rows, kept, so that no day is integrated or judged twice.
    energy = cut_lineage(channel_energy(
        series.add_local_day_window(samples, tz=tz), max_gap_seconds=max_gap_seconds, **options
    ).select(*by, "channel", F.round("kwh", 3).alias("kwh")))
    monitored = energy.groupBy(*by).agg(F.round(F.sum("kwh"), 3).alias("monitored_kwh"))
    judged = days.join(per_day, by, "left").join(monitored, by, "left")
    meter_failure = F.when(
        F.col("meter_coverage_pct") < meter_threshold,
        F.array(F.concat(F.lit(f"{meter_label}: "), F.format_string("%.1f", F.col("meter_coverage_pct")),
                         F.lit(f"% coverage (need ≥ {meter_threshold:.0f}%)"))),
    ).otherwise(F.array().cast("array<string>"))
    judged = judged.withColumn("_meter_failure", meter_failure)
    valid = (
        (F.size("_meter_failure") == 0) & F.col("_clean") & (F.col("_meter") > 0)
        & (F.coalesce("monitored_kwh", F.lit(0.0)) <= F.col("_meter") * 1.05)
    )
    judged = judged.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    neg_age = F.datediff("day", F.lit("1970-01-01").cast("date"))
    valid_day = F.when(F.col("_valid"), F.col("day"))
    judged = cut_lineage(judged.groupBy("site_id").agg(
        F.max(valid_day).alias("day"), F.max_by("_meter", valid_day).alias("meter_kwh"),
        F.max_by("monitored_kwh", valid_day).alias("monitored_kwh"),
        F.bool_or("_valid").alias("available"),
        F.max_by(F.when(F.col("meter_coverage_pct") > 0, F.col("day")),
                 F.struct("meter_coverage_pct", neg_age)).alias("best_meter_day"),
        F.max("meter_coverage_pct").alias("best_meter_coverage_pct"),
        F.max_by(F.when(F.col("worst_channel_coverage_pct") > 0, F.col("day")),
                 F.struct("worst_channel_coverage_pct", neg_age)).alias("best_channel_day"),
        F.max("worst_channel_coverage_pct").alias("best_channel_coverage_pct"),
        F.max_by("_meter_failure", "day").alias("_meter_failure"),
    ))
    chosen = judged.filter("available").select("site_id", "day", "meter_kwh", "monitored_kwh")
    grid = chosen.withColumn(
        "channel", F.explode(F.array(*[F.lit(c) for c in channels], F.lit(UNMONITORED)))
    ).join(energy, [*by, "channel"], "left")
    rest = steady_round(
        F.greatest(F.col("meter_kwh") - F.coalesce("monitored_kwh", F.lit(0.0)), F.lit(0.0)), 3
    )
    kwh = F.when(F.col("channel") == UNMONITORED, rest).otherwise(F.coalesce("kwh", F.lit(0.0)))
    slices = grid.select(
        *by, "channel", kwh.alias("kwh"),
        F.round(100.0 * kwh / F.col("meter_kwh"), 1).alias("pct"),
        F.round("meter_kwh", 2).alias("meter_kwh"),
    )
    diagnostics = judged.join(told, "site_id", "left").withColumn(
        "latest_failures", F.concat("_meter_failure", "_failures")
    ).drop("day", "meter_kwh", "monitored_kwh", "_meter_failure", "_failures")
    return slices, diagnostics


# ---- overlap and correlation ---------------------------------------------------------

def overlap_windows(
    intervals: DataFrame, samples: DataFrame, *, hours: int, keys: Sequence[str] = SITE
) -> DataFrame:
    """Per site: bounds of both sources, their overlap, and its last ``hours`` hours."""
    left = intervals.groupBy(*keys).agg(
        F.min("start_ts").alias("left_start"), F.max("end_ts").alias("left_end")
    )
    right = samples.groupBy(*keys).agg(
        F.min("ts").alias("right_start"), F.max("ts").alias("right_end")
    )
    both = left.join(right, list(keys), "full_outer")
    overlaps = (F.col("left_start") < F.col("right_end")) & (
        F.col("right_start") < F.col("left_end")
    )
    end = F.when(overlaps, F.least("left_end", "right_end"))
    start = F.when(overlaps, F.greatest("left_start", "right_start"))
    recent = F.timestamp_micros(F.unix_micros("overlap_end") - hours * 3_600_000_000)
    return (
        both.withColumn("overlap_start", start)
        .withColumn("overlap_end", end)
        .withColumn("window_start", F.greatest(recent, F.col("overlap_start")))
        .withColumn("window_end", F.col("overlap_end"))
    )


def _last_per_zone(entries: Column) -> Column:
    """Map of sorted (zone, action) entries; a zone read twice at an instant keeps the last."""
    n = F.size(entries)
    kept = F.filter(
        entries,
        lambda x, i: (i == n - 1) | (F.get(entries, i + 1)["zone"] != x["zone"]),
    )
    return F.map_from_entries(kept)


def correlate(
    intervals: DataFrame,
    zones: DataFrame,
    *,
    high_kwh: float = 1.0,
    slack_seconds: int = 600,
    keys: Sequence[str] = SITE,
    bucket_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Each interval with the zone actions of its as-of sample and a note on high usage."""
    per_ts = zones.groupBy(*keys, "ts").agg(
        F.bool_or(F.col("action") == series.COOLING).alias("_cooling"),
        _last_per_zone(F.sort_array(F.collect_set(F.struct("zone", "action")))).alias("_map"),
    ) if "zone" in zones.columns else zones.groupBy(*keys, "ts").agg(
        F.bool_or(F.col("action") == series.COOLING).alias("_cooling")
    )
    columns = [c for c in ("_cooling", "_map") if c in per_ts.columns]
    joined = joins.asof_within_interval(
        intervals, per_ts, keys, payload=F.struct(*columns),
        slack_seconds=slack_seconds, bucket_seconds=bucket_seconds,
    )
    cooling = F.coalesce(F.col("matched._cooling"), F.lit(False))
    note = F.when(
        cooling & (F.col("kwh") >= high_kwh),
        F.concat(F.lit("High usage ("), F.format_string("%.2f", F.col("kwh")),
                 F.lit(" kWh) during cooling")),
    )
    extra = [F.col("matched._map").alias("zone_actions")] if "_map" in columns else []
    return joined.select(
        *intervals.columns, *extra, cooling.alias("any_cooling"), note.alias("note"),
        F.col("matched_ts").alias("sample_ts"),
    )


def correlation_status(
    intervals: DataFrame,
    zones: DataFrame,
    *,
    hours: int = 24,
    keys: Sequence[str] = SITE,
    slack_seconds: int = 600,
    bucket_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Why a site has, or has not, correlation rows, with the counts behind it."""
    windows = overlap_windows(intervals, zones, hours=hours, keys=keys)
    bounds = windows.select(*keys, "window_start", "window_end")
    rows = intervals.join(bounds, list(keys)).filter(
        (F.col("start_ts") >= F.col("window_start")) & (F.col("start_ts") < F.col("window_end"))
    ).select(*intervals.columns)
    matched = correlate(
        rows, zones, keys=keys, slack_seconds=slack_seconds, bucket_seconds=bucket_seconds
    ).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("interval_rows"), F.count("sample_ts").alias("matched_rows")
    )
    stamps = zones.select(*keys, "ts").distinct().join(bounds, list(keys)).filter(
        (F.col("ts") >= F.col("window_start")) & (F.col("ts") < F.col("window_end"))
    ).groupBy(*keys).agg(F.count(F.lit(1)).alias("sample_rows"))
    out = windows.join(matched, list(keys), "left").join(stamps, list(keys), "left")
    zero = F.lit(0).cast("long")
    status = (
        F.when(F.col("left_start").isNull(), "no_interval_data")
        .when(F.col("right_start").isNull(), "no_sample_data")
        .when(F.col("overlap_start").isNull(), "no_overlap")
        .when((F.col("window_start") >= F.col("window_end"))
              | (F.coalesce("interval_rows", zero) == 0), "no_rows_in_window")
        .when(F.coalesce("matched_rows", zero) == 0, "no_matched_rows")
        .otherwise("available")
    )
    return out.select(
        *keys, "overlap_start", "overlap_end", "window_start", "window_end",
        F.coalesce("interval_rows", zero).alias("interval_rows"),
        F.coalesce("sample_rows", zero).alias("sample_rows"),
        F.coalesce("matched_rows", zero).alias("matched_rows"),
        status.alias("status"),
    )


# ---- demand peaks --------------------------------------------------------------------

def dominant_action(actions: Column) -> Column:
    """COOLING before HEATING before the first action of the list."""
    return (
        F.when(F.array_contains(actions, series.COOLING), F.lit(series.COOLING))
        .when(F.array_contains(actions, series.HEATING), F.lit(series.HEATING))
        .otherwise(F.get(actions, F.lit(0)))
    )


def actions_by_ts(zones: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Distinct actions per timestamp (a handful of action names) in name order."""
    return zones.filter(F.col("action").isNotNull()).groupBy(*keys, "ts").agg(
        F.sort_array(F.collect_set("action")).alias("actions")
    )


def demand_peaks(
    samples: DataFrame,
    intervals: DataFrame,
    zones: DataFrame,
    *,
    keys: Sequence[str] = SITE,
    hvac_channels: Sequence[str],
    cooldown_seconds: float = 1800,
    n: int = 5,
    tolerance_seconds: float = 600,
    interval_minutes: int = 15,
    bucket_seconds: int = DAY_SECONDS,
    cell_seconds: int = 900,
    strict_reference: bool = True,
    sample_label: str = "Tuya",
    zone_label: str = "Nest",
) -> DataFrame:
    """Top peaks per site with zone action, meter power, remainder and a class.

    Samples closer than the cool-down form one event, represented by its highest total (the
    earliest on ties). Sites without samples fall back to their top meter intervals. With
    ``strict_reference`` the other-load share counts as zero, as in the published behaviour;
    without it the true share takes part in the class.
    """
    kw = F.round(F.col("power_w") / 1000.0, 4)
    hvac = F.when(F.col("channel").isin(*hvac_channels), kw).otherwise(0.0)
    totals = samples.filter(F.col("power_w").isNotNull()).groupBy(*keys, "ts").agg(
        F.round(F.sum(kw), 4).alias("total_kw"), F.round(F.sum(hvac), 2).alias("hvac_kw")
    )
    rank = F.struct(F.col("total_kw").alias("t"), (-F.unix_micros("ts")).alias("u"))
    events = gap_sessions(
        totals, keys, "ts", cooldown_seconds,
        best=(F.struct("ts", "total_kw", "hvac_kw"), rank), bucket_seconds=bucket_seconds,
    ).select(*keys, "best_value.*")
    sampled = top_n(events, keys, [F.col("total_kw").desc(), F.col("ts").asc()], n)
    sampled = joins.interval_value_at(
        sampled, intervals, keys, point_key=["rank"], value="kwh", out="_kwh",
        cell_seconds=cell_seconds,
    )
    sampled = sampled.withColumn("meter_kw", tk.mean_kw("_kwh", interval_minutes)).drop("_kwh")
    sampled = sampled.withColumn("peak_source", F.lit("samples"))
    metered = top_intervals(
        intervals.join(samples.select(*keys).distinct(), list(keys), "left_anti"),
        n, keys, interval_minutes=interval_minutes,
    ).select(
        *keys, F.col("start_ts").alias("ts"), F.col("peak_kw").alias("total_kw"),
        F.lit(None).cast("double").alias("hvac_kw"), "rank",
        F.col("peak_kw").alias("meter_kw"), F.lit("intervals").alias("peak_source"),
    )
    peaks = cut_lineage(sampled.unionByName(metered))
    near = joins.nearest(
        peaks, actions_by_ts(_around(zones, peaks, keys, tolerance_seconds), keys), keys, payload=F.col("actions"),
        tolerance_seconds=tolerance_seconds, bucket_seconds=bucket_seconds,
    )
    return _classify_peaks(near, keys, strict_reference, sample_label, zone_label)


def _around(df: DataFrame, points: DataFrame, keys: Sequence[str], seconds: float) -> DataFrame:
    """Rows in or next to the time cell of a point of their key; cells are ``seconds`` wide, so all
    rows closer than that are among them. A few points leave little of a history to any window."""
    width = max(1, math.ceil(seconds))
    cell = bucket_of("ts", width)
    near = points.select(*keys, F.explode(F.sequence(cell - 1, cell + 1)).alias("_cell")).distinct()
    return df.withColumn("_cell", cell).join(near, [*keys, "_cell"], "left_semi").drop("_cell")


def _classify_peaks(
    near: DataFrame,
    keys: Sequence[str],
    strict_reference: bool,
    sample_label: str,
    zone_label: str,
) -> DataFrame:
    total, hvac = F.col("total_kw"), F.col("hvac_kw")
    sampled = F.col("peak_source") == "samples"
    other_share = F.lit(0.0) if strict_reference else (total - hvac) / total
    hvac_share = hvac / total
    action = dominant_action(F.col("matched"))
    kind = (
        F.when(~sampled | (total <= 0), f"Unknown — no {sample_label} data")
        .when((action == series.COOLING) & (hvac_share >= 0.6) & (other_share > 0.2),
              "HVAC + other significant load")
        .when((action == series.COOLING) & (hvac_share >= 0.6), "HVAC only")
        .when(hvac_share >= 0.5, "HVAC only")
        .when(other_share >= 0.3, "Non-HVAC load")
        .when(action.isNull(), f"Unknown — missing {zone_label} data")
        .otherwise("Mixed load")
    )
    rest = steady_round(F.greatest(F.col("meter_kw") - total, F.lit(0.0)), 2)
    shown = F.when(sampled, F.round(total, 2)).otherwise(total)
    return near.select(
        *keys, "rank", "ts", shown.alias("total_kw"), "hvac_kw",
        F.when(sampled, F.round("meter_kw", 2)).otherwise(F.col("meter_kw")).alias("meter_kw"),
        F.when(sampled, rest).alias("remainder_kw"), action.alias("action"),
        kind.alias("classification"), "peak_source",
    )


# ---- window choice, timeline, findings -----------------------------------------------

def meter_days(intervals: DataFrame, now: Column, *, keys: Sequence[str] = SITE, tz: str = tk.DEFAULT_ZONE) -> DataFrame:
    """Partials per site and local day: intervals, those of today and of the last 24 hours, last end.

    One pass with map-side sums; whatever asks for whole days reads these rows instead.
    """
    today, day_ago = tk.day_start(tk.local_day(now, tz), tz), now - F.expr("INTERVAL 24 HOURS")
    start = F.col("start_ts")
    return intervals.groupBy(*keys, tk.local_day("start_ts", tz).alias("day")).agg(
        F.count(F.lit(1)).alias("intervals"),
        F.count_if((start >= today) & (start < now)).alias("today"),
        F.count_if((start >= day_ago) & (start < now)).alias("last_24h"),
        F.max("end_ts").alias("latest"),
    )


def meter_targets(days: DataFrame, keys: Sequence[str] = SITE, full_day_intervals: int = 48) -> DataFrame:
    """Per site: intervals of today and of 24 hours, and the latest full day, else the latest one."""
    return days.groupBy(*keys).agg(
        F.sum("today").alias("m_today"), F.sum("last_24h").alias("m_24h"),
        F.coalesce(F.max(F.when(F.col("intervals") >= full_day_intervals, F.col("day"))), F.max("day")).alias("m_day"),
    )


def choose_window(
    intervals: DataFrame,
    samples: DataFrame,
    zones: DataFrame,
    now: Column,
    *,
    keys: Sequence[str] = SITE,
    tz: str = tk.DEFAULT_ZONE,
    min_samples: int = 5,
    min_zone_samples: int = 3,
    full_day_intervals: int = 48,
    sites: DataFrame | None = None,
    targets: DataFrame | None = None,
) -> DataFrame:
    """Best analysis window per site: today, last 24 h, latest usable meter day, fallback.

    The meter names the days of interest; samples and zones are looked at on those alone, with the
    days as literals, so a history is not made distinct to count three days. ``targets`` may bring
    ``meter_targets`` that are there already.
    """
    today = tk.day_start(tk.local_day(now, tz), tz)
    day_ago = now - F.expr("INTERVAL 24 HOURS")
    keys = list(keys)

    def within(ts: str, start: Column, end: Column) -> Column:
        return (F.col(ts) >= start) & (F.col(ts) < end)

    if targets is None:
        targets = cut_lineage(meter_targets(meter_days(intervals, now, keys=keys, tz=tz), keys, full_day_intervals))
    # Days of the calendar, not of the sites: this list stays short.
    days = sorted(r["m_day"] for r in targets.select("m_day").distinct().collect() if r["m_day"] is not None)
    since = F.least(today, day_ago, *([tk.day_start(F.lit(days[0]), tz)] if days else []))
    day_from, day_to = tk.day_start("m_day", tz), tk.day_end("m_day", tz)
    bounds = targets.select(*keys, day_from.alias("_from"), day_to.alias("_to"))

    def counts(df: DataFrame, prefix: str) -> DataFrame:
        asked = within("ts", F.least(today, day_ago), now) | tk.local_day("ts", tz).isin(days)
        stamps = df.filter((F.col("ts") >= since) & asked).select(*keys, "ts").distinct().join(bounds, keys, "left")
        return stamps.groupBy(*keys).agg(
            F.count_if(within("ts", today, now)).alias(f"{prefix}_today"),
            F.count_if(within("ts", day_ago, now)).alias(f"{prefix}_24h"),
            F.count_if(within("ts", F.col("_from"), F.col("_to"))).alias(f"{prefix}_day"),
        )

    if sites is None:
        sites = (
            intervals.select(*keys).unionByName(samples.select(*keys))
            .unionByName(zones.select(*keys)).distinct()
        )
    out = sites.join(targets, keys, "left").join(counts(samples, "s"), keys, "left")
    out = out.join(counts(zones, "z"), keys, "left")

    def at_least(name: str, n: int) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) >= n

    flags = {
        w: (at_least(f"s_{w}", min_samples), at_least(f"z_{w}", min_zone_samples))
        for w in ("today", "24h", "day")
    }
    use_today = at_least("m_today", 2) & (flags["today"][0] | flags["today"][1])
    use_24h = at_least("m_24h", 4) & (flags["24h"][0] | flags["24h"][1])
    use_day = F.col("m_day").isNotNull()
    basis = (
        F.when(use_today, "today").when(use_24h, "latest_24h")
        .when(use_day, "latest_day").otherwise("fallback")
    )
    start = (
        F.when(use_today, today).when(use_24h, day_ago).when(use_day, day_from).otherwise(day_ago)
    )
    end = F.when(use_today | use_24h, now).when(use_day, day_to).otherwise(now)

    def has(i: int) -> Column:
        return (
            F.when(use_today, flags["today"][i]).when(use_24h, flags["24h"][i])
            .when(use_day, flags["day"][i]).otherwise(F.lit(False))
        )

    return out.select(
        *keys, basis.alias("basis"), start.alias("window_start"), end.alias("window_end"),
        (use_today | use_24h | use_day).alias("has_meter"), has(0).alias("has_samples"),
        has(1).alias("has_zones"),
    )


TIMELINE_COLUMNS = ("site_id", "kind", "name", "start_ts", "end_ts", "value", "detail")


def timeline(
    intervals: DataFrame,
    samples: DataFrame,
    zones: DataFrame,
    windows: DataFrame,
    *,
    hvac_channels: Sequence[str],
    gap_seconds: float = series.CYCLE_GAP_SECONDS,
    interval_minutes: int = 15,
    bucket_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Aligned chart rows of a site's window in one long frame, told apart by ``kind``."""
    bounds = windows.select("site_id", "window_start", "window_end")

    def inside(df: DataFrame, ts: str, closed: bool = False) -> DataFrame:
        t = F.col(ts)
        upper = t <= F.col("window_end") if closed else t < F.col("window_end")
        return df.join(bounds, "site_id").filter((t >= F.col("window_start")) & upper)

    none = F.lit(None)

    def rows(df: DataFrame, kind: str, name: Column, start: str, end: Column, value: Column,
             detail: Column = none) -> DataFrame:
        return df.select(
            "site_id", F.lit(kind).alias("kind"), name.cast("string").alias("name"),
            F.col(start).alias("start_ts"), end.cast("timestamp").alias("end_ts"),
            value.cast("double").alias("value"), detail.cast("string").alias("detail"),
        )

    picked = inside(samples, "ts", closed=True)
    zone_rows = inside(zones, "ts")
    bars = rows(inside(intervals, "start_ts"), "interval", none, "start_ts", F.col("end_ts"),
                tk.mean_kw(F.coalesce("kwh", F.lit(0.0)), interval_minutes))
    per_channel = rows(series.channel_kw_series(picked), "channel", F.col("channel"), "ts", none,
                       F.col("kw"))
    total = rows(series.kw_series(picked), "monitored_total", none, "ts", none, F.col("kw"))
    hvac = rows(series.kw_series(picked, channels=hvac_channels), "hvac_total", none, "ts", none,
                F.col("kw"))
    zone_samples = rows(zone_rows, "zone_sample", F.col("zone"), "ts", none, none, F.col("action"))
    bands = rows(
        series.cooling_bands(zone_rows, gap_seconds=gap_seconds, bucket_seconds=bucket_seconds),
        "cooling_band", none, "session_start", F.col("session_end"), none,
    )
    out = bars
    for part in (per_channel, total, hvac, zone_samples, bands):
        out = out.unionByName(part)
    return out


def findings(
    peaks: DataFrame,
    breakdowns: DataFrame,
    cycles: DataFrame,
    *,
    keys: Sequence[str] = SITE,
    tz: str = tk.DEFAULT_ZONE,
    limit: int = 5,
    meter_label: str = "SMT",
) -> DataFrame:
    """Up to five plain sentences per site, each only when its data exists."""
    keys = list(keys)
    top = peaks.filter(F.col("rank") == 1).select(
        *keys, F.col("ts").alias("peak_ts"), F.col("total_kw").alias("peak_total_kw"),
        F.col("remainder_kw").alias("peak_remainder_kw"), "peak_source",
    )
    out = breakdowns.join(top, keys, "full_outer").join(cycles, keys, "full_outer")
    at = tk.time_label("peak_ts", tz)
    note = F.when(F.col("peak_source") == "intervals", F.lit(f" ({meter_label} 15-min avg)")).otherwise("")
    minutes = F.col("total_runtime_minutes")
    hours = F.floor(minutes / 60).cast("int")
    left = F.floor(minutes % 60).cast("int")
    n = F.col("cycle_count")
    plural = F.when(n == 1, F.lit("")).otherwise(F.lit("s"))
    one_hour = F.when(hours == 1, F.lit("")).otherwise(F.lit("s"))
    one_min = F.when(left == 1, F.lit("")).otherwise(F.lit("s"))
    ran = (
        F.when((hours > 0) & (left > 0),
               F.concat(F.lit("Cooling ran for "), hours.cast("string"), F.lit(" hr "),
                        left.cast("string"), F.lit(" min across "), n.cast("string"),
                        F.lit(" cycle"), plural, F.lit(".")))
        .when(hours > 0,
              F.concat(F.lit("Cooling ran for "), hours.cast("string"), F.lit(" hour"), one_hour,
                       F.lit(" ("), n.cast("string"), F.lit(" cycle"), plural, F.lit(").")))
        .otherwise(F.concat(F.lit("Cooling ran for "), left.cast("string"), F.lit(" minute"),
                            one_min, F.lit(".")))
    )
    sentences = F.array_compact(F.array(
        F.when(F.col("peak_total_kw") > 0,
               F.concat(F.lit("Peak demand was "), F.format_string("%.1f", F.col("peak_total_kw")),
                        F.lit(" kW at "), at, note, F.lit("."))),
        F.when(F.col("hvac_pct").isNotNull() & F.col("has_meter") & F.col("has_samples"),
               F.concat(F.lit("HVAC used approximately "),
                        F.format_string("%.0f", F.col("hvac_pct")),
                        F.lit("% of total household energy."))),
        F.when(minutes > 0, ran),
        F.when(F.col("peak_remainder_kw") > 0.5,
               F.concat(F.lit("Estimated unmonitored load at peak: "),
                        F.format_string("%.1f", F.col("peak_remainder_kw")),
                        F.lit(f" kW ({meter_label} whole-home minus measured circuits)."))),
    ))
    return out.select(*keys, F.slice(sentences, 1, limit).alias("findings"))
