"""Full energy analysis of every site, composed lazily from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import timekeys as tk
from gaugeworks.functions.timekeys import DEFAULT_ZONE
from gaugeworks.operators import energy, health, series
from gaugeworks.operators.ordered import DAY_SECONDS
from gaugeworks.session import cut_lineage

PREFERRED_ZONE = "downstairs"


def _main_zone(preferred: str) -> Column:
    return F.coalesce(F.max(F.when(F.col("zone") == preferred, F.col("zone"))), F.min("zone")).alias("zone")


def primary_zones(zones: DataFrame, preferred: str = PREFERRED_ZONE) -> DataFrame:
    """The zone that stands for a site: the preferred one, else the first by name."""
    return zones.groupBy("site_id").agg(_main_zone(preferred))


def _within(df: DataFrame, windows: DataFrame, ts: str) -> DataFrame:
    bounds = windows.select("site_id", "window_start", "window_end")
    inside = (F.col(ts) >= F.col("window_start")) & (F.col(ts) < F.col("window_end"))
    return df.join(bounds, "site_id").filter(inside).select(*df.columns)


def analyse(
    intervals: DataFrame,
    samples: DataFrame,
    zones: DataFrame,
    now: Column,
    *,
    channels: Sequence[str],
    hvac_channels: Sequence[str],
    compressor: str,
    tz: str = DEFAULT_ZONE,
    labels: dict[str, str] | None = None,
    interval_minutes: int = 15,
    poll_seconds: int = series.POLL_SECONDS,
    max_gap_seconds: int = series.MAX_GAP_SECONDS,
    cycle_gap_seconds: float = series.CYCLE_GAP_SECONDS,
    cooldown_seconds: float = 1800,
    tolerance_seconds: float = 600,
    bucket_seconds: int = DAY_SECONDS,
    tail_seconds: float | None = None,
    look_back: int = 14,
    window_options: dict | None = None,
    cycle_options: dict | None = None,
    share_options: dict | None = None,
) -> dict[str, DataFrame]:
    """Frames keyed by site: window, cycles, stats, breakdown, peaks, timeline, trends,
    quality, agreement, shares, diagnostics, findings.

    Every source is read twice, however many frames there are. The first pass leaves partials: days of
    the meter, the latest instant and main zone of each site. They name the earliest day that any
    frame looks at, a literal for the scans of the second pass, whose rows are kept in the shared
    checkpoint folder; all frames read these.
    """
    samples = samples.filter(F.col("channel").isin(*channels))
    window_options = dict(window_options or {})
    full_day = {k: window_options.pop(k) for k in ("full_day_intervals",) if k in window_options}
    days = cut_lineage(energy.meter_days(intervals, now, tz=tz))
    targets = cut_lineage(energy.meter_targets(days, **full_day))
    of_samples = cut_lineage(samples.groupBy("site_id").agg(F.max("ts").alias("latest")))
    of_zones = cut_lineage(zones.groupBy("site_id").agg(F.max("ts").alias("latest"), _main_zone(PREFERRED_ZONE)))
    today = tk.local_day(now, tz)
    first = targets.agg(F.min("m_day").alias("d")).select(F.unix_micros(F.least(
        tk.day_start(F.col("d"), tz), tk.day_start(F.date_sub(today, look_back), tz),
        now - F.expr("INTERVAL 24 HOURS"))).alias("t")).first()["t"]
    since = F.timestamp_micros(F.lit(first - int(max(tolerance_seconds, max_gap_seconds) * 1_000_000)))
    intervals = cut_lineage(intervals.filter(F.col("start_ts") >= since))
    samples = cut_lineage(samples.filter(F.col("ts") >= since).select("site_id", "ts", "channel", "power_w"))
    zones = cut_lineage(zones.filter(F.col("ts") >= since))
    sites = targets.select("site_id").unionByName(of_samples.select("site_id")).unionByName(
        of_zones.select("site_id")).distinct()
    windows = cut_lineage(energy.choose_window(
        intervals, samples, zones, now, tz=tz, sites=sites, targets=targets, **window_options))
    w_intervals = cut_lineage(_within(intervals, windows, "start_ts"))
    w_samples = cut_lineage(_within(samples, windows, "ts"))
    w_zones = cut_lineage(_within(zones, windows, "ts"))
    main_zones = of_zones.select("site_id", "zone")
    options = {"max_gap_seconds": max_gap_seconds, "bucket_seconds": bucket_seconds,
               "tail_seconds": 2 * poll_seconds if tail_seconds is None else tail_seconds}
    main_zone = w_zones.join(main_zones, ["site_id", "zone"], "left_semi")
    # What other frames are made of is kept as well, a few rows a site; no plan holds the whole analysis.
    cycles = cut_lineage(series.cooling_sessions(
        main_zone, gap_seconds=cycle_gap_seconds, bucket_seconds=bucket_seconds))
    stats = energy.cycle_stats(cycles, w_samples, compressor=compressor, **(cycle_options or {}))
    hvac = energy.channel_energy(
        w_samples.filter(F.col("channel").isin(*hvac_channels)).withColumn("channel", F.lit("hvac"))
        .join(windows.select("site_id", "window_start", "window_end"), "site_id"), ["site_id"], **options)
    stats = cut_lineage(stats.join(hvac.select("site_id", F.col("kwh").alias("hvac_energy_kwh")), "site_id", "left"))
    parts = cut_lineage(energy.breakdown(w_intervals, w_samples, windows, hvac_channels=hvac_channels, **options))
    peaks = cut_lineage(energy.demand_peaks(
        w_samples, w_intervals, zones, hvac_channels=hvac_channels, cooldown_seconds=cooldown_seconds,
        tolerance_seconds=tolerance_seconds, interval_minutes=interval_minutes,
        bucket_seconds=bucket_seconds, cell_seconds=interval_minutes * 60))
    agreement = parts.select(
        "site_id", F.lit(False).alias("available"), F.lit("no_whole_home_ct").alias("classification"),
        F.when(F.col("meter_kwh") > 0, F.col("meter_kwh")).alias("meter_kwh"),
        F.when(F.col("monitored_kwh") > 0, F.col("monitored_kwh")).alias("circuit_kwh"),
        F.when(F.col("hvac_kwh") > 0, F.col("hvac_kwh")).alias("hvac_circuit_kwh"))
    slices, diagnostics = energy.valid_day_shares(intervals, samples, now, **{
        "channels": channels, "labels": labels, "tz": tz, "interval_minutes": interval_minutes,
        "poll_seconds": poll_seconds, "max_gap_seconds": max_gap_seconds, "look_back": look_back, "sites": sites,
        **(share_options or {})})
    return {
        "window": windows,
        "cycles": cycles,
        "hvac_stats": stats,
        "agreement": agreement,
        "breakdown": parts,
        "peaks": peaks,
        "timeline": energy.timeline(
            w_intervals, w_samples, w_zones, windows, hvac_channels=hvac_channels,
            gap_seconds=cycle_gap_seconds, interval_minutes=interval_minutes, bucket_seconds=bucket_seconds),
        "trends": energy.daily_trends(
            intervals, samples, zones, now, tz=tz, hvac_channels=hvac_channels,
            interval_minutes=interval_minutes, poll_seconds=poll_seconds, sites=sites, **options),
        "quality": health.data_quality(intervals, samples, zones, now, windows, latest_of={
            "meter": days.groupBy("site_id").agg(F.max("latest").alias("latest")), "sample": of_samples, "zone": of_zones}),
        "shares": slices,
        "diagnostics": diagnostics,
        "findings": energy.findings(peaks, parts, stats, tz=tz),
        "primary_zone": main_zones,
    }
