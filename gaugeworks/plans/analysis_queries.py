"""The full analysis of every site as one query: a row a site with the figures of every frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.plans import analysis
from gaugeworks.plans.bindings import (
    CHANNELS,
    HOUR,
    HVAC_CHANNELS,
    INTERVAL_MINUTES,
    SQL_I,
    SQL_NOW,
    SQL_S,
    SQL_Z,
    intervals,
    now,
    samples,
    zones,
)
from gaugeworks.plans.energy_queries import (
    BREAKDOWN_OF_WIN,
    CYCLES_OF_X,
    FINDINGS_OF_BD_PK_CS,
    GAP,
    HVAC_SQL,
    PEAKS_OF_S_Z_I,
    SESSIONS_OF_Z,
    SHARE_OPTIONS,
    TAIL,
)
from gaugeworks.plans.registry import ORACLES, plain, query
from gaugeworks.session import cut_lineage

_BREAKDOWN = f"""WITH s AS (SELECT * FROM s_in), i AS (SELECT * FROM i_in), {BREAKDOWN_OF_WIN.strip()}"""
_PEAKS = f"""WITH s AS (SELECT * FROM s_in), z AS (SELECT * FROM z0), i AS (SELECT * FROM i_in), {PEAKS_OF_S_Z_I.strip()}"""
_CYCLES = f"""WITH z AS (SELECT z_in.* FROM z_in JOIN main USING (site_id, zone)), {SESSIONS_OF_Z.strip()}, {CYCLES_OF_X.strip()}"""


def _of(source: str, name: str) -> str:
    """A source of the other twins under a name of its own."""
    return source.replace(f"{name} AS (", f"{name}0 AS (", 1)


def _inside(name: str, ts: str) -> str:
    return f"{name}_in AS (SELECT x.* FROM {name}0 x JOIN win USING (site_id) WHERE {ts} >= ws AND {ts} < we)"


@query("r02_analysis", f"""
WITH {_of(SQL_S, 's')}, {_of(SQL_Z, 'z')}, {_of(SQL_I, 'i')},
win AS (SELECT site_id, basis, make_timestamp(window_start) AS ws, make_timestamp(window_end) AS we,
          has_meter AS wm, has_samples AS wsm, has_zones AS wz FROM ({ORACLES['w09_window_choice']})),
{_inside('s', 'ts')}, {_inside('z', 'ts')}, {_inside('i', 'start_ts')},
main AS (SELECT site_id, coalesce(max(zone) FILTER (WHERE zone = 'downstairs'), min(zone)) AS zone FROM z0 GROUP BY site_id),
br AS ({_BREAKDOWN} SELECT * FROM bd),
peak AS ({_PEAKS} SELECT * FROM pk),
cycle AS ({_CYCLES} SELECT * FROM cs),
hp AS (SELECT x.site_id, x.ts, any_value(we) AS we, sum(power_w) AS power_w FROM s_in x JOIN win USING (site_id)
  WHERE channel IN {HVAC_SQL} GROUP BY x.site_id, x.ts),
hl AS (SELECT *, lead(ts) OVER (PARTITION BY site_id ORDER BY ts) AS nx FROM hp),
hvac AS (SELECT site_id, round(sum(CASE WHEN nx IS NULL THEN power_w * least(7200.0, (epoch_us(we) - epoch_us(ts)) / 1e6)
    WHEN epoch_us(nx) - epoch_us(ts) <= 21600000000 THEN power_w * ((epoch_us(nx) - epoch_us(ts)) / 1e6) ELSE 0 END) / 3.6e6, 4) AS kwh
  FROM hl GROUP BY site_id),
bc AS (SELECT DISTINCT site_id, ts FROM z_in WHERE action = 'COOLING'),
bf AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY site_id ORDER BY ts)) <= 43200000000 THEN 0 ELSE 1 END AS fresh FROM bc),
tl AS (SELECT site_id, count(*) AS rows, count_if(kind = 'b') AS bands FROM (
  SELECT site_id, 'i' AS kind FROM i_in UNION ALL SELECT site_id, 'c' FROM (SELECT DISTINCT site_id, ts, channel FROM s_in)
  UNION ALL SELECT site_id, 't' FROM (SELECT DISTINCT site_id, ts FROM s_in)
  UNION ALL SELECT site_id, 'h' FROM (SELECT DISTINCT site_id, ts FROM s_in WHERE channel IN {HVAC_SQL})
  UNION ALL SELECT site_id, 'z' FROM z_in UNION ALL SELECT site_id, 'b' FROM bf WHERE fresh = 1) GROUP BY site_id),
trend AS (SELECT site_id, count_if(adequate_coverage) AS days, round(sum(meter_kwh), 2) AS kwh, sum(cooling_minutes) AS cooling,
  max(peak_kw) AS peak FROM ({ORACLES['a13_trends']}) GROUP BY site_id),
share AS (SELECT site_id, any_value(day) AS day, count(*) AS slices, round(sum(kwh), 3) AS kwh FROM ({ORACLES['a14_day_shares']}) GROUP BY site_id),
diag AS ({ORACLES['a14_day_diagnostics']}),
age AS (SELECT site_id, greatest(0, (epoch_us({SQL_NOW}) - epoch_us(max(ts))) // 60000000) AS age FROM z0 GROUP BY site_id),
mage AS (SELECT site_id, greatest(0, (epoch_us({SQL_NOW}) - epoch_us(max(end_ts))) // 60000000) AS age FROM i0 GROUP BY site_id),
mr AS (SELECT site_id, count(*) AS n FROM i_in GROUP BY site_id),
sr AS (SELECT site_id, count(DISTINCT ts) AS n FROM s_in GROUP BY site_id),
fi AS (WITH bd AS (SELECT * FROM br), pk AS (SELECT * FROM peak), cs AS (SELECT * FROM cycle), {FINDINGS_OF_BD_PK_CS.strip()})
SELECT win.site_id, basis, epoch_us(ws) AS window_start, epoch_us(we) AS window_end, wm AS has_meter, wsm AS has_samples, wz AS has_zones,
  main.zone AS primary_zone, cycle.cycle_count, cycle.total_runtime_minutes, cycle.longest_cycle_minutes,
  CASE WHEN cycle.site_id IS NOT NULL THEN hvac.kwh END AS hvac_energy_kwh,
  br.meter_kwh, br.monitored_kwh, CASE WHEN br.meter_kwh > 0 AND br.monitored_kwh > 0 THEN round(greatest(br.meter_kwh - br.monitored_kwh, 0), 4) END AS remainder_kwh,
  CASE WHEN br.meter_kwh > 0 AND br.hvac_kwh > 0 THEN round(100.0 * br.hvac_kwh / br.meter_kwh, 1) END AS hvac_pct,
  CASE WHEN br.monitored_kwh > 0 THEN br.monitored_kwh END AS circuit_kwh,
  (SELECT count(*) FROM peak WHERE peak.site_id = win.site_id) AS peaks, epoch_us(p1.ts) AS peak_ts, p1.total_kw AS peak_kw,
  p1.action AS peak_action, p1.classification AS peak_class, coalesce(tl.rows, 0) AS timeline_rows, coalesce(tl.bands, 0) AS timeline_bands,
  trend.days AS trend_days, trend.kwh AS trend_kwh, trend.cooling AS trend_cooling_minutes, trend.peak AS trend_peak_kw,
  coalesce(mr.n, 0) AS meter_rows, coalesce(sr.n, 0) AS sample_rows, mage.age AS meter_age_minutes, age.age AS sample_age_minutes,
  age.age AS zone_age_minutes, share.day AS share_day, share.slices AS share_slices, share.kwh AS share_kwh,
  coalesce(diag.available, FALSE) AS share_available, diag.best_meter_day, coalesce(fi.findings, '') AS findings
FROM win LEFT JOIN main USING (site_id) LEFT JOIN cycle USING (site_id) LEFT JOIN hvac USING (site_id) LEFT JOIN br USING (site_id)
LEFT JOIN peak p1 ON p1.site_id = win.site_id AND p1.rank = 1 LEFT JOIN tl ON tl.site_id = win.site_id
LEFT JOIN trend ON trend.site_id = win.site_id LEFT JOIN share ON share.site_id = win.site_id LEFT JOIN diag ON diag.site_id = win.site_id
LEFT JOIN age ON age.site_id = win.site_id LEFT JOIN mage ON mage.site_id = win.site_id LEFT JOIN mr ON mr.site_id = win.site_id
LEFT JOIN sr ON sr.site_id = win.site_id LEFT JOIN fi ON fi.site_id = win.site_id""")
def r02(spark, sf):
    """One row per site: the chosen window and the figures of all frames of the analysis."""
    return plain(figures(analysis.analyse(
        intervals(spark, sf), samples(spark, sf), zones(spark, sf), now(), channels=CHANNELS,
        hvac_channels=HVAC_CHANNELS, compressor="click", interval_minutes=INTERVAL_MINUTES,
        max_gap_seconds=GAP, poll_seconds=6 * HOUR, tail_seconds=TAIL, cycle_gap_seconds=12 * HOUR,
        cooldown_seconds=6 * HOUR, tolerance_seconds=3 * HOUR,
        window_options={"min_samples": 2, "min_zone_samples": 1, "full_day_intervals": 3},
        cycle_options={"cell_seconds": 6 * HOUR}, share_options=SHARE_OPTIONS)))


def figures(frames: dict[str, DataFrame]) -> DataFrame:
    """A row per site out of the frames of an analysis, each reduced to its sites by itself."""
    def counted(column: str) -> Column:
        return F.coalesce(column, F.lit(0).cast("long")).alias(column)

    timeline = frames["timeline"].groupBy("site_id").agg(
        F.count(F.lit(1)).alias("timeline_rows"), F.count_if(F.col("kind") == "cooling_band").alias("timeline_bands"))
    peaks = frames["peaks"].groupBy("site_id").agg(
        F.count(F.lit(1)).alias("peaks"),
        F.min_by(F.struct("ts", "total_kw", "action", "classification"), "rank").alias("_top"))
    trends = frames["trends"].groupBy("site_id").agg(
        F.count_if("adequate_coverage").alias("trend_days"), F.round(F.sum("meter_kwh"), 2).alias("trend_kwh"),
        F.sum("cooling_minutes").alias("trend_cooling_minutes"), F.max("peak_kw").alias("trend_peak_kw"))
    shares = frames["shares"].groupBy("site_id").agg(
        F.max("day").alias("share_day"), F.count(F.lit(1)).alias("share_slices"), F.round(F.sum("kwh"), 3).alias("share_kwh"))
    parts = (
        frames["primary_zone"].select("site_id", F.col("zone").alias("primary_zone")),
        frames["hvac_stats"].select("site_id", "cycle_count", "total_runtime_minutes", "longest_cycle_minutes", "hvac_energy_kwh"),
        frames["breakdown"].select("site_id", "meter_kwh", "monitored_kwh", "remainder_kwh", "hvac_pct"),
        frames["agreement"].select("site_id", "circuit_kwh"), peaks, timeline, trends,
        frames["quality"].select("site_id", "meter_rows", "sample_rows", "meter_age_minutes", "sample_age_minutes", "zone_age_minutes"),
        shares, frames["diagnostics"].select("site_id", F.col("available").alias("share_available"), "best_meter_day"),
        frames["findings"].select("site_id", F.array_join("findings", " ").alias("findings")),
    )
    out = reduce(lambda a, b: a.join(b, "site_id", "left"), map(cut_lineage, parts), frames["window"])
    return out.select(
        *frames["window"].columns, "primary_zone", "cycle_count", "total_runtime_minutes", "longest_cycle_minutes",
        "hvac_energy_kwh", "meter_kwh", "monitored_kwh", "remainder_kwh", "hvac_pct", "circuit_kwh", counted("peaks"),
        F.col("_top.ts").alias("peak_ts"), F.col("_top.total_kw").alias("peak_kw"), F.col("_top.action").alias("peak_action"),
        F.col("_top.classification").alias("peak_class"), counted("timeline_rows"), counted("timeline_bands"),
        "trend_days", "trend_kwh", "trend_cooling_minutes", "trend_peak_kw", "meter_rows", "sample_rows",
        "meter_age_minutes", "sample_age_minutes", "zone_age_minutes", "share_day", "share_slices", "share_kwh",
        F.coalesce("share_available", F.lit(False)).alias("share_available"), "best_meter_day",
        F.coalesce("findings", F.lit("")).alias("findings"))
