"""Queries over sample series, intervals and zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions import timekeys as tk
from gaugeworks.operators import energy, joins, series
from gaugeworks.plans.bindings import (
    CHANNELS,
    HOUR,
    HVAC_CHANNELS,
    INTERVAL_MINUTES,
    NOW,
    SQL_I,
    SQL_NOW,
    SQL_S,
    SQL_T,
    SQL_Z,
    intervals,
    now,
    samples,
    zones,
)
from gaugeworks.plans.registry import plain, query, table

GAP = 6 * HOUR
TAIL = 2 * HOUR
HVAC_SQL = "('click', 'view')"


def _integral_sql(source: str, by: str) -> str:
    """kWh per ``by`` of ``source`` (site_id, ts, day, power_w, ...)."""
    return f"""
st AS (SELECT *, lead(ts) OVER (PARTITION BY {by} ORDER BY ts) AS nx FROM {source}),
e AS (SELECT {by}, count(*) AS sample_count, round(sum(
        CASE WHEN nx IS NULL THEN power_w * least(7200.0,
               (epoch_us(CAST(day AS TIMESTAMP) + INTERVAL 30 HOUR) - epoch_us(ts)) / 1e6)
             WHEN epoch_us(nx) - epoch_us(ts) <= 21600000000
               THEN power_w * ((epoch_us(nx) - epoch_us(ts)) / 1e6)
             ELSE 0 END) / 3.6e6, 4) AS kwh
      FROM st GROUP BY {by})"""


@query("w01_integrate", f"""
WITH {SQL_T}, {_integral_sql('t', 'site_id, day')}
SELECT site_id, CAST(day AS VARCHAR) AS day, kwh, sample_count FROM e""")
def w01(spark, sf):
    out = series.daily_energy(samples(spark, sf), max_gap_seconds=GAP, tail_seconds=TAIL)
    return plain(out.select("site_id", "day", "kwh", "sample_count"))


SESSIONS_OF_Z = """
c AS (SELECT site_id, zone, ts FROM z WHERE action = 'COOLING'),
f AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 43200000000
                     THEN 0 ELSE 1 END AS fresh
      FROM c WINDOW w AS (PARTITION BY site_id, zone ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY site_id, zone ORDER BY ts
                                 ROWS UNBOUNDED PRECEDING) AS sid FROM f),
x AS (SELECT site_id, zone, min(ts) AS session_start, max(ts) AS session_end,
             count(*) AS sample_count FROM g GROUP BY site_id, zone, sid)"""
_SESSIONS_SQL = f"""
WITH {SQL_Z}, {SESSIONS_OF_Z.strip()}"""


@query("w02_sessions", _SESSIONS_SQL + """
SELECT site_id, zone, epoch_us(session_start) AS session_start,
       epoch_us(session_end) AS session_end, sample_count FROM x""")
def w02(spark, sf):
    out = series.cooling_sessions(zones(spark, sf), gap_seconds=12 * HOUR)
    return plain(out.drop("duration_minutes"))


@query("w03_bands", f"""
WITH {SQL_Z}, c AS (SELECT DISTINCT site_id, ts FROM z WHERE action = 'COOLING'),
f AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 43200000000
                     THEN 0 ELSE 1 END AS fresh
      FROM c WINDOW w AS (PARTITION BY site_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY site_id ORDER BY ts
                                 ROWS UNBOUNDED PRECEDING) AS sid FROM f)
SELECT site_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) AS session_end,
       count(*) AS sample_count FROM g GROUP BY site_id, sid""")
def w03(spark, sf):
    return plain(series.cooling_bands(zones(spark, sf), gap_seconds=12 * HOUR))


# Zone actions within the tolerance on either side of a peak, the nearer one, back on ties.
PEAKS_OF_S_Z_I = f"""
tot AS (SELECT site_id, ts, round(sum(round(power_w / 1000, 4)), 4) AS total_kw,
               round(sum(CAST(CASE WHEN channel IN {HVAC_SQL} THEN round(power_w / 1000, 4)
                              ELSE 0 END AS DECIMAL(18,4))), 2) AS hvac_kw
        FROM s GROUP BY site_id, ts),
f AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY site_id ORDER BY ts))
                     <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM tot),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY site_id ORDER BY ts ROWS UNBOUNDED PRECEDING)
                AS sid FROM f),
best AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY site_id, sid
                                                    ORDER BY total_kw DESC, ts) = 1),
p AS (SELECT site_id, ts, total_kw, hvac_kw,
             row_number() OVER (PARTITION BY site_id ORDER BY total_kw DESC, ts) AS rank
      FROM best QUALIFY rank <= 5),
a AS (SELECT site_id, ts, list_sort(list(DISTINCT action)) AS actions
      FROM z WHERE action IS NOT NULL GROUP BY site_id, ts),
near AS (SELECT p.site_id, p.rank, a.actions,
                row_number() OVER (PARTITION BY p.site_id, p.rank
                    ORDER BY abs(epoch_us(a.ts) - epoch_us(p.ts)), a.ts) AS k
         FROM p JOIN a ON a.site_id = p.site_id
          AND abs(epoch_us(a.ts) - epoch_us(p.ts)) < 10800000000),
m AS (SELECT p.*, round(i.kwh / 6, 4) AS meter_kw, n.actions
      FROM p LEFT JOIN i ON i.site_id = p.site_id AND i.start_ts <= p.ts AND p.ts < i.end_ts
             LEFT JOIN near n ON n.site_id = p.site_id AND n.rank = p.rank AND n.k = 1),
k AS (SELECT *, CASE WHEN list_contains(actions, 'COOLING') THEN 'COOLING'
                     WHEN list_contains(actions, 'HEATING') THEN 'HEATING'
                     ELSE actions[1] END AS action FROM m),
pk AS (SELECT site_id, rank, ts, round(CAST(total_kw AS DECIMAL(18,4)), 2) AS total_kw, hvac_kw,
       round(CAST(meter_kw AS DECIMAL(18,4)), 2) AS meter_kw,
       round(greatest(CAST(meter_kw AS DECIMAL(18,4)) - CAST(total_kw AS DECIMAL(18,4)), 0), 2)
         AS remainder_kw,
       action,
       CASE WHEN total_kw <= 0 THEN 'Unknown — no Tuya data'
            WHEN action = 'COOLING' AND hvac_kw / total_kw >= 0.6 THEN 'HVAC only'
            WHEN hvac_kw / total_kw >= 0.5 THEN 'HVAC only'
            WHEN action IS NULL THEN 'Unknown — missing Nest data'
            ELSE 'Mixed load' END AS classification
FROM k)"""
_PEAKS_SQL = f"""
WITH {SQL_S}, {SQL_Z}, {SQL_I},{PEAKS_OF_S_Z_I}"""


def _peaks(spark, sf):
    return energy.demand_peaks(
        samples(spark, sf), intervals(spark, sf), zones(spark, sf), hvac_channels=HVAC_CHANNELS,
        cooldown_seconds=6 * HOUR, tolerance_seconds=3 * HOUR, interval_minutes=INTERVAL_MINUTES,
        cell_seconds=6 * HOUR,
    )


@query("w04_peaks", _PEAKS_SQL + """
SELECT site_id, rank, epoch_us(ts) AS ts, total_kw, hvac_kw, meter_kw, remainder_kw, action,
       classification FROM pk""")
def w04(spark, sf):
    return plain(_peaks(spark, sf).drop("peak_source"))


@query("w05_gap", """
WITH d AS (SELECT DISTINCT user_id AS site_id, event_type AS channel, ts FROM events),
g AS (SELECT *, lag(ts) OVER (PARTITION BY site_id, channel ORDER BY ts) AS prev FROM d)
SELECT site_id, channel, epoch_us(min(prev)) AS gap_start, epoch_us(min(ts)) AS gap_end,
       arg_min((epoch_us(ts) - epoch_us(prev)) / 1e6, ts) AS gap_seconds, count(*) AS gap_count
FROM g WHERE (epoch_us(ts) - epoch_us(prev)) / 1e6 > 43200 GROUP BY site_id, channel""")
def w05(spark, sf):
    return plain(series.first_gap(
        samples(spark, sf), ["site_id", "channel"], threshold_seconds=12 * HOUR
    ))


@query("w06_counter", """
WITH r AS (SELECT user_id AS host, ts,
        sum(CAST(round(value * 100) AS BIGINT)) OVER w AS total,
        sum(CASE WHEN event_type = 'view' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END)
          OVER w AS idle
      FROM events
      WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING)),
d AS (SELECT host, ts, total - lag(total) OVER v AS dt, idle - lag(idle) OVER v AS di
      FROM r WINDOW v AS (PARTITION BY host ORDER BY ts))
SELECT host, epoch_us(ts) AS ts,
       CASE WHEN dt > 0 THEN round(greatest(0.0, least(100.0, 100.0 * (dt - di) / dt)), 6) END
         AS busy_percent
FROM d""")
def w06(spark, sf):
    from pyspark.sql import Window

    # A counter that restarts every day, so that it also falls at times.
    w = Window.partitionBy("host", F.to_date("ts")).orderBy("ts").rowsBetween(
        Window.unboundedPreceding, 0)
    cents = F.round(F.col("value") * 100).cast("long")
    counters = table(spark, sf, "events").select(
        F.col("user_id").alias("host"), "ts", cents.alias("c"),
        F.when(F.col("event_type") == "view", cents).otherwise(0).alias("i"),
    ).select("host", "ts", F.sum("c").over(w).alias("cpu_total_jiffies"),
             F.sum("i").over(w).alias("cpu_idle_jiffies"))
    out = series.counter_rates(counters)
    return plain(out.select("host", "ts", F.round("busy_percent", 6).alias("busy_percent")))


@query("w07_series", f"""
WITH {SQL_S}
SELECT site_id, channel, epoch_us(ts) AS ts, round(power_w / 1000, 4) AS kw FROM s
WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'
UNION ALL
SELECT site_id, 'total', epoch_us(ts), round(sum(power_w) / 1000, 4) FROM s
WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' GROUP BY site_id, ts""")
def w07(spark, sf):
    bounds = {"start": tk.utc_literal("2024-01-05 00:00:00"),
              "end": tk.utc_literal("2024-01-25 00:00:00")}
    each = series.channel_kw_series(samples(spark, sf), **bounds)
    total = series.kw_series(samples(spark, sf), **bounds).withColumn("channel", F.lit("total"))
    return plain(each.unionByName(total))


@query("w10_latest", """
SELECT user_id AS site_id, max(epoch_us(ts)) AS ts, arg_max(event_type, ts) AS channel,
       round(arg_max(value, ts) * 3.14159, 4) AS power_w FROM events GROUP BY user_id""")
def w10(spark, sf):
    return plain(series.latest_record(samples(spark, sf), ["site_id"])).select(
        "site_id", "ts", "channel", F.round("power_w", 4).alias("power_w"))


# ---- joins ---------------------------------------------------------------------------

@query("j04_asof", f"""
WITH {SQL_Z}, {SQL_I},
a AS (SELECT site_id, ts, coalesce(bool_or(action = 'COOLING'), FALSE) AS cooling
      FROM z GROUP BY site_id, ts),
j AS (SELECT i.*, a.ts AS sample_ts, a.cooling
      FROM i ASOF LEFT JOIN a ON i.site_id = a.site_id AND i.end_ts > a.ts),
k AS (SELECT *, sample_ts >= least(start_ts, end_ts - INTERVAL 10 MINUTE) AS ok FROM j)
SELECT site_id, epoch_us(start_ts) AS start_ts, round(kwh, 4) AS kwh,
       ok AND cooling AS any_cooling,
       CASE WHEN ok AND cooling AND kwh >= 4 THEN
         'High usage (' || printf('%.2f', kwh) || ' kWh) during cooling' END AS note,
       CASE WHEN ok THEN epoch_us(sample_ts) END AS sample_ts
FROM k""")
def j04(spark, sf):
    out = energy.correlate(intervals(spark, sf), zones(spark, sf), high_kwh=4.0)
    return plain(out.select("site_id", "start_ts", F.round("kwh", 4).alias("kwh"), "any_cooling", "note",
                            "sample_ts"))


@query("j05_nearest", """
WITH l AS (SELECT event_id, user_id AS site_id, ts FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id AS site_id, ts, max(value) AS value FROM events WHERE event_type = 'view'
      GROUP BY user_id, ts),
c AS (SELECT l.event_id, r.ts AS matched_ts, r.value,
             row_number() OVER (PARTITION BY l.event_id
               ORDER BY abs(epoch_us(r.ts) - epoch_us(l.ts)), r.ts) AS k
      FROM l JOIN r ON r.site_id = l.site_id AND abs(epoch_us(r.ts) - epoch_us(l.ts)) < 14400000000)
SELECT l.event_id, l.site_id, epoch_us(c.matched_ts) AS matched_ts, c.value AS matched
FROM l LEFT JOIN c ON c.event_id = l.event_id AND c.k = 1""")
def j05(spark, sf):
    events = table(spark, sf, "events")
    left = events.filter("event_type = 'purchase'").select(
        "event_id", F.col("user_id").alias("site_id"), "ts")
    right = events.filter("event_type = 'view'").groupBy(
        F.col("user_id").alias("site_id"), "ts").agg(F.max("value").alias("value"))
    out = joins.nearest(left, right, ["site_id"], payload=F.col("value"),
                        tolerance_seconds=4 * HOUR)
    return plain(out.select("event_id", "site_id", "matched_ts", "matched"))


@query("j06_interval", f"""
WITH {SQL_I}
SELECT e.event_id, round(i.kwh / 6, 4) AS meter_kw
FROM events e LEFT JOIN i ON i.site_id = e.user_id AND i.start_ts <= e.ts AND e.ts < i.end_ts
""")
def j06(spark, sf):
    points = table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("site_id"), "ts")
    out = joins.interval_value_at(points, intervals(spark, sf), point_key=["event_id"],
                                  value="kwh", out="kwh", cell_seconds=6 * HOUR, disjoint=True)
    return out.select("event_id", tk.mean_kw("kwh", INTERVAL_MINUTES).alias("meter_kw"))


@query("j07_range", _SESSIONS_SQL + """
SELECT x.site_id, x.zone, epoch_us(x.session_start) AS session_start,
       count(e.ts) AS reading_count, round(avg(e.value * 3.14159) / 1000, 3) AS mean_kw
FROM x JOIN events e ON e.user_id = x.site_id AND e.ts >= x.session_start
     AND e.ts <= x.session_end AND e.value > 0 AND e.event_type = 'click'
GROUP BY x.site_id, x.zone, x.session_start""")
def j07(spark, sf):
    cycles = series.cooling_sessions(zones(spark, sf), gap_seconds=12 * HOUR)
    clicks = samples(spark, sf).filter("channel = 'click' AND power_w > 0")
    pairs = joins.range_join(
        clicks, cycles.select("site_id", "zone", "session_start", "session_end"), ["site_id"],
        start="session_start", end="session_end", closed=True, cell_seconds=6 * HOUR)
    return plain(pairs.groupBy("site_id", "zone", "session_start").agg(
        F.count(F.lit(1)).alias("reading_count"),
        F.round(F.avg("power_w") / 1000, 3).alias("mean_kw")))


@query("j15_overlap", f"""
WITH {SQL_I}, {SQL_Z},
l AS (SELECT site_id, min(start_ts) AS ls, max(end_ts) AS le FROM i GROUP BY site_id),
zz AS (SELECT * FROM z WHERE action = 'COOLING'),
r AS (SELECT site_id, min(ts) AS rs, max(ts) AS re FROM zz GROUP BY site_id),
b AS (SELECT coalesce(l.site_id, r.site_id) AS site_id, ls, rs,
             CASE WHEN ls < re AND rs < le THEN greatest(ls, rs) END AS os,
             CASE WHEN ls < re AND rs < le THEN least(le, re) END AS oe
      FROM l FULL JOIN r ON l.site_id = r.site_id),
w AS (SELECT *, greatest(oe - INTERVAL 72 HOUR, os) AS ws FROM b),
ir AS (SELECT i.* FROM i JOIN w ON w.site_id = i.site_id AND start_ts >= ws AND start_ts < oe),
st AS (SELECT DISTINCT site_id, ts FROM zz),
m AS (SELECT ir.site_id, count(*) AS n,
             count_if(EXISTS (SELECT 1 FROM st WHERE st.site_id = ir.site_id AND st.ts < ir.end_ts
                AND st.ts >= least(ir.start_ts, ir.end_ts - INTERVAL 10 MINUTE))) AS k
      FROM ir GROUP BY ir.site_id),
sr AS (SELECT w.site_id, count(*) AS n FROM w JOIN st ON st.site_id = w.site_id
         AND st.ts >= ws AND st.ts < oe GROUP BY w.site_id)
SELECT w.site_id, epoch_us(os) AS overlap_start, epoch_us(oe) AS overlap_end,
       epoch_us(ws) AS window_start, coalesce(m.n, 0) AS interval_rows,
       coalesce(sr.n, 0) AS sample_rows, coalesce(m.k, 0) AS matched_rows,
       CASE WHEN ls IS NULL THEN 'no_interval_data' WHEN rs IS NULL THEN 'no_sample_data'
            WHEN os IS NULL THEN 'no_overlap'
            WHEN ws >= oe OR coalesce(m.n, 0) = 0 THEN 'no_rows_in_window'
            WHEN coalesce(m.k, 0) = 0 THEN 'no_matched_rows' ELSE 'available' END AS status
FROM w LEFT JOIN m ON m.site_id = w.site_id LEFT JOIN sr ON sr.site_id = w.site_id""")
def j15(spark, sf):
    cooling = zones(spark, sf).filter("action = 'COOLING'")
    out = energy.correlation_status(intervals(spark, sf), cooling, hours=72)
    return plain(out.drop("window_end"))


@query("j19_reconcile", f"""
WITH {SQL_S}, {SQL_I},
p AS (SELECT site_id, channel, ts, any_value(day) AS day, sum(power_w) AS power_w
      FROM s GROUP BY site_id, channel, ts), {_integral_sql('p', 'site_id, channel, day')},
c AS (SELECT site_id, day, round(sum(kwh), 4) AS monitored_kwh FROM e WHERE kwh > 0
      GROUP BY site_id, day),
m AS (SELECT site_id, CAST(start_ts - INTERVAL 6 HOUR AS DATE) AS day, round(sum(kwh), 4) AS meter_kwh
      FROM i GROUP BY ALL)
SELECT coalesce(m.site_id, c.site_id) AS site_id,
       CAST(coalesce(m.day, c.day) AS VARCHAR) AS day, meter_kwh, monitored_kwh,
       CASE WHEN meter_kwh > 0 AND monitored_kwh > 0
            THEN round(greatest(meter_kwh - monitored_kwh, 0), 4) END AS remainder_kwh,
       FALSE AS comparable
FROM m FULL JOIN c ON m.site_id = c.site_id AND m.day = c.day""")
def j19(spark, sf):
    return plain(energy.reconcile_daily(
        intervals(spark, sf), samples(spark, sf), max_gap_seconds=GAP, tail_seconds=TAIL))


# ---- aggregates ----------------------------------------------------------------------

@query("s07_range_scan", f"""
WITH {SQL_I} SELECT site_id, epoch_us(start_ts) AS start_ts, epoch_us(end_ts) AS end_ts,
  round(kwh, 4) AS kwh FROM i WHERE provider = 'meter' AND start_ts >= TIMESTAMP '2024-01-10'
  AND start_ts < TIMESTAMP '2024-01-20'""")
def s07(spark, sf):
    out = energy.range_scan(
        intervals(spark, sf), tk.utc_literal("2024-01-10 00:00:00"),
        tk.utc_literal("2024-01-20 00:00:00"), provider="meter")
    return plain(out.drop("provider").withColumn("kwh", F.round("kwh", 4)))


@query("a01_daily", f"""
WITH {SQL_I} SELECT site_id, CAST(CAST(start_ts - INTERVAL 6 HOUR AS DATE) AS VARCHAR) AS day,
  round(sum(kwh), 4) AS kwh FROM i GROUP BY ALL""")
def a01(spark, sf):
    return plain(energy.daily_totals(intervals(spark, sf)))


@query("a02_monthly", f"""
WITH {SQL_I} SELECT site_id, strftime(start_ts - INTERVAL 6 HOUR, '%Y-%m') AS month,
  round(sum(kwh), 4) AS kwh FROM i GROUP BY ALL""")
def a02(spark, sf):
    return energy.monthly_totals(intervals(spark, sf))


@query("a03_hourly", f"""
WITH {SQL_I} SELECT site_id, CAST(hour(start_ts - INTERVAL 6 HOUR) AS INTEGER) AS hour,
  round(avg(kwh), 4) AS avg_kwh FROM i GROUP BY ALL""")
def a03(spark, sf):
    return energy.hourly_profile(intervals(spark, sf))


@query("a04_avg_daily", f"""
WITH {SQL_I}, d AS (SELECT site_id, CAST(start_ts - INTERVAL 6 HOUR AS DATE) AS day,
    round(sum(kwh), 4) AS kwh FROM i
    WHERE start_ts >= CAST(CAST({SQL_NOW} - INTERVAL 6 HOUR AS DATE) - 6 AS TIMESTAMP) + INTERVAL 6 HOUR
    GROUP BY ALL),
m AS (SELECT site_id, round(avg(kwh), 2) AS avg_kwh, count(*) AS day_count FROM d GROUP BY site_id)
SELECT x.site_id, m.avg_kwh, coalesce(m.day_count, 0) AS day_count
FROM (SELECT DISTINCT site_id FROM i) x LEFT JOIN m ON m.site_id = x.site_id""")
def a04(spark, sf):
    return energy.average_daily_usage(intervals(spark, sf), 7, now(), digits=2)


@query("a05_bounds", f"""
WITH {SQL_I} SELECT site_id, epoch_us(min(start_ts)) AS range_start,
  epoch_us(max(end_ts)) AS range_end, count(*) AS interval_count FROM i GROUP BY site_id""")
def a05(spark, sf):
    return plain(energy.range_bounds(intervals(spark, sf)))


@query("a06_window_total", f"""
WITH {SQL_I} SELECT site_id, round(sum(CASE WHEN start_ts >= TIMESTAMP '2024-01-08'
  AND start_ts < TIMESTAMP '2024-01-15' THEN kwh ELSE 0 END), 4) AS kwh FROM i GROUP BY site_id""")
def a06(spark, sf):
    return energy.window_total(
        intervals(spark, sf), tk.utc_literal("2024-01-08 00:00:00"),
        tk.utc_literal("2024-01-15 00:00:00"))


_MISSING_SQL = """
b AS (SELECT site_id, min(start_ts) AS s0, max(end_ts) AS e0 FROM i GROUP BY site_id),
grid AS (SELECT site_id, unnest(generate_series(s0, e0 - INTERVAL 6 HOUR, INTERVAL 6 HOUR)) AS g
         FROM b),
miss AS (SELECT grid.site_id, count(*) AS expected_count,
                count_if(i.start_ts IS NULL) AS missing_count
         FROM grid LEFT JOIN i ON i.site_id = grid.site_id AND i.start_ts = grid.g
         GROUP BY grid.site_id)"""


@query("a07_summary", f"""
WITH {SQL_I}, {_MISSING_SQL}
SELECT i.site_id, count(*) AS interval_count, epoch_us(min(start_ts)) AS range_start,
       epoch_us(max(end_ts)) AS range_end, round(sum(kwh), 4) AS total_kwh,
       epoch_us(arg_min(start_ts, (-kwh, start_ts))) AS peak_start,
       round(max(kwh) / 6, 4) AS peak_kw, any_value(missing_count) AS missing_count
FROM i JOIN miss ON miss.site_id = i.site_id GROUP BY i.site_id""")
def a07(spark, sf):
    return plain(energy.summary(intervals(spark, sf), interval_minutes=INTERVAL_MINUTES))


@query("a08_missing", f"WITH {SQL_I}, {_MISSING_SQL} SELECT * FROM miss")
def a08(spark, sf):
    return series.missing_intervals(intervals(spark, sf), interval_minutes=INTERVAL_MINUTES)


@query("a09_interval_coverage", f"""
WITH {SQL_I} SELECT site_id, CAST(CAST(start_ts - INTERVAL 6 HOUR AS DATE) AS VARCHAR) AS day,
  count(*) AS interval_count, round(100.0 * count(*) / 4, 1) AS coverage_pct FROM i GROUP BY ALL""")
def a09(spark, sf):
    return plain(series.interval_coverage(intervals(spark, sf), interval_minutes=INTERVAL_MINUTES))


@query("a10_sample_coverage", f"""
WITH {SQL_S} SELECT site_id, channel, CAST(day AS VARCHAR) AS day, count(*) AS reading_count,
  round(least(100.0, 100.0 * count(*) / 4), 1) AS coverage_pct FROM s GROUP BY ALL""")
def a10(spark, sf):
    return plain(series.sample_coverage(samples(spark, sf), poll_seconds=6 * HOUR))


_QUALITY_SQL = """
st AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY site_id, day, channel
               ORDER BY ts))) / 1e6 AS gap FROM s),
q AS (SELECT site_id, day, channel, count(*) AS n, min(ts) AS f, max(ts) AS l,
             arg_min(gap, ts) FILTER (WHERE gap > 14400) AS wide
      FROM st GROUP BY ALL),
grid AS (SELECT DISTINCT site_id, day, c.channel FROM s
         CROSS JOIN (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) c(channel)),
k AS (SELECT g.site_id, g.day, g.channel, coalesce(n, 0) AS n,
             round(least(100.0, 100.0 * coalesce(n, 0) / 4), 1) AS cov,
             (epoch_us(f) - epoch_us(CAST(g.day AS TIMESTAMP) + INTERVAL 6 HOUR)) / 1e6 AS fo,
             (epoch_us(CAST(g.day AS TIMESTAMP) + INTERVAL 30 HOUR) - epoch_us(l)) / 1e6 AS lo, wide
      FROM grid g LEFT JOIN q ON q.site_id = g.site_id AND q.day = g.day AND q.channel = g.channel)"""


@query("a11_channel_quality", f"""
WITH {SQL_S}, {_QUALITY_SQL}
SELECT site_id, CAST(day AS VARCHAR) AS day, channel, n AS reading_count, cov AS coverage_pct,
  concat_ws('; ',
    CASE WHEN cov < 95 THEN channel || ': ' || printf('%.1f', cov) || '% coverage (need ≥ 95%)' END,
    CASE WHEN n = 0 THEN channel || ': no samples in window' END,
    CASE WHEN fo > 21600 THEN channel || ': first sample late' END,
    CASE WHEN lo > 21600 THEN channel || ': last sample early' END,
    CASE WHEN wide IS NOT NULL THEN channel || ': internal gap' END) AS failures
FROM k""")
def a11(spark, sf):
    out = series.channel_quality(
        samples(spark, sf), channels=CHANNELS, poll_seconds=6 * HOUR, edge_seconds=6 * HOUR,
        max_gap_seconds=4 * HOUR)
    # Minute counts are rounded differently at halves, so they leave the compared text.
    text = F.concat_ws("; ", "failures")
    text = F.regexp_replace(text, r"first sample \d+ min after window start \(need ≤ 360 min\)",
                            "first sample late")
    text = F.regexp_replace(text, r"last sample \d+ min before window end \(need ≤ 360 min\)",
                            "last sample early")
    text = F.regexp_replace(text, r"internal gap of \d+ min \(max 240 min\)", "internal gap")
    return plain(out.withColumn("failures", text))


BREAKDOWN_OF_WIN = f"""
pc AS (SELECT s.site_id, s.channel, s.ts, any_value(we) AS we, sum(power_w) AS power_w
       FROM s JOIN win ON win.site_id = s.site_id AND ts >= ws AND ts < we
       GROUP BY s.site_id, s.channel, s.ts),
pl AS (SELECT *, lead(ts) OVER (PARTITION BY site_id, channel ORDER BY ts) AS nx FROM pc),
pe AS (SELECT site_id, channel, round(sum(
        CASE WHEN nx IS NULL THEN power_w * least(7200.0, (epoch_us(we) - epoch_us(ts)) / 1e6)
             WHEN epoch_us(nx) - epoch_us(ts) <= 21600000000
               THEN power_w * ((epoch_us(nx) - epoch_us(ts)) / 1e6)
             ELSE 0 END) / 3.6e6, 4) AS kwh FROM pl GROUP BY site_id, channel),
pr AS (SELECT site_id, round(sum(kwh), 4) AS monitored_kwh,
        round(sum(CASE WHEN channel IN {HVAC_SQL} THEN kwh ELSE 0 END), 4) AS hvac_kwh,
        string_agg(channel || '=' || printf('%.4f', kwh), ',' ORDER BY channel) AS channel_kwh
       FROM pe WHERE kwh > 0 GROUP BY site_id),
mt AS (SELECT i.site_id, round(sum(kwh), 4) AS meter_kwh FROM i JOIN win ON win.site_id = i.site_id
        AND start_ts >= ws AND start_ts < we GROUP BY i.site_id),
bd AS (SELECT win.site_id, coalesce(meter_kwh, 0) AS meter_kwh, channel_kwh,
              coalesce(monitored_kwh, 0) AS monitored_kwh, coalesce(hvac_kwh, 0) AS hvac_kwh
       FROM win LEFT JOIN mt ON mt.site_id = win.site_id LEFT JOIN pr ON pr.site_id = win.site_id)"""
_WINDOW_SQL = f"""
win AS (SELECT site_id, TIMESTAMP '2024-01-08' AS ws, TIMESTAMP '2024-01-15' AS we
        FROM (SELECT DISTINCT site_id FROM i)),{BREAKDOWN_OF_WIN}"""


def _fixed_windows(spark, sf):
    return intervals(spark, sf).select("site_id").distinct().select(
        "site_id", tk.utc_literal("2024-01-08 00:00:00").alias("window_start"),
        tk.utc_literal("2024-01-15 00:00:00").alias("window_end"))


def _breakdown(spark, sf):
    return energy.breakdown(
        intervals(spark, sf), samples(spark, sf), _fixed_windows(spark, sf),
        hvac_channels=HVAC_CHANNELS, max_gap_seconds=GAP, tail_seconds=TAIL)


@query("a12_breakdown", f"""
WITH {SQL_S}, {SQL_I}, {_WINDOW_SQL}
SELECT site_id, meter_kwh, channel_kwh, monitored_kwh,
  CASE WHEN meter_kwh > 0 AND monitored_kwh > 0
       THEN round(greatest(meter_kwh - monitored_kwh, 0), 4) END AS remainder_kwh, hvac_kwh,
  CASE WHEN meter_kwh > 0 AND hvac_kwh > 0 THEN round(100.0 * hvac_kwh / meter_kwh, 1) END AS hvac_pct,
  meter_kwh > 0 AS has_meter, monitored_kwh > 0 AS has_samples
FROM bd""")
def a12(spark, sf):
    out = _breakdown(spark, sf)
    pairs = F.transform(
        F.map_entries("channel_kwh"),
        lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"])))
    text = F.when(F.col("channel_kwh").isNotNull(), F.array_join(pairs, ","))
    return out.withColumn("channel_kwh", text)


@query("a13_trends", f"""
WITH {SQL_T}, {SQL_Z}, {SQL_I}, {_integral_sql('t', 'site_id, day')},
h AS (SELECT site_id, ts, any_value(day) AS day, sum(power_w) AS power_w FROM s
      WHERE channel IN {HVAC_SQL} GROUP BY site_id, ts),
hs AS (SELECT *, lead(ts) OVER (PARTITION BY site_id, day ORDER BY ts) AS nx FROM h),
he AS (SELECT site_id, day, round(sum(
        CASE WHEN nx IS NULL THEN power_w * least(7200.0,
               (epoch_us(CAST(day AS TIMESTAMP) + INTERVAL 30 HOUR) - epoch_us(ts)) / 1e6)
             WHEN epoch_us(nx) - epoch_us(ts) <= 21600000000
               THEN power_w * ((epoch_us(nx) - epoch_us(ts)) / 1e6)
             ELSE 0 END) / 3.6e6, 4) AS kwh FROM hs GROUP BY site_id, day),
m AS (SELECT site_id, CAST(start_ts - INTERVAL 6 HOUR AS DATE) AS day, sum(kwh) AS kwh,
             count(*) AS n, max(kwh) AS mx FROM i GROUP BY ALL),
r AS (SELECT site_id, day, count(*) AS n FROM t GROUP BY ALL),
ct AS (SELECT site_id, ts, coalesce(bool_or(action = 'COOLING'), FALSE) AS c FROM z GROUP BY ALL),
c AS (SELECT site_id, CAST(ts - INTERVAL 6 HOUR AS DATE) AS day, count_if(c) * 5.0 AS minutes
      FROM ct GROUP BY ALL),
cal AS (SELECT x.site_id, CAST(g AS DATE) AS day, CAST(g AS DATE) = DATE '2024-01-29' AS is_today
        FROM (SELECT DISTINCT user_id AS site_id FROM events) x,
             (SELECT unnest(generate_series(DATE '2024-01-23', DATE '2024-01-29', INTERVAL 1 DAY)) AS g)),
k AS (SELECT cal.*, m.kwh AS mk, m.n AS mn, m.mx, e.kwh AS ek, he.kwh AS hk, c.minutes,
        round(100.0 * coalesce(m.n, 0) / 4, 1) AS mc,
        round(least(100.0, 100.0 * coalesce(r.n, 0) / 4), 1) AS sc
      FROM cal LEFT JOIN m USING (site_id, day) LEFT JOIN r USING (site_id, day)
      LEFT JOIN e USING (site_id, day) LEFT JOIN he USING (site_id, day) LEFT JOIN c USING (site_id, day))
SELECT site_id, CAST(day AS VARCHAR) AS day, is_today,
  CASE WHEN mc >= 50 OR (is_today AND coalesce(mn, 0) >= 1) THEN round(mk, 2) END AS meter_kwh,
  CASE WHEN sc >= 50 THEN round(CAST(ek AS DECIMAL(18,4)), 2) END AS sampled_kwh,
  CASE WHEN sc >= 50 THEN round(CAST(coalesce(hk, 0) AS DECIMAL(18,4)), 2) END AS hvac_kwh,
  minutes AS cooling_minutes, round(CAST(round(mx / 6, 4) AS DECIMAL(18,4)), 2) AS peak_kw,
  mc AS meter_coverage_pct, sc AS sample_coverage_pct,
  (mc >= 50 OR (is_today AND coalesce(mn, 0) >= 1)) AS adequate_coverage
FROM k""")
def a13(spark, sf):
    out = energy.daily_trends(
        intervals(spark, sf), samples(spark, sf), zones(spark, sf), now(),
        hvac_channels=HVAC_CHANNELS, interval_minutes=INTERVAL_MINUTES, poll_seconds=6 * HOUR,
        max_gap_seconds=GAP, tail_seconds=TAIL,
        sites=table(spark, sf, "events").select(F.col("user_id").alias("site_id")).distinct())
    return plain(out)


# Looser limits than the defaults: the stand-in samples are hours apart.
_SHARES_SQL = f"""
sd AS (SELECT * FROM s WHERE day BETWEEN DATE '2024-01-15' AND DATE '2024-01-28'
       AND channel IN {HVAC_SQL}),
md AS (SELECT site_id, CAST(start_ts - INTERVAL 6 HOUR AS DATE) AS day, CAST(round(sum(kwh), 4) AS DECIMAL(18,4)) AS meter,
              round(100.0 * count(*) / 4, 1) AS cov FROM i GROUP BY ALL),
sites AS (SELECT DISTINCT site_id FROM (
   SELECT site_id FROM sd UNION ALL
   SELECT site_id FROM md WHERE day BETWEEN DATE '2024-01-15' AND DATE '2024-01-28')),
days AS (SELECT site_id, CAST(g AS DATE) AS day FROM sites,
   (SELECT unnest(generate_series(DATE '2024-01-15', DATE '2024-01-28', INTERVAL 1 DAY)) AS g)),
gaps AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY site_id, day, channel
           ORDER BY ts))) / 1e6 AS gap FROM sd),
q AS (SELECT site_id, day, channel, count(*) AS n, min(ts) AS f, max(ts) AS l, max(gap) AS g
      FROM gaps GROUP BY ALL),
jq AS (SELECT d.site_id, d.day, c.channel, coalesce(n, 0) AS n,
        round(least(100.0, 100.0 * coalesce(n, 0) / 2), 1) AS cov,
        coalesce(n, 0) > 0
         AND round(least(100.0, 100.0 * coalesce(n, 0) / 2), 1) >= 50
         AND (epoch_us(f) - epoch_us(CAST(d.day AS TIMESTAMP) + INTERVAL 6 HOUR)) / 1e6 <= 72000
         AND (epoch_us(CAST(d.day AS TIMESTAMP) + INTERVAL 30 HOUR) - epoch_us(l)) / 1e6 <= 72000
         AND coalesce(g, 0) <= 57600 AS ok
       FROM days d CROSS JOIN (VALUES ('click'), ('view')) c(channel)
       LEFT JOIN q ON q.site_id = d.site_id AND q.day = d.day AND q.channel = c.channel),
dq AS (SELECT site_id, day, min(cov) AS worst, bool_and(ok) AS ok FROM jq GROUP BY ALL),
pt AS (SELECT site_id, channel, ts, any_value(day) AS day, sum(power_w) AS power_w FROM sd GROUP BY ALL),
pn AS (SELECT *, lead(ts) OVER (PARTITION BY site_id, channel, day ORDER BY ts) AS nx FROM pt),
pe AS (SELECT site_id, channel, day, round(CAST(round(sum(
        CASE WHEN nx IS NULL THEN power_w * least(7200.0,
               (epoch_us(CAST(day AS TIMESTAMP) + INTERVAL 30 HOUR) - epoch_us(ts)) / 1e6)
             WHEN epoch_us(nx) - epoch_us(ts) <= 57600000000
               THEN power_w * ((epoch_us(nx) - epoch_us(ts)) / 1e6)
             ELSE 0 END) / 3.6e6, 4) AS DECIMAL(18,4)), 3) AS kwh FROM pn GROUP BY ALL),
mo AS (SELECT site_id, day, round(sum(kwh), 3) AS monitored FROM pe GROUP BY ALL),
jd AS (SELECT d.site_id, d.day, md.meter, coalesce(md.cov, 0.0) AS mcov, dq.worst, mo.monitored,
        coalesce(coalesce(md.cov, 0.0) >= 75 AND dq.ok AND md.meter > 0
         AND coalesce(mo.monitored, 0) <= md.meter * 1.05, FALSE) AS valid
       FROM days d LEFT JOIN md USING (site_id, day) LEFT JOIN dq USING (site_id, day)
       LEFT JOIN mo USING (site_id, day)),
ch AS (SELECT site_id, max(day) AS day, arg_max(meter, day) AS meter, arg_max(monitored, day) AS monitored
       FROM jd WHERE valid GROUP BY site_id)"""
SHARE_OPTIONS = dict(
    channels=HVAC_CHANNELS, interval_minutes=INTERVAL_MINUTES, poll_seconds=12 * HOUR,
    meter_threshold=75.0, channel_threshold=50.0, edge_seconds=20 * HOUR,
    max_gap_seconds=16 * HOUR, tail_seconds=TAIL,
)


@query("a14_day_shares", f"""
WITH {SQL_S}, {SQL_I}, {_SHARES_SQL}
SELECT ch.site_id, CAST(ch.day AS VARCHAR) AS day, c.channel,
   CASE WHEN c.channel = 'unmonitored' THEN round(greatest(meter - coalesce(monitored, 0), 0), 3)
        ELSE coalesce(kwh, 0) END AS kwh,
   round(100.0 * CASE WHEN c.channel = 'unmonitored'
        THEN round(greatest(meter - coalesce(monitored, 0), 0), 3)
        ELSE coalesce(kwh, 0) END / meter, 1) AS pct, round(meter, 2) AS meter_kwh
FROM ch CROSS JOIN (VALUES ('click'), ('view'), ('unmonitored')) c(channel)
LEFT JOIN pe ON pe.site_id = ch.site_id AND pe.day = ch.day AND pe.channel = c.channel""")
def a14(spark, sf):
    slices, _ = energy.valid_day_shares(
        intervals(spark, sf), samples(spark, sf), now(), **SHARE_OPTIONS)
    return plain(slices)


@query("a14_day_diagnostics", f"""
WITH {SQL_S}, {SQL_I}, {_SHARES_SQL}
SELECT site_id, bool_or(valid) AS available,
  CAST(arg_max(day, (mcov, day)) FILTER (WHERE mcov > 0) AS VARCHAR) AS best_meter_day,
  max(mcov) AS best_meter_coverage_pct,
  CAST(arg_max(day, (worst, day)) FILTER (WHERE worst > 0) AS VARCHAR) AS best_channel_day,
  max(worst) AS best_channel_coverage_pct
FROM jd GROUP BY site_id""")
def a14_diagnostics(spark, sf):
    _, diagnostics = energy.valid_day_shares(
        intervals(spark, sf), samples(spark, sf), now(), **SHARE_OPTIONS)
    return plain(diagnostics.drop("latest_failures"))


CYCLES_OF_X = """
cy AS (SELECT site_id, zone, session_start, session_end,
              (epoch_us(session_end) - epoch_us(session_start)) / 6e7 AS minutes FROM x),
cs AS (SELECT site_id, count(*) AS cycle_count, round(sum(minutes), 1) AS total_runtime_minutes,
         round(avg(minutes), 1) AS avg_cycle_minutes, round(max(minutes), 1) AS longest_cycle_minutes,
         count_if(minutes < 10) AS short_cycle_count, count_if(minutes > 90) AS long_cycle_count
       FROM cy GROUP BY site_id)"""


def _cycles(spark, sf):
    sessions = series.cooling_sessions(zones(spark, sf), gap_seconds=12 * HOUR)
    return energy.cycle_stats(
        sessions, samples(spark, sf), compressor="click", cell_seconds=6 * HOUR)


@query("a15_cycle_stats", _SESSIONS_SQL + f""", {CYCLES_OF_X},
pw AS (SELECT cy.site_id, round(avg(e.value * 3.14159) / 1000, 3) AS kw FROM cy JOIN events e
       ON e.user_id = cy.site_id AND e.event_type = 'click' AND e.value > 0
       AND e.ts BETWEEN cy.session_start AND cy.session_end GROUP BY cy.site_id)
SELECT cs.*, pw.kw AS avg_compressor_kw FROM cs LEFT JOIN pw ON pw.site_id = cs.site_id""")
def a15(spark, sf):
    return _cycles(spark, sf)


_TAGGED_SQL = f"""{SQL_Z},
w AS (SELECT * FROM (VALUES
  ('last_24h', {SQL_NOW} - INTERVAL 24 HOUR, {SQL_NOW}),
  ('today', TIMESTAMP '2024-01-29 06:00:00', {SQL_NOW}),
  ('yesterday', TIMESTAMP '2024-01-28 06:00:00', TIMESTAMP '2024-01-29 06:00:00'))
  v("window", ws, we)),
zw AS (SELECT z.*, w."window" FROM z JOIN w ON z.ts >= w.ws AND z.ts < w.we)"""


@query("a16_zone_runtime", f"""
WITH {_TAGGED_SQL}
SELECT site_id, "window", zone, count_if(action = 'COOLING') * 5.0 AS cooling_minutes,
  count_if(action = 'HEATING') * 5.0 AS heating_minutes,
  count_if(action NOT IN ('COOLING', 'HEATING')) * 5.0 AS idle_minutes,
  round(100.0 * count_if(action = 'COOLING') / count(*), 4) AS percent_cooling,
  epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen, count(*) AS sample_count
FROM zw WHERE action IS NOT NULL GROUP BY ALL""")
def a16(spark, sf):
    return plain(energy.zone_runtime(tk.tag_named_windows(zones(spark, sf), "ts", NOW)))


@query("a17_household_runtime", f"""
WITH {_TAGGED_SQL},
t AS (SELECT site_id, "window", ts, bool_or(action = 'COOLING') AS a, bool_and(action = 'COOLING') AS b
      FROM zw WHERE action IS NOT NULL GROUP BY ALL)
SELECT site_id, "window", count_if(a) * 5.0 AS any_cooling_minutes,
  count_if(b) * 5.0 AS all_cooling_minutes,
  round(100.0 * count_if(a) / count(*), 4) AS percent_any_cooling, count(*) AS sample_count
FROM t GROUP BY ALL""")
def a17(spark, sf):
    return energy.household_runtime(tk.tag_named_windows(zones(spark, sf), "ts", NOW))


@query("w08_timeline", f"""
WITH {SQL_S}, {SQL_Z}, {SQL_I},
b AS (SELECT TIMESTAMP '2024-01-08' AS ws, TIMESTAMP '2024-01-15' AS we),
sw AS (SELECT s.* FROM s, b WHERE ts >= ws AND ts <= we),
zw AS (SELECT z.* FROM z, b WHERE ts >= ws AND ts < we),
c AS (SELECT DISTINCT site_id, ts FROM zw WHERE action = 'COOLING'),
f AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY site_id ORDER BY ts))
         <= 43200000000 THEN 0 ELSE 1 END AS fresh FROM c),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY site_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM f)
SELECT site_id, 'interval' AS kind, CAST(NULL AS VARCHAR) AS name, epoch_us(start_ts) AS start_ts,
       epoch_us(end_ts) AS end_ts, round(kwh / 6, 4) AS "value", CAST(NULL AS VARCHAR) AS detail
FROM i, b WHERE start_ts >= ws AND start_ts < we
UNION ALL SELECT site_id, 'channel', channel, epoch_us(ts), NULL, round(power_w / 1000, 4), NULL FROM sw
UNION ALL SELECT site_id, 'monitored_total', NULL, epoch_us(ts), NULL, round(sum(power_w) / 1000, 4), NULL
  FROM sw GROUP BY site_id, ts
UNION ALL SELECT site_id, 'hvac_total', NULL, epoch_us(ts), NULL, round(sum(power_w) / 1000, 4), NULL
  FROM sw WHERE channel IN {HVAC_SQL} GROUP BY site_id, ts
UNION ALL SELECT site_id, 'zone_sample', zone, epoch_us(ts), NULL, NULL, action FROM zw
UNION ALL SELECT site_id, 'cooling_band', NULL, epoch_us(min(ts)), epoch_us(max(ts)), NULL, NULL
  FROM g GROUP BY site_id, sid""")
def w08(spark, sf):
    out = energy.timeline(
        intervals(spark, sf), samples(spark, sf), zones(spark, sf), _fixed_windows(spark, sf),
        hvac_channels=HVAC_CHANNELS, gap_seconds=12 * HOUR, interval_minutes=INTERVAL_MINUTES)
    return plain(out)


@query("w09_window_choice", f"""
WITH {SQL_S}, {SQL_Z}, {SQL_I},
d AS (SELECT site_id, CAST(start_ts - INTERVAL 6 HOUR AS DATE) AS day, count(*) AS n,
        count_if(start_ts >= TIMESTAMP '2024-01-29 06:00:00' AND start_ts < {SQL_NOW}) AS t,
        count_if(start_ts >= {SQL_NOW} - INTERVAL 24 HOUR AND start_ts < {SQL_NOW}) AS h
      FROM i GROUP BY ALL),
m AS (SELECT site_id, sum(t) AS mt, sum(h) AS mh,
        CAST(coalesce(max(day) FILTER (WHERE n >= 3), max(day)) AS TIMESTAMP) AS md FROM d GROUP BY site_id),
u AS (SELECT DISTINCT site_id, ts, 's' AS src FROM s UNION ALL SELECT DISTINCT site_id, ts, 'z' FROM z),
k AS (SELECT u.site_id, src,
        count_if(ts >= TIMESTAMP '2024-01-29 06:00:00' AND ts < {SQL_NOW}) AS t,
        count_if(ts >= {SQL_NOW} - INTERVAL 24 HOUR AND ts < {SQL_NOW}) AS h,
        count_if(ts >= md + INTERVAL 6 HOUR AND ts < md + INTERVAL 30 HOUR) AS d
      FROM u LEFT JOIN m ON m.site_id = u.site_id GROUP BY ALL),
j AS (SELECT x.site_id, coalesce(mt, 0) AS mt, coalesce(mh, 0) AS mh, md,
        coalesce(a.t, 0) >= 2 AS st, coalesce(a.h, 0) >= 2 AS sh, coalesce(a.d, 0) >= 2 AS sd,
        coalesce(b.t, 0) >= 1 AS zt, coalesce(b.h, 0) >= 1 AS zh, coalesce(b.d, 0) >= 1 AS zd
      FROM (SELECT DISTINCT user_id AS site_id FROM events) x LEFT JOIN m USING (site_id)
      LEFT JOIN k a ON a.site_id = x.site_id AND a.src = 's'
      LEFT JOIN k b ON b.site_id = x.site_id AND b.src = 'z'),
f AS (SELECT *, CASE WHEN mt >= 2 AND (st OR zt) THEN 'today' WHEN mh >= 4 AND (sh OR zh) THEN 'latest_24h'
               WHEN md IS NOT NULL THEN 'latest_day' ELSE 'fallback' END AS basis FROM j)
SELECT site_id, basis,
  epoch_us(CASE basis WHEN 'today' THEN TIMESTAMP '2024-01-29 06:00:00'
       WHEN 'latest_day' THEN md + INTERVAL 6 HOUR ELSE {SQL_NOW} - INTERVAL 24 HOUR END) AS window_start,
  epoch_us(CASE basis WHEN 'latest_day' THEN md + INTERVAL 30 HOUR ELSE {SQL_NOW} END) AS window_end,
  basis <> 'fallback' AS has_meter,
  CASE basis WHEN 'today' THEN st WHEN 'latest_24h' THEN sh WHEN 'latest_day' THEN sd ELSE FALSE END AS has_samples,
  CASE basis WHEN 'today' THEN zt WHEN 'latest_24h' THEN zh WHEN 'latest_day' THEN zd ELSE FALSE END AS has_zones
FROM f""")
def w09(spark, sf):
    out = energy.choose_window(
        intervals(spark, sf), samples(spark, sf), zones(spark, sf), now(), min_samples=2,
        min_zone_samples=1, full_day_intervals=3)
    return plain(out)


FINDINGS_OF_BD_PK_CS = """
top AS (SELECT * FROM pk WHERE rank = 1),
o AS (SELECT coalesce(bd.site_id, top.site_id, cs.site_id) AS site_id, top.ts, top.total_kw,
        top.remainder_kw, bd.meter_kwh, bd.monitored_kwh, bd.hvac_kwh,
        cs.cycle_count AS n, cs.total_runtime_minutes AS mins,
        CAST(floor(cs.total_runtime_minutes / 60) AS INTEGER) AS hh,
        CAST(floor(cs.total_runtime_minutes % 60) AS INTEGER) AS mm
      FROM bd FULL JOIN top ON top.site_id = bd.site_id
      FULL JOIN cs ON cs.site_id = coalesce(bd.site_id, top.site_id))
SELECT site_id, concat_ws(' ',
  CASE WHEN total_kw > 0 THEN 'Peak demand was ' || CAST(round(total_kw, 1) AS VARCHAR) || ' kW at '
     || strftime(ts - INTERVAL 6 HOUR, '%-I:%M %p') || '.' END,
  CASE WHEN meter_kwh > 0 AND hvac_kwh > 0 AND monitored_kwh > 0 THEN 'HVAC used approximately '
     || CAST(round(CAST(round(100.0 * hvac_kwh / meter_kwh, 1) AS DECIMAL(18,1)), 0) AS VARCHAR) || '% of total household energy.' END,
  CASE WHEN mins > 0 AND hh > 0 AND mm > 0 THEN 'Cooling ran for ' || hh || ' hr ' || mm
        || ' min across ' || n || ' cycle' || CASE WHEN n = 1 THEN '' ELSE 's' END || '.'
       WHEN mins > 0 AND hh > 0 THEN 'Cooling ran for ' || hh || ' hour'
        || CASE WHEN hh = 1 THEN '' ELSE 's' END || ' (' || n || ' cycle'
        || CASE WHEN n = 1 THEN '' ELSE 's' END || ').'
       WHEN mins > 0 THEN 'Cooling ran for ' || mm || ' minute' || CASE WHEN mm = 1 THEN '' ELSE 's' END || '.' END,
  CASE WHEN remainder_kw > 0.5 THEN 'Estimated unmonitored load at peak: '
     || CAST(round(remainder_kw, 1) AS VARCHAR) || ' kW (SMT whole-home minus measured circuits).' END) AS findings
FROM o"""


@query("r01_findings", _PEAKS_SQL + f""", {_WINDOW_SQL},
{_SESSIONS_SQL.replace('WITH ' + SQL_Z + ',', '').replace('c AS (', 'sc AS (').replace('FROM c WINDOW', 'FROM sc WINDOW').replace('f AS (SELECT *, CASE', 'sf AS (SELECT *, CASE').replace('FROM f)', 'FROM sf)').replace('g AS (SELECT *, sum', 'sg AS (SELECT *, sum').replace('FROM g GROUP', 'FROM sg GROUP')},
{CYCLES_OF_X},
{FINDINGS_OF_BD_PK_CS}""")
def r01(spark, sf):
    out = energy.findings(_peaks(spark, sf), _breakdown(spark, sf), _cycles(spark, sf))
    return out.withColumn("findings", F.array_join("findings", " "))


# ---- ranking and resampling ----------------------------------------------------------

@query("t01_peak", f"""
WITH {SQL_I} SELECT site_id, epoch_us(start_ts) AS start_ts, epoch_us(end_ts) AS end_ts, round(kwh, 4) AS kwh,
  round(kwh / 6, 4) AS peak_kw FROM i
QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY kwh DESC, start_ts) = 1""")
def t01(spark, sf):
    return plain(energy.peak_interval(intervals(spark, sf), interval_minutes=INTERVAL_MINUTES))


@query("t02_topn", f"""
WITH {SQL_I} SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY kwh DESC, start_ts) AS rank,
  epoch_us(start_ts) AS start_ts, epoch_us(end_ts) AS end_ts, round(kwh, 4) AS kwh, round(kwh / 6, 4) AS peak_kw
FROM i QUALIFY rank <= 5""")
def t02(spark, sf):
    return plain(energy.top_intervals(intervals(spark, sf), 5, interval_minutes=INTERVAL_MINUTES))


@query("t03_anomalies", f"""
WITH {SQL_I}, k AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY kwh DESC, start_ts) AS rn FROM i)
SELECT site_id, epoch_us(start_ts) AS start_ts, epoch_us(end_ts) AS end_ts, round(kwh, 4) AS kwh,
  round(kwh / 6, 4) AS peak_kw FROM k WHERE kwh >= 3 OR rn <= 5""")
def t03(spark, sf):
    return plain(energy.anomalies(
        intervals(spark, sf), threshold_kwh=3.0, interval_minutes=INTERVAL_MINUTES))


@query("u02_weekly", f"""
WITH {SQL_I}, d AS (SELECT site_id, CAST(start_ts - INTERVAL 6 HOUR AS DATE) AS day,
  round(sum(kwh), 4) AS kwh FROM i GROUP BY ALL),
n AS (SELECT *, count(*) OVER (PARTITION BY site_id) AS pts FROM d)
SELECT site_id, CAST(CASE WHEN pts > 24 THEN CAST(date_trunc('week', day) AS DATE) ELSE day END AS VARCHAR) AS day,
  round(sum(kwh), 4) AS kwh FROM n GROUP BY ALL""")
def u02(spark, sf):
    return plain(energy.weekly_if_long(energy.daily_totals(intervals(spark, sf)), max_points=24))


@query("f05_has_data", f"""
WITH {SQL_S} SELECT site_id,
  count(DISTINCT ts) FILTER (WHERE ts >= {SQL_NOW} - INTERVAL 72 HOUR AND ts < {SQL_NOW}) >= 5 AS has_data
FROM s GROUP BY site_id""")
def f05(spark, sf):
    start = now() - F.expr("INTERVAL 72 HOURS")
    return series.has_data(samples(spark, sf), start, now(), minimum=5)


@query("f02_retention", f"""
SELECT user_id AS site_id, epoch_us(ts) AS ts FROM events
WHERE ts >= {SQL_NOW} - INTERVAL 336 HOUR""")
def f02(spark, sf):
    from gaugeworks.sinks.tables import within_retention

    kept = within_retention(samples(spark, sf), now(), hours=336)
    return plain(kept.select("site_id", "ts"))
