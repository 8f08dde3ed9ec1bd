"""Queries over keyed state, in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.text import name_key
from gaugeworks.functions.timekeys import utc_literal
from gaugeworks.operators import state
from gaugeworks.plans.bindings import HOUR, samples
from gaugeworks.plans.registry import plain, query, table


@query("x01_throttle", """
WITH RECURSIVE d AS (SELECT DISTINCT user_id AS site_id, epoch_us(ts) AS ts FROM events),
o AS (SELECT site_id, ts, row_number() OVER (PARTITION BY site_id ORDER BY ts) AS i FROM d),
a AS (SELECT site_id, min(ts) AS ts FROM d GROUP BY site_id
  UNION ALL SELECT a.site_id, (SELECT min(d.ts) FROM d WHERE d.site_id = a.site_id AND d.ts >= a.ts + 43200000000) FROM a WHERE a.ts IS NOT NULL)
SELECT site_id, ts FROM a WHERE ts IS NOT NULL""")
def x01(spark, sf):
    return plain(state.throttle(samples(spark, sf), ["site_id"], 12 * HOUR))


_RESULTS_SQL = """r AS (SELECT user_id AS backup_id, ts, CASE event_type WHEN 'view' THEN 'healthy' WHEN 'click' THEN 'warning' WHEN 'signup' THEN 'healthy'
   WHEN 'purchase' THEN 'skipped' ELSE 'critical' END AS severity, CASE event_type WHEN 'click' THEN 'SLOW' WHEN 'error' THEN CASE WHEN value > 100 THEN 'LOST|SLOW' ELSE 'LOST' END ELSE 'healthy' END AS fp,
   value > 5 AS sent FROM events)"""


@query("x05_alerts", f"""
WITH {_RESULTS_SQL},
p AS (SELECT *, coalesce(lag(severity) OVER w IN ('warning', 'critical'), FALSE) AS bad FROM r WINDOW w AS (PARTITION BY backup_id ORDER BY ts)),
o AS (SELECT *, coalesce(bool_or(sent AND (severity <> 'healthy' OR bad)) OVER (PARTITION BY backup_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS opened FROM p),
m AS (SELECT *, CASE WHEN sent AND severity <> 'healthy' THEN fp WHEN sent AND (bad OR opened) THEN 'healthy' END AS mark FROM o),
l AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY backup_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM m)
SELECT backup_id, epoch_us(ts) AS ts, severity, CASE WHEN severity <> 'healthy' THEN CASE WHEN last = fp THEN 'none' ELSE 'alert' END
  WHEN last = 'healthy' THEN 'none' WHEN bad OR last IS NOT NULL THEN 'recovery' ELSE 'none' END AS decision FROM l""")
def x05(spark, sf):
    kind = F.col("event_type")
    none = F.array().cast("array<string>")
    lost = F.when(F.col("value") > 100, F.array(F.lit("LOST"), F.lit("SLOW"))).otherwise(F.array(F.lit("LOST")))
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("backup_id"), "ts",
        F.expr("""CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'warning' WHEN 'signup' THEN 'ok'
          WHEN 'purchase' THEN 'skipped' ELSE 'error' END""").alias("status"),
        F.when(kind == "click", F.array(F.lit("SLOW"))).when(kind == "error", lost).otherwise(none).alias("issue_codes"),
        (F.col("value") > 5).alias("delivered"))
    out = state.alert_decisions(rows)
    return plain(out.select("backup_id", "ts", "severity", "decision"))


@query("x06_ttl", """
WITH l AS (SELECT user_id AS chat_key, arg_max(event_type, ts) AS t, max(ts) AS s FROM events GROUP BY user_id)
SELECT chat_key, epoch_us(s + INTERVAL 1440 MINUTE) AS expires_at, CASE WHEN t = 'view' THEN 'egg' ELSE t || ',egg' END AS items FROM l
WHERE s + INTERVAL 1440 MINUTE > TIMESTAMP '2024-01-31 20:00:00'""")
def x06(spark, sf):
    item = lambda c: F.struct(c.alias("normalized_key"))
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("chat_key"), F.col("ts").alias("saved_at"),
        F.array(item(F.lit("milk")), item(F.col("event_type")), item(F.lit("egg"))).alias("items"))
    live = state.pending_batches(rows, utc_literal("2024-01-31 20:00:00"), ttl_minutes=1440)
    out = state.remove_items(live.withColumn("t", F.lit("1, Views")), "t", name_key)
    text = F.array_join(F.transform("items", lambda x: x["normalized_key"]), ",")
    return plain(out.select("chat_key", "expires_at", text.alias("items")))


@query("x08_lifecycle", """
WITH c AS (SELECT user_id AS search_id, ts, CASE WHEN event_type = 'signup' AND value > 150 THEN 'ended' WHEN event_type = 'click' THEN 'paused'
   WHEN event_type = 'view' THEN 'active' ELSE 'bogus' END AS target FROM events),
b AS (SELECT *, coalesce(bool_or(target = 'ended') OVER w, FALSE) AS over, last_value(CASE WHEN target <> 'bogus' THEN target END IGNORE NULLS) OVER w AS last
   FROM c WINDOW w AS (PARTITION BY search_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, CASE WHEN over THEN 'ended' ELSE coalesce(last, 'active') END AS state_before FROM b)
SELECT search_id, epoch_us(ts) AS ts, target, state_before, state_before <> 'ended' AND target <> 'bogus' AND target <> state_before AS accepted FROM m""")
def x08(spark, sf):
    target = F.expr("""CASE WHEN event_type = 'signup' AND value > 150 THEN 'ended' WHEN event_type = 'click' THEN 'paused'
      WHEN event_type = 'view' THEN 'active' ELSE 'bogus' END""")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("search_id"), "ts", target.alias("target"))
    return plain(state.lifecycle(rows).drop("state_after"))
