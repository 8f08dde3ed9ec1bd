"""Queries over hosts, status checks, logs, inventories and keyed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.timekeys import utc_literal
from gaugeworks.operators import health, hosts
from gaugeworks.plans.bindings import (

    SQL_I,
    SQL_NOW,
    SQL_S,
    SQL_Z,
    intervals,
    now,
    samples,
    zones,
)
from gaugeworks.plans.registry import plain, query, table

# ---- host metrics: events as samples of a host per user ------------------------------

_HOST_SQL = """h AS (SELECT user_id AS host, ts, value / 10 AS load_1, value / 5 AS memory_used_percent,
  CAST(value * 1000000 AS BIGINT) AS memory_used_bytes, least(100.0, value / 2) AS cpu_percent,
  CASE WHEN event_type <> 'error' THEN 40 + value / 6 END AS cpu_temp_celsius, CAST(value AS INTEGER) % 8 + 1 AS cpu_threads FROM events)"""


def _host_samples(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("host"), "ts", (v / 10).alias("load_1"), (v / 5).alias("memory_used_percent"),
        (v * 1_000_000).cast("long").alias("memory_used_bytes"), F.least(F.lit(100.0), v / 2).alias("cpu_percent"),
        F.when(F.col("event_type") != "error", 40 + v / 6).alias("cpu_temp_celsius"),
        (v.cast("int") % 8 + 1).alias("cpu_threads"))


def _host_windows(spark, sf):
    # The stand-in "hour" is the whole last hour of a day's samples per host.
    return hosts.metric_windows(_host_samples(spark, sf), utc_literal("2024-01-29 18:00:00"),
                                threshold=20.0)


_WIN_SQL = f"""{_HOST_SQL}, r AS (SELECT *, ts >= {SQL_NOW} - INTERVAL 1 HOUR AS hr, ts >= TIMESTAMP '2024-01-29' AS td FROM h
   WHERE ts >= {SQL_NOW} - INTERVAL 24 HOUR AND ts <= {SQL_NOW}),
w AS (SELECT host, round(max(memory_used_percent) FILTER (WHERE hr), 4) AS memory_percent_1h, round(max(memory_used_percent), 4) AS memory_percent_24h,
  round(max(load_1) FILTER (WHERE hr), 4) AS load_1h, round(max(load_1), 4) AS load_24h, round(max(cpu_percent) FILTER (WHERE hr), 4) AS cpu_1h,
  round(max(cpu_percent), 4) AS cpu_24h, round(max(cpu_temp_celsius) FILTER (WHERE td), 4) AS temp_high_today,
  round(max(cpu_temp_celsius), 4) AS temp_high_24h, round(avg(cpu_temp_celsius) FILTER (WHERE hr), 4) AS temp_avg_1h,
  CASE WHEN count_if(hr) > 0 THEN count_if(hr AND cpu_percent > 20) * 1.0 END AS saturated_minutes_1h,
  count_if(cpu_percent > 20) * 1.0 AS saturated_minutes_24h, round(arg_max(cpu_percent, ts) FILTER (WHERE hr), 4) AS cpu_now,
  arg_max(cpu_temp_celsius, ts) FILTER (WHERE hr) AS temp_now,
  count(*) AS sample_count, count_if(hr) AS sample_count_1h FROM r GROUP BY host)"""


@query("a18_host_windows", f"WITH {_WIN_SQL} SELECT * EXCLUDE (temp_now) FROM w")
def a18(spark, sf):
    out = _host_windows(spark, sf).drop("memory_bytes_1h", "memory_bytes_24h", "temp_now", "cpu_threads")
    doubles = [f.name for f in out.schema.fields if f.dataType.typeName() == "double" and "minutes" not in f.name]
    return out.withColumns({c: F.round(c, 4) for c in doubles})


@query("a19_operating_issues", f"""
WITH {_HOST_SQL}, d AS (SELECT host, max(cpu_temp_celsius) AS t, count_if(cpu_percent > 20) * 1.0 AS m FROM h GROUP BY host)
SELECT host, concat_ws('; ', CASE WHEN t >= 120 THEN 'FAIL heat' WHEN t >= 110 THEN 'WARN heat' END,
  CASE WHEN m >= 35 THEN 'FAIL busy' WHEN m >= 25 THEN 'WARN busy' END) AS issues FROM d""")
def a19(spark, sf):
    # Whole history per host, so that both thresholds are met by some hosts.
    stats = _host_samples(spark, sf).groupBy("host").agg(
        F.max("cpu_temp_celsius").alias("temp_now"),
        (F.count_if(F.col("cpu_percent") > 20) * 1.0).cast("double").alias("saturated_minutes_1h"))
    out = hosts.operating_issues(stats, temp_warn=110, temp_fail=120, minutes_warn=25, minutes_fail=35)
    short = F.transform("issues", lambda i: F.concat(
        i["severity"], F.when(i["message"].contains("temperature"), " heat").otherwise(" busy")))
    return out.select("host", F.array_join(short, "; ").alias("issues"))


_IFACE = """map('interface_name', CASE l_linenumber WHEN 1 THEN 'lo' ELSE 'eth' || CAST(l_linenumber AS STRING) END,
  CASE WHEN l_linenumber % 2 = 0 THEN 'bytes_recv_rate' ELSE 'rx' END, CASE WHEN l_returnflag = 'N' THEN '-1' ELSE CAST(l_quantity AS STRING) END,
  'tx', CASE WHEN l_linenumber > 3 THEN 'n/a' ELSE CAST(l_partkey AS STRING) END)"""


@query("a27_network_sum", """
SELECT l_orderkey, sum(CASE WHEN l_linenumber <> 1 AND l_returnflag <> 'N' THEN l_quantity END) AS rx_bps,
  sum(CASE WHEN l_linenumber <> 1 AND l_linenumber <= 3 THEN CAST(l_partkey AS DOUBLE) END) AS tx_bps FROM lineitem GROUP BY l_orderkey""")
def a27(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.expr(_IFACE).alias("entry"))
    return hosts.network_totals(rows, ["l_orderkey"])


@query("a28_sensors", """
WITH s AS (SELECT l_orderkey, l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS position, l_quantity AS value,
   CASE l_linenumber WHEN 1 THEN 'Package id 0' WHEN 2 THEN 'Core 0' WHEN 3 THEN 'Core 1' ELSE 'disk ' || l_linenumber END AS label FROM lineitem),
p AS (SELECT l_orderkey, arg_min({'l': label, 'v': value}, position) FILTER (WHERE label = 'Package id 0') AS pkg,
   arg_max({'l': label, 'v': value}, (value, -position)) FILTER (WHERE starts_with(label, 'Core')) AS core,
   arg_max({'l': label, 'v': value}, (value, -position)) AS top FROM s GROUP BY l_orderkey),
r AS (SELECT l_orderkey, 1 AS k, 'CPU Package' AS role, coalesce(pkg, top) AS x FROM p UNION ALL SELECT l_orderkey, 2, 'Core Max', core FROM p
   UNION ALL SELECT l_orderkey, 3, 'Highest System Temp', top FROM p)
SELECT l_orderkey, role, x.l AS label, x.v AS value FROM r WHERE x IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY l_orderkey, x.l ORDER BY k) = 1""")
def a28(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", (F.col("l_partkey") * 10000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("position"),
        F.col("l_quantity").alias("value"),
        F.expr("""CASE l_linenumber WHEN 1 THEN 'Package id 0' WHEN 2 THEN 'Core 0' WHEN 3 THEN 'Core 1'
          ELSE 'disk ' || CAST(l_linenumber AS STRING) END""").alias("label"))
    return hosts.sensor_summary(rows, ["l_orderkey"])


@query("t11_top_process", """
WITH p AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS pid, CASE WHEN l_returnflag = 'R' THEN '' ELSE 'proc' || l_linenumber END AS name,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS cpu FROM lineitem)
SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY cpu DESC, pid) AS rank, pid, CASE WHEN name = '' THEN 'root' ELSE name END AS name
FROM p WHERE cpu IS NOT NULL QUALIFY rank <= 5""")
def t11(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pid"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(
            F.concat(F.lit("proc"), F.col("l_linenumber").cast("string"))).alias("name"),
        F.lit("root").alias("username"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice")).alias("cpu_percent"))
    return hosts.top_processes(rows, ["l_suppkey"], 5).select("l_suppkey", "rank", "pid", "name")


# ---- checks: orders as section checks of a customer host -----------------------------

_CHECK_SQL = """c AS (SELECT 'h' || o_custkey AS host, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'storage' WHEN '2-HIGH' THEN 'services'
   WHEN '3-MEDIUM' THEN 'docker' ELSE 'network' END AS section, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'degraded' ELSE 'critical' END AS status,
   CASE WHEN o_orderkey % 2 = 0 THEN 'd' || (o_orderkey % 3) END AS detail FROM orders)"""


def _checks(spark, sf):
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("h"), F.col("o_custkey").cast("string")).alias("host"), "o_orderkey",
        F.expr("""CASE o_orderpriority WHEN '1-URGENT' THEN 'storage' WHEN '2-HIGH' THEN 'services'
          WHEN '3-MEDIUM' THEN 'docker' ELSE 'network' END""").alias("section"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'degraded' ELSE 'critical' END").alias("status"),
        F.when(key % 2 == 0, F.concat(F.lit("d"), (key % 3).cast("string"))).alias("detail"),
        F.when(F.col("o_orderstatus") == "P", F.array(F.struct(
            F.lit("critical").alias("severity"), F.lit("order").alias("category"),
            F.concat(F.lit("C"), (key % 5).cast("string")).alias("code")))).otherwise(
            F.array().cast("array<struct<severity:string,category:string,code:string>>")).alias("alerts"))


@query("a29_worst_status", f"""
WITH {_CHECK_SQL} SELECT host, CASE max(CASE status WHEN 'critical' THEN 2 WHEN 'degraded' THEN 1 ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'ok' END AS overall_status,
  count_if(status = 'critical') AS critical_count, count_if(status = 'degraded') AS warning_count FROM c GROUP BY host""")
def a29(spark, sf):
    return health.worst_status(_checks(spark, sf))


@query("a29_host_rollup", f"""
WITH {_CHECK_SQL}, k AS (SELECT *, CASE status WHEN 'critical' THEN 2 WHEN 'degraded' THEN 1 ELSE 0 END AS r, section || ': ' || coalesce(detail, status) AS line FROM c),
w AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY host, section ORDER BY r DESC, line DESC) = 1)
SELECT host, CASE max(r) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'ok' END AS overall_status,
  coalesce(string_agg(line, ', ' ORDER BY line) FILTER (WHERE r = 2), '') AS critical,
  coalesce(string_agg(line, ', ' ORDER BY line) FILTER (WHERE r = 1), '') AS warnings FROM w GROUP BY host""")
def a29_rollup(spark, sf):
    out = health.host_rollup(_checks(spark, sf))
    return out.withColumns({c: F.array_join(c, ", ") for c in ("critical", "warnings")})


@query("a29_host_alerts", f"""
WITH {_CHECK_SQL} SELECT host, section, 'critical' AS severity, 'order' AS category, 'C' || (o_orderkey % 5) AS code FROM c
WHERE status = 'critical' AND section <> 'network'""")
def a29_alerts(spark, sf):
    return health.host_alerts(_checks(spark, sf))


_VOL_SQL = """v AS (SELECT p_partkey, p_brand AS host, p_name AS label, '/mnt/' || p_size AS mount_path,
  CASE WHEN p_size <= 35 THEN 'OK' WHEN p_size <= 38 THEN 'MISSING_DEVICE' WHEN p_size <= 41 THEN 'NOT_MOUNTED' WHEN p_size <= 44 THEN 'AUTOMOUNT_INACTIVE'
    WHEN p_size <= 46 THEN 'STALE_MOUNT' WHEN p_size <= 48 THEN 'DF_TIMEOUT' ELSE 'ODD' END AS status,
  CASE WHEN p_size % 5 > 0 THEN 60 + p_size END AS pct FROM part)"""


def _volumes(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey", F.col("p_brand").alias("host"), F.col("p_name").alias("label"),
        F.concat(F.lit("/mnt/"), size.cast("string")).alias("mount_path"),
        F.expr("""CASE WHEN p_size <= 35 THEN 'OK' WHEN p_size <= 38 THEN 'MISSING_DEVICE' WHEN p_size <= 41 THEN 'NOT_MOUNTED'
          WHEN p_size <= 44 THEN 'AUTOMOUNT_INACTIVE' WHEN p_size <= 46 THEN 'STALE_MOUNT' WHEN p_size <= 48 THEN 'DF_TIMEOUT'
          ELSE 'ODD' END""").alias("status"),
        F.when(size % 5 > 0, size + 60).alias("use_percent"), F.lit(None).cast("string").alias("uuid"),
        F.lit(None).cast("string").alias("detail"), F.lit(True).alias("required"))


@query("a30_storage_alerts", f"""
WITH {_VOL_SQL} SELECT host, CASE WHEN status IN ('STALE_MOUNT', 'DF_TIMEOUT', 'ERROR') OR pct >= 90 THEN 'critical' ELSE 'warning' END AS severity,
  'storage' AS category, CASE WHEN status <> 'OK' THEN status WHEN pct >= 90 THEN 'CRITICAL' ELSE 'WARNING' END AS code, label AS volume, mount_path,
  CASE status WHEN 'OK' THEN label || ' (' || mount_path || '): ' || pct || '% used' WHEN 'MISSING_DEVICE' THEN label || ': device UUID unknown not detected'
    WHEN 'NOT_MOUNTED' THEN label || ' (' || mount_path || '): present but not mounted' WHEN 'AUTOMOUNT_INACTIVE' THEN label || ' (' || mount_path || '): automount inactive'
    WHEN 'STALE_MOUNT' THEN label || ' (' || mount_path || '): stale or unreachable mount' WHEN 'DF_TIMEOUT' THEN label || ' (' || mount_path || '): df timed out'
    ELSE label || ' (' || mount_path || '): ODD' END AS message
FROM v WHERE NOT (status = 'OK' AND coalesce(pct, 0) < 80)""")
def a30(spark, sf):
    return health.storage_alerts(_volumes(spark, sf))


@query("a30_storage_overview", f"""
WITH {_VOL_SQL} SELECT host, CASE max(greatest(CASE WHEN status = 'OK' THEN 0 WHEN status IN ('STALE_MOUNT', 'DF_TIMEOUT', 'ERROR') THEN 2 ELSE 1 END,
   CASE WHEN pct >= 90 THEN 2 WHEN pct >= 80 THEN 1 ELSE 0 END)) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'ok' END AS status FROM v GROUP BY host""")
def a30_overview(spark, sf):
    return health.storage_overview(_volumes(spark, sf))


# ---- logs: orders as lines of a clerk's log ------------------------------------------

_LOG = """'1998-01-02T03:04:05 ' || CASE o_orderpriority WHEN '1-URGENT' THEN '[ERROR] token=abc failed #' WHEN '2-HIGH' THEN '[warn] slow #'
  WHEN '3-MEDIUM' THEN 'Starting hunt cycle #' WHEN '5-LOW' THEN 'Hunt cycle completed #' ELSE '[INFO] order #' END"""
_LOG_SQL = f"""g AS (SELECT o_custkey % 200 AS source, o_orderkey AS line_no, o_orderdate AS ts, {_LOG} || o_orderkey AS line, o_orderpriority AS p FROM orders)"""


def _log_lines(spark, sf):
    return table(spark, sf, "orders").select(
        (F.col("o_custkey") % 200).alias("source"), F.col("o_orderkey").alias("line_no"),
        F.col("o_orderdate").alias("ts"), F.concat(F.expr(_LOG), F.col("o_orderkey").cast("string")).alias("line"))


@query("a31_log_summary", f"""
WITH {_LOG_SQL}, c AS (SELECT source, count_if(p = '2-HIGH') AS warning_count, count_if(p = '1-URGENT') AS error_count,
   arg_max(line, (CASE p WHEN '5-LOW' THEN 2 ELSE 1 END, line_no)) FILTER (WHERE p IN ('5-LOW', '3-MEDIUM')) AS last_match FROM g GROUP BY source),
i AS (SELECT source, line_no, regexp_replace(line, 'token=\\S+', 'token=[REDACTED]') AS line FROM g WHERE p IN ('1-URGENT', '2-HIGH')
   QUALIFY row_number() OVER (PARTITION BY source ORDER BY line_no DESC) <= 5),
s AS (SELECT source, string_agg(line, '|' ORDER BY line_no) AS recent_issues FROM i GROUP BY source)
SELECT c.source, warning_count, error_count, coalesce(recent_issues, '') AS recent_issues, last_match,
  CASE WHEN error_count > 0 THEN 'fail' WHEN warning_count > 0 THEN 'warn' ELSE 'ok' END AS overall FROM c LEFT JOIN s ON s.source = c.source""")
def a31(spark, sf):
    out = health.log_summary(_log_lines(spark, sf))
    return out.withColumn("recent_issues", F.array_join("recent_issues", "|"))


@query("a32_log_freshness", f"""
WITH {_LOG_SQL}, l AS (SELECT source, arg_max(ts, line_no) AS t FROM g WHERE p IN ('3-MEDIUM', '5-LOW') GROUP BY source)
SELECT source, epoch_us(t) AS last_activity, (epoch_us(TIMESTAMP '2000-01-01') - epoch_us(t)) // 60000000 AS age_minutes,
  CASE WHEN epoch_us(TIMESTAMP '2000-01-01') - epoch_us(t) <= 1500000.0 * 60000000 THEN 'fresh' ELSE 'stale' END AS status FROM l""")
def a32(spark, sf):
    out = health.log_freshness(_log_lines(spark, sf), utc_literal("2000-01-01 00:00:00"), fresh_minutes=1_500_000)
    return plain(out)


@query("s20_log_scan", f"""
WITH {_LOG_SQL} SELECT source, line_no, epoch_us(TIMESTAMP '1998-01-02 03:04:05') AS ts, p IN ('1-URGENT', '2-HIGH') AS is_error
FROM g QUALIFY row_number() OVER (PARTITION BY source ORDER BY line_no DESC) <= 10""")
def s20(spark, sf):
    from gaugeworks.sources import logs

    parsed = logs.parse_lines(_log_lines(spark, sf).drop("ts"))
    tail = health.last_lines(parsed, ["source"], 10)
    return plain(tail.select("source", "line_no", "ts", "is_error"))


# ---- freshness and inventories -------------------------------------------------------

@query("a33_collection_health", f"""
WITH s AS (SELECT user_id AS site_id, max(CASE WHEN ts <= {SQL_NOW} THEN ts END) AS l, count(DISTINCT CASE WHEN ts >= {SQL_NOW} - INTERVAL 1440 MINUTE AND ts <= {SQL_NOW} THEN ts END) AS n
  FROM events GROUP BY user_id),
a AS (SELECT *, (epoch_us({SQL_NOW}) - epoch_us(l)) // 60000000 AS age FROM s)
SELECT site_id, epoch_us(l) AS latest_sample, n AS recent_samples, age AS age_minutes,
  CASE WHEN l IS NULL THEN 'missing' WHEN age > 900 THEN 'stale' WHEN age <= 400 AND n >= 3 THEN 'ok' ELSE 'limited' END AS status FROM a""")
def a33(spark, sf):
    return plain(health.collection_health(
        samples(spark, sf), now(), window_minutes=1440, ok_age=400, stale_age=900))


@query("a33_data_quality", f"""
WITH {SQL_S}, {SQL_Z}, {SQL_I}, w AS (SELECT DISTINCT site_id, TIMESTAMP '2024-01-08' AS a, TIMESTAMP '2024-01-15' AS b FROM i),
m AS (SELECT site_id, count_if(start_ts >= TIMESTAMP '2024-01-08' AND start_ts < TIMESTAMP '2024-01-15') AS n, max(end_ts) AS l FROM i GROUP BY site_id),
d AS (SELECT DISTINCT site_id, ts FROM s), t AS (SELECT site_id, count_if(ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15') AS n, max(ts) AS l FROM d GROUP BY site_id)
SELECT w.site_id, m.n AS meter_rows, greatest(0, (epoch_us({SQL_NOW}) - epoch_us(m.l)) // 60000000) AS meter_age_minutes,
  greatest(0, (epoch_us({SQL_NOW}) - epoch_us(m.l)) // 60000000) < 1440 AS meter_fresh, t.n AS sample_rows,
  greatest(0, (epoch_us({SQL_NOW}) - epoch_us(t.l)) // 60000000) AS sample_age_minutes, greatest(0, (epoch_us({SQL_NOW}) - epoch_us(t.l)) // 60000000) < 5 AS sample_fresh,
  t.n AS zone_rows, greatest(0, (epoch_us({SQL_NOW}) - epoch_us(t.l)) // 60000000) AS zone_age_minutes,
  greatest(0, (epoch_us({SQL_NOW}) - epoch_us(t.l)) // 60000000) < 15 AS zone_fresh
FROM w JOIN m ON m.site_id = w.site_id JOIN t ON t.site_id = w.site_id""")
def a33_quality(spark, sf):
    windows = intervals(spark, sf).select("site_id").distinct().select(
        "site_id", utc_literal("2024-01-08 00:00:00").alias("window_start"),
        utc_literal("2024-01-15 00:00:00").alias("window_end"))
    return health.data_quality(intervals(spark, sf), samples(spark, sf), zones(spark, sf), now(), windows)


@query("a34_archive_status", """
SELECT o_custkey AS source, count(*) AS record_count, epoch_us(min(CASE WHEN o_orderstatus <> 'P' THEN date_trunc('second', o_orderdate) END)) AS oldest
FROM orders GROUP BY o_custkey""")
def a34(spark, sf):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("source"),
        F.when(F.col("o_orderstatus") != "P", stamp).otherwise("not a time").alias("timestamp"))
    return plain(health.archive_status(rows))


_FILE_SQL = """f AS (SELECT o_custkey % 300 AS target, o_orderkey, strftime(o_orderdate, '%Y%m%dT000000Z') || '-' || lpad(o_orderkey::VARCHAR, 9, '0') AS tail,
   o_orderdate AS d, CASE WHEN o_orderstatus = 'P' THEN 'notes-' || o_orderkey || '.txt' ELSE 'bundle-' || strftime(o_orderdate, '%Y%m%dT000000Z') || '-' || lpad(o_orderkey::VARCHAR, 9, '0') || '.tar' END AS name,
   o_orderpriority AS p FROM orders)"""


def _files(spark, sf):
    stamp = F.date_format("o_orderdate", "yyyyMMdd'T000000Z'")
    key = F.lpad(F.col("o_orderkey").cast("string"), 9, "0")
    name = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("notes-"), F.col("o_orderkey").cast("string"), F.lit(".txt"))
                  ).otherwise(F.concat(F.lit("bundle-"), stamp, F.lit("-"), key, F.lit(".tar")))
    digest = F.sha2(F.col("o_orderkey").cast("string"), 256)
    return table(spark, sf, "orders").select(
        (F.col("o_custkey") % 300).alias("target"), name.alias("name"), F.col("o_orderdate").alias("mtime"),
        digest.alias("sha256"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None).cast("string"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("broken"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.sha2(F.lit("other"), 256))
        .otherwise(F.concat(F.upper(digest), F.lit("  file.tar"))).alias("sidecar"))


# The stamp and the order key together name a file, so no two files of a target tie.
_NAME = r"^bundle-(\d{8}T\d{6}Z-\d{9})\.tar$"
_STAMP_ONLY = r"^bundle-(\d{8}T\d{6}Z)-\d{9}\.tar$"


@query("a35_backup_health", f"""
WITH {_FILE_SQL}, l AS (SELECT target, arg_max({{'n': name, 'd': date_trunc('day', d), 'p': p}}, (date_trunc('day', d), name)) FILTER (WHERE starts_with(name, 'bundle')) AS x FROM
   f GROUP BY target),
k AS (SELECT target, x.n AS latest_name, (epoch_us(TIMESTAMP '2001-12-01') - epoch_us(x.d)) / 3.6e9 AS age,
   CASE WHEN x IS NULL THEN 'not_checked' WHEN x.p = '1-URGENT' THEN 'missing' WHEN x.p IN ('2-HIGH', '3-MEDIUM') THEN 'invalid' ELSE 'ok' END AS checksum_status FROM l)
SELECT target, latest_name, round(age, 2) AS age_hours, checksum_status,
  CASE WHEN checksum_status <> 'ok' OR age >= 4000 THEN 'critical' WHEN age >= 3000 THEN 'warning' ELSE 'ok' END AS status,
  concat_ws(',', CASE checksum_status WHEN 'not_checked' THEN 'NO_COMPLETED_ARCHIVE' WHEN 'missing' THEN 'CHECKSUM_MISSING' WHEN 'invalid' THEN 'CHECKSUM_INVALID' END,
    CASE WHEN age >= 4000 THEN 'BACKUP_STALE' WHEN age >= 3000 THEN 'BACKUP_APPROACHING_STALE' END) AS issue_codes FROM k""")
def a35(spark, sf):
    out = health.backup_health(_files(spark, sf), utc_literal("2001-12-01 00:00:00"), name_pattern=_STAMP_ONLY,
                               warn_hours=3000, stale_hours=4000)
    return out.drop("reason").withColumn("issue_codes", F.array_join("issue_codes", ","))


@query("a37_verify_copy", """
WITH a AS (SELECT o_custkey AS name, sum(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(o_totalprice AS BIGINT) END) AS s FROM orders GROUP BY o_custkey),
b AS (SELECT c_custkey AS name, CASE WHEN c_acctbal > 3000 THEN CAST(c_acctbal AS BIGINT) ELSE 0 END AS s FROM customer)
SELECT coalesce(a.name, b.name) AS name, NOT (coalesce(a.s, 0) > 0 AND coalesce(b.s, 0) <= 0) AS ok FROM a FULL JOIN b ON a.name = b.name""")
def a37(spark, sf):
    source = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("name"),
        F.when(F.col("o_orderstatus") == "P", 0).otherwise(F.round("o_totalprice").cast("long")).alias("size"))
    copy = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("name"),
        F.when(F.col("c_acctbal") > 3000, F.round("c_acctbal").cast("long")).otherwise(0).alias("size"))
    return health.verify_copy(source, copy).select("name", "ok")


@query("a38_day_report", """
SELECT o_custkey AS site_id, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'lagging' ELSE 'failed' END AS status, count(*) AS day_count,
  CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_day
FROM orders GROUP BY ALL""")
def a38(spark, sf):
    days = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("site_id"), F.to_date("o_orderdate").alias("day"),
        F.expr("""CASE o_orderstatus WHEN 'O' THEN 'No energy data received from the respective TDSP'
          WHEN 'P' THEN 'server said token=1' END""").alias("error"))
    return plain(health.day_report_counts(days))


@query("t08_retention_plan", f"""
WITH {_FILE_SQL}, r AS (SELECT target, name, row_number() OVER (PARTITION BY target ORDER BY name DESC) AS rn FROM f WHERE starts_with(name, 'bundle'))
SELECT target, name, CASE WHEN rn <= 3 THEN 'keep' ELSE 'delete' END AS action FROM r""")
def t08(spark, sf):
    return health.keep_last(_files(spark, sf), 3, name_pattern=_NAME)


@query("t08_age_plan", f"""
WITH {_FILE_SQL} SELECT target, name, CASE WHEN date_trunc('day', d) >= TIMESTAMP '2000-01-01' - INTERVAL 365 DAY THEN 'keep' ELSE 'delete' END AS action
FROM f WHERE starts_with(name, 'bundle')""")
def t08_age(spark, sf):
    return health.keep_days(_files(spark, sf), 365, utc_literal("2000-01-01 00:00:00"), name_pattern=_STAMP_ONLY)


