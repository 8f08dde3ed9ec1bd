"""Status rollups, storage levels, log summaries, freshness, inventories, retention plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import labels
from gaugeworks.functions.redaction import redact_log, redact_payload
from gaugeworks.functions.text import any_of
from gaugeworks.operators.ordered import top_n

# Words of each status class, and disk levels in percent used.
CRITICAL_WORDS = ("critical", "fail", "error")
WARNING_WORDS = ("warning", "warn", "degraded", "stale_mount", "df_timeout")
DISK_WARNING, DISK_CRITICAL = 80, 90


def status_rank(status: Column) -> Column:
    s = F.lower(status)
    return F.when(s.isin(*CRITICAL_WORDS), 2).when(s.isin(*WARNING_WORDS), 1).otherwise(0)


def rank_label(rank: Column) -> Column:
    return F.when(rank >= 2, "critical").when(rank == 1, "warning").otherwise("ok")


def worst_status(checks: DataFrame, keys: Sequence[str] = ("host",)) -> DataFrame:
    """Worst status over the sections of each key: a maximum of ranks."""
    return checks.groupBy(*keys).agg(
        rank_label(F.max(status_rank(F.col("status")))).alias("overall_status"),
        F.count_if(status_rank(F.col("status")) == 2).alias("critical_count"),
        F.count_if(status_rank(F.col("status")) == 1).alias("warning_count"))


ALERT_SECTIONS = ("storage", "services", "docker", "systemd_failed")


def host_rollup(checks: DataFrame) -> DataFrame:
    """Per host: overall status with its critical and warning section lines.

    Input has the CHECK schema. A host is first reduced to one line per section, its worst,
    and sections are a fixed set of check names, so the lists stay short however many checks
    a host reports. Alerts stay rows, see :func:`host_alerts`.
    """
    rank = status_rank(F.col("status"))
    line = F.concat(F.col("section"), F.lit(": "), F.coalesce("detail", "status"))
    worst = checks.groupBy("host", "section").agg(
        F.max(rank).alias("_rank"),
        F.max_by(F.struct("status", line.alias("line")), F.struct(rank.alias("r"), line.alias("l"))).alias("_w"))
    critical = F.col("_w.status") == "critical"
    warning = F.col("_w.status").isin("warning", "not_configured", "degraded")

    def gather(condition: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(condition, F.col("_w.line"))))

    return worst.groupBy("host").agg(
        rank_label(F.max("_rank")).alias("overall_status"),
        gather(critical).alias("critical"), gather(warning).alias("warnings"))


def host_alerts(checks: DataFrame, alert_sections: Sequence[str] = ALERT_SECTIONS) -> DataFrame:
    """One row per alert of the sections that raise alerts."""
    return checks.filter(F.col("section").isin(*alert_sections)).select(
        "host", "section", F.explode("alerts").alias("a")).select("host", "section", "a.*")


# ---- storage -------------------------------------------------------------------------

def use_level(percent: Column) -> Column:
    return F.when(percent >= DISK_CRITICAL, "critical").when(percent >= DISK_WARNING, "warning")


def volume_status(status: Column, required: Column) -> Column:
    return F.when(status == "OK", "ok").when(
        status.isin("STALE_MOUNT", "DF_TIMEOUT", "ERROR"), "critical").otherwise("warning")


def storage_alerts(volumes: DataFrame) -> DataFrame:
    """Alert rows of volumes. Input: host, label, mount_path, status, use_percent, uuid,
    detail, required."""
    level = use_level(F.col("use_percent"))
    status = F.coalesce("status", F.lit("ERROR"))
    place = F.concat(F.col("label"), F.lit(" ("), F.col("mount_path"), F.lit(")"))
    message = (
        F.when((status == "OK") & F.col("use_percent").isNotNull(),
               F.concat(place, F.lit(": "), F.format_string("%.0f", F.col("use_percent").cast("double")),
                        F.lit("% used")))
        .when(status == "MISSING_DEVICE",
              F.concat(F.col("label"), F.lit(": device UUID "),
                       F.coalesce("uuid", F.lit("unknown")), F.lit(" not detected")))
        .when(status == "NOT_MOUNTED", F.concat(place, F.lit(": present but not mounted")))
        .when(status == "AUTOMOUNT_INACTIVE", F.concat(place, F.lit(": automount inactive")))
        .when(status == "STALE_MOUNT", F.concat(place, F.lit(": stale or unreachable mount")))
        .when(status == "DF_TIMEOUT", F.concat(place, F.lit(": df timed out")))
        .otherwise(F.concat(place, F.lit(": "), F.coalesce("detail", status)))
    )
    severe = status.isin("STALE_MOUNT", "DF_TIMEOUT", "ERROR") | F.coalesce(level == "critical", F.lit(False))
    return volumes.filter(~((status == "OK") & level.isNull())).select(
        "host", F.when(severe, "critical").otherwise("warning").alias("severity"),
        F.lit("storage").alias("category"),
        F.when(status != "OK", status).otherwise(F.upper(level)).alias("code"),
        F.col("label").alias("volume"), "mount_path", message.alias("message"))


def storage_overview(volumes: DataFrame) -> DataFrame:
    """Worst level per host over volume status and use."""
    level = F.coalesce(use_level(F.col("use_percent")), F.lit("ok"))
    rank = F.greatest(status_rank(volume_status(F.col("status"), F.col("required"))), status_rank(level))
    return volumes.groupBy("host").agg(rank_label(F.max(rank)).alias("status"))


# ---- logs ----------------------------------------------------------------------------

def log_summary(
    lines: DataFrame,
    keys: Sequence[str] = ("source",),
    *,
    patterns: Sequence[str] = ("hunt cycle completed", "hunt cycle"),
    issues: int = 5,
) -> DataFrame:
    """Warning and error counts, last issue lines, last pattern line and overall level.

    Input: keys, line_no (order), line. The pattern line follows pattern priority before
    recency. The issue list is a group-limited top-n, so no log is gathered whole.
    """
    tagged = lines.withColumn("_level", labels.log_level("line"))
    lower = F.lower("line")
    hit = F.coalesce(*[F.when(lower.contains(p), len(patterns) - i) for i, p in enumerate(patterns)])
    rank = F.when(hit.isNotNull(), F.struct(hit.alias("p"), F.col("line_no").alias("n")))
    counts = tagged.groupBy(*keys).agg(
        F.count_if(F.col("_level") == "WARNING").alias("warning_count"),
        F.count_if(F.col("_level").isin("ERROR", "CRITICAL")).alias("error_count"),
        F.max_by("line", rank).alias("_last"))
    last = top_n(tagged.filter(F.col("_level").isNotNull()), keys, [F.col("line_no").desc()], issues)
    recent = last.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))),
                    lambda x: redact_log(x["line"])).alias("recent_issues"))
    overall = F.when(F.col("error_count") > 0, "fail").when(F.col("warning_count") > 0, "warn").otherwise("ok")
    return counts.join(recent, list(keys), "left").select(
        *keys, "warning_count", "error_count",
        F.coalesce("recent_issues", F.array().cast("array<string>")).alias("recent_issues"),
        redact_log("_last").alias("last_match"), overall.alias("overall"))


# Words of scheduler activity and of a finished run.
SUCCESS_WORDS = ("hunt cycle completed", "done hunt")
ACTIVITY_WORDS = ("starting hunt", "done hunt", "hunt cycle", "scheduler")


def log_freshness(
    lines: DataFrame, now: Column, keys: Sequence[str] = ("source",), *,
    words: Sequence[str] = ACTIVITY_WORDS, fresh_minutes: float = 30,
) -> DataFrame:
    """Age of the last line with one of the words and a timestamp; fresh or stale.

    Input: keys, line_no, ts, line (see ``sources.logs``).
    """
    hit = F.col("ts").isNotNull() & F.lower("line").rlike(any_of(words))
    last = lines.filter(hit).groupBy(*keys).agg(F.max_by("ts", "line_no").alias("last_activity"))
    age = (F.unix_micros(now) - F.unix_micros("last_activity")) / 60_000_000
    return last.withColumn("age_minutes", F.floor(age).cast("long")).withColumn(
        "status", F.when(age <= fresh_minutes, "fresh").otherwise("stale"))


# ---- collection health ---------------------------------------------------------------

def age_minutes(now: Column, ts: Column) -> Column:
    """Whole minutes since ``ts``, never negative."""
    return F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 60_000_000)).cast("long")


def collection_health(
    samples: DataFrame, now: Column, keys: Sequence[str] = ("site_id",), *,
    sites: DataFrame | None = None, window_minutes: float = 30, ok_age: float = 10,
    ok_samples: int = 3, stale_age: float = 15,
) -> DataFrame:
    """ok, limited, stale or missing per key from the latest sample and the recent count.

    Several channels of one instant are one record: the distinct instants are counted. Records
    after ``now`` do not count; a key that has no other is missing.
    """
    since = F.timestamp_micros(F.unix_micros(now) - int(window_minutes * 60_000_000))
    recent = (F.col("ts") >= since) & (F.col("ts") <= now)
    stats = samples.select(*keys, "ts").distinct().groupBy(*keys).agg(
        F.max(F.when(F.col("ts") <= now, F.col("ts"))).alias("latest_sample"),
        F.count_if(recent).alias("recent_samples"))
    if sites is not None:
        stats = sites.select(*keys).join(stats, list(keys), "left")
    age = age_minutes(now, F.col("latest_sample"))
    n = F.coalesce("recent_samples", F.lit(0).cast("long"))
    status = (
        F.when(F.col("latest_sample").isNull(), "missing").when(age > stale_age, "stale")
        .when((age <= ok_age) & (n >= ok_samples), "ok").otherwise("limited"))
    return stats.select(*keys, "latest_sample", n.alias("recent_samples"),
                        F.when(F.col("latest_sample").isNotNull(), age).alias("age_minutes"),
                        status.alias("status"))


def section_state(age_seconds: Column, has_rows: Column, stale: Column, limited: Column,
                  stale_after: float = 120) -> Column:
    """State of a snapshot section: no_data, error, stale, limited or online."""
    return (
        F.when(age_seconds.isNull(), "no_data").when(~has_rows, "error")
        .when(F.coalesce(stale, F.lit(False)) | (age_seconds > stale_after), "stale")
        .when(limited, "limited").otherwise("online"))


def data_quality(
    intervals: DataFrame, samples: DataFrame, zones: DataFrame, now: Column,
    windows: DataFrame, keys: Sequence[str] = ("site_id",), latest_of: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Rows in the window and freshness of each source per site.

    Sources may be late by a day (meter), 5 minutes (samples) and 15 minutes (zones). Where the frames
    hold recent rows alone, ``latest_of`` brings each source's ``latest`` instant per site.
    """
    keys = list(keys)
    out = windows.select(*keys, "window_start", "window_end")
    limits = (("meter", intervals, "start_ts", "end_ts", 1440), ("sample", samples, "ts", "ts", 5),
              ("zone", zones, "ts", "ts", 15))
    for name, df, ts, latest, limit in limits:
        bounds = windows.select(*keys, "window_start", "window_end")
        stamps = df.select(*keys, *dict.fromkeys((ts, latest)))
        inside = (F.col(ts) >= F.col("window_start")) & (F.col(ts) < F.col("window_end"))
        if latest_of is None:
            stamps = stamps.distinct().join(bounds, keys)
        else:  # rows outside the window count nothing, so they leave before copies are looked for
            stamps = stamps.join(bounds, keys).filter(inside).distinct()
        stats = stamps.groupBy(*keys).agg(
            F.count_if(inside).alias(f"{name}_rows"), F.max(latest).alias("_latest"))
        if latest_of is not None:
            stats = latest_of[name].select(*keys, F.col("latest").alias("_latest")).join(
                stats.drop("_latest"), keys, "left")
        age = age_minutes(now, F.col("_latest"))
        stats = stats.select(*keys, f"{name}_rows", age.alias(f"{name}_age_minutes"))
        out = out.join(stats, keys, "left").withColumn(
            f"{name}_rows", F.coalesce(f"{name}_rows", F.lit(0).cast("long"))).withColumn(
            f"{name}_fresh", F.coalesce(F.col(f"{name}_age_minutes") < limit, F.lit(True)))
    return out.drop("window_start", "window_end")


def archive_status(archive: DataFrame, keys: Sequence[str] = ("source",), ts: str = "timestamp") -> DataFrame:
    """Records and oldest timestamp; text that is no timestamp counts but is skipped."""
    parsed = F.col(ts).try_cast("timestamp")
    return archive.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("record_count"), F.min(parsed).alias("oldest"))


# ---- inventories ---------------------------------------------------------------------

STAMP = r"(\d{8}T\d{6}Z)"


def stamp_time(stamp: Column) -> Column:
    return F.try_to_timestamp(F.replace(stamp, F.lit("Z"), F.lit("")), F.lit("yyyyMMdd'T'HHmmss"))


def backup_health(
    files: DataFrame, now: Column, keys: Sequence[str] = ("target",), *,
    name_pattern: str = rf"^.*{STAMP}.*$", warn_hours: float = 30, stale_hours: float = 36,
    targets: DataFrame | None = None,
) -> DataFrame:
    """Latest complete archive per target by the stamp in its name, its issues and status.

    Input has the FILE_ENTRY schema; ``sidecar`` is the text of the checksum file. Of files with
    one stamp the last by name counts. The first critical issue, else the first warning, is the reason.
    """
    stamp = F.nullif(F.regexp_extract("name", name_pattern, 1), F.lit(""))
    latest = files.withColumn("_stamp", stamp).filter(F.col("_stamp").isNotNull()).groupBy(*keys).agg(
        F.max_by(F.struct("name", "sha256", "sidecar", "_stamp"), F.struct("_stamp", "name")).alias("_f"))
    base = (targets if targets is not None else files).select(*keys).distinct().join(latest, list(keys), "left")
    found = F.col("_f").isNotNull()
    digest = F.lower(F.regexp_extract(F.coalesce("_f.sidecar", F.lit("")), r"(?m)^\s*([0-9a-fA-F]{64})\b", 1))
    age = (F.unix_micros(now) - F.unix_micros(stamp_time(F.col("_f._stamp")))) / 3.6e9
    checksum = (
        F.when(~found, "not_checked").when(F.col("_f.sidecar").isNull(), "missing")
        .when((digest == "") | (digest != F.lower("_f.sha256")), "invalid").otherwise("ok"))

    def issue(severity: str, code: str, message: Column) -> Column:
        return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"))

    hours = F.format_string("%.0f", age)
    issues = F.array_compact(F.array(
        F.when(~found, issue("critical", "NO_COMPLETED_ARCHIVE", F.lit("No completed archive found"))),
        F.when(checksum == "missing", issue("critical", "CHECKSUM_MISSING", F.concat(
            F.lit("Missing checksum sidecar for "), F.col("_f.name")))),
        F.when(checksum == "invalid", issue("critical", "CHECKSUM_INVALID", F.when(
            digest == "", F.lit("Checksum sidecar has no valid sha256 digest")).otherwise(
            F.concat(F.lit("Checksum mismatch for "), F.col("_f.name"))))),
        F.when(age >= stale_hours, issue("critical", "BACKUP_STALE", F.concat(
            F.lit("Latest recovery bundle is "), hours, F.lit(f" hours old (threshold {stale_hours:.0f}h)"))))
        .when(age >= warn_hours, issue("warning", "BACKUP_APPROACHING_STALE", F.concat(
            F.lit("Latest recovery bundle is "), hours,
            F.lit(f" hours old (warn at {warn_hours:.0f}h, stale at {stale_hours:.0f}h)"))))))
    out = base.withColumns({"issues": issues, "checksum_status": checksum, "age_hours": F.round(age, 2)})

    def first(severity: str) -> Column:
        return F.get(F.filter("issues", lambda i: i["severity"] == severity), F.lit(0))

    status = F.when(first("critical").isNotNull(), "critical").when(
        first("warning").isNotNull(), "warning").otherwise("ok")
    reason = F.coalesce(first("critical")["message"], first("warning")["message"], F.lit("Backup healthy"))
    return out.select(
        *keys, F.col("_f.name").alias("latest_name"), "age_hours", "checksum_status",
        status.alias("status"), reason.alias("reason"),
        F.transform("issues", lambda i: i["code"]).alias("issue_codes"))


def verify_copy(source: DataFrame, copy: DataFrame, keys: Sequence[str] = ("name",), size: str = "size") -> DataFrame:
    """A non-empty source whose copy is missing or empty fails. Input: keys, size."""
    left = source.groupBy(*keys).agg(F.sum(size).alias("source_size"))
    right = copy.groupBy(*keys).agg(F.sum(size).alias("copy_size"))
    both = left.join(right, list(keys), "full_outer")
    full = F.coalesce("source_size", F.lit(0)) > 0
    bad = full & (F.coalesce("copy_size", F.lit(0)) <= 0)
    message = F.when(bad, "backup missing or empty for non-empty source").when(
        full, "backup verified").otherwise("source absent or empty")
    return both.withColumn("ok", ~bad).withColumn("message", message)


def day_report(days: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """ok, lagging or failed per landed day payload. Input: keys, day, rows, error.

    A day without rows and without an error is ok with nothing in it, as the fetch returns.
    """
    lag = F.col("error").rlike(r"(?i)no energy data received from the respective tdsp")
    status = F.when(F.col("error").isNull(), "ok").when(lag, "lagging").otherwise("failed")
    return days.withColumn("status", status).withColumn(
        "message", F.when(F.col("status") == "failed", redact_payload("error")))


def day_report_counts(days: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    return day_report(days, keys).groupBy(*keys, "status").agg(
        F.count(F.lit(1)).alias("day_count"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


# ---- retention plans -----------------------------------------------------------------

def keep_last(
    files: DataFrame, n: int, keys: Sequence[str] = ("target",), *,
    name_pattern: str = rf"^.*{STAMP}.*$", pending: DataFrame | None = None,
) -> DataFrame:
    """``action`` keep or delete: the newest ``n`` matching names per key stay.

    Only matching names take part. Pending files compete for a place but are not deleted.
    The cut-off stamp comes from a group-limited top-n, so no key is sorted whole.
    """
    if n < 1:
        raise ValueError("at least one file must be kept")
    stamp = F.nullif(F.regexp_extract("name", name_pattern, 1), F.lit(""))
    rows = files.select(*keys, "name").withColumn("_here", F.lit(True))
    if pending is not None:
        new = pending.select(*keys, "name").join(files.select(*keys, "name"), [*keys, "name"], "left_anti")
        rows = rows.unionByName(new.withColumn("_here", F.lit(False)))
    rows = rows.withColumn("_stamp", stamp).filter(F.col("_stamp").isNotNull())
    newest = top_n(rows, keys, [F.col("_stamp").desc(), F.col("name").desc()], n)
    edge = newest.groupBy(*keys).agg(F.min(F.struct("_stamp", "name")).alias("_edge"))
    kept = F.struct("_stamp", "name") >= F.col("_edge")
    return rows.join(edge, list(keys)).filter("_here").select(
        *keys, "name", F.when(kept, "keep").otherwise("delete").alias("action"))


def keep_days(
    files: DataFrame, days: int, now: Column, keys: Sequence[str] = ("target",), *,
    name_pattern: str = rf"^.*{STAMP}.*$",
) -> DataFrame:
    """``action`` by the age of the stamp in the name; names without one are left out."""
    if days < 1:
        raise ValueError("at least one day must be kept")
    stamp = stamp_time(F.regexp_extract("name", name_pattern, 1))
    cutoff = F.timestamp_micros(F.unix_micros(now) - days * 86_400_000_000)
    return files.withColumn("_at", stamp).filter(F.col("_at").isNotNull()).select(
        *keys, "name", F.when(F.col("_at") >= cutoff, "keep").otherwise("delete").alias("action"))


def shortest_per_signature(cards: DataFrame, text: str, signature: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Shortest text per non-empty signature, the first of equal lengths by text."""
    tagged = cards.withColumn("signature", signature).filter(F.col("signature") != "")
    return tagged.groupBy(*keys, "signature").agg(
        F.min_by(text, F.struct(F.length(text), F.col(text))).alias(text))


def first_with_fallback_key(
    rows: DataFrame, candidates: Sequence[str], order: Sequence[str], limit: int | None = None
) -> DataFrame:
    """First row per key, the key being the first non-empty candidate column; rows without
    any key drop out. ``limit`` keeps the earliest rows of the result."""
    key = F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in candidates])
    keyed = rows.withColumn("_key", key).filter(F.col("_key").isNotNull())
    columns = [c for c in rows.columns]
    first = keyed.groupBy("_key").agg(
        F.min_by(F.struct(*columns), F.struct(*order)).alias("_r")).select("_r.*")
    return first.orderBy(*order).limit(limit) if limit is not None else first


def last_lines(lines: DataFrame, keys: Sequence[str], n: int, order: str = "line_no") -> DataFrame:
    """Last ``n`` lines per file."""
    return top_n(lines, keys, [F.col(order).desc()], n).drop("rank")
