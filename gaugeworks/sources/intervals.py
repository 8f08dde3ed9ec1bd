"""Interval meter data: generic CSV, utility-export CSV and packed-day payloads."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.text import hash_identifier
from gaugeworks.functions.timekeys import DEFAULT_ZONE, day_start

# Header names of each field, best first, and the accepted time formats.
HEADERS = {
    "start": ("start", "start time", "starttime", "interval start", "intervalstart", "date time",
              "datetime", "begin", "from", "reading start"),
    "end": ("end", "end time", "endtime", "interval end", "intervalend", "stop", "to",
            "reading end"),
    "usage": ("usage", "kwh", "usage kwh", "kwh used", "energy", "consumption", "value",
              "interval usage", "interval kwh"),
    "date": ("date", "reading date", "day"),
    "time": ("time", "reading time", "interval time"),
    "usage_date": ("usage date",), "usage_start": ("usage start time",),
    "usage_end": ("usage end time",), "usage_kwh": ("usage kwh",), "account": ("esiid",),
    "revision": ("revision date",), "estimated": ("estimated actual",),
    "kind": ("consumption surplusgeneration",),
}
LOCAL_FORMATS = (
    "yyyy-M-d H:mm:ss", "yyyy-M-d H:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm",
    "M/d/yyyy h:mm:ss a", "M/d/yyyy h:mm a", "yyyy-M-d'T'H:mm:ss", "yyyy-M-d'T'H:mm",
)
ZONED = r"(?:[+-]\d{2}:?\d{2}|Z)$"


def header_key(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", name.strip().lower()).strip()


def resolve_headers(columns: Sequence[str]) -> dict[str, str]:
    """Field to column, by the first header name that exists."""
    known = {header_key(c): c for c in columns}
    found = {f: next((known[n] for n in names if n in known), None) for f, names in HEADERS.items()}
    return {f: c for f, c in found.items() if c}


def parse_local(text: Column, tz: str) -> Column:
    """UTC instant of a date and time written in any accepted format; local unless zoned."""
    value = F.trim(text)
    local = F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in LOCAL_FORMATS])
    fallback = F.to_utc_timestamp(value.try_cast("timestamp"), tz)
    zoned = value.try_cast("timestamp")
    return F.date_trunc("second", F.when(value.rlike(ZONED), zoned).otherwise(
        F.coalesce(F.to_utc_timestamp(local, tz), fallback)))


def parse_kwh(text: Column) -> Column:
    """Empty and ``-`` are 0; ``1.2-x`` is 1.2; anything else that is no number is null."""
    value = F.trim(F.coalesce(text, F.lit("")))
    head = F.when(value.contains("-") & ~value.startswith("-"), F.substring_index(value, "-", 1)).otherwise(value)
    return F.when(value.isin("", "-"), 0.0).otherwise(F.round(head.try_cast("double"), 6))


def _minutes_later(ts: Column, minutes: int) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + minutes * 60_000_000)


def decode_csv(
    rows: DataFrame,
    *,
    tz: str = DEFAULT_ZONE,
    account_id: str | None = None,
    meter_id: str | None = None,
    provider: str = "smart_meter_texas",
    raw_source: str = "csv",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Intervals of either CSV layout, with ``problem`` for rows that do not decode.

    ``rows`` has string columns as read with a header; the layout follows from the headers.
    """
    at = resolve_headers([c for c in rows.columns if c not in keep])
    col = {f: F.col(f"`{c}`") for f, c in at.items()}
    default_account = hash_identifier(F.lit(account_id).cast("string"))
    if all(f in col for f in ("usage_date", "usage_start", "usage_end", "usage_kwh")):
        start, end, kwh, account, source = _export_fields(col, tz, default_account, raw_source)
    else:
        start, end = _generic_bounds(col, tz)
        kwh = parse_kwh(col["usage"]) if "usage" in col else F.lit(None).cast("double")
        account, source = default_account, F.lit(raw_source)
    problem = F.when(F.lit("usage" not in col and "usage_kwh" not in col), "could not find a usage/kWh column").when(
        start.isNull(), "unrecognized or missing start time").when(
        end.isNull(), "unrecognized end time").when(kwh.isNull(), "invalid kWh value")
    return rows.select(
        *keep, F.lit(provider).alias("provider"), start.alias("start_ts"), end.alias("end_ts"),
        kwh.alias("kwh"), hash_identifier(F.lit(meter_id).cast("string")).alias("meter_id_hash"),
        account.alias("account_id_hash"), source.alias("raw_source"), problem.alias("problem"))


def _filled(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit("")) != ""


def _generic_bounds(col: dict[str, Column], tz: str) -> tuple[Column, Column]:
    none = F.lit(None).cast("timestamp")
    start, end = none, none
    if "date" in col and "time" in col:
        both = _filled(col["date"]) & _filled(col["time"])
        start = F.when(both, parse_local(F.concat_ws(" ", col["date"], col["time"]), tz))
    if "start" in col:
        start = F.when(_filled(col["start"]), parse_local(col["start"], tz)).otherwise(start)
    end = _minutes_later(start, 15)
    if "end" in col and "start" in col:
        given = _filled(col["start"]) & _filled(col["end"])
        end = F.when(given, parse_local(col["end"], tz)).otherwise(end)
    return start, end


def _export_fields(col, tz, default_account, raw_source):
    day = F.ltrim(F.trim(col["usage_date"]), F.lit("'"))
    first = F.ltrim(F.trim(col["usage_start"]), F.lit("'"))
    last = F.ltrim(F.trim(col["usage_end"]), F.lit("'"))

    def at(clock: Column) -> Column:
        return F.try_to_timestamp(F.concat_ws(" ", day, clock), F.lit("M/d/yyyy H:mm"))

    wraps = at(last) <= at(first)
    end_local = F.when(wraps, _minutes_later(at(last), 1440)).otherwise(at(last))
    account = default_account
    if "account" in col:
        account = F.when(_filled(col["account"]), hash_identifier(col["account"])).otherwise(account)
    marks = [F.lit(raw_source)]
    for field, tag in (("estimated", "est"), ("kind", "type"), ("revision", "revision")):
        if field in col:
            marks.append(F.when(_filled(col[field]), F.concat(F.lit(f"{tag}="), F.trim(col[field]))))
    return (F.to_utc_timestamp(at(first), tz), F.to_utc_timestamp(end_local, tz),
            parse_kwh(col["usage_kwh"]), account, F.concat_ws(";", *marks))


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """Intervals of all CSV files under ``path``, which share one layout."""
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return decode_csv(rows, **options)


def good_rows(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("problem").isNull()).drop("problem")


def bad_rows(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("problem").isNotNull())


PACKED_SCHEMA = (
    "struct<data:struct<errorCode:string,errorMessage:string,"
    "energyData:array<struct<RT:string,RD:string>>>>"
)


def explode_packed_days(
    payloads: DataFrame,
    *,
    payload: str = "payload",
    day: str = "day",
    keep: Sequence[str] = ("site_id",),
    tz: str = DEFAULT_ZONE,
    provider: str = "smart_meter_texas",
    raw_source: str = "portal_api",
    minutes: int = 15,
) -> DataFrame:
    """One row per slot of a packed day: the consumption list, else the first one.

    Slots are counted in real time from local midnight, so a day with a clock change keeps
    its 92 or 100 slots in the right place.
    """
    data = F.from_json(payload, PACKED_SCHEMA)["data"]
    entries = F.coalesce(data["energyData"], F.array().cast("array<struct<RT:string,RD:string>>"))
    chosen = F.coalesce(F.get(F.filter(entries, lambda e: e["RT"] == "C"), F.lit(0)),
                        F.get(entries, F.lit(0)))
    parts = F.filter(F.split(F.coalesce(chosen["RD"], F.lit("")), ","), lambda p: F.trim(p) != "")
    slots = payloads.filter(data["errorCode"].isNull()).select(
        *keep, day_start(day, tz).alias("_midnight"), F.posexplode(parts).alias("_slot", "_text")
    ).withColumn("_slot", F.col("_slot").cast("long"))
    return slots.select(
        *keep, F.lit(provider).alias("provider"),
        F.timestamp_micros(F.unix_micros("_midnight") + F.col("_slot") * (minutes * 60_000_000)).alias("start_ts"),
        F.timestamp_micros(F.unix_micros("_midnight") + (F.col("_slot") + 1) * (minutes * 60_000_000)).alias("end_ts"),
        parse_kwh(F.col("_text")).alias("kwh"), F.lit(raw_source).alias("raw_source"))


def payload_errors(payloads: DataFrame, payload: str = "payload", keep: Sequence[str] = ("site_id", "day")):
    """Landed day payloads with their error text, ready for ``health.day_report``."""
    data = F.from_json(payload, PACKED_SCHEMA)["data"]
    return payloads.select(
        *keep, F.when(data.isNull(), F.lit("response missing data object")).when(
            F.coalesce(F.nullif(data["errorCode"], F.lit("")), F.lit("0")) != "0",
            F.coalesce(data["errorMessage"], F.lit("unknown error"))).alias("error"))
