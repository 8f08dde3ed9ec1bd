"""The two recurring jobs: match new listings against searches, and alert show watches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators import listings as match
from gaugeworks.operators import shows as show_ops
from gaugeworks.sinks.tables import append_new, flag_new, ledger_rows, upsert_seen


def listing_cycle(listings: DataFrame, searches: DataFrame, stored: DataFrame) -> dict[str, DataFrame]:
    """One matching run: rows to insert and alert on, counters, and searches that cannot run.

    Works on a batch table or inside ``foreachBatch``; a search that cannot run is reported
    and the rest goes on.
    """
    compiled = match.compile_searches(searches.filter(F.lower(F.trim("status")) == "active"))
    runnable = compiled.filter(F.col("invalid").isNull())
    accepted = match.matches(listings, runnable)
    return {
        "new_listings": flag_new(stored, accepted.select(*listings.columns), "link", ["source", "title"])
        .filter("is_new").drop("is_new"),
        "counters": match.run_counters(listings, runnable, stored, order=("search_id", "source")),
        "invalid": compiled.filter(F.col("invalid").isNotNull()).select("search_id", "invalid"),
    }


def listing_stream_batch(searches: DataFrame, path: str):
    """``foreachBatch`` writer of the listing cycle; a repeated batch inserts nothing again."""
    def write(batch: DataFrame, batch_id: int) -> None:
        compiled = match.compile_searches(searches.filter(F.lower(F.trim("status")) == "active"))
        accepted = match.matches(batch, compiled.filter(F.col("invalid").isNull()))
        named = accepted.select(*batch.columns).filter(F.coalesce("link", F.lit("")) != "")
        append_new(named, path, ["link"], ["source", "title"])

    return write


def watch_cycle(
    watches: DataFrame, shows: DataFrame, stored_shows: DataFrame, ledger: DataFrame, today: Column
) -> dict[str, DataFrame]:
    """One watch run: due alerts, the refreshed show table, and a summary per watch.

    Append :func:`sinks.tables.ledger_rows` of the alerts that were delivered; the others
    come up again in the next run.
    """
    checked = show_ops.check_criteria(watches)
    valid = checked.filter("valid").drop("valid", "reason")
    found = show_ops.watch_candidates(valid, shows, today)
    alerts = show_ops.watch_alerts(valid, shows, ledger, today)
    sighted = found.select(*shows.columns).dropDuplicates(["source", "provider_event_id"]).withColumn(
        "seen_at", today.cast("timestamp"))
    return {
        "alerts": alerts,
        "shows": upsert_seen(stored_shows, sighted, ["source", "provider_event_id"]),
        "summary": show_ops.watch_summary(valid, found, alerts),
        "rejected": checked.filter("NOT valid").select("watch_id", "reason"),
    }


def bootstrap_watch(ledger: DataFrame, first_results: DataFrame) -> DataFrame:
    """Ledger rows that mark what a new watch already shows, so that nothing is sent for it."""
    return ledger_rows(ledger, first_results)
