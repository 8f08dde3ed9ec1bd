"""Sample streams: throttle, archive with rolling view, sessions, host windows, late data.

Each function takes a streaming frame and returns one, or starts nothing by itself; the
caller names sink, checkpoint folder and trigger. Keys keep their watermark, so state is
bounded by the allowed lateness.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.series import COOLING
from gaugeworks.sinks.archive import append_days
from gaugeworks.sinks.tables import rewrite_rolling
from gaugeworks.streaming.in_order import Fold, State, fold_in_order


def throttle_fold(interval_seconds: float) -> Fold:
    """State: the last accepted instant, which says nothing any more once the interval is over."""
    interval = int(interval_seconds * 1_000_000)

    def step(state: State, us: int, row: tuple) -> tuple[State, list[tuple]]:
        return (state, []) if state is not None and us < state[0] + interval else ((us,), [(us,)])

    return Fold("last long", (), "_us long", step, lambda state: state[0] + interval)


def throttle(stream: DataFrame, key: str, interval_seconds: float, *, ts: str = "ts",
             lateness: str = "0 seconds", slot_seconds: float = 60) -> DataFrame:
    """Accepted instants per key, as ``operators.state.throttle`` gives them. A key without rows for
    longer than the interval holds no state."""
    return fold_in_order(stream, throttle_fold(interval_seconds), [key], {}, ts=ts, lateness=lateness,
                         slot_seconds=slot_seconds)


def deduplicated(stream: DataFrame, keys: Sequence[str] = ("site_id", "ts"), *, ts: str = "ts",
                 lateness: str = "1 day") -> DataFrame:
    """Each (key, instant) once; out-of-order rows within the lateness are welcome."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(keys))


def archive_batch(archive_path: str, rolling_table: str, now, keys: Sequence[str] = ("site_id", "ts"),
                  days: float = 14, order: Sequence[str] = ("ts",)):
    """``foreachBatch`` writer: insert-or-ignore into the archive, then the rolling table.

    Both writes may run again for a batch without adding a row twice; of either store only the days
    that the batch touches are read.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        append_days(batch, archive_path, f"{batch_id:012d}", keys, order)
        rewrite_rolling(batch, rolling_table, now, keys=keys, days=days)

    return write


def cooling_sessions(stream: DataFrame, keys: Sequence[str] = ("site_id", "zone"), *,
                     gap: str = "15 minutes", lateness: str = "1 hour", action: str = COOLING) -> DataFrame:
    """Closed cooling cycles. A session window ends one gap after its last row, so the end
    is taken from the rows."""
    rows = stream.filter(F.col("action") == action).withWatermark("ts", lateness)
    return rows.groupBy(*keys, F.session_window("ts", gap)).agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("session_end"),
        F.count(F.lit(1)).alias("sample_count")).drop("session_window")


def host_windows(stream: DataFrame, keys: Sequence[str] = ("host",), *, length: str = "1 hour",
                 slide: str | None = "5 minutes", lateness: str = "10 minutes", threshold: float = 90.0,
                 sample_seconds: float = 60.0) -> DataFrame:
    """Peaks and saturation minutes per host and window. ``slide=None`` makes them tumble."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    hot = F.count_if(F.col("cpu_percent") > threshold)
    return stream.withWatermark("ts", lateness).groupBy(*keys, window.alias("w")).agg(
        F.max("cpu_percent").alias("cpu_peak"), F.max("load_1").alias("load_peak"),
        F.max("memory_used_percent").alias("memory_peak"),
        (hot * (sample_seconds / 60.0)).alias("saturated_minutes"),
        F.count(F.lit(1)).alias("sample_count")).select(
        *keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "cpu_peak",
        "load_peak", "memory_peak", "saturated_minutes", "sample_count")


def late_interval_batch(path: str, keys: Sequence[str] = ("site_id", "provider", "start_ts", "end_ts")):
    """``foreachBatch`` writer for intervals that arrive days late: insert-or-ignore by key.

    There is no watermark, so nothing is too late for the table. Days are those of the start.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        append_days(batch, path, f"{batch_id:012d}", keys, ["start_ts"], ts="start_ts")

    return write
