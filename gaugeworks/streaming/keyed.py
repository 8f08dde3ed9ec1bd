"""Keyed state streams: alert decisions, lifecycles, pending batches with expiry.

Each is a fold over the rows of a key in event time (``in_order``): a row is decided when the
watermark has passed it, so late rows within ``lateness`` are decided in their place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gaugeworks.operators.state import STATES, TTL_MINUTES, fingerprint_of, severity_of
from gaugeworks.streaming.in_order import Fold, State, fold_in_order, output


def _after(us: int, seconds: float | None) -> int | None:
    return None if seconds is None else us + int(seconds * 1_000_000)


def alert_fold(idle_seconds: float | None = None) -> Fold:
    """State: last severity, last fingerprint sent, instant of the last row."""
    def step(state: State, us: int, row: tuple) -> tuple[State, list[tuple]]:
        previous, sent, _ = state or ("healthy", None, us)
        severity, fingerprint, delivered = row
        if severity == "healthy":
            fingerprint = "healthy"
            due = sent != "healthy" and (previous in ("warning", "critical") or sent is not None)
            kind = "recovery" if due else "none"
        else:
            kind = "none" if sent == fingerprint else "alert"
        if kind != "none" and delivered:
            sent = fingerprint
        return (severity, sent, us), [(us, severity, kind)]

    return Fold(
        "severity string, sent string, at long", ("severity", "fingerprint", "delivered"),
        "_us long, severity string, decision string", step, lambda state: _after(state[2], idle_seconds))


def alert_decisions(stream: DataFrame, key: str = "backup_id", *, lateness: str = "0 seconds",
                    idle_seconds: float | None = None, slot_seconds: float = 60) -> DataFrame:
    """Decision per result row, as ``operators.state.alert_decisions`` gives it.

    With ``idle_seconds`` a key without a result for so long begins anew and holds no state.
    """
    return fold_in_order(stream, alert_fold(idle_seconds), [key], {
        "severity": severity_of(F.col("status")), "fingerprint": fingerprint_of(F.col("issue_codes")),
        "delivered": F.coalesce("delivered", F.lit(False))}, lateness=lateness, slot_seconds=slot_seconds)


def lifecycle_fold(initial: str = "active") -> Fold:
    def step(state: State, us: int, row: tuple) -> tuple[State, list[tuple]]:
        current, target = state[0] if state else initial, row[0]
        accepted = current != "ended" and target in STATES and target != current
        return (target if accepted else current,), [(us, target, current, accepted)]

    return Fold("status string", ("target",), "_us long, target string, state_before string, accepted boolean", step)


def lifecycle(stream: DataFrame, key: str = "search_id", initial: str = "active", *, lateness: str = "0 seconds",
              slot_seconds: float = 60) -> DataFrame:
    """Commands with the state they met and whether they were accepted. State: the status."""
    return fold_in_order(stream, lifecycle_fold(initial), [key], {"target": F.col("target")},
                         lateness=lateness, slot_seconds=slot_seconds)


# ---- pending batches -----------------------------------------------------------------

_BATCH = "items array<string>, saved long"


def changed(items: list, saved: int | None, us: int, row: tuple) -> tuple[list, int | None]:
    """Items and time of a chat's batch after the command ``(action, items, positions, names)``."""
    action, new, positions, names = row
    if action == "save":
        return list(new if new is not None else []), us
    if action == "clear":
        return [], None
    if action == "remove" and saved is not None:
        drop = {int(p) for p in (positions if positions is not None else [])}
        gone = set(names if names is not None else [])
        items = [x for i, x in enumerate(items, 1) if i not in drop and x not in gone]
        return items, us if items else None
    return items, saved


def pending_fold(ttl_minutes: float = TTL_MINUTES) -> Fold:
    """State: the batch of the chat and when it was last written; void after its time to live."""
    def step(state: State, us: int, row: tuple) -> tuple[State, list[tuple]]:
        items, saved = changed(*(state or ([], None)), us, row)
        after = None if saved is None else (items, saved)
        return after, [(us, "empty" if after is None else "saved", items)]

    return Fold(
        _BATCH, ("action", "items", "positions", "names"), "_us long, event string, items array<string>", step,
        lambda state: _after(state[1], ttl_minutes * 60), lambda state, us: [(us, "expired", list(state[0]))])


def pending_batches(stream: DataFrame, key: str = "chat_key", ttl_minutes: float = TTL_MINUTES,
                    lateness: str = "0 seconds", slot_seconds: float = 60) -> DataFrame:
    """Current batch of a chat after each command, and its end when it expires.

    Input: key, ts, action (save, remove, clear), items array<string> for a save and
    positions array<int> (1-based) plus names array<string> for a remove. State is the
    batch of the chat; it goes away on clear, when emptied, or at the end of its time to live in
    event time, with or without another command of the chat.
    """
    return fold_in_order(stream, pending_fold(ttl_minutes), [key], {
        name: F.col(name) for name in ("action", "items", "positions", "names")}, lateness=lateness, slot_seconds=slot_seconds)


class _Latest(StatefulProcessor):
    """The batch of a chat as it is held, in the order of arrival."""

    def __init__(self, key: str, ttl_ms: int):
        self.key, self.ttl_ms = key, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.batch = handle.getValueState("batch", _BATCH, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = self.batch.get()
        items, saved = ([], None) if found is None else (list(found[0]), found[1])
        for frame in rows:
            out = []
            for _, us, *row in frame.itertuples(index=False, name=None):
                items, saved = changed(items, saved, int(us), tuple(row))
                out.append((key[0], int(us), "empty" if saved is None else "saved", items))
            yield output(out, [self.key, "_us", "event", "items"])
        if saved is not None:
            self.batch.update((items, saved))
        elif found is not None:
            self.batch.clear()

    def close(self) -> None:
        pass


def held_batches(stream: DataFrame, key: str = "chat_key", ttl_minutes: float = TTL_MINUTES) -> DataFrame:
    """As ``pending_batches``, decided on arrival: state lives ``ttl_minutes`` of the clock after its
    last write and is then absent, as the state store's own time to live has it. Commands of
    one micro-batch are taken in its order; nothing is put out when a batch expires."""
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, F.unix_micros("ts").alias("_us"), "action", "items", "positions", "names")
    out = rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Latest(key, int(ttl_minutes * 60_000)),
        outputStructType=f"`{key}` {kind}, _us long, event string, items array<string>",
        outputMode="Append", timeMode="ProcessingTime")
    return out.select(key, F.timestamp_micros("_us").alias("ts"), "event", "items")
