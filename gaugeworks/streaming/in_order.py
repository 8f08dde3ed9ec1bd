"""Keyed folds over a stream in the order of event time, late rows included.

Rows of a key wait in state until the watermark has passed them, are then folded one after the
other, and only the fold's small state stays. Rows that come late, but within the allowed lateness,
so get the answer that the batch form gives; rows behind the watermark are dropped by Spark.

Waiting rows are kept in chunks by time slot, one map entry a chunk, and each chunk sets a timer at
its latest row. A backlog is thus read one slot at a time, and rows are never gathered over a
micro-batch. A fold may name a moment at which its state has no meaning any more; when that moment
comes without a new row, a timer takes the state away, so idle keys cost nothing.

The session needs the state store that such operators require:
``spark.sql.streaming.stateStore.providerClass`` naming Spark's RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State of a fold: a tuple of its schema, or None.
State = tuple | None


@dataclass(frozen=True)
class Fold:
    """A state machine over the rows of one key.

    ``step(state, us, row)`` returns the next state and output rows, where ``row`` is a tuple of
    the fold's input columns. ``deadline(state)`` is the instant from which the state is void, or
    None; ``expire(state, us)`` gives the output rows of that moment.
    """

    state: str
    inputs: Sequence[str]
    outputs: str
    step: Callable[[State, int, tuple], tuple[State, list[tuple]]]
    deadline: Callable[[tuple], int | None] = lambda state: None
    expire: Callable[[tuple, int], list[tuple]] = lambda state, us: []

    def names(self) -> list[str]:
        return [field.strip().split(" ", 1)[0] for field in self.outputs.split(",")]

    def run(self, state: State, rows: Iterator[tuple]) -> tuple[State, list[tuple]]:
        """Folds rows ``(us, *inputs)`` that are in order."""
        out = []
        for us, *row in rows:
            state, ended = self.ended(state, us)
            out += ended
            state, more = self.step(state, us, tuple(row))
            out += more
        return state, out

    def ended(self, state: State, us: int) -> tuple[State, list[tuple]]:
        """The state at ``us``, and what its end before that moment gives."""
        end = None if state is None else self.deadline(state)
        if end is None or us < end:
            return state, []
        return None, self.expire(state, end)


def output(rows: list[tuple], columns: Sequence[str]) -> pd.DataFrame:
    """Rows as they are; a column type that pandas guesses does not always fit the way back."""
    return pd.DataFrame(rows, columns=list(columns), dtype=object)


def packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(chunk: bytes) -> pa.Table:
    return pa.ipc.open_stream(chunk).read_all()


def due_at(us: int) -> int:
    """The first millisecond at which the watermark has passed the instant ``us``."""
    return -(-us // 1000)


class InOrder(StatefulProcessor):
    """Runs a fold over rows that wait until the watermark has passed them."""

    def __init__(self, fold: Fold, given: Sequence[str], columns: Sequence[str], key: Sequence[str],
                 order: Sequence[str], slot_ms: int):
        self.fold, self.given, self.columns, self.key = fold, list(given), list(columns), list(key)
        self.order, self.slot_ms = list(order), slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long, part long", "chunk binary")
        self.parts = handle.getMapState("parts", "slot long", "n long")
        self.kept = handle.getValueState("state", self.fold.state)
        self.swept = handle.getValueState("swept", "watermark long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch.columns = self.given  # names such as ``_us`` do not survive the way here
            slots = (batch["_us"] + 999) // 1000 // self.slot_ms
            for slot, part in batch[self.columns].groupby(slots):
                self._wait(int(slot), part)
                self.handle.registerTimer(due_at(int(part["_us"].max())))
        yield self._frame(key, [])

    def _wait(self, slot: int, rows: pd.DataFrame) -> None:
        known = self.parts.getValue((slot,))
        number = 0 if known is None else known[0]
        self.waiting.updateValue((slot, number), (packed(rows),))
        self.parts.updateValue((slot,), (number + 1,))

    def _due(self, slot: int, until: int) -> list[tuple]:
        """Takes the slot's rows up to ``until`` in order; the rest of the slot goes on waiting."""
        known = self.parts.getValue((slot,))
        if known is None:
            return []
        tables = []
        for number in range(known[0]):
            tables.append(unpacked(bytes(self.waiting.getValue((slot, number))[0])))
            self.waiting.removeKey((slot, number))
        self.parts.removeKey((slot,))
        table = pa.concat_tables(tables, promote_options="permissive")
        table = table.sort_by([(name, "ascending") for name in ("_us", *self.order)])
        at = table["_us"].to_numpy()
        here = int((at <= until).sum())
        if here < len(at):
            self._wait(slot, table.slice(here).to_pandas())
        return list(zip(*(table.slice(0, here)[name].to_pylist() for name in self.columns), strict=True))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The first timer of a key folds all that the watermark has passed, slot by slot; the others
        of the same watermark find nothing left."""
        now = timerValues.getCurrentWatermarkInMs()
        swept = self.swept.get()
        if swept is not None and swept[0] >= now:
            yield self._frame(key, [])
            return
        state = before = self._state()
        width = 1 + len(self.fold.inputs)
        for slot in sorted(s for (s,) in list(self.parts.keys()) if s <= now // self.slot_ms):
            state, out = self.fold.run(state, (row[:width] for row in self._due(slot, now * 1000)))
            yield self._frame(key, out)
        state, out = self.fold.ended(state, now * 1000)
        if state != before:
            self._keep(state)
        if state is None and not any(True for _ in self.parts.keys()):
            self.swept.clear()
        else:
            self.swept.update((now,))
        yield self._frame(key, out)

    def _state(self) -> State:
        found = self.kept.get()
        return None if found is None else tuple(found)

    def _keep(self, state: State) -> None:
        if state is None:
            self.kept.clear()
            return
        self.kept.update(state)
        end = self.fold.deadline(state)
        if end is not None:
            self.handle.registerTimer(due_at(end))

    def _frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        return output([(*key, *row) for row in rows], [*self.key, *self.fold.names()])

    def close(self) -> None:
        pass


def fold_in_order(
    stream: DataFrame, fold: Fold, keys: Sequence[str], inputs: dict[str, Column], *, ts: str = "ts",
    order: Sequence[str] = (), lateness: str = "0 seconds", slot_seconds: float = 60,
) -> DataFrame:
    """Output rows of the fold: keys, ``ts`` and the fold's other outputs.

    ``inputs`` gives the fold's input columns; rows of one instant are folded in the order of these
    and of the ``order`` columns, so the result does not depend on how they arrive. Rows without
    an instant are left out.
    """
    keys = list(keys)
    ties = [name for name in order if name not in inputs]
    rows = stream.filter(F.col(ts).isNotNull()).withWatermark(ts, lateness).select(
        *keys, ts, F.unix_micros(ts).alias("_us"), *[c.alias(n) for n, c in inputs.items()], *ties)
    plain = [f.name for f in rows.select(*inputs).schema.fields if f.dataType.simpleString()[:5] not in ("array", "struc")]
    columns = ["_us", *inputs, *ties]
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    processor = InOrder(fold, rows.columns, columns, keys, [*order, *[n for n in plain if n not in order]], int(slot_seconds * 1000))
    out = rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=f"{kinds}, {fold.outputs}", outputMode="Append",
        timeMode="EventTime")
    names = [n for n in fold.names() if n != "_us"]
    return out.select(*keys, F.timestamp_micros("_us").alias(ts), *names)
