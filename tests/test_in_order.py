"""Folds in event time: late rows, idle keys, backlogs, many rows at one instant."""

import random
import time

import pytest
from pyspark.sql import functions as F
from test_streaming import at, results, sampled

from gaugeworks.operators import state
from gaugeworks.streaming import in_order, keyed, samples


def late(df, path, ts="ts", files=4, last=None):
    """Files in time order, but every third row comes one file later; ``last`` rows close the stream."""
    rows = df.orderBy(ts).collect()
    step = -(-len(rows) // files)
    dealt = [[] for _ in range(files + 1)]
    for i, row in enumerate(rows):
        dealt[i // step + (i % 3 == 0)].append(row)
    for i, part in enumerate([*dealt, *([last] if last else [])]):
        df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"{path}/f{i}")


def run(spark, schema, folder, tmp_path, build, name="cp"):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    table = f"out_{random.randrange(10**9)}"
    query = (build(stream).writeStream.format("memory").queryName(table).outputMode("append")
             .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
    query.awaitTermination(120)
    return sorted(map(tuple, spark.table(table).collect()), key=str), query


def held(spark, tmp_path, variable, name="cp"):
    """Rows of a state variable after the last batch."""
    return (spark.read.format("statestore").option("stateVarName", variable).load(str(tmp_path / name))
            .select("key", "value").collect())


@pytest.mark.parametrize("slot", [1, 5000])
def test_late_alerts_equal_batch(spark, tmp_path, slot):
    df = results(spark, 90)
    end = [("end", at(10_000_000), "ok", [], True)]
    late(df, str(tmp_path / "in"), last=end)
    out, _ = run(spark, df.schema, tmp_path / "in", tmp_path, lambda s: keyed.alert_decisions(
        s, lateness="12 hours", slot_seconds=slot))
    batch = state.alert_decisions(df).select("backup_id", "ts", "severity", "decision")
    assert [r for r in out if r[0] != "end"] == sorted(map(tuple, batch.collect()), key=str)


def test_late_throttle_equals_batch_and_idle_keys_go(spark, tmp_path):
    df = sampled(spark, 120, seed=3)
    late(df, str(tmp_path / "in"), last=[(9, at(10_000_000))])
    out, _ = run(spark, df.schema, tmp_path / "in", tmp_path, lambda s: samples.throttle(s, "host", 400, lateness="12 hours"))
    batch = state.throttle(df, ["host"], 400)
    assert [r for r in out if r[0] != 9] == sorted(map(tuple, batch.collect()), key=str)
    # All hosts but the last have been idle for longer than the interval.
    assert held(spark, tmp_path, "state") == [] and held(spark, tmp_path, "swept") == []


def test_late_lifecycle_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    df = spark.createDataFrame(
        [(rng.choice("abc"), at(i * 500), rng.choice(["active", "paused", "active", "paused", "ended", "odd", None]))
         for i in range(70)], "search_id string, ts timestamp, target string")
    late(df, str(tmp_path / "in"), last=[("end", at(10_000_000), "paused")])
    out, _ = run(spark, df.schema, tmp_path / "in", tmp_path, lambda s: keyed.lifecycle(s, lateness="8 hours"))
    batch = state.lifecycle(df).select("search_id", "ts", "target", "state_before", F.coalesce("accepted", F.lit(False)))
    assert [r for r in out if r[0] != "end"] == sorted(map(tuple, batch.collect()), key=str)


def plain(fold, rows):
    """The fold over one key's rows in order, and the end of what it leaves."""
    left, out = fold.run(None, iter(sorted(rows, key=lambda r: r[0])))
    return out + fold.ended(left, 1 << 62)[1]


def test_late_pending_batches_expire_without_a_message(spark, tmp_path):
    rng = random.Random(6)
    kinds = ["save", "save", "remove", "clear"]
    rows = [(rng.choice("pqr"), at(i * 700), k := rng.choice(kinds), list("xyz") if k == "save" else None,
             [rng.randint(1, 3)] if k == "remove" else None, ["z"] if k == "remove" and rng.random() < 0.5 else None)
            for i in range(60)]
    schema = "chat_key string, ts timestamp, action string, items array<string>, positions array<int>, names array<string>"
    df = spark.createDataFrame(rows, schema)
    last = [("end", at(1_000_000), "clear", None, None, None)]
    late(df, str(tmp_path / "in"), last=last)
    out, _ = run(spark, df.schema, tmp_path / "in", tmp_path, lambda s: keyed.pending_batches(s, lateness="12 hours"))
    want = []
    for key in "pqr":
        own = [(int(ts.timestamp()) * 1_000_000, *rest) for k, ts, *rest in rows if k == key]
        want += [(key, us / 1_000_000, event, list(items)) for us, event, items in plain(keyed.pending_fold(), own)]
    got = [(k, ts.timestamp(), e, list(i)) for k, ts, e, i in out if k != "end"]
    assert sorted(got) == sorted(want)
    assert sum(e == "expired" for _, _, e, _ in got) >= 3
    assert held(spark, tmp_path, "state") == []


def test_idle_alerts_begin_anew(spark, tmp_path):
    schema = "backup_id string, ts timestamp, status string, issue_codes array<string>, delivered boolean"
    rows = [("a", at(0), "error", ["X"], True), ("a", at(60), "error", ["X"], True), ("a", at(9000), "error", ["X"], True),
            ("b", at(0), "error", ["X"], True), ("z", at(90_000), "ok", [], True)]
    for i, part in enumerate((rows[:2], rows[2:4][1:], rows[2:3], rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    out, _ = run(spark, spark.createDataFrame([], schema).schema, tmp_path / "in", tmp_path,
                 lambda s: keyed.alert_decisions(s, lateness="4 hours", idle_seconds=3600))
    assert [(r[0], r[3]) for r in sorted(out, key=lambda r: (r[0], r[1]))] == [
        ("a", "alert"), ("a", "none"), ("a", "alert"), ("b", "alert")]
    assert held(spark, tmp_path, "state") == []


def test_held_batches_live_by_the_clock(spark, tmp_path):
    schema = spark.createDataFrame(
        [], "chat_key string, ts timestamp, action string, items array<string>, positions array<int>, names array<string>").schema

    def send(number, rows):
        """One run of the query over what is new, since state that lives by the clock asks for batches without end."""
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{number}"))
        out = []
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        query = (keyed.held_batches(stream, ttl_minutes=0.5).writeStream.trigger(once=True)
                 .foreachBatch(lambda batch, _: out.extend(map(tuple, batch.collect())))
                 .option("checkpointLocation", str(tmp_path / "cp")).start())
        query.awaitTermination(120)
        return out

    first = send(0, [("a", at(0), "save", ["x", "y"], None, None), ("b", at(0), "save", ["q"], None, None)])
    assert sorted((r[0], r[2], r[3]) for r in first) == [("a", "saved", ["x", "y"]), ("b", "saved", ["q"])]
    second = send(1, [("a", at(1), "remove", None, [1], None)])
    assert [(r[0], r[2], r[3]) for r in second] == [("a", "saved", ["y"])]
    time.sleep(31)
    third = send(2, [("a", at(2), "remove", None, [1], None)])
    assert [(r[0], r[2], r[3]) for r in third] == [("a", "empty", [])]
    assert held(spark, tmp_path, "batch") == []


class Store:
    """State of one key in memory, with the calls that a processor makes."""

    def __init__(self):
        self.maps, self.timers, self.reads = {}, set(), []

    def getMapState(self, name, *_):
        store, table = self, self.maps.setdefault(name, {})

        class Map:
            def getValue(self, key):
                store.reads.append((name, key))
                return table.get(key)

            def updateValue(self, key, value):
                table[key] = value

            def removeKey(self, key):
                del table[key]

            def keys(self):
                return iter(list(table))
        return Map()

    def getValueState(self, name, *_):
        box = self.maps.setdefault(name, [None])

        class Value:
            def get(self):
                return box[0]

            def update(self, value):
                box[0] = value

            def clear(self):
                box[0] = None
        return Value()

    def registerTimer(self, at):
        self.timers.add(at)


class Clock:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def processor(fold, columns, order=(), slot=60_000):
    import pandas as pd

    p, store = in_order.InOrder(fold, ["k", "ts", *columns], columns, ["k"], order, slot), Store()
    p.init(store)

    def feed(rows):
        return list(p.handleInputRows(("a",), iter([pd.DataFrame(
            [("a", None, *r) for r in rows], columns=["k", "ts", *columns])]), None))

    def tick(watermark):
        out = [row for frame in p.handleExpiredTimer(("a",), Clock(watermark), None) for row in frame.itertuples(index=False, name=None)]
        return out
    return p, store, feed, tick


def test_backlog_is_read_slot_by_slot(monkeypatch):
    """Of a key's long backlog no more than one slot is in memory at once."""
    fold = samples.throttle_fold(90)
    _, store, feed, tick = processor(fold, ["_us"])
    rng = random.Random(1)
    times = [rng.randrange(0, 40_000) * 1_000_000 for _ in range(20_000)]
    for i in range(0, len(times), 1000):
        feed([(t,) for t in times[i:i + 1000]])
    sizes, join = [], in_order.pa.concat_tables
    monkeypatch.setattr(in_order.pa, "concat_tables", lambda t, **o: sizes.append(sum(x.num_rows for x in t)) or join(t, **o))
    got = [us for _, us in tick(20_000_000)] + [us for _, us in tick(90_000_000)]
    want, last = [], None
    for t in sorted(times):
        if last is None or t >= last + 90_000_000:
            want.append(t)
            last = t
    assert got == want
    assert max(sizes) <= 80 and len(sizes) > 600
    assert store.maps["waiting"] == {} and store.maps["parts"] == {} and store.maps["state"] == [None]


def test_rows_past_the_watermark_go_on_waiting():
    _, store, feed, tick = processor(samples.throttle_fold(10), ["_us"])
    feed([(5_000_000,), (30_000_000,), (30_000_001,)])
    assert store.timers == {30_001}
    assert tick(30_000) == [("a", 5_000_000), ("a", 30_000_000)]
    assert tick(30_000) == [] and len(store.maps["waiting"]) == 1
    feed([(30_000_500,)])
    assert tick(40_000) == []
    assert tick(50_000) == [] and store.maps["state"] == [None]


def test_order_within_an_instant_does_not_hang_on_arrival():
    rows = [(1_000_000, t) for t in ("paused", "active", "ended", "paused", "active")]
    seen = set()
    for seed in range(5):
        random.Random(seed).shuffle(rows)
        _, _, feed, tick = processor(keyed.lifecycle_fold(), ["_us", "target"], ["target"])
        for row in rows:
            feed([row])
        seen.add(tuple(tick(5_000)))
    assert len(seen) == 1
