"""Streams replayed from files give what the batch forms give."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions.timekeys import utc_literal
from gaugeworks.operators import series, state
from gaugeworks.streaming import keyed, samples

BASE = datetime(2024, 3, 1, tzinfo=timezone.utc)


def at(seconds):
    return BASE + timedelta(seconds=seconds)


def land(df, path, column="ts", files=4):
    """Write rows in time order as several files, so a stream reads them in that order."""
    rows = df.orderBy(column).collect()
    step = -(-len(rows) // files)
    for i in range(files):
        part = rows[i * step:(i + 1) * step]
        if part:
            df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{path}/f{i}")


def replay(spark, df, path, tmp_path, mode="append", build=lambda s: s):
    land(df, path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    name = f"out_{random.randrange(10**9)}"
    query = (build(stream).writeStream.format("memory").queryName(name).outputMode(mode)
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(240)
    return spark.table(name)


def sampled(spark, n=200, seed=1):
    rng = random.Random(seed)
    rows = sorted({(rng.randint(1, 3), rng.randint(0, 40_000)) for _ in range(n)}, key=lambda r: r[1])
    return spark.createDataFrame([(k, at(s)) for k, s in rows], "host long, ts timestamp")


@pytest.mark.parametrize("bucket", [500, 3600, 86_400])
def test_throttle_batch_is_greedy(spark, bucket):
    df = sampled(spark)
    got = {(r["host"], r["ts"]) for r in state.throttle(df, ["host"], 400, bucket_seconds=bucket).collect()}
    want = set()
    for host in (1, 2, 3):
        last = None
        for t in sorted(r["ts"] for r in df.collect() if r["host"] == host):
            if last is None or (t - last).total_seconds() >= 400:
                want.add((host, t))
                last = t
    assert got == want


@pytest.mark.parametrize("interval", [90, 700, 9000])
def test_throttle_never_collects_a_key(spark, monkeypatch, interval):
    """One key over many buckets, intervals below and above a bucket: only instants of one bucket are collected."""
    rng, collected = random.Random(7), []
    seconds = sorted(rng.sample(range(60_000), 1500))
    df = spark.createDataFrame([(1, at(s)) for s in seconds], "host long, ts timestamp")
    collect = F.collect_list
    monkeypatch.setattr(state.F, "collect_list", lambda c: collected.append(c) or collect(c))
    got = sorted(r["ts"] for r in state.throttle(df, ["host"], interval, bucket_seconds=600).collect())
    want = []
    for s in seconds:
        if not want or s - want[-1] >= interval:
            want.append(s)
    assert got == [r["ts"] for r in spark.createDataFrame([(at(s),) for s in want], "ts timestamp").collect()]
    assert collected == ["_us"]


def test_throttle_stream_equals_batch(spark, tmp_path):
    df = sampled(spark)
    out = replay(spark, df, str(tmp_path / "in"), tmp_path, build=lambda s: samples.throttle(s, "host", 400))
    batch = state.throttle(df, ["host"], 400)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def results(spark, n=150):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        status = rng.choice(["ok", "ok", "warning", "critical", "skipped"])
        codes = {"ok": [], "warning": ["W"], "critical": rng.choice([["A"], ["A", "B"]]), "skipped": []}[status]
        rows.append((rng.choice(["x", "y"]), at(i * 1000), status, codes, rng.random() < 0.7))
    return spark.createDataFrame(
        rows, "backup_id string, ts timestamp, status string, issue_codes array<string>, delivered boolean")


def test_alerts_stream_equals_batch(spark, tmp_path):
    df = results(spark)
    batch = state.alert_decisions(df, bucket_seconds=7000).select("backup_id", "ts", "severity", "decision")
    out = replay(spark, df, str(tmp_path / "in"), tmp_path, build=keyed.alert_decisions)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))
    assert {r["decision"] for r in batch.collect()} == {"alert", "recovery", "none"}


@pytest.mark.parametrize("n", [400, 100_000])
def test_any_number_of_rows_at_one_instant(spark, n):
    """Rows of few instants in the order of their number, against the streaming fold over that order."""
    rng = random.Random(n)
    kinds = [("ok", []), ("warning", ["W"]), ("critical", ["A"]), ("critical", ["A", "B"])]
    rows = [("x", at(600 if i > 40 else i % 3 * 300), i * 37 - 5000, *rng.choice(kinds), rng.random() < 0.6) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(
        rows, "backup_id string, ts timestamp, tie long, status string, issue_codes array<string>, delivered boolean")
    out = state.alert_decisions(df, tie="tie").select("ts", "tie", "decision").collect()
    severity = {"ok": "healthy"}
    ordered = sorted(rows, key=lambda r: r[1:3])
    _, want = keyed.alert_fold().run(None, (
        (i, severity.get(s, s), "|".join(codes) or "healthy", d) for i, (_, _, _, s, codes, d) in enumerate(ordered)))
    assert [r["decision"] for r in sorted(out, key=lambda r: (r["ts"], r["tie"]))] == [kind for _, _, kind in want]


def test_commands_of_one_instant_have_an_order(spark):
    rng = random.Random(2)
    rows = [("x", at(i // 50), i, rng.choice(["active", "paused", "odd", "active", "paused"])) for i in range(300)]
    df = spark.createDataFrame(rows, "search_id string, ts timestamp, tie long, target string")
    out = state.lifecycle(df, tie="tie").orderBy("ts", "tie").collect()
    _, want = keyed.lifecycle_fold().run(None, ((i, target) for i, (*_, target) in enumerate(rows)))
    assert [(r["target"], r["state_before"], r["accepted"]) for r in out] == [w[1:] for w in want]


def test_lifecycle_stream_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice("abcd"), at(i * 500), rng.choice(["active", "paused", "paused", "active", "ended", "odd"]))
            for i in range(60)]
    df = spark.createDataFrame(rows, "search_id string, ts timestamp, target string")
    batch = state.lifecycle(df, bucket_seconds=4000).select("search_id", "ts", "target", "state_before", "accepted")
    out = replay(spark, df, str(tmp_path / "in"), tmp_path, build=keyed.lifecycle)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_sessions_stream_equals_batch_for_closed_ones(spark, tmp_path):
    rng = random.Random(6)
    rows = [(1, at(s), "up", rng.choice(["COOLING", "COOLING", "OFF"])) for s in sorted(rng.sample(range(0, 60_000), 120))]
    df = spark.createDataFrame(rows, "site_id long, ts timestamp, zone string, action string")
    end = spark.createDataFrame([(9, at(500_000), "up", "COOLING"), (9, at(900_000), "up", "COOLING")], df.schema)
    out = replay(spark, df.unionByName(end), str(tmp_path / "in"), tmp_path, build=samples.cooling_sessions)
    columns = ["site_id", "zone", "session_start", "session_end", "sample_count"]
    batch = series.cooling_sessions(df).select(*columns)
    got = out.filter("site_id = 1").select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_host_windows_stream_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [("h", at(i * 120), rng.uniform(0, 100), rng.uniform(0, 4), rng.uniform(0, 90)) for i in range(120)]
    schema = "host string, ts timestamp, cpu_percent double, load_1 double, memory_used_percent double"
    df = spark.createDataFrame(rows, schema)
    end = spark.createDataFrame([("z", at(900_000), 0.0, 0.0, 0.0), ("z", at(999_000), 0.0, 0.0, 0.0)], schema)
    out = replay(spark, df.unionByName(end), str(tmp_path / "in"), tmp_path, build=samples.host_windows)
    batch = df.groupBy("host", F.window("ts", "1 hour", "5 minutes").alias("w")).agg(
        F.max("cpu_percent").alias("c"), (F.count_if(F.col("cpu_percent") > 90) * 1.0).alias("m"))
    got = {(r["window_start"], r["cpu_peak"], r["saturated_minutes"]) for r in out.filter("host = 'h'").collect()}
    assert got == {(r["w"]["start"], r["c"], r["m"]) for r in batch.collect()}


def test_pending_batches_expire(spark, tmp_path):
    rows = [
        ("a", at(0), "save", ["x", "y", "z"], None, None), ("a", at(60), "remove", None, [2], ["z"]),
        ("b", at(100), "save", ["q"], None, None), ("b", at(4000), "remove", None, [1], None),
        ("c", at(50), "save", ["m"], None, None), ("c", at(70), "clear", None, None, None),
        ("zz", at(100_000), "save", ["end"], None, None), ("zz", at(200_000), "save", ["end"], None, None),
    ]
    df = spark.createDataFrame(
        rows, "chat_key string, ts timestamp, action string, items array<string>, positions array<int>, names array<string>")
    out = replay(spark, df, str(tmp_path / "in"), tmp_path, build=keyed.pending_batches)
    events = [(r["chat_key"], r["event"], list(r["items"])) for r in out.filter("chat_key <> 'zz'").orderBy("chat_key", "ts").collect()]
    assert ("a", "saved", ["x"]) in events and ("c", "empty", []) in events
    assert ("b", "expired", ["q"]) in events and ("a", "expired", ["x"]) in events


def test_archive_stream_keeps_each_instant_once(spark, tmp_path):
    rows = [(1, at(s), f"v{s}") for s in (0, 60, 60, 120)] + [(1, at(60), "late")]
    df = spark.createDataFrame(rows, "site_id long, ts timestamp, v string")
    land(df, str(tmp_path / "in"))
    spark.sql("DROP TABLE IF EXISTS rolling_stream")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in") + "/*")
    write = samples.archive_batch(str(tmp_path / "archive"), "rolling_stream", utc_literal("2024-03-01 12:00:00"))
    query = (samples.deduplicated(stream).writeStream.foreachBatch(write)
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(240)
    archive = spark.read.parquet(str(tmp_path / "archive"))
    assert archive.count() == archive.select("site_id", "ts").distinct().count() == 3
    assert spark.table("rolling_stream").count() == 3


def test_late_intervals_are_merged_whenever_they_come(spark, tmp_path):
    schema = "site_id long, provider string, start_ts timestamp, end_ts timestamp, kwh double"
    days = [0, 86_400 * 5, 86_400 * 2, 0]
    for i, s in enumerate(days):
        spark.createDataFrame([(1, "m", at(s), at(s + 900), float(i))], schema).coalesce(1).write.parquet(
            str(tmp_path / "in" / f"f{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in") + "/*")
    query = (stream.writeStream.foreachBatch(samples.late_interval_batch(str(tmp_path / "table")))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(240)
    rows = spark.read.parquet(str(tmp_path / "table")).orderBy("start_ts").collect()
    assert len(rows) == 3 and rows[0]["kwh"] == 0.0
