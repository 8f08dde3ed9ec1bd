"""The archive by day: what is read, and what a batch that runs again does."""

import glob
import random
from datetime import date

import pytest
from pyspark.sql import functions as F
from test_sinks import BASE, frame

from gaugeworks.sinks import archive

KEYS = ["site_id", "ts"]


def stored(spark, path, schema, **days):
    return sorted(tuple(r) for r in archive.read_archive(spark, path, schema, KEYS, **days).select("site_id", "ts", "v").collect())


def test_insert_or_ignore_over_batches(spark, tmp_path):
    rng, path, held = random.Random(1), str(tmp_path / "a"), {}
    for number in range(4):
        rows = [(rng.randint(1, 3), rng.randint(0, 60), f"b{number}") for _ in range(40)]
        batch = frame(spark, rows)
        archive.append_days(batch, path, f"{number:04d}", KEYS, ["v"])
        for k, h, v in rows:
            held.setdefault((k, h), v)
    got = {(k, int((ts.timestamp() - BASE.timestamp()) // 3600)): v for k, ts, v in stored(spark, path, batch.schema)}
    assert got == held


def test_untouched_days_are_not_read(spark, tmp_path):
    path = str(tmp_path / "a")
    first = frame(spark, [(1, h, "x") for h in range(0, 96, 6)])
    archive.append_days(first, path, "0000", KEYS, ["v"])
    late = frame(spark, [(1, 30, "late"), (1, 31, "late")])
    assert [f.rsplit("/", 1)[1] for f in archive.touched_folders(
        spark, path, late.withColumn("day", F.to_date("ts")), KEYS)] == ["day=2024-03-02"]
    # Within a day, a folder whose keys lie elsewhere is left alone as well.
    other = frame(spark, [(7, 30, "x")]).withColumn("day", F.to_date("ts"))
    assert archive.touched_folders(spark, path, other, KEYS) == []
    # Files of other days could as well be broken.
    for day in ("01", "03", "04"):
        for name in glob.glob(f"{path}/batch=0000/day=2024-03-{day}/*"):
            open(name, "wb").write(b"no parquet")
    archive.append_days(late, path, "0001", KEYS, ["v"])
    only = {"first_day": date(2024, 3, 2), "last_day": date(2024, 3, 2)}
    assert [v for _, _, v in stored(spark, path, first.schema, **only)].count("late") == 1
    with pytest.raises(Exception, match="(?i)parquet"):
        stored(spark, path, first.schema)


def test_a_batch_that_runs_again_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "a")
    batch = frame(spark, [(1, 0, "a"), (1, 0, "b"), (2, 30, "c")])
    archive.append_days(batch, path, "0000", KEYS, ["v"])
    files = sorted(glob.glob(f"{path}/**", recursive=True))
    archive.append_days(batch.withColumn("v", F.lit("again")), path, "0000", KEYS, ["v"])
    assert sorted(glob.glob(f"{path}/**", recursive=True)) == files
    assert [v for *_, v in stored(spark, path, batch.schema)] == ["a", "c"]


def test_a_batch_that_broke_off_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a")
    batch = frame(spark, [(1, 0, "a"), (2, 30, "c")])
    good = archive.zones
    calls = []

    def broken(rows, keys):
        calls.append(1)
        if len(calls) == 2:  # the first call asks for the touched days, the second is after the data
            raise RuntimeError("lost")
        return good(rows, keys)

    monkeypatch.setattr(archive, "zones", broken)
    with pytest.raises(RuntimeError):
        archive.append_days(batch, path, "0000", KEYS, ["v"])
    assert glob.glob(f"{path}/batch=0000/day=*") and stored(spark, path, batch.schema) == []
    monkeypatch.undo()
    archive.append_days(batch, path, "0000", KEYS, ["v"])
    assert [v for *_, v in stored(spark, path, batch.schema)] == ["a", "c"]


def test_empty_batches_and_rows_without_an_instant(spark, tmp_path):
    path = str(tmp_path / "a")
    batch = frame(spark, [(1, 0, "a")])
    archive.append_days(batch.limit(0), path, "0000", KEYS, ["v"])
    assert stored(spark, path, batch.schema) == []
    blank = batch.withColumn("ts", F.lit(None).cast("timestamp"))
    for number in (1, 1, 2):
        archive.append_days(batch.union(blank), path, f"000{number}", KEYS, ["v"])
    rows = archive.read_archive(spark, path, batch.schema, KEYS).collect()
    # No stored key equals one with a null, so each batch adds its own.
    assert sorted(r["ts"] is None for r in rows) == [False, True, True]


def test_rolling_table_leaves_the_session_alone(spark):
    from gaugeworks.functions.timekeys import utc_literal
    from gaugeworks.sinks import tables as sinks

    name, setting = "rolling_days", "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    now = utc_literal("2024-03-04 00:00:00")
    sinks.rewrite_rolling(frame(spark, [(1, h, "x") for h in range(0, 72, 6)]), name, now, days=10)
    sinks.rewrite_rolling(frame(spark, [(1, 1, "new"), (1, 0, "again"), (1, -1000, "old")]), name, now, days=10)
    assert spark.conf.get(setting) == before
    assert spark.table(name).count() == 13 and spark.table(name).filter("v = 'new'").count() == 1
    assert spark.table(name).select("day").distinct().count() == 3
