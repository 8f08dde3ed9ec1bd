"""Edge rules of integration, sessions, coverage and joins on a few inline rows."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import timekeys as tk
from gaugeworks.operators import energy, joins, series
from gaugeworks.operators.ordered import carry_last, gap_sessions

BASE = datetime(2024, 3, 1, 12, tzinfo=timezone.utc)


def at(seconds):
    return BASE + timedelta(seconds=seconds)


def power(spark, rows):
    return spark.createDataFrame(
        [(1, at(s), c, w) for s, c, w in rows], "site_id long, ts timestamp, channel string, power_w double")


def energy_of(spark, rows, end=3600, channels=None, **options):
    totals = series.channel_totals(power(spark, rows), ["site_id"], channels=channels)
    totals = totals.withColumn("window_start", F.lit(at(0))).withColumn("window_end", F.lit(at(end)))
    out = series.integrate_power(totals, ["site_id"], digits=9, **options).collect()
    return out[0]["kwh"] if out else 0.0


def test_gap_of_exactly_the_limit_counts(spark):
    got = energy_of(spark, [(0, "a", 1000.0), (300, "a", 500.0)])
    assert got == pytest.approx((1000 * 300 + 500 * 120) / 3.6e6)


def test_longer_gap_counts_nothing(spark):
    got = energy_of(spark, [(0, "a", 1000.0), (301, "a", 500.0)])
    assert got == pytest.approx(500 * 120 / 3.6e6)


def test_tail_stops_at_the_window_end(spark):
    assert energy_of(spark, [(3570, "a", 1000.0)]) == pytest.approx(1000 * 30 / 3.6e6)


def test_null_readings_do_not_break_a_step(spark):
    got = energy_of(spark, [(0, "a", 100.0), (60, "a", None), (120, "a", 100.0)])
    assert got == pytest.approx(100 * 240 / 3.6e6)


def test_channel_choice_changes_the_next_row(spark):
    rows = [(0, "a", 100.0), (60, "b", 50.0), (120, "a", 100.0)]
    assert energy_of(spark, rows, channels=["a"]) == pytest.approx(100 * 240 / 3.6e6)
    assert energy_of(spark, rows) == pytest.approx((100 * 60 + 50 * 60 + 100 * 120) / 3.6e6)


def test_rows_outside_the_window_are_ignored(spark):
    assert energy_of(spark, [(-10, "a", 9e9), (3600, "a", 9e9)]) == 0.0


def test_integration_is_the_same_for_any_bucket_width(spark):
    rng = random.Random(3)
    rows = [(s, "a", float(rng.randint(1, 900))) for s in sorted(rng.sample(range(0, 3600), 60))]
    whole = energy_of(spark, rows, bucket_seconds=86_400)
    assert energy_of(spark, rows, bucket_seconds=300) == pytest.approx(whole)
    expected = 0.0
    for i, (s, _, w) in enumerate(rows):
        step = (rows[i + 1][0] if i + 1 < len(rows) else min(3600, s + 120)) - s
        expected += w * step / 3.6e6 if step <= 300 else 0
    assert whole == pytest.approx(expected)


def sessions(spark, seconds, gap, bucket):
    df = spark.createDataFrame([(1, at(s)) for s in seconds], "k long, ts timestamp")
    rows = gap_sessions(df, ["k"], "ts", gap, bucket_seconds=bucket).collect()
    return sorted((int((r["session_start"].replace(tzinfo=timezone.utc) - BASE).total_seconds()),
                   int((r["session_end"].replace(tzinfo=timezone.utc) - BASE).total_seconds()),
                   r["sample_count"]) for r in rows)


def test_sessions_join_at_the_exact_gap(spark):
    assert sessions(spark, [0, 900, 1801], 900, 86_400) == [(0, 900, 2), (1801, 1801, 1)]


@pytest.mark.parametrize("bucket", [120, 600, 86_400])
def test_sessions_cross_buckets(spark, bucket):
    rng = random.Random(bucket)
    stamps = sorted(rng.sample(range(0, 20_000), 150))
    want, start, last, n = [], stamps[0], stamps[0], 1
    for s in stamps[1:]:
        if s - last <= 100:
            last, n = s, n + 1
        else:
            want.append((start, last, n))
            start, last, n = s, s, 1
    want.append((start, last, n))
    assert sessions(spark, stamps, 100, bucket) == want


@pytest.mark.parametrize("backwards", [False, True])
def test_carry_last_equals_a_plain_scan(spark, backwards):
    rng = random.Random(5)
    rows = [(k, at(i * 37), rng.choice([None, None, f"v{i}"])) for k in (1, 2) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, ts timestamp, v string")
    out = carry_last(df, ["k"], ["ts"], F.col("v"), "p", backwards=backwards, bucket_seconds=300)
    got = {(r["k"], r["ts"].replace(tzinfo=timezone.utc)): r["p"] for r in out.collect()}
    for key in (1, 2):
        last = None
        mine = [r for r in rows if r[0] == key]
        for _, t, v in (reversed(mine) if backwards else mine):
            assert got[(key, t)] == last
            last = v if v is not None else last


def test_cooling_rows_of_other_actions_do_not_split(spark):
    z = spark.createDataFrame(
        [(1, at(0), "up", "COOLING"), (1, at(300), "up", "OFF"), (1, at(600), "up", "COOLING")],
        "site_id long, ts timestamp, zone string, action string")
    assert series.cooling_sessions(z).count() == 1


def test_coverage_counts_zero_watts_but_not_null(spark):
    rows = power(spark, [(i * 60, "a", 0.0 if i % 2 else None) for i in range(100)])
    out = series.sample_coverage(rows).collect()[0]
    assert out["reading_count"] == 50 and out["coverage_pct"] == round(100 * 50 / 1440, 1)


def day_of_samples(spark, skip=()):
    start = datetime(2024, 3, 1, 6, tzinfo=timezone.utc)  # local midnight in Chicago
    rows = [(1, start + timedelta(minutes=m), "a", 5.0) for m in range(1440) if m not in skip]
    return spark.createDataFrame(rows, "site_id long, ts timestamp, channel string, power_w double")


def failures(spark, skip):
    out = series.channel_quality(day_of_samples(spark, skip), channels=["a", "b"]).collect()
    return {r["channel"]: r["failures"] for r in out}


def test_clean_day_and_silent_channel(spark):
    got = failures(spark, ())
    assert got["a"] == []
    assert got["b"] == ["b: 0.0% coverage (need ≥ 95%)", "b: no samples in window"]


def test_inner_gap_and_edges(spark):
    assert failures(spark, range(700, 705))["a"] == ["a: internal gap of 6 min (max 5 min)"]
    assert failures(spark, range(700, 704))["a"] == []
    assert failures(spark, range(0, 16))["a"] == [
        "a: first sample 16 min after window start (need ≤ 15 min)"]
    assert failures(spark, range(1425, 1440))["a"] == [
        "a: last sample 16 min before window end (need ≤ 15 min)"]


def test_coverage_threshold_is_inclusive(spark):
    every = {m for m in range(1440) if m % 20 == 10}  # 95 percent left
    assert failures(spark, every)["a"] == []
    more = every | {m for m in range(1440) if m % 20 == 15}
    assert failures(spark, more)["a"][0] == "a: 90.0% coverage (need ≥ 95%)"


def test_daylight_saving_days_keep_their_length(spark):
    df = spark.sql("SELECT explode(array(date'2024-03-10', date'2024-11-03', date'2024-07-01')) AS d")
    hours = [r[0] for r in df.select(
        ((F.unix_seconds(tk.day_end("d")) - F.unix_seconds(tk.day_start("d"))) / 3600)).collect()]
    assert hours == [23.0, 25.0, 24.0]


def test_missing_intervals_ignores_off_grid_rows(spark):
    rows = [(1, at(m * 60), at(m * 60 + 900), 1.0) for m in (0, 15, 45, 52, 60)]
    df = spark.createDataFrame(rows, "site_id long, start_ts timestamp, end_ts timestamp, kwh double")
    out = series.missing_intervals(df).collect()[0]
    assert (out["expected_count"], out["missing_count"]) == (5, 1)


def test_counter_rate_null_unless_total_grew(spark):
    rows = [("h", at(0), 100, 50), ("h", at(60), 200, 75), ("h", at(120), 200, 75), ("h", at(180), 50, 10)]
    df = spark.createDataFrame(rows, "host string, ts timestamp, cpu_total_jiffies long, cpu_idle_jiffies long")
    got = [r["busy_percent"] for r in series.counter_rates(df).orderBy("ts").collect()]
    assert got == [None, 75.0, None, None]


# ---- joins ---------------------------------------------------------------------------

def asof(spark, sample_seconds, start=0, end=900, slack=600):
    left = spark.createDataFrame([(1, at(start), at(end))], "site_id long, start_ts timestamp, end_ts timestamp")
    right = spark.createDataFrame([(1, at(s), s) for s in sample_seconds], "site_id long, ts timestamp, s int")
    out = joins.asof_within_interval(left, right, payload=F.col("s"), slack_seconds=slack, bucket_seconds=600)
    return out.collect()[0]["matched"]


def test_asof_edges(spark):
    assert asof(spark, [0]) == 0              # at the start: inside
    assert asof(spark, [900]) is None         # at the end: outside
    assert asof(spark, [-1]) is None          # before an interval longer than the slack
    assert asof(spark, [-300], end=300) == -300   # exactly the slack before the end
    assert asof(spark, [-301], end=300) is None
    assert asof(spark, [10, 20, 899]) == 899


def test_nearest_is_strict_and_ties_go_back(spark):
    left = spark.createDataFrame([(1, at(1000), "x"), (1, at(5000), "y"), (1, at(9000), "z")],
                                 "site_id long, ts timestamp, n string")
    right = spark.createDataFrame([(1, at(s), s) for s in (900, 1100, 5600, 9599)],
                                  "site_id long, ts timestamp, s int")
    out = joins.nearest(left, right, ["site_id"], payload=F.col("s"), tolerance_seconds=600,
                        bucket_seconds=700)
    assert {r["n"]: r["matched"] for r in out.collect()} == {"x": 900, "y": None, "z": 9599}


def test_nearest_against_brute_force(spark):
    rng = random.Random(11)
    lefts = [(rng.randint(1, 3), rng.randint(0, 5000), i) for i in range(80)]
    rights = sorted({(rng.randint(1, 3), rng.randint(0, 5000)) for _ in range(120)})
    left = spark.createDataFrame([(k, at(s), i) for k, s, i in lefts], "k long, ts timestamp, i int")
    right = spark.createDataFrame([(k, at(s), s) for k, s in rights], "k long, ts timestamp, s int")
    out = joins.nearest(left, right, ["k"], payload=F.col("s"), tolerance_seconds=90, bucket_seconds=100)
    got = {r["i"]: r["matched"] for r in out.collect()}
    for k, s, i in lefts:
        near = [(abs(r - s), r) for kk, r in rights if kk == k and abs(r - s) < 90]
        assert got[i] == (min(near)[1] if near else None)


def test_range_join_bounds(spark):
    points = spark.createDataFrame([(1, at(s), s) for s in (0, 50, 100, 101)], "k long, ts timestamp, s int")
    ranges = spark.createDataFrame([(1, at(0), at(100))], "k long, start_ts timestamp, end_ts timestamp")
    half = joins.range_join(points, ranges, ["k"], cell_seconds=30)
    closed = joins.range_join(points, ranges, ["k"], closed=True, cell_seconds=30)
    assert sorted(r["s"] for r in half.collect()) == [0, 50]
    assert sorted(r["s"] for r in closed.collect()) == [0, 50, 100]


@pytest.mark.parametrize(("closed", "bucket"), [(True, 70), (False, 5000)])
def test_sweep_join_equals_range_join(spark, closed, bucket):
    """Ranges from a moment to many buckets; two lanes whose ranges overlap each other."""
    rng = random.Random(bucket)
    ranges = []
    for lane in "ab":
        at_s = 0
        while at_s < 6000:
            length = rng.choice([0, 1, 30, 900])
            ranges.append((1, lane, at(at_s), at(at_s + length)))
            at_s += length + rng.randint(1, 200)
    ranges.append((2, "a", at(0), at(10)))
    r = spark.createDataFrame(ranges, "k long, lane string, start_ts timestamp, end_ts timestamp")
    p = spark.createDataFrame([(rng.randint(1, 3), at(rng.randint(0, 6500)), i) for i in range(300)] + [(1, at(7), 999)] * 3,
                              "k long, ts timestamp, i int")
    columns = ["k", "ts", "i", "lane", "start_ts"]
    want = joins.range_join(p, r, ["k"], closed=closed, cell_seconds=300).select(*columns).collect()
    got = joins.sweep_join(p, r, ["k"], lanes=["lane"], closed=closed, bucket_seconds=bucket).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
    # Rows do not multiply with the length of a range.
    plan = joins.sweep_join(p, r, ["k"], lanes=["lane"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_nearest_sorts_once(spark):
    left = spark.createDataFrame([(1, at(5))], "k long, ts timestamp")
    plan = joins.nearest(left, left, ["k"], payload=F.col("ts"))._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" +-:*").startswith("Window") for line in plan.splitlines()) == 1


def test_contains_pairs_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    hay = [(i, word(rng.randint(0, 12))) for i in range(60)]
    needles = [(i, word(rng.randint(1, 5))) for i in range(40)]
    h = spark.createDataFrame(hay, "hid int, text string")
    n = spark.createDataFrame(needles, "nid int, needle string")
    out = joins.contains_pairs(h, n, hay_text="text", needle_text="needle")
    got = sorted((r["hid"], r["nid"]) for r in out.collect())
    assert got == sorted((a, b) for a, t in hay for b, w in needles if w in t)


def test_contains_pairs_same_result_without_broadcast(spark):
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    h = spark.createDataFrame([(1, "red ring"), (2, "pineapple")], "hid int, text string")
    n = spark.createDataFrame([(1, "apple"), (2, "ri"), (3, "g")], "nid int, needle string")
    try:
        spark.conf.set(setting, "-1")
        out = joins.contains_pairs(h, n, hay_text="text", needle_text="needle")
        assert sorted((r["hid"], r["nid"]) for r in out.collect()) == [(1, 2), (1, 3), (2, 1)]
    finally:
        spark.conf.set(setting, before)


@pytest.mark.parametrize("few", [10_000, 0])
def test_contains_pairs_never_broadcasts_pieces(spark, monkeypatch, tmp_path, few):
    def stored(df, name):  # files have a size that joins are planned by
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    monkeypatch.setattr(joins, "FEW_NEEDLES", few, raising=False)
    h = spark.createDataFrame([(1, "red ring"), (2, "pineapple"), (2, "pineapple")], "hid int, text string")
    n = spark.createDataFrame([(1, "apple"), (2, "ri"), (3, "g"), *((9, f"none{i}") for i in range(2000))], "nid int, needle string")
    h, n = stored(h, "hay"), stored(n, "needles")
    out = joins.contains_pairs(h, n, hay_text="text", needle_text="needle")
    assert sorted((r["hid"], r["nid"]) for r in out.collect()) == [(1, 2), (1, 3), (2, 1), (2, 1)]
    lines = out._jdf.queryExecution().sparkPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" +-:*")) for line in lines]
    for i, line in enumerate(lines):
        if "BroadcastHashJoin" in line:
            children = [j for j in range(i + 1, len(lines)) if depth[j] == depth[i] + 3]
            built = children[0] if "BuildLeft" in line else children[1]
            end = next((j for j in range(built + 1, len(lines)) if depth[j] <= depth[built]), len(lines))
            assert not any("Generate" in x for x in lines[built:end])


# ---- energy --------------------------------------------------------------------------

def test_peaks_fall_back_to_intervals(spark):
    samples = power(spark, []).filter("false")
    intervals = spark.createDataFrame(
        [(1, "m", at(i * 900), at(i * 900 + 900), float(i)) for i in range(8)],
        "site_id long, provider string, start_ts timestamp, end_ts timestamp, kwh double")
    zones = spark.createDataFrame([], "site_id long, ts timestamp, zone string, action string")
    out = energy.demand_peaks(samples, intervals, zones, hvac_channels=["a"]).orderBy("rank").collect()
    assert [r["total_kw"] for r in out] == [28.0, 24.0, 20.0, 16.0, 12.0]
    assert {r["classification"] for r in out} == {"Unknown — no Tuya data"}


def test_peak_class_and_remainder(spark):
    samples = power(spark, [(0, "a", 3000.0), (0, "b", 1000.0), (60, "a", 100.0)])
    intervals = spark.createDataFrame(
        [(1, "m", at(-300), at(600), 1.5)],
        "site_id long, provider string, start_ts timestamp, end_ts timestamp, kwh double")
    zones = spark.createDataFrame([(1, at(120), "up", "COOLING"), (1, at(120), "down", "OFF")],
                                  "site_id long, ts timestamp, zone string, action string")
    row = energy.demand_peaks(samples, intervals, zones, hvac_channels=["a"]).collect()[0]
    assert (row["total_kw"], row["hvac_kw"], row["meter_kw"], row["remainder_kw"]) == (4.0, 3.0, 6.0, 2.0)
    assert (row["action"], row["classification"]) == ("COOLING", "HVAC only")
    true_share = energy.demand_peaks(samples, intervals, zones, hvac_channels=["a"], strict_reference=False)
    assert true_share.collect()[0]["classification"] == "HVAC + other significant load"


def test_shares_need_a_fully_valid_day(spark):
    start = datetime(2024, 3, 1, 6, tzinfo=timezone.utc)
    rows = [(1, start + timedelta(minutes=m), c, 1000.0) for m in range(1440) for c in ("a", "b")]
    samples = spark.createDataFrame(rows, "site_id long, ts timestamp, channel string, power_w double")
    intervals = spark.createDataFrame(
        [(1, "m", start + timedelta(minutes=15 * i), start + timedelta(minutes=15 * i + 15), 1.0) for i in range(96)],
        "site_id long, provider string, start_ts timestamp, end_ts timestamp, kwh double")
    now = tk.utc_literal("2024-03-03 12:00:00")
    slices, diag = energy.valid_day_shares(intervals, samples, now, channels=["a", "b"])
    got = {r["channel"]: (r["kwh"], r["pct"]) for r in slices.collect()}
    assert got["a"][0] == pytest.approx(24.0, abs=0.05) and got["unmonitored"][0] == pytest.approx(48.0, abs=0.1)
    assert diag.collect()[0]["available"]
    missing = samples.filter("NOT (channel = 'b' AND minute(ts) < 6 AND hour(ts) = 15)")
    slices, diag = energy.valid_day_shares(intervals, missing, now, channels=["a", "b"])
    row = diag.collect()[0]
    assert slices.count() == 0 and not row["available"]
    assert row["latest_failures"][0].startswith("SMT: 0.0% coverage")


def test_trend_days_without_data_are_null(spark):
    intervals = spark.createDataFrame(
        [(1, "m", at(0), at(900), 1.0)],
        "site_id long, provider string, start_ts timestamp, end_ts timestamp, kwh double")
    samples = power(spark, [(0, "a", 1.0)])
    zones = spark.createDataFrame([(1, at(0), "up", None)], "site_id long, ts timestamp, zone string, action string")
    out = energy.daily_trends(intervals, samples, zones, tk.utc_literal("2024-03-01 20:00:00"),
                              hvac_channels=["a"], days=3).orderBy("day").collect()
    assert [r["meter_kwh"] for r in out] == [None, None, 1.0]
    assert [r["cooling_minutes"] for r in out] == [None, None, 0.0]
    assert [r["sampled_kwh"] for r in out] == [None, None, None]


def test_clean_says_whether_there_are_failures(spark):
    samples = day_of_samples(spark).unionByName(
        day_of_samples(spark, range(700, 705)).withColumn("channel", F.lit("b"))).unionByName(
        day_of_samples(spark, range(0, 1440, 2)).withColumn("site_id", F.lit(2).cast("long")))
    out = series.channel_quality(samples, channels=["a", "b"], clean=True).collect()
    assert {(r["site_id"], r["channel"]): r["clean"] for r in out} == {
        (1, "a"): True, (1, "b"): False, (2, "a"): False, (2, "b"): False}
    assert all(r["clean"] == (r["failures"] == []) for r in out)


def test_shares_judge_and_integrate_each_day_once(spark):
    start = datetime(2024, 3, 1, 6, tzinfo=timezone.utc)
    samples = day_of_samples(spark).unionByName(day_of_samples(spark).withColumn("channel", F.lit("b")))
    intervals = spark.createDataFrame(
        [(s, "m", start + timedelta(minutes=15 * i), start + timedelta(minutes=15 * i + 15), 1.0)
         for s in (1, 2) for i in range(96)],
        "site_id long, provider string, start_ts timestamp, end_ts timestamp, kwh double")
    slices, diag = energy.valid_day_shares(
        intervals, samples, tk.utc_literal("2024-03-03 12:00:00"), channels=["a", "b"], look_back=3)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (slices, diag)]
    assert "Window" not in plans[0]
    assert not any("_halo" in p or "lead(" in p or "_bucket" in p for p in plans)
    assert {(r["site_id"], r["channel"]) for r in slices.collect()} == {(1, "a"), (1, "b"), (1, "unmonitored")}
    silent = ["SMT: 0.0% coverage (need ≥ 90%)", "a: 0.0% coverage (need ≥ 95%)", "a: no samples in window",
              "b: 0.0% coverage (need ≥ 95%)", "b: no samples in window"]
    got = {r["site_id"]: r for r in diag.collect()}
    assert [got[s]["available"] for s in (1, 2)] == [True, False]
    assert [got[s]["latest_failures"] for s in (1, 2)] == [silent, silent]
    assert got[2]["best_meter_day"].isoformat() == "2024-03-01" and got[2]["best_channel_day"] is None


def test_full_analysis_composes(spark):
    from gaugeworks.plans.analysis import analyse

    samples = day_of_samples(spark).unionByName(day_of_samples(spark).withColumn("channel", F.lit("b")))
    start = datetime(2024, 3, 1, 6, tzinfo=timezone.utc)
    intervals = spark.createDataFrame(
        [(1, "m", start + timedelta(minutes=15 * i), start + timedelta(minutes=15 * i + 15), 0.5) for i in range(96)],
        "site_id long, provider string, start_ts timestamp, end_ts timestamp, kwh double")
    zones = spark.createDataFrame(
        [(1, start + timedelta(minutes=5 * i), "downstairs", "COOLING" if i < 30 else "OFF") for i in range(280)],
        "site_id long, ts timestamp, zone string, action string")
    out = analyse(intervals, samples, zones, tk.utc_literal("2024-03-02 05:00:00"), channels=["a", "b"],
                  hvac_channels=["a"], compressor="a")
    assert out["window"].collect()[0]["basis"] == "today"
    assert out["hvac_stats"].collect()[0]["cycle_count"] == 1
    assert "Cooling ran for 2 hr 25 min across 1 cycle." in out["findings"].collect()[0]["findings"]
    for name in ("agreement", "breakdown", "peaks", "timeline", "trends", "quality", "diagnostics"):
        assert out[name].count() > 0, name
