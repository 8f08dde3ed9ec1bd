"""Keyed writes on temporary tables."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from gaugeworks.functions.timekeys import utc_literal
from gaugeworks.sinks import tables as sinks

BASE = datetime(2024, 3, 1, tzinfo=timezone.utc)


def frame(spark, rows):
    return spark.createDataFrame(
        [(k, BASE + timedelta(hours=h), v) for k, h, v in rows], "site_id long, ts timestamp, v string")


def test_append_new_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = frame(spark, [(1, 0, "a"), (1, 0, "b"), (2, 0, "c")])
    for _ in range(3):
        sinks.append_new(batch, path, ["site_id", "ts"], ["v"])
    rows = sorted(r["v"] for r in spark.read.parquet(path).collect())
    assert rows == ["a", "c"]


def test_insert_counts(spark):
    stored = frame(spark, [(1, 0, "a")])
    incoming = frame(spark, [(1, 0, "x"), (2, 0, "y"), (2, 0, "z"), (3, 0, "w")])
    row = sinks.insert_counts(stored, incoming, ["site_id", "ts"]).collect()[0]
    assert (row["inserted"], row["skipped"]) == (2, 2)


def test_empty_links_never_collide(spark):
    stored = spark.createDataFrame([("b",)], "link string")
    rows = spark.createDataFrame([("", 1), (None, 2), ("a", 3), ("a", 4), ("b", 5)], "link string, n int")
    out = {r["link"]: (r["n"], r["is_new"]) for r in sinks.flag_new(stored, rows, "link", ["n"]).collect()}
    assert out == {"a": (3, True), "b": (5, False)}


def test_upsert_keeps_first_seen(spark):
    old = spark.createDataFrame([("k", "old", BASE, BASE)], "id string, title string, first_seen timestamp, last_seen timestamp")
    new = spark.createDataFrame([("k", "new", BASE + timedelta(days=1)), ("n", "fresh", BASE)], "id string, title string, seen_at timestamp")
    out = {r["id"]: r for r in sinks.upsert_seen(old, new, ["id"]).collect()}
    assert out["k"]["title"] == "new" and out["k"]["first_seen"] < out["k"]["last_seen"]
    assert out["n"]["first_seen"] == out["n"]["last_seen"]


def test_seed_import_modes(spark):
    stored = spark.createDataFrame([("a", 1, "mine")], "k string, ver int, v string")
    seed = spark.createDataFrame([("a", 9, "seed"), ("b", 1, "seed")], "k string, ver int, v string")
    keep = {r["k"]: r["v"] for r in sinks.upsert_latest(stored, seed, ["k"], "ver", overwrite=False).collect()}
    replace = {r["k"]: r["v"] for r in sinks.upsert_latest(stored, seed, ["k"], "ver").collect()}
    assert keep == {"a": "mine", "b": "seed"} and replace == {"a": "seed", "b": "seed"}


def test_bootstrap_only_when_empty(spark):
    rolling = frame(spark, [(1, 0, "a"), (1, 1, "b")])
    empty = rolling.limit(0)
    assert sinks.bootstrap_rows(empty, rolling).count() == 2
    assert sinks.bootstrap_rows(rolling, rolling).count() == 0


def test_rolling_table_drops_expired_days(spark):
    name = "rolling_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    sinks.rewrite_rolling(frame(spark, [(1, 0, "a"), (1, 0, "dup"), (1, 30, "b")]), name,
                          utc_literal("2024-03-02 12:00:00"), days=2)
    assert spark.table(name).count() == 2
    sinks.rewrite_rolling(frame(spark, [(1, 30, "again"), (1, 80, "c")]), name,
                          utc_literal("2024-03-04 12:00:00"), days=2)
    rows = sorted(r["v"] for r in spark.table(name).collect())
    assert rows == ["c"] or rows == ["b", "c"]
    cutoff = spark.table(name).filter(F.col("day") < "2024-03-02")
    assert cutoff.count() == 0


def test_publish_may_replace_what_it_reads(spark):
    name = "publish_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    frame(spark, [(1, 0, "a"), (2, 0, "b")]).write.saveAsTable(name)
    sinks.publish(spark.table(name).filter("site_id = 2"), name)
    assert [r["v"] for r in spark.table(name).collect()] == ["b"]


def test_cascade_and_report(spark):
    parents = spark.createDataFrame([(1, "ended"), (2, "active")], "watch_id long, status string")
    children = spark.createDataFrame([(1, "x"), (2, "y")], "watch_id long, k string")
    kept, rows = sinks.cascade_delete(parents, children, sinks.ended_report(parents), "watch_id")
    assert [r["watch_id"] for r in kept.collect()] == [2] and [r["k"] for r in rows.collect()] == ["y"]


def test_cycles_compose(spark):
    from gaugeworks.plans import cycles, match_queries, text_queries

    sf = "/root/testdata/sf0.001"
    rows = text_queries.listings(spark, sf).select("source", "title", "price", "link")
    out = cycles.listing_cycle(rows, match_queries.searches(spark, sf), rows.select("link").limit(0))
    assert {"new_listings", "counters", "invalid"} == set(out)
    assert out["counters"].count() > 0
    ledger = spark.createDataFrame([], "watch_id long, event_dedupe_key string")
    shows = match_queries._shows(spark, sf)
    stored = shows.limit(0).withColumns({"first_seen": F.lit(None).cast("timestamp"), "last_seen": F.lit(None).cast("timestamp")})
    run = cycles.watch_cycle(match_queries._watches(spark, sf), shows, stored, ledger, F.lit("2024-02-01").cast("date"))
    alerts = run["alerts"]
    assert alerts.count() == run["summary"].agg(F.sum("alerts_due")).first()[0]
    told = sinks.ledger_rows(ledger, alerts)
    again = cycles.watch_cycle(match_queries._watches(spark, sf), shows, stored, told, F.lit("2024-02-01").cast("date"))
    assert again["alerts"].count() == 0


def _alert_tables(spark):
    from gaugeworks.operators import shows

    rows = [("ticketmaster", f"t{i}", "Red Ring", "Hall", "Houston", "TX", "2024-02-1" + str(i % 2), f"u{i}", "Rock") for i in range(4)]
    rows += [("ticketmaster", "t9", "Bolt", "Hall", "Tyler", "TX", "2024-02-12", "u9", "Pop")]
    frame = shows.normalise(spark.createDataFrame(rows, "source string, provider_event_id string, artist_or_title string, venue string, "
                                                  "city string, state string, starts_at string, ticket_url string, genre_or_classification string"))
    watches = [(i, "red", None, "nationwide", None, True) for i in range(30)]
    watches += [(40, "red", None, "houston", None, True), (40, "red", None, "nationwide", None, True), (40, "bolt", None, "nationwide", None, True),
                (None, "red", None, "nationwide", None, True), (50, None, "rock", None, "Houston", True), (60, "red", None, "houston", None, False)]
    kinds = "watch_id long, artist string, genre string, area string, city string, active boolean"
    return frame, spark.createDataFrame(watches, kinds).selectExpr(
        "*", "CAST(NULL AS STRING) AS state", "CAST(NULL AS INT) AS radius_miles", "60 AS days_forward")


def test_watches_of_equal_criteria_meet_shows_once(spark, monkeypatch):
    from gaugeworks.operators import shows

    frame, watches = _alert_tables(spark)
    merged, real = [], shows.merge
    monkeypatch.setattr(shows, "CHUNK", 7, raising=False)
    monkeypatch.setattr(shows, "merge", lambda df, *a, **k: real(merged.append(df) or df, *a, **k))
    today = F.lit("2024-02-01").cast("date")
    none = spark.createDataFrame([], "watch_id long, event_dedupe_key string")
    out = shows.watch_alerts(watches, frame, none, today).cache()
    got = sorted((-1 if r.watch_id is None else r.watch_id, r.starts_at, r.artist_or_title, r.member_count) for r in out.collect())
    ids = [-1, *range(30), 40, 50]
    want = [(i, day, "Red Ring", 2) for i in ids for day in ("2024-02-10", "2024-02-11")] + [(40, "2024-02-12", "Bolt", 1)]
    assert got == sorted(want)
    assert merged[0].count() == 4 + 5 + 4  # of three sets of criteria, not of 33 watches
    told = out.filter("watch_id % 2 = 0 OR watch_id IS NULL").select("watch_id", "event_dedupe_key")
    left = [-1 if r.watch_id is None else r.watch_id for r in shows.watch_alerts(watches, frame, told, today).collect()]
    assert sorted(left) == sorted(2 * [-1, *range(1, 30, 2)])
    pairs = shows.watch_candidates(watches, frame, today)
    assert pairs.count() == 4 * 31 + 5 + 4


def test_alerts_of_a_watch_reach_the_ledger_without_a_shuffle(spark, monkeypatch):
    from gaugeworks.operators import shows

    frame, watches = _alert_tables(spark)
    today = F.lit("2024-02-01").cast("date")
    told = spark.createDataFrame([(1, "none such"), (2, None), (None, None)], "watch_id long, event_dedupe_key string")
    due = shows.watch_alerts(watches, frame, told, today)
    ledger = due.filter("starts_at < '2024-02-11'").select("watch_id", "event_dedupe_key")
    added = sinks.ledger_rows(ledger, due)
    plan = added._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(watch_id" in x and "event_dedupe_key" in x]
    later = shows.watch_alerts(watches, frame, due.filter("watch_id < 9").select("watch_id", "event_dedupe_key"), today)
    monkeypatch.setattr(shows, "FEW_SHOWS", 0)
    many = shows.watch_alerts(watches, frame, told, today)
    assert sorted(map(str, due.collect())) == sorted(map(str, many.collect())) and due.columns == many.columns
    want = [(r.watch_id or -1, r.event_dedupe_key) for r in many.collect() if r.watch_id is None or r.starts_at >= "2024-02-11"]
    assert sorted((r[0] or -1, r[1]) for r in added.collect()) == sorted(want)
    rest = [str(r) for r in many.collect() if r.watch_id is None or r.watch_id >= 9]
    assert sorted(map(str, later.collect())) == sorted(rest)


def test_ledger_is_reduced_in_one_shuffle(spark):
    ledger = spark.createDataFrame([(1, "a"), (1, "a"), (None, "c")], "watch_id long, event_dedupe_key string")
    alerts = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, ""), (2, None), (None, "c"), (None, "c")],
                                   "watch_id long, event_dedupe_key string")
    out = sinks.ledger_rows(ledger, alerts)
    assert sorted((r[0] or 0, r[1]) for r in out.collect()) == [(0, "c"), (1, "b"), (2, "a")]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
