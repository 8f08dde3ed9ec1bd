"""Expressions and rules on small tables of cases."""

import pytest
from pyspark.sql import functions as F

from gaugeworks import schemas
from gaugeworks.functions import labels, redaction, requests, text, titles
from gaugeworks.functions import timekeys as tk
from gaugeworks.operators import listings, resolve, rules


def column(spark, values, expression, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_name_keys(spark):
    cases = {"Eggs": "eggs", "Tomatoes": "tomato", "berries": "berry", "ties": "tie", "boxes": "box",
             "peaches": "peach", "glass": "glass", "hummus": "hummus", "apples!": "apple", "gas": "gas",
             "  Whole  MILK, 2%": "whole milk 2", "green beans": "green beans", "": "", "crème": "crème"}
    assert column(spark, list(cases), text.name_key) == list(cases.values())


def test_prices(spark):
    assert column(spark, ["$1,234 obo", "free", None, "45.99"], text.price_text) == [1234, None, None, 45]
    assert column(spark, [38000, 999, 0, -5, 1000], text.price_minor_units, "long") == [380, 999, None, None, 10]


def test_identifier_hash(spark):
    import hashlib

    want = hashlib.sha256(b"100").hexdigest()[:16]
    assert column(spark, ["'100", " 100 ", "", None], text.hash_identifier) == [want, want, None, None]


def test_item_links(spark):
    page = lambda v: text.item_page_link(F.lit("m1"), v, "https://www.shop.com", "/item/", "/us/item/")
    assert column(spark, ["/item/m1", "https://shop.com/item/m2/", None, "https://other.com/x"], page) == [
        "https://www.shop.com/us/item/m1/", "https://www.shop.com/us/item/m2/",
        "https://www.shop.com/us/item/m1/", "https://www.shop.com/us/item/m1/"]


def test_show_keys(spark):
    df = spark.createDataFrame([("A  B!", "V", "2024-05-01T20:00:00Z"), ("a b", "v", "2024-05-01 20:00"),
                                ("", "", "")], "t string, v string, s string")
    keys = [r[0] for r in df.select(text.show_key("t", "v", "s")).collect()]
    assert keys[0] == keys[1] and keys[0].startswith("event|") and keys[2] == ""


def test_sizes_and_labels(spark):
    assert column(spark, ["12Gi", "1.5G", "7", "x"], tk.size_to_bytes) == [12 * 1024**3, 1_500_000_000, 7, None]
    label = lambda v: tk.interval_label(v.cast("timestamp"), (v.cast("timestamp") + F.expr("INTERVAL 15 MINUTES")))
    assert column(spark, ["2024-07-01 14:00:00"], label) == ["9 AM–9:15 AM"]


def test_list_lines(spark):
    raw = "2 dozen eggs, - 1/2 lb Flank Steak; # note\n1. milk\nMilk # again\n3x yogurt, 1/0 rice"
    df = spark.createDataFrame([(1, raw)], "id int, t string")
    out = resolve.parse_lists(df, ["id"], "t").orderBy("position").collect()
    assert [(r["normalized_name"], r["quantity"], r["unit"]) for r in out] == [
        ("eggs", 24.0, None), ("flank steak", 0.5, "lb"), ("milk", 1.0, None), ("yogurt", 3.0, None),
        ("rice", 1.0, None)]


def test_title_attributes(spark):
    assert column(spark, ["2019 Civic 89k miles", "87K", "120,500 mi."], titles.miles) == [89000, None, 120500]
    assert column(spark, ["2x8GB kit", "32 gb"], titles.ram_gb) == [16, 32]
    assert column(spark, ["1TB nvme", "512GB"], titles.disk_gb) == [1024, 512]
    assert column(spark, ["part 1934 of 2016", "2050"], titles.model_year) == [2016, None]
    assert column(spark, ["2400MHz to 3200 MHz", "fast"], titles.speed_mhz) == [3200, None]
    assert column(spark, ["RTX 3080 10GB", "8GB VRAM", "16GB PC"], titles.vram_gb) == [10, 8, None]
    assert column(spark, ['75" tv', "75in tv", "65 in good shape", "300 inch"], titles.screen_inches) == [75, 75, None, None]
    ranks = column(spark, ["rtx 3080 ti", "RTX 3080", "card"], titles.gpu_rank)
    assert ranks[0] == ranks[1] + 1 and ranks[2] is None


def test_taxonomy_and_genre(spark):
    assert column(spark, ["concert, rock", "nba,concert", "", "rock climbing", "sport thing"],
                  labels.taxonomy_signal) == ["positive", "negative", "neutral", "positive", "negative"]
    assert column(spark, ["Hard-Rock", "Pop", "Latin Rock", "Jazz trio", "Polka", None],
                  labels.genre_signal) == ["positive", "negative", "positive", "negative", "neutral", "neutral"]


def test_log_levels_and_errors(spark):
    assert column(spark, ["[WARN] x", "[critical] y", "z"], labels.log_level) == ["WARNING", "CRITICAL", None]
    assert column(spark, ["not configured", "cloud read sign", "timeout", "odd"], labels.error_class) == [
        "config", "cloud", "local", "api"]


def test_redaction(spark):
    got = column(spark, ["password = hunter2 ok", "GET /x?token=abc&y=1", "Bearer abc.def"], redaction.redact_log)
    assert got == ["password=[REDACTED] ok", "GET /x?token=[REDACTED]", "Bearer [REDACTED]"]
    nested = column(spark, ['{"Password": "x", "a": {"row_hash": "q", "t": "Bearer zz"}}', "Bearer q"],
                    redaction.redact_json)
    assert nested == ['{"Password": "[REDACTED]", "a": {"row_hash": "[REDACTED_HASH]", "t": "Bearer [REDACTED]"}}',
                      "Bearer [REDACTED]"]
    assert column(spark, ['{"a": [1, 2], "s": "hi"}', "no"], redaction.payload_shape) == [
        '{"a": ["int", "...(2 items)"], "s": "str(\'hi\')"}', None]


REQUESTS = [
    ("honda civic less than 100k miles under 15k", dict(topic="vehicles", max_price=15000, max_miles=100000, vehicle_make="honda", vehicle_model="civic")),
    ("hyndai under 50000 miles 20000 dollars", dict(topic="vehicles", max_price=20000, max_miles=50000, vehicle_make="hyundai")),
    ("4runner 2015 or newer under $30k", dict(max_price=30000, min_year=2015, vehicle_make="toyota", vehicle_model="4runner")),
    ("gtx 3080 card only under 600", dict(topic="computer_parts", max_price=600, gpu_model="RTX 3080", max_miles=None)),
    ("7900xtx", dict(gpu_model="RX 7900 XTX")),
    ("mac mini for under 50", dict(search_phrase="mac mini")),
    ("at least 16gb ddr5 6000mhz or faster", dict(min_gb=16, ram_type="ddr5", min_speed_mhz=6000)),
]


@pytest.mark.parametrize("request_text,want", REQUESTS)
def test_requests(spark, request_text, want):
    df = requests.with_request_fields(spark.createDataFrame([(request_text,)], "r string"), "r")
    row = df.collect()[0].asDict()
    assert {k: row[k] for k in want} == want


def reason(spark, title, price=500, **fields):
    struct = F.struct(*[
        (F.lit(None) if fields.get(f.name) is None else
         F.array(*[F.lit(x) for x in fields[f.name]]) if isinstance(fields[f.name], list) else F.lit(fields[f.name])
         ).cast(f.dataType).alias(f.name) for f in schemas.struct_of(schemas.RULES).fields])
    df = spark.createDataFrame([(title, price)], "title string, price int").withColumn("rules", struct)
    return rules.with_reason(df).collect()[0]["reason"]


CASES = [
    ("anything", 5, dict(min_price=10), "price $5 < min_price $10"),
    ("anything", None, dict(max_price=10), "missing price while max_price is required"),
    ("Mac mini lipstick brush", 5, dict(product_family="apple_mac_mini", target_product_type="device"),
     "non-computer MAC/cosmetics listing for Apple Mac Mini hunt"),
    ("dock for mac mini", 5, dict(product_family="apple_mac_mini", target_product_type="device"),
     "accessory-only listing for Apple Mac Mini device hunt"),
    ("mac mini 2018 16gb with dock", 5, dict(product_family="apple_mac_mini", target_product_type="device"), None),
    ("steam deck carrying case", 5, dict(product_family="steam_deck", hunt_subtype="handheld"),
     "accessory-only listing for Steam Deck console hunt"),
    ("SATA ssd 1TB", 5, dict(hunt_subtype="storage", excluded_storage_protocols=["sata"], vertical="parts"),
     '[parts] excluded storage protocol "sata"'),
    ("toyota tacoma or tundra", 5, dict(vertical="vehicles", include_keywords=["toyota tacoma"]),
     "[vehicles] ambiguous multi-model vehicle title (tacoma, tundra)"),
    ("camry clean", 5, dict(vertical="vehicles", include_keywords=["toyota camry"]),
     '[vehicles] title missing include keyword (any of: "toyota camry")'),
    ("tacoma clean", 5, dict(vertical="vehicles", include_keywords=["toyota tacoma"]), None),
    ("x", 5, dict(include_keywords=["a", "b", "c", "d", "e"]),
     'title missing include keyword (any of: "a", "b", "c", "d" +1 more)'),
    ("red ring", 5, dict(require_all_keywords=["Red", "bolt"]), 'title missing required keyword "bolt"'),
    ("red ring", 5, dict(exclude_keywords=["zzz", "RING"]), 'excluded keyword "RING"'),
    ("rtx 3060 laptop", 5, dict(hunt_subtype="gpu"), "whole system/laptop listing (GPU card hunt)"),
    ("HP desktop computer", 5, dict(hunt_subtype="ram"), "whole computer listing (RAM kit hunt)"),
    ("civic 120k miles", 5, dict(max_miles=100000), "mileage 120,000 > max_miles 100,000"),
    ("civic low miles", 5, dict(max_miles=100000), None),
    ("8gb stick", 5, dict(min_capacity_gb=16), "capacity 8GB < min_capacity_gb 16GB"),
    ("2005 civic", 5, dict(min_year=2010), "year 2005 < min_year 2010"),
    ('55" tv', 5, dict(min_size_inches=65), 'TV size 55" < min_size_inches 65"'),
    ("rtx 2060", 5, dict(min_gpu_class="rtx 3060"),
     'GPU in title is below min_gpu_class "rtx 3060" (tier 7 < 17)'),
    ("mystery card", 5, dict(min_gpu_class="rtx 3060"), None),
]


@pytest.mark.parametrize("title,price,fields,want", CASES)
def test_first_reason(spark, title, price, fields, want):
    assert reason(spark, title, price, **fields) == want


def test_matches_equals_judging_every_pair(spark):
    from gaugeworks.plans import match_queries, text_queries

    sf = "/root/testdata/sf0.001"
    rows, searches = text_queries.listings(spark, sf), match_queries._runnable(spark, sf)
    keys = ["search_id", "source", "link"]
    quick = {tuple(r) for r in listings.matches(rows, searches).select(*keys).collect()}
    full = {tuple(r) for r in listings.judge(rows, searches).filter("reason IS NULL").select(*keys).collect()}
    assert quick == full and quick


def test_alias_resolution(spark):
    aliases = spark.createDataFrame(
        [("Milk", "Whole milk", "P1", None, None, None), ("egg", "Eggs", None, None, "large eggs", None),
         ("oat milk", "Oat", None, "U2", None, None)], schemas.ALIAS)
    redirects = spark.createDataFrame([("leche", "dairy"), ("dairy", "milk"), ("a", "b"), ("b", "a")], schemas.REDIRECT)
    items = spark.createDataFrame(
        [("milk", 1.0), ("egg", 2.0), ("leche", 1.0), ("soy milk", 1.0), ("chocolate oat milk", 1.0), ("tea", 0.2)],
        "normalized_name string, quantity double")
    out = {r["normalized_name"]: (r["status"], r["matched_alias"], r["search_term"])
           for r in resolve.resolve_items(items, aliases, redirects).collect()}
    assert out["milk"] == ("EXACT_DEFAULT", "Whole milk", "milk")
    assert out["leche"] == ("EXACT_DEFAULT", "Whole milk", "leche")
    assert out["egg"] == ("NEEDS_SEARCH", "Eggs", "large eggs")
    assert out["soy milk"][0] == "EXACT_DEFAULT"
    assert out["chocolate oat milk"][0] == "AMBIGUOUS"
    assert out["tea"] == ("MISSING", None, "tea")


def test_redirect_cycles_end_where_they_repeat(spark):
    redirects = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("c", "b"), ("x", "y"), ("s", "s")], schemas.REDIRECT)
    keys = spark.createDataFrame([(k,) for k in "abcxyzs"], "alias_key string")
    out = {r[0]: r[1] for r in resolve.follow_redirects(keys, redirects).collect()}
    assert out == {"a": "b", "b": "b", "c": "c", "x": "y", "y": "y", "z": "z", "s": "s"}


def test_numbers_too_large_are_no_numbers(spark):
    assert column(spark, ["99999x99999GB", "2x8GB"], titles.ram_gb) == [None, 16]
    assert column(spark, ["9999999k miles", "50k miles"], titles.miles) == [None, 50000]
    assert column(spark, ["9999999TB", "2TB"], titles.disk_gb) == [None, 2048]
    assert column(spark, ["99999999999 gb", "16gb"], requests.capacities_gb) == [[], [16]]


def test_shapes_have_no_bounds_unless_asked(spark):
    deep = '{"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}, "t": "' + "x" * 50 + '"}'
    assert column(spark, [deep], redaction.payload_shape) == [
        '{"a": {"b": {"c": {"d": {"e": {"f": "int"}}}}}, "t": "str(\'' + "x" * 50 + '\')"}']
    short = column(spark, [deep], lambda c: redaction.payload_shape(c, depth=4, text=40))
    assert short == ['{"a": {"b": {"c": {"d": {"e": "..."}}}}, "t": "str(len=50)"}']


def test_a_batch_seen_twice_is_existing(spark):
    from gaugeworks.plans import match_queries, text_queries

    sf = "/root/testdata/sf0.001"
    rows = text_queries.listings(spark, sf)
    searches, none = match_queries._runnable(spark, sf), rows.select("link").limit(0)
    once = listings.run_counters(rows, searches, none, order=("search_id", "source")).collect()
    twice = listings.run_counters(rows.union(rows), searches, none, order=("search_id", "source")).collect()
    first = {(r.search_id, r.source): r for r in once}
    for r in twice:
        a = first[r.search_id, r.source]
        assert r.new_count == a.new_count and r.filtered_count == 2 * a.filtered_count
        assert r.existing_count == 2 * a.existing_count + a.new_count
    assert sum(r.new_count for r in once) > 0


def _run(spark, *rows):
    fields = {f.name: f.dataType for f in schemas.struct_of(schemas.RULES).fields}
    df = spark.createDataFrame(rows, "search_id string, source_sites array<string>, words array<string>, high int")
    given = {"include_keywords": F.col("words"), "max_price": F.col("high")}
    return df.withColumn("rules", F.struct(*[
        given.get(k, F.lit(None)).cast(t).alias(k) for k, t in fields.items()])).drop("words", "high")


_LISTED = "link string, title string, price int, source string"


def test_equal_rules_are_judged_once_a_title(spark, monkeypatch):
    judged, real = [], listings.with_reason
    monkeypatch.setattr(listings, "with_reason", lambda pairs: real(judged.append(pairs) or pairs))
    searches = _run(spark, *[(str(i), ["a"], ["red", "ring"], 9) for i in range(8)], *[(f"o{i}", ["a"], None, 9) for i in range(8)])
    rows = spark.createDataFrame([(f"l{i}", "red ring", 5, "a") for i in range(7)], _LISTED)
    pairs = listings.matches(rows, searches)
    assert pairs.count() == 7 * 16 and pairs.select("link", "search_id").distinct().count() == 7 * 16
    assert judged[0].count() == 2
    out = listings.run_counters(rows, searches, rows.select("link").limit(0), order=("search_id", "source")).collect()
    assert {r.search_id: r.new_count for r in out if r.new_count} == {"0": 7} and len(out) == 16
    assert {r.new_count + r.existing_count for r in out} == {7}
    assert len(judged) == 2 and judged[1].count() == 2


def test_versions_of_one_search_and_nulls(spark):
    searches = _run(spark, ("1", ["a", "A"], ["red"], 9), ("1", ["a"], ["ring"], 9), ("1", ["a"], ["red"], 9),
                    (None, ["a"], None, None), ("2", None, ["red"], None))
    rows = spark.createDataFrame(
        [("x", "Red ring", 5, "a"), ("x", "Red ring", 5, "a"), ("y", "ring", None, "a"), ("z", None, None, "a"), ("w", "red", 1, None)], _LISTED)
    got = sorted((r.search_id or "", r.link) for r in listings.matches(rows, searches).collect())
    assert got == [("", "x"), ("", "y"), ("", "z"), ("1", "x")]
    out = listings.run_counters(rows, searches, rows.select("link").limit(0), order=("search_id", "source")).collect()
    assert {r.existing_count + r.new_count for r in out if r.search_id == "1"} == {2}


def test_pairs_of_one_class_are_written_by_several_tasks(spark):
    searches = _run(spark, *[(str(i), ["a"], ["red"], 9) for i in range(200)], ("v", ["a"], ["red"], 9), ("v", ["a"], ["ring"], 9))
    rows = spark.createDataFrame([(f"l{i}", f"red {i}", 5, "a") for i in range(40)], _LISTED)
    pairs = listings.matches(rows, searches)
    assert pairs.columns[:4] == ["source", "link", "title", "price"] and "rules" in pairs.columns
    got = pairs.select("search_id", "link", "rules.max_price", F.spark_partition_id().alias("task")).collect()
    assert len(got) == 40 * 201 == len({(r.search_id, r.link) for r in got}) and {r.max_price for r in got} == {9}
    assert len({r.task for r in got if r.search_id != "v"}) > 2


def test_last_plan_of_the_counters_holds_no_rules(spark):
    searches = _run(spark, ("1", ["a"], ["red"], 9), ("1", ["a"], ["ring"], 9), ("2", ["a", "b"], ["red"], 9), ("3", ["a"], None, 3))
    rows = spark.createDataFrame([("x", "red ring", 5, "a"), ("x", "red ring", 5, "a"), ("y", "ring", 2, "a"), ("z", None, 1, "a"), ("", "red", 1, "b")], _LISTED)
    out = listings.run_counters(rows, searches, rows.filter("link = 'z'").select("link"), order=("search_id", "source"))
    assert "include_keywords" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.search_id, r.source): (r.new_count, r.existing_count, r.filtered_count) for r in out.collect()}
    assert got == {("1", "a"): (2, 1, 1), ("2", "a"): (0, 2, 2), ("2", "b"): (0, 0, 0), ("3", "a"): (0, 2, 2)}


def test_costly_rows_are_spread_over_tasks(spark, tmp_path):
    from gaugeworks.plans import catalog

    spark.range(60).selectExpr(
        "id AS p_partkey", "CAST(id % 50 AS INT) AS p_size", "'red ring' AS p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("b23_constraints", "s09_extractors"):
        out = catalog.queries()[name](spark, str(tmp_path))
        assert "RoundRobinPartitioning" in out._jdf.queryExecution().executedPlan().toString()
