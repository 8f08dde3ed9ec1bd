"""Readers of landed files and pages."""

from datetime import timezone

import pytest
from pyspark.sql import functions as F

from gaugeworks.sources import catalog, intervals, logs, pages, payloads, telemetry


def test_zone_lines_drop_what_does_not_parse(spark, tmp_path, ts):
    (tmp_path / "z.jsonl").write_text(
        '{"timestamp": "2024-03-01T00:00:00+00:00", "thermostats": {"up": {"action": "COOLING", "temperature": 75}, "bad": 3}}\n'
        '\nnot json\n[1]\n{"timestamp": 5, "thermostats": {}}\n{"timestamp": "nope"}\n'
        '{"timestamp": "2024-03-01T00:05:00", "thermostats": []}\n')
    lines = spark.read.text(str(tmp_path)).withColumn("site_id", F.lit(1))
    records = telemetry.zone_records(lines, ["site_id"]).orderBy("ts").collect()
    assert [len(r["zones"]) for r in records if r["ts"].year == 2024] == [1, 0]
    row = telemetry.zone_samples(lines).collect()[0]
    assert (row["zone"], row["action"], row["temperature"]) == ("up", "COOLING", 75)


def test_power_lines(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text(
        '{"timestamp": "2024-03-01T00:00:00Z", "source": "", "appliances": {"a": {"power_w": 0.0}, "b": {"power_w": null}}}\n')
    out = telemetry.power_samples(spark.read.text(str(tmp_path)).withColumn("site_id", F.lit(1))).orderBy("channel").collect()
    assert [(r["channel"], r["power_w"], r["limited"], r["source"]) for r in out] == [
        ("a", 0.0, False, None), ("b", None, False, None)]


def test_host_lines_accept_epoch_and_need_loads(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text(
        '{"timestamp": 1709251200, "load_1": 1, "load_5": 2, "load_15": 3}\n'
        '{"timestamp": "2024-03-01T00:01:00", "load_1": 1, "load_5": 2}\n'
        '{"timestamp": "2024-03-01T00:02:00", "load_1": "1.5", "load_5": 2, "load_15": 3, "cpu_percent": "x"}\n')
    out = telemetry.host_samples(spark.read.text(str(tmp_path)).withColumn("host", F.lit("h"))).collect()
    assert len(out) == 1 and out[0]["load_15"] == 3.0


def test_generic_csv_layout(spark, tmp_path, ts):
    (tmp_path / "a.csv").write_text(
        "Interval Start,Interval End,Usage (kWh)\n2024-07-01 00:00:00,2024-07-01 00:15:00,1.25\n"
        "07/01/2024 12:15 AM,,-\nbroken,,2\n")
    out = intervals.read_csv(spark, str(tmp_path), raw_source="csv:a")
    good = intervals.good_rows(out).orderBy("start_ts").collect()
    assert [r["kwh"] for r in good] == [1.25, 0.0]
    assert good[0]["start_ts"].replace(tzinfo=timezone.utc) == ts("2024-07-01 05:00:00")
    assert good[1]["end_ts"].replace(tzinfo=timezone.utc) == ts("2024-07-01 05:30:00")
    assert intervals.bad_rows(out).count() == 1


def test_export_layout_wraps_midnight(spark, tmp_path, ts):
    (tmp_path / "e.csv").write_text(
        "ESIID,USAGE_DATE,REVISION_DATE,USAGE_START_TIME,USAGE_END_TIME,USAGE_KWH,ESTIMATED_ACTUAL,CONSUMPTION_SURPLUSGENERATION\n"
        "'100,06/15/2026,06/15/2026 11:18:06,23:45,00:00,0.250,A,Consumption\n")
    row = intervals.read_csv(spark, str(tmp_path)).collect()[0]
    assert row["start_ts"].replace(tzinfo=timezone.utc) == ts("2026-06-16 04:45:00")
    assert row["end_ts"].replace(tzinfo=timezone.utc) == ts("2026-06-16 05:00:00")
    assert row["raw_source"] == "csv;est=A;type=Consumption;revision=06/15/2026 11:18:06"


def test_packed_day_keeps_real_time_over_a_clock_change(spark, ts):
    rd = ",".join(["1"] * 92)
    rows = spark.createDataFrame(
        [(1, f'{{"data": {{"energyData": [{{"RT": "C", "RD": "{rd}"}}]}}}}')], "site_id long, payload string"
    ).withColumn("day", F.lit("2024-03-10").cast("date"))
    out = intervals.explode_packed_days(rows).orderBy("start_ts").collect()
    assert out[0]["start_ts"].replace(tzinfo=timezone.utc) == ts("2024-03-10 06:00:00")
    assert out[-1]["end_ts"].replace(tzinfo=timezone.utc) == ts("2024-03-11 05:00:00")


CARDS = {
    "classified": '<li class="cl-static-search-result"><a href="https://c.org/1.html"><div class="title">RTX 3080</div>'
                  '<div class="price">$500</div><div class="location">(Katy)</div></a></li>',
    "grid": '<div class="item-cell"><a class="item-title" href="/p/N1?x=1">RTX 3080</a><li class="price-current">$500</li></div>',
    "tiles": '<li class="sku-item"><h4 class="sku-title"><a href="/site/9.p?id=1">RTX 3080</a></h4>'
             '<div class="priceView-customer-price"><span>$500.00</span></div></li>',
    "store": '<li class="product_wrapper"><a data-name="RTX 3080" data-price="500.00" href="/product/1/x#r"></a>'
             '<div class="price_wrapper">12 in stock QUICK VIEW more</div></li>',
    "wrapper": '<div class="xui_card_wrapper" data-code="LX1" data-price="500"><span class="headline">RTX 3080</span></div>',
}
LINKS = {
    "classified": "https://c.org/1.html", "grid": "https://www.newegg.com/p/N1",
    "tiles": "https://www.bestbuy.com/site/9.p", "store": "https://www.microcenter.com/product/1/x",
    "wrapper": "https://swappa.com/listing/view/LX1",
}


@pytest.mark.parametrize("layout", sorted(CARDS))
def test_card_layouts(spark, layout):
    html = f"<html><script>var x='<li>';</script><ul>{CARDS[layout]}{CARDS[layout]}</ul></html>"
    page = spark.createDataFrame([(1, html), (2, "<html></html>"), (3, None)], "page_id long, html string")
    rows = pages.page_listings(page, layout, limit=5).collect()
    assert [(r["title"], r["price"], r["link"]) for r in rows] == [("RTX 3080", 500, LINKS[layout])]


def test_blocked_pages(spark):
    df = spark.createDataFrame(
        [("Just a moment...", "x", 3), ("ok", "x __cf_chl y", 0), ("ok", "tiny", 0), ("ok", "tiny", 2)],
        "t string, h string, n int")
    got = [r[0] for r in df.select(pages.block_reason(F.col("t"), F.col("h"), F.col("n"))).collect()]
    assert got == ["challenge_title:just a moment", "challenge_html:__cf_chl", "thin_html_no_products", None]


def test_blockers(spark):
    df = spark.createDataFrame(
        [("Log in to Facebook to see marketplace_search", "https://f/marketplace/houston/search", 0),
         ("marketplace_search", "https://f/marketplace/category/search", 0), ("hello", "https://x", 0), ("fine", "https://x", 2)],
        "h string, u string, n int")
    got = [r[0] for r in df.select(pages.blockers(F.col("h"), F.col("u"), F.col("n"), F.lit("houston"))).collect()]
    assert got == [["login_wall"], ["location_resolution_failed", "empty_public_results"],
                   ["marketplace_unavailable"], []]


def test_thermostat_setpoints(spark):
    t = "sdm.devices.traits."
    payload = (
        '{"devices": [{"name": "a/b/dev", "type": "sdm.devices.types.THERMOSTAT", "parentRelations": [{"displayName": "Up Stairs"}],'
        f'"traits": {{"{t}ThermostatMode": {{"mode": "HEAT"}}, "{t}ThermostatTemperatureSetpoint": {{"heatCelsius": 20.0}},'
        f'"{t}Temperature": {{"ambientTemperatureCelsius": 22.5}}, "{t}ThermostatEco": {{"mode": "MANUAL_ECO", "heatCelsius": 15.0, "coolCelsius": 28.0}}}}}}]}}')
    df = spark.createDataFrame([(1, payload)], "site_id long, payload string")
    row = payloads.thermostats(df, keep=["site_id"]).collect()[0]
    assert (row["zone"], row["mode"], row["setpoint"], row["temperature"], row["online"]) == (
        "up_stairs", "MANUAL_ECO", 59, 72, False)


def test_log_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("2024-03-01 10:00:00 [ERROR] x\nplain\n2024-03-01T10:05:00 ok\n")
    out = logs.read_logs(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r["level"] for r in out] == ["ERROR", None, None]
    assert [r["ts"] is None for r in out] == [False, True, False]


def test_unknown_tables_resolve_their_columns(spark):
    df = spark.createDataFrame([("n", "s", "u")], "name string, site string, url string")
    assert catalog.with_known_columns(df).columns == ["title", "source", "link"]


def data_page(tree):
    import json

    return f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(tree)}</script>'


def test_known_item_lists_come_first(spark):
    item = {"id": "1", "name": "lamp", "price": "5", "seller": {"id": "9", "name": "ann"}}
    deep = item
    for _ in range(15):
        deep = {"more": [deep]}
    rows = [(1, data_page({"data": {"search": {"items": [item]}}})), (2, data_page(deep)),
            (3, data_page({"data": {"searchFacet": {"items": []}}}))]
    frame = spark.createDataFrame(rows, "page_id long, html string")
    found = pages.embedded_listings(frame, source="s", item_url="u/").select("page_id", "link").collect()
    assert sorted(map(tuple, found)) == [(1, "u/1"), (2, "u/1"), (2, "u/9")]


def test_extractors_by_sql_call(spark):
    from gaugeworks.sources import extractors

    extractors.register(spark)
    pages = {
        "feed": '<script id="__NEXT_DATA__">{"data": {"search": {"items": [{"id": 7, "name": "lamp", "price": "$3"}]}}}</script>',
        "attributes": '<c data-vehicle-details="{&quot;listingId&quot;:&quot;9&quot;,&quot;make&quot;:&quot;ax&quot;}"></c><c data-vehicle-details="{oops"></c>',
        " Nav ": '<li><a href="/x">one</a></li><li><a href="/y">two</a></li>', "nobody": "<li>x</li>",
    }
    want = {"feed": [(0, "lamp", "$3", None, "7")], "attributes": [(0, "ax", None, None, "9")],
            " Nav ": [(0, "one", None, None, "/x"), (1, "two", None, None, "/y")], "nobody": []}
    for name, html in pages.items():
        spark.createDataFrame([(1, html), (2, None)], "page_id long, html string").createOrReplaceTempView("extractor_pages")
        for how in ("", " PARTITION BY (page_id)"):
            rows = spark.sql(f"SELECT * FROM listing_cards(TABLE(SELECT page_id, html FROM extractor_pages){how}, '{name}')").collect()
            assert sorted(tuple(r)[1:] for r in rows) == want[name], name
