"""Queries over pages and over payloads that Spark writes from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.plans.registry import query, table
from gaugeworks.session import spread
from gaugeworks.sources import pages as src

_CARDS_SQL = """c AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)) AS href,
   unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2)) AS title,
   unnest(range(len(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)))) AS pos FROM pages),
l AS (SELECT page_id, pos, trim(title) AS title, 'https://example.com' || href AS link FROM c WHERE trim(title) <> ''
   QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1)"""


@query("s09_page_listings", f"WITH {_CARDS_SQL} SELECT page_id, title, link FROM l")
def s09(spark, sf):
    return src.page_listings(table(spark, sf, "pages"), "nav").select("page_id", "title", "link")


# A page of each layout for every part, a card twice in it.
_LAYOUT_PAGES = {
    "grid": """concat('<div class="item-cell"><a class="item-title" href="/p/N', p_partkey, '?a=1">', p_name, '</a><b class="price-current">$',
      p_size, '.50</b><i class="shipping">Free</i></div>')""",
    "tiles": """concat('<ul><li class="sku-item"><h4 class="sku-title"><a href="/site/N', p_partkey, '">', p_name,
      '</a></h4><b class="priceView-customer-price">$', p_size, '.50</b></li></ul>')""",
    "store": """concat('<ul><li class="product_wrapper"><a href="/product/N', p_partkey, '#x" data-name="', p_name, '" data-price="', p_size,
      '.50">see</a></li></ul>')""",
    "wrapper": """concat('<div class="xui_card_wrapper" data-price="', p_size, '.50"><a href="/N', p_partkey, '"><b class="headline">', p_name,
      '</b></a></div>')""",
}


@query("s09_extractors", """
WITH o AS (SELECT unnest(['newegg', 'bestbuy', 'microcenter', 'swappa']) AS source,
  unnest(['https://www.newegg.com/p/N', 'https://www.bestbuy.com/site/N', 'https://www.microcenter.com/product/N', 'https://swappa.com/N']) AS link)
SELECT p_partkey AS page_id, source, p_name AS title, p_size AS price, link || p_partkey AS link FROM part, o""")
def s09_extractors(spark, sf):
    from gaugeworks.sources.extractors import extracted

    part = spread(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"))
    found = [extracted(part.select(F.col("p_partkey").alias("page_id"), F.concat(F.expr(html), F.expr(html)).alias("html")), name)
             for name, html in _LAYOUT_PAGES.items()]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out.select("page_id", "source", "title", "price", "link")


_DATA = """concat('<html><script id="__NEXT_DATA__" type="application/json">{"props": {"feed": [{"ad": 1}, {"__typename": "Item", "listingId": "',
  p_partkey, '", "title": " ', p_name, '  kit", "price": "$', p_size, ',000", "locationName": "', p_brand,
  '"}, {"wrap": {"__typename": "Item", "listingId": "', p_partkey, '", "title": "twice"}}, {"__typename": "Item", "listingId": "x',
  p_partkey, '", "title": ""}]}}</script></html>')"""


@query("s10_embedded_json", """
SELECT p_partkey AS page_id, p_name || ' kit' AS title, p_size * 1000 AS price, p_brand AS location, 'https://items.example/' || p_partkey AS link FROM part""")
def s10(spark, sf):
    pages = table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), F.expr(_DATA).alias("html"))
    return src.embedded_listings(pages, "Item", source="feed", item_url="https://items.example/").drop("source")


_ATTR = """concat('<html><fuse-card data-vehicle-details="{&quot;listingId&quot;:&quot;', p_partkey, '&quot;,&quot;stockType&quot;:&quot;Used&quot;,&quot;year&quot;:',
  2000 + p_size % 20, ',&quot;make&quot;:&quot;', split_part(p_name, ' ', 1), '&quot;,&quot;model&quot;:&quot;', split_part(p_name, ' ', 2),
  '&quot;,&quot;price&quot;:', CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1000 + p_size END, ',&quot;msrp&quot;:&quot;$', 2, ',', 500, '&quot;}"></fuse-card>',
  '<fuse-card data-vehicle-details="{}"></fuse-card></html>')"""


@query("s11_attribute_json", """
SELECT p_partkey AS page_id, 'Used ' || (2000 + p_size % 20) || ' ' || p_name AS title,
  CASE WHEN p_size % 2 = 0 THEN 2500 ELSE 1000 + p_size END AS price, 'https://cars.example/vehicledetail/' || p_partkey || '/' AS link FROM part""")
def s11(spark, sf):
    pages = table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), F.expr(_ATTR).alias("html"))
    return src.attribute_cards(pages, source="cars", origin="https://cars.example").drop("source")


@query("s12_page_with_blockers", f"""
WITH {_CARDS_SQL}, n AS (SELECT page_id, count(*) AS n FROM l GROUP BY page_id)
SELECT p.page_id, coalesce(n, 0) AS listing_count,
  concat_ws(',', CASE WHEN contains(lower(html), 'captcha') THEN 'captcha_checkpoint' END,
    CASE WHEN coalesce(n, 0) = 0 THEN CASE WHEN regexp_matches(lower(html || ' ' || url), 'marketplace|facebook') THEN 'unsupported_page_shape' ELSE 'marketplace_unavailable' END END) AS blockers
FROM pages p LEFT JOIN n ON n.page_id = p.page_id""")
def s12(spark, sf):
    pages = table(spark, sf, "pages")
    out = src.pages_with_blockers(pages, src.page_listings(pages, "nav"))
    return out.select("page_id", "listing_count", F.array_join("blockers", ",").alias("blockers"))


@query("s13_page_block", """
SELECT page_id, CASE WHEN length(html) % 3 = 0 THEN 'challenge_title:just a moment'
  WHEN length(html) % 2 = 0 THEN CASE WHEN length(html) < 12000 THEN 'thin_html_no_products' END END AS reason FROM pages""")
def s13(spark, sf):
    size = F.length("html")
    title = F.when(size % 3 == 0, F.lit("Just a moment...")).otherwise(src.page_title(F.col("html")))
    return table(spark, sf, "pages").select(
        "page_id", src.block_reason(title, F.col("html"), (size % 2).cast("int")).alias("reason"))


@query("s14_ticket_events", """
SELECT CAST(p_partkey AS VARCHAR) AS provider_event_id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'Evening of ' || p_type END AS artist_or_title,
  p_brand AS venue, 'TX' AS state, CASE WHEN p_size % 3 = 0 THEN '2024-05-01' ELSE '2024-05-01T19:30:00Z' END AS starts_at,
  CASE WHEN p_size % 5 = 0 THEN 'Music' ELSE 'Rock' END AS genre_or_classification FROM part""")
def s14(spark, sf):
    from gaugeworks.sources import payloads

    raw = F.expr("""concat('{"id": "', p_partkey, '", "name": "Evening of ', p_type, '", "url": "https://t.example/', p_partkey,
      '", "_embedded": {"venues": [{"name": " ', p_brand, '", "city": {"name": "Austin"}, "state": {"stateCode": "TX"}}], "attractions": [',
      CASE WHEN p_size % 2 = 0 THEN concat('{"name": "', p_name, '"}') ELSE '' END, ']}, "classifications": [{"genre": {"name": "',
      CASE WHEN p_size % 5 = 0 THEN '' ELSE 'Rock' END, '"}, "segment": {"name": "Music"}}], "dates": {"start": {"localDate": "2024-05-01"',
      CASE WHEN p_size % 3 = 0 THEN '' ELSE ', "dateTime": "2024-05-01T19:30:00Z"' END, '}}}')""")
    out = payloads.ticket_events(table(spark, sf, "part").select(raw.alias("payload")))
    return out.select("provider_event_id", "artist_or_title", "venue", "state", "starts_at", "genre_or_classification")


@query("s15_seat_events", """
SELECT CAST(p_partkey AS VARCHAR) AS provider_event_id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS artist_or_title,
  'concert, rock' AS genre_or_classification FROM part""")
def s15(spark, sf):
    from gaugeworks.sources import payloads

    raw = F.expr("""concat('{"id": ', p_partkey, ', "performers": [{"name": "', p_type, '"}', CASE WHEN p_size % 2 = 0
      THEN concat(', {"name": "', p_name, '", "primary": true}') ELSE '' END,
      '], "taxonomies": [{"name": "rock"}, {"name": "concert"}, {"name": "rock"}, {"id": 3}]}')""")
    out = payloads.seat_events(table(spark, sf, "part").select(raw.alias("payload")))
    return out.select("provider_event_id", "artist_or_title", "genre_or_classification")


@query("s16_products", """
SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS product_id, CASE WHEN p_size % 2 = 0 THEN 'U' || p_size ELSE 'I' || p_size END AS upc,
  CAST(p_size AS VARCHAR) || '.5' AS price, greatest(0, p_size - 10) AS result_total FROM part""")
def s16(spark, sf):
    from gaugeworks.sources import payloads

    raw = F.expr("""concat('{"data": [{"productId": "', p_partkey, '", "upc": "', CASE WHEN p_size % 2 = 0 THEN concat('U', p_size) ELSE '' END,
      '", "items": [{"price": {"regular": ', p_size, '.5}, "upc": "I', p_size, '"}]}, {"productId": ""}], "meta": {"pagination": {"total": ', p_size - 10, '}}}')""")
    out = payloads.products(table(spark, sf, "part").select("p_partkey", raw.alias("payload")), keep=["p_partkey"])
    return out.select("p_partkey", "product_id", "upc", "price", "result_total")


@query("s17_locations", """
SELECT c_custkey, 'L' || c_custkey AS location_id, c_name AS name, c_custkey % 3 = 0 AS has_pickup,
  CASE c_custkey % 2 WHEN 0 THEN '(555) 010-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') ELSE 'ext ' || c_custkey END AS phone FROM customer""")
def s17(spark, sf):
    from gaugeworks.sources import payloads

    raw = F.expr("""concat('{"data": [{"locationId": " L', c_custkey, '", "name": "', c_name, '", "departments": [{"departmentId": "',
      CASE WHEN c_custkey % 3 = 0 THEN '94' ELSE '12' END, '"}], "phone": "', CASE WHEN c_custkey % 2 = 0
      THEN concat('555-010-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')) ELSE concat('ext ', c_custkey) END, '"}]}')""")
    out = payloads.locations(table(spark, sf, "customer").select("c_custkey", raw.alias("payload")), keep=["c_custkey"])
    return out.select("c_custkey", "location_id", "name", "has_pickup", "phone")


@query("s18_thermostats", """
SELECT p_partkey AS site_id, CASE WHEN p_size % 2 = 0 THEN 'up_stairs' ELSE 'custom' END AS zone, CAST(p_size * 9 + 32 AS INTEGER) AS temperature,
  CASE WHEN p_size % 3 = 0 THEN 'MANUAL_ECO' ELSE 'COOL' END AS mode, 'COOLING' AS action, 77 AS setpoint, p_size % 4 = 0 AS online FROM part""")
def s18(spark, sf):
    from gaugeworks.sources import payloads

    t = "sdm.devices.traits."
    raw = F.expr(f"""concat('{{"devices": [{{"name": "a/b/dev', p_partkey, '", "type": "sdm.devices.types.THERMOSTAT", "parentRelations": [{{"displayName": "',
      CASE WHEN p_size % 2 = 0 THEN ' Up Stairs! ' ELSE '' END, '"}}], "traits": {{"{t}Info": {{"customName": "Custom"}}, "{t}Temperature": {{"ambientTemperatureCelsius": ',
      5 * p_size, '}}, "{t}ThermostatMode": {{"mode": "COOL"}}, "{t}ThermostatHvac": {{"status": "COOLING"}}, "{t}ThermostatTemperatureSetpoint": {{"coolCelsius": 25}}, "{t}ThermostatEco": {{"mode": "',
      CASE WHEN p_size % 3 = 0 THEN 'MANUAL_ECO' ELSE 'OFF' END, '", "coolCelsius": 25, "heatCelsius": 10}}, "{t}Connectivity": {{"status": "', CASE WHEN p_size % 4 = 0 THEN 'ONLINE' ELSE 'OFFLINE' END,
      '"}}}}}}, {{"type": "sdm.devices.types.CAMERA"}}]}}')""")
    out = payloads.thermostats(table(spark, sf, "part").select(
        F.col("p_partkey").alias("site_id"), raw.alias("payload")), keep=["site_id"])
    return out.select("site_id", "zone", "temperature", "mode", "action", "setpoint", "online")


@query("s19_registers", """
WITH p AS (SELECT *, p_size % 2 = 0 AS one FROM part)
SELECT p_partkey AS site_id, CASE WHEN one THEN 'pj1103a' ELSE 'v_wifi_dl02_es' END AS profile, 'ac_compressor' AS channel,
  p_size / 10 AS power_w, CASE WHEN one THEN p_size / 1000 END AS current_a, CASE WHEN NOT one THEN 120.5 END AS voltage_v FROM p
UNION ALL SELECT p_partkey, CASE WHEN one THEN 'pj1103a' ELSE 'v_wifi_dl02_es' END, 'furnace_air_handler', p_size * 2 / 10,
  CASE WHEN one THEN p_size / 1000 END, CASE WHEN NOT one THEN 120.5 END FROM p""")
def s19(spark, sf):
    from gaugeworks.sources import payloads

    registers = F.expr("""CASE WHEN p_size % 2 = 0 THEN map('101', CAST(p_size AS DOUBLE), '105', CAST(p_size * 2 AS DOUBLE), '113', CAST(p_size AS DOUBLE), '114', CAST(p_size AS DOUBLE))
      ELSE map('107', 1205D, '108', CAST(p_size AS DOUBLE), '117', 1205D, '118', CAST(p_size * 2 AS DOUBLE)) END""")
    out = payloads.meter_channels(table(spark, sf, "part").select(
        F.col("p_partkey").alias("site_id"), F.lit("meter_1").alias("meter"), registers.alias("registers")), keep=["site_id"])
    return out.select("site_id", "profile", "channel", "power_w", "current_a", "voltage_v")


@query("s22_agent_samples", """
SELECT o_orderkey AS host, CAST(o_custkey AS DOUBLE) AS load_1, 100 - o_custkey % 100 + 0.0 AS cpu_percent, greatest(0, 5000 - o_custkey) AS memory_used_bytes,
  o_custkey + 3.0 AS network_rx_bps, CAST(NULL AS DOUBLE) AS network_tx_bps FROM orders WHERE o_orderstatus <> 'P'""")
def s22(spark, sf):
    from gaugeworks.sources import payloads

    raw = F.expr("""concat('{"cpu": {"idle": ', o_custkey % 100, '}, "load": {', CASE WHEN o_orderstatus = 'P' THEN '' ELSE concat('"min1": ', o_custkey) END,
      '}, "mem": {"total": 5000, "available": ', o_custkey, '}, "network": [{"interface_name": "lo", "rx": 7}, {"interface_name": "e0", "bytes_recv_rate": ', o_custkey,
      '}, {"name": "e1", "bytes_recv_rate": -1, "rx": 3}]}')""")
    parsed = payloads.agent_payloads(table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("host"), raw.alias("payload")), keep=["host"])
    return payloads.agent_host_samples(parsed, keep=["host"]).select(
        "host", "load_1", "cpu_percent", "memory_used_bytes", "network_rx_bps", "network_tx_bps")


# ---- decoders of landed text, on text that Spark writes from events ------------------

@query("s01_zone_lines", """
SELECT user_id AS site_id, epoch_us(date_trunc('second', ts)) AS ts, 'up' AS zone, CASE WHEN event_type <> 'error' THEN upper(event_type) END AS action,
  CAST(floor(value) AS INTEGER) AS temperature FROM events WHERE event_type <> 'signup'""")
def s01(spark, sf):
    from gaugeworks.plans.registry import plain
    from gaugeworks.sources import telemetry

    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    line = F.when(F.col("event_type") == "signup", F.concat(F.lit("{broken "), stamp)).otherwise(F.concat(
        F.lit('{"timestamp": "'), stamp, F.lit('", "thermostats": {"bad": 3, "up": {"temperature": '),
        F.floor("value").cast("string"), F.lit(', "action": '),
        F.when(F.col("event_type") == "error", F.lit("null")).otherwise(
            F.concat(F.lit('"'), F.upper("event_type"), F.lit('"'))), F.lit("}}}")))
    lines = table(spark, sf, "events").select(F.col("user_id").alias("site_id"), line.alias("value"))
    return plain(telemetry.zone_samples(lines).select("site_id", "ts", "zone", "action", "temperature"))


@query("s02_power_lines", """
SELECT user_id AS site_id, epoch_us(date_trunc('second', ts)) AS ts, event_type AS channel, value AS power_w, event_type = 'view' AS limited,
  CASE WHEN event_type <> 'error' THEN 'lan' END AS source FROM events""")
def s02(spark, sf):
    from gaugeworks.plans.registry import plain
    from gaugeworks.sources import telemetry

    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.concat(
        F.lit('{"timestamp": "'), stamp, F.lit('", "source": "'),
        F.when(F.col("event_type") == "error", "").otherwise("lan"), F.lit('"'),
        F.when(F.col("event_type") == "view", ', "limited": true').otherwise(""),
        F.lit(', "appliances": {"'), F.col("event_type"), F.lit('": {"power_w": '),
        F.col("value").cast("string"), F.lit('}, "odd": []}}'))
    lines = table(spark, sf, "events").select(F.col("user_id").alias("site_id"), line.alias("value"))
    return plain(telemetry.power_samples(lines).select("site_id", "ts", "channel", "power_w", "limited", "source"))


@query("s03_host_lines", """
SELECT user_id AS host, epoch_us(date_trunc('second', ts)) AS ts, value AS load_1, CASE WHEN event_type = 'view' THEN value END AS cpu_percent
FROM events WHERE event_type NOT IN ('error', 'signup')""")
def s03(spark, sf):
    from gaugeworks.plans.registry import plain
    from gaugeworks.sources import telemetry

    kind = F.col("event_type")
    v = F.col("value").cast("string")
    stamp = F.when(kind == "click", F.unix_seconds("ts").cast("string")).otherwise(
        F.concat(F.lit('"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"')))
    line = F.concat(
        F.lit('{"timestamp": '), stamp, F.lit(', "load_1": '), v, F.lit(', "load_5": '), v,
        F.when(kind == "error", F.lit("")).otherwise(F.concat(F.lit(', "load_15": '), v)),
        F.when(kind == "view", F.concat(F.lit(', "cpu_percent": '), v)).when(
            kind == "signup", F.lit(', "cpu_percent": "n/a"')).otherwise(F.lit("")), F.lit("}"))
    lines = table(spark, sf, "events").select(F.col("user_id").alias("host"), line.alias("value"))
    return plain(telemetry.host_samples(lines).select("host", "ts", "load_1", "cpu_percent"))


@query("s04_generic_csv", """
SELECT event_id, epoch_us(date_trunc('minute', ts)) AS start_ts, epoch_us(date_trunc('minute', ts) + INTERVAL 15 MINUTE) AS end_ts,
  CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN NULL ELSE value END AS kwh, event_type = 'signup' AS bad FROM events""")
def s04(spark, sf):
    from gaugeworks.plans.registry import plain
    from gaugeworks.sources import intervals as src_intervals

    local = F.from_utc_timestamp("ts", "America/Chicago")
    kind = F.col("event_type")
    written = F.when(kind == "view", F.date_format(local, "MM/dd/yyyy hh:mm a")).when(
        kind == "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:00'Z'")).otherwise(
        F.date_format(local, "yyyy-MM-dd HH:mm"))
    usage = F.when(kind == "error", " - ").when(kind == "signup", "n/a").when(
        kind == "purchase", F.concat(F.col("value").cast("string"), F.lit("-est"))).otherwise(
        F.col("value").cast("string"))
    rows = table(spark, sf, "events").select(
        "event_id", written.alias("Interval Start"), usage.alias("Usage (kWh)"))
    out = src_intervals.decode_csv(rows, keep=["event_id"])
    return plain(out.select("event_id", "start_ts", "end_ts", "kwh", F.col("problem").isNotNull().alias("bad")))


@query("s05_export_csv", """
WITH l AS (SELECT event_id, make_timestamp(((epoch_us(ts) - 21600000000) // 900000000) * 900000000) AS a, value, user_id FROM events)
SELECT event_id, epoch_us(a + INTERVAL 6 HOUR) AS start_ts, epoch_us(a + INTERVAL 6 HOUR + INTERVAL 15 MINUTE) AS end_ts, value AS kwh,
  substr(sha256('10' || user_id), 1, 16) AS account_id_hash, 'csv;est=A;revision=06/15/2026' AS raw_source FROM l""")
def s05(spark, sf):
    from gaugeworks.plans.registry import plain
    from gaugeworks.sources import intervals as src_intervals

    local = F.timestamp_micros(F.floor((F.unix_micros("ts") - 21_600_000_000) / 900_000_000) * 900_000_000)
    later = F.timestamp_micros(F.unix_micros(local) + 900_000_000)
    rows = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("'10"), F.col("user_id").cast("string")).alias("ESIID"),
        F.concat(F.lit("'"), F.date_format(local, "MM/dd/yyyy")).alias("USAGE_DATE"),
        F.lit("06/15/2026").alias("REVISION_DATE"),
        F.date_format(local, "HH:mm").alias("USAGE_START_TIME"), F.date_format(later, "HH:mm").alias("USAGE_END_TIME"),
        F.col("value").cast("string").alias("USAGE_KWH"), F.lit("A ").alias("ESTIMATED_ACTUAL"))
    out = src_intervals.decode_csv(rows, keep=["event_id"])
    return plain(out.select("event_id", "start_ts", "end_ts", "kwh", "account_id_hash", "raw_source"))


@query("s06_packed_day", """
WITH d AS (SELECT event_id, CAST(ts AS DATE) AS day, value FROM events WHERE event_type <> 'error'), s AS (SELECT unnest(range(3)) AS k)
SELECT event_id, epoch_us(CAST(day AS TIMESTAMP) + INTERVAL 6 HOUR + k * INTERVAL 15 MINUTE) AS start_ts, round(value + k, 4) AS kwh FROM d, s""")
def s06(spark, sf):
    from gaugeworks.plans.registry import plain
    from gaugeworks.sources import intervals as src_intervals

    v = F.col("value")
    listed = F.concat_ws(", ", v.cast("string"), F.round(v + 1, 2).cast("string"), F.round(v + 2, 2).cast("string"), F.lit(""))
    payload = F.when(F.col("event_type") == "error", F.lit('{"data": {"errorCode": "1", "errorMessage": "none"}}')).otherwise(
        F.concat(F.lit('{"data": {"energyData": [{"RT": "G", "RD": "9"}, {"RT": "C", "RD": "'), listed, F.lit('"}]}}')))
    rows = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"), payload.alias("payload"))
    out = src_intervals.explode_packed_days(rows, keep=["event_id"])
    return plain(out.select("event_id", "start_ts", F.round("kwh", 4).alias("kwh")))
