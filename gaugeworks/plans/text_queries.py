"""Queries over titles, requests, labels, lines and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions import labels, redaction, requests, text, titles
from gaugeworks.functions import timekeys as tk
from gaugeworks.operators import resolve, rules
from gaugeworks.plans.bindings import NOW, SQL_NOW
from gaugeworks.plans.registry import plain, query, table
from gaugeworks.session import spread

# Listing titles written from the part table; every kind of title takes a share of the rows.
_TITLE = """p_name || ' ' || lower(p_type) || ' ' || CASE p_size % 6
  WHEN 0 THEN CAST(1955 + p_size * 2 AS STRING) || ' toyota tacoma ' || CAST(p_size AS STRING) || 'k miles'
  WHEN 1 THEN 'ddr4 ram kit 2x' || CAST(p_size AS STRING) || 'GB ' || CAST(1000 + p_size * 100 AS STRING) || 'MHz'
  WHEN 2 THEN 'rtx ' || CAST(3060 + 10 * (p_size % 4) AS STRING) || ' ' || CAST(p_size AS STRING) || 'GB gpu'
  WHEN 3 THEN 'samsung ' || CAST(p_size * 3 AS STRING) || ' inch tv'
  WHEN 4 THEN 'm.2 2280 nvme ssd ' || CAST(p_size AS STRING) || 'TB lot of 2'
  ELSE 'apple mac mini m1 case ' || CAST(p_size AS STRING) || 'GB' END"""
_TITLE_SQL = _TITLE.replace("STRING", "VARCHAR")
TITLES_SQL = f"""l AS (SELECT p_partkey, lower(p_brand) AS source, {_TITLE_SQL} AS title,
  CAST(floor(p_retailprice) AS INTEGER) AS price, p_size,
  'https://shop.example/p/' || p_partkey AS link FROM part)"""


def listings(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.lower("p_brand").alias("source"), F.expr(_TITLE).alias("title"),
        F.floor("p_retailprice").cast("int").alias("price"), "p_size",
        F.concat(F.lit("https://shop.example/p/"), F.col("p_partkey").cast("string")).alias("link"))


# ---- time ----------------------------------------------------------------------------

@query("b01_mean_kw", """
SELECT event_id, round(value * 0.0314159 * 4, 4) AS avg_kw FROM events""")
def b01(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", tk.mean_kw(F.col("value") * 0.0314159, 15).alias("avg_kw"))


@query("b02_local_keys", """
SELECT event_id, CAST(CAST(ts - INTERVAL 6 HOUR AS DATE) AS VARCHAR) AS day,
  CAST(hour(ts - INTERVAL 6 HOUR) AS INTEGER) AS hour, strftime(ts - INTERVAL 6 HOUR, '%Y-%m') AS month
FROM events""")
def b02(spark, sf):
    return plain(table(spark, sf, "events").select(
        "event_id", tk.local_day("ts").alias("day"), tk.local_hour("ts").alias("hour"),
        tk.local_month("ts").alias("month")))


@query("b03_cutoff", """
SELECT event_id,
  epoch_us(CAST(CAST(ts - INTERVAL 6 HOUR AS DATE) - 6 AS TIMESTAMP) + INTERVAL 6 HOUR) AS cutoff,
  CAST(CAST(ts - INTERVAL 6 HOUR AS DATE) - 7 AS VARCHAR) AS first_day,
  CAST(CAST(ts - INTERVAL 6 HOUR AS DATE) - 1 AS VARCHAR) AS last_day
FROM events""")
def b03(spark, sf):
    first, last = tk.completed_days(F.col("ts"), 7)
    return plain(table(spark, sf, "events").select(
        "event_id", tk.days_cutoff(F.col("ts"), 7).alias("cutoff"), first.alias("first_day"),
        last.alias("last_day")))


@query("b04_named_windows", f"""
WITH w AS (SELECT * FROM (VALUES
  ('last_24h', {SQL_NOW} - INTERVAL 24 HOUR, {SQL_NOW}),
  ('today', TIMESTAMP '2024-01-29 06:00:00', {SQL_NOW}),
  ('yesterday', TIMESTAMP '2024-01-28 06:00:00', TIMESTAMP '2024-01-29 06:00:00')) v("window", ws, we))
SELECT event_id, "window" FROM events JOIN w ON ts >= ws AND ts < we""")
def b04(spark, sf):
    return tk.tag_named_windows(table(spark, sf, "events"), "ts", NOW).select("event_id", "window")


@query("b05_labels", """
WITH e AS (SELECT event_id, ts - INTERVAL 6 HOUR AS t,
  make_timestamp((epoch_us(ts) // 900000000) * 900000000) - INTERVAL 6 HOUR AS a FROM events)
SELECT event_id, strftime(t, '%-I:%M %p') AS time_label, strftime(t, '%b %-d, %-I:%M %p') AS datetime_label,
  CASE WHEN minute(a) = 0 THEN strftime(a, '%-I %p') ELSE strftime(a, '%-I:%M %p') END || '–' ||
  CASE WHEN minute(a + INTERVAL 15 MINUTE) = 0 THEN strftime(a + INTERVAL 15 MINUTE, '%-I %p')
       ELSE strftime(a + INTERVAL 15 MINUTE, '%-I:%M %p') END AS interval_label
FROM e""")
def b05(spark, sf):
    start = F.floor(F.unix_micros("ts") / 900_000_000) * 900_000_000
    return table(spark, sf, "events").select(
        "event_id", tk.time_label("ts").alias("time_label"),
        tk.datetime_label("ts").alias("datetime_label"),
        tk.interval_label(F.timestamp_micros(start), F.timestamp_micros(start + 900_000_000)).alias(
            "interval_label"))


@query("b06_size_text", """
WITH s AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_size || '.5Gi' WHEN 1 THEN p_size || 'M'
    WHEN 2 THEN CAST(p_size AS VARCHAR) WHEN 3 THEN p_size || 'Ti' WHEN 4 THEN p_size || 'K' ELSE p_size || 'xb' END AS t,
    p_size * p_size * 997.13 AS bps, p_size FROM part)
SELECT p_partkey, CAST(CASE p_size % 6 WHEN 0 THEN (p_size + 0.5) * 1073741824 WHEN 1 THEN p_size * 1000000
   WHEN 2 THEN p_size WHEN 3 THEN p_size * 1099511627776 WHEN 4 THEN p_size * 1000 END AS BIGINT) AS bytes,
  CASE WHEN bps >= 1048576 THEN printf('%.1f', bps / 1048576) || ' MB/s'
       WHEN bps >= 1024 THEN printf('%.1f', bps / 1024) || ' KB/s' ELSE printf('%.0f', bps) || ' B/s' END AS rate
FROM s""")
def b06(spark, sf):
    size = "CAST(p_size AS STRING)"
    part = table(spark, sf, "part").withColumn("t", F.expr(f"""CASE p_size % 6
      WHEN 0 THEN {size} || '.5Gi' WHEN 1 THEN {size} || 'M' WHEN 2 THEN {size}
      WHEN 3 THEN {size} || 'Ti' WHEN 4 THEN {size} || 'K' ELSE {size} || 'xb' END"""))
    return part.select("p_partkey", tk.size_to_bytes("t").alias("bytes"),
                       tk.rate_label(F.col("p_size") * F.col("p_size") * 997.13).alias("rate"))


# ---- scalars -------------------------------------------------------------------------

@query("b07_price", """
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_partkey AS INTEGER) END AS text_price,
  CAST(CASE WHEN p_partkey <= 0 THEN NULL WHEN p_partkey >= 1000 THEN p_partkey // 100 ELSE p_partkey END AS INTEGER) AS unit_price
FROM part""")
def b07(spark, sf):
    raw = F.expr("""CASE WHEN p_size % 4 = 0 THEN 'make an offer'
      ELSE 'now $' || format_number(p_partkey, 0) || '.99 obo' END""")
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        "p_partkey", text.price(raw, F.lit("text")).alias("text_price"),
        text.price(key.cast("string"), F.lit("minor_units")).alias("unit_price"))


@query("b08_hash", """
SELECT c_custkey, substr(sha256(c_name), 1, 16) AS hash FROM customer""")
def b08(spark, sf):
    quoted = F.concat(F.lit(" '"), F.col("c_name"), F.lit(" "))
    return table(spark, sf, "customer").select(
        "c_custkey", text.hash_identifier(quoted).alias("hash"))


@query("b09_link", """
SELECT page_id,
  CASE WHEN url LIKE '%/en/%' THEN regexp_replace(split_part(url, '?', 1), '/+$', '') ELSE url END AS link,
  'https://shop.example.com/us/item/' || page_id || '/' AS item
FROM pages""")
def b09(spark, sf):
    pages = table(spark, sf, "pages")
    # Legacy item paths, rooted paths and foreign links all end on the same item page.
    raw = F.expr("""CASE page_id % 3 WHEN 0 THEN '/item/' || CAST(page_id AS STRING)
      WHEN 1 THEN 'https://www.shop.example.com/item/' || CAST(page_id AS STRING) ELSE url END""")
    return pages.select(
        "page_id", text.canonical_link("url", "https://shop.example.com", "/en/").alias("link"),
        text.item_page_link(F.col("page_id").cast("string"), raw, "https://shop.example.com",
                            "/item/", "/us/item/").alias("item"))


@query("b10_event_key", """
WITH p AS (SELECT *, CASE p_size % 4 WHEN 0 THEN '2024-05-01T19:30:00Z' WHEN 1 THEN '2024-05-02 20:00:00'
   WHEN 2 THEN '2024-05-03T' ELSE '' END AS s FROM part),
k AS (SELECT *, trim(regexp_replace(lower(p_name || '!! ' || p_type), '[^a-z0-9]+', ' ', 'g')) AS t,
   trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS v,
   CASE p_size % 4 WHEN 0 THEN '2024-05-01 19:30' WHEN 1 THEN '2024-05-02 20:00' WHEN 2 THEN '2024-05-03' ELSE '' END AS n FROM p)
SELECT p_partkey, n AS starts_key, 'event|' || substr(sha1(t || '|' || v || '|' || n), 1, 16) AS event_key,
  'shop|' || p_partkey AS provider_key FROM k""")
def b10(spark, sf):
    starts = F.expr("""CASE p_size % 4 WHEN 0 THEN '2024-05-01T19:30:00Z'
      WHEN 1 THEN '2024-05-02 20:00:00' WHEN 2 THEN '2024-05-03T' ELSE '' END""")
    title = F.concat(F.col("p_name"), F.lit("!! "), F.col("p_type"))
    return table(spark, sf, "part").select(
        "p_partkey", text.local_start_key(starts).alias("starts_key"),
        text.show_key(title, "p_brand", starts).alias("event_key"),
        text.provider_key(F.lit("shop"), F.col("p_partkey").cast("string")).alias("provider_key"))


@query("b11_name_key", """
WITH w AS (SELECT p_partkey, split_part(p_name, ' ', 2) AS w, p_name, p_size FROM part),
s AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN lower(w) || 's' WHEN 1 THEN lower(w) || 'ies' WHEN 2 THEN lower(w) || 'oes'
   WHEN 3 THEN lower(w) || 'ches' WHEN 4 THEN lower(w) || 'ss' ELSE lower(p_name) END AS k FROM w)
SELECT p_partkey, CASE WHEN contains(k, ' ') OR length(k) <= 3 THEN k
  WHEN k LIKE '%ies' AND length(k) > 4 THEN left(k, length(k) - 3) || 'y'
  WHEN regexp_matches(k, '(oes|xes|ches|shes)$') THEN left(k, length(k) - 2)
  WHEN regexp_matches(k, '(ss|us)$') THEN k WHEN regexp_matches(k, '[^g]s$') THEN left(k, length(k) - 1) ELSE k END AS name_key
FROM s""")
def b11(spark, sf):
    word = F.expr("""'  ' || CASE p_size % 6 WHEN 0 THEN upper(split_part(p_name, ' ', 2)) || 's!'
      WHEN 1 THEN split_part(p_name, ' ', 2) || 'ies' WHEN 2 THEN split_part(p_name, ' ', 2) || 'oes.'
      WHEN 3 THEN split_part(p_name, ' ', 2) || 'ches' WHEN 4 THEN split_part(p_name, ' ', 2) || 'ss'
      ELSE replace(p_name, ' ', ' , ') END""")
    return table(spark, sf, "part").select("p_partkey", text.name_key(word).alias("name_key"))


@query("b12_title_attrs", f"""
WITH {TITLES_SQL}
SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN p_size * 1000 END AS miles,
  CASE p_size % 6 WHEN 1 THEN 2 * p_size WHEN 2 THEN p_size WHEN 5 THEN p_size END AS ram_gb,
  CASE p_size % 6 WHEN 1 THEN 2 * p_size WHEN 2 THEN p_size WHEN 4 THEN p_size * 1024 WHEN 5 THEN p_size END AS disk_gb,
  CASE WHEN p_size % 6 = 0 AND 1955 + p_size * 2 BETWEEN 1960 AND 2030 THEN 1955 + p_size * 2 END AS model_year,
  CASE WHEN p_size % 6 = 1 THEN 1000 + p_size * 100 END AS speed_mhz,
  CASE WHEN p_size % 6 = 2 THEN p_size END AS vram_gb,
  CASE WHEN p_size % 6 = 3 AND p_size * 3 BETWEEN 20 AND 120 THEN p_size * 3 END AS screen_inches,
  CASE WHEN p_size % 6 = 4 THEN 'nvme' END AS protocol,
  CASE WHEN p_size % 6 = 4 THEN '2280' END AS form
FROM l""")
def b12(spark, sf):
    t = F.col("title")
    lower = F.lower("title")
    return listings(spark, sf).select(
        "p_partkey", titles.miles(t).alias("miles"), titles.ram_gb(t).alias("ram_gb"),
        titles.disk_gb(t).alias("disk_gb"), titles.model_year(t).alias("model_year"),
        titles.speed_mhz(t).alias("speed_mhz"), titles.vram_gb(t).alias("vram_gb"),
        titles.screen_inches(t).alias("screen_inches"),
        titles.storage_protocol(lower).alias("protocol"), titles.storage_form(lower).alias("form"))


_RANK_SQL = ("CASE WHEN p_size % 6 = 2 THEN CASE p_size % 4 WHEN 0 THEN 17 WHEN 2 THEN 27 "
             "WHEN 1 THEN 22 ELSE 34 END END")


@query("b13_tier_rank", f"WITH {TITLES_SQL} SELECT p_partkey, {_RANK_SQL} AS gpu_rank FROM l")
def b13(spark, sf):
    return listings(spark, sf).select("p_partkey", titles.gpu_rank("title").alias("gpu_rank"))


@query("b14_subtype", f"""
WITH {TITLES_SQL}
SELECT p_partkey, FALSE AS whole_system, FALSE AS whole_computer,
  p_size % 6 = 5 AS device, FALSE AS cosmetics, FALSE AS mac_accessory,
  p_size % 6 = 4 AS bulk_lot FROM l""")
def b14(spark, sf):
    t = F.lower("title")
    return listings(spark, sf).select(
        "p_partkey", titles.is_whole_system(t).alias("whole_system"),
        titles.is_whole_computer(t).alias("whole_computer"),
        titles.has_device_evidence(t).alias("device"), titles.is_cosmetics(t).alias("cosmetics"),
        titles.is_mac_accessory(t).alias("mac_accessory"), titles.is_bulk_lot(t).alias("bulk_lot"))


@query("b15_vehicle", f"""
WITH {TITLES_SQL}, t AS (SELECT p_partkey, title || CASE WHEN p_size % 12 = 0 THEN ' or tundra' ELSE '' END AS title FROM l)
SELECT p_partkey, regexp_matches(title, '\\btacoma\\b') AND NOT regexp_matches(title, '\\btundra\\b') AS matches,
  regexp_matches(title, '\\btacoma\\b') AND regexp_matches(title, '\\btundra\\b') AS ambiguous FROM t""")
def b15(spark, sf):
    t = F.concat(F.col("title"), F.when(F.col("p_size") % 12 == 0, F.lit(" or tundra")).otherwise(""))
    out = listings(spark, sf).withColumn("t", F.lower(t))
    return out.select(
        "p_partkey",
        titles.vehicle_matches(F.col("t"), F.lit("toyota"), F.lit("tacoma"),
                               F.array(F.lit("toyota hilux"))).alias("matches"),
        (F.size(titles.vehicle_models(F.col("t"))) > 1).alias("ambiguous"))


# The stand-in documents hold quoted secrets, mail, cards and hex keys inside prose.
def _redact_sql(rules_, source: str) -> str:
    out = source
    for pattern, replacement in rules_:
        flags = "gi" if pattern.startswith("(?i)") else "g"
        pattern = pattern.removeprefix("(?i)").replace("'", "''")
        replacement = replacement.replace("$1", "\\1").replace("$2", "\\2")
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', '{flags}')"
    return out


@query("b16_redact_log", f"""
SELECT doc_id, md5({_redact_sql(redaction.LOG_RULES, "trim(replace(text, ' = ', '='), chr(9) || chr(10) || ' ')")}) AS digest
FROM documents""")
def b16(spark, sf):
    lines = F.trim(F.replace("text", F.lit(" = "), F.lit("=")), F.lit("\t\n "))
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(redaction.redact_log(lines)).alias("digest"))


@query("b17_redact_payload", f"""
SELECT doc_id, md5({_redact_sql(redaction.PAYLOAD_RULES, "text")}) AS digest FROM documents""")
def b17(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(redaction.redact_payload("text")).alias("digest"))


@query("b18_redact_nested", """
SELECT event_id, props AS note, '[REDACTED]' AS account_id, event_type AS kind, '[REDACTED_HASH]' AS row_hash, 'user ' || user_id AS label,
  '[REDACTED]' AS token, 'Bearer [REDACTED]' AS auth, '[REDACTED_PATH] ok' AS deep_path, user_id % 7 AS number, 'PASSWORD=[REDACTED]' AS plain FROM events""")
def b18(spark, sf):
    """Objects, lists and six levels of nesting; keys that are secrets, texts that hold some."""
    user = F.col("user_id").cast("string")
    leaf = F.struct(F.concat(F.lit("/srv/data/"), user, F.lit(" ok")).alias("path"), (F.col("user_id") % 7).alias("n"))
    deep = leaf
    for name in "dcba":
        deep = F.struct(deep.alias(name))
    payload = F.to_json(F.struct(
        F.col("props").alias("note"), F.col("user_id").alias("account_id"),
        F.struct(F.col("event_type").alias("kind"), F.sha2("props", 256).alias("row_hash")).alias("detail"),
        F.array(F.struct(F.concat(F.lit("user "), user).alias("label"), user.alias("Token")),
                F.struct(F.concat(F.lit("bearer "), user).alias("label"), user.alias("Token"))).alias("items"),
        deep.alias("deep")))
    out = table(spark, sf, "events").select(
        "event_id", redaction.redact_json(payload).alias("p"),
        redaction.redact_json(F.concat(F.lit("PASSWORD="), user)).alias("plain"))

    def at(path: str, name: str):
        return F.get_json_object("p", path).alias(name)

    return out.select(
        "event_id", at("$.note", "note"), at("$.account_id", "account_id"), at("$.detail.kind", "kind"),
        at("$.detail.row_hash", "row_hash"), at("$.items[0].label", "label"), at("$.items[1].Token", "token"),
        at("$.items[1].label", "auth"), at("$.deep.a.b.c.d.path", "deep_path"),
        at("$.deep.a.b.c.d.n", "number").cast("long").alias("number"), "plain")


@query("b18_redact_map", """
SELECT event_id, '[REDACTED]' AS token, '[REDACTED_HASH]' AS row_hash, event_type AS kind FROM events""")
def b18_map(spark, sf):
    values = F.create_map(F.lit("Token"), F.col("event_type"), F.lit("row_hash"), F.col("props"),
                          F.lit("kind"), F.col("event_type"))
    out = table(spark, sf, "events").select("event_id", redaction.redact_map(values).alias("m"))
    return out.select("event_id", F.col("m")["Token"].alias("token"),
                      F.col("m")["row_hash"].alias("row_hash"), F.col("m")["kind"].alias("kind"))


@query("b19_list_parse", """
WITH t AS (SELECT p_partkey, p_size, lower(p_name) AS name, p_size % 3 AS k FROM part),
x AS (SELECT p_partkey, 0 AS position, name, CAST(p_size * 12 AS DOUBLE) AS quantity, CAST(NULL AS VARCHAR) AS unit FROM t
  UNION ALL SELECT p_partkey, 1, name, 0.5, 'lb' FROM t
  UNION ALL SELECT p_partkey, 2, name, 1.0, NULL FROM t
  UNION ALL SELECT p_partkey, 3, CASE WHEN k = 0 THEN 'eggs' ELSE 'boxes of ' || name END, 3.0, NULL FROM t)
SELECT p_partkey, CAST(position AS INTEGER) AS position, name AS normalized_name, quantity, unit FROM x""")
def b19(spark, sf):
    written = F.expr("""CAST(p_size AS STRING) || ' dozen ' || p_name || '\\n# a comment\\n - 1/2 lb '
      || p_name || ', 1. ' || upper(p_name) || '; ' || p_name || '\\n3 x '
      || CASE WHEN p_size % 3 = 0 THEN 'eggs # brown' ELSE 'boxes of ' || p_name END""")
    out = resolve.parse_lists(table(spark, sf, "part").withColumn("t", written), ["p_partkey"], "t")
    return out.select("p_partkey", "position", "normalized_name", "quantity", "unit")


_GENRE_SQL = """g AS (SELECT p_partkey, p_name, p_size % 9 AS k, CASE p_size % 9 WHEN 0 THEN 'Rock' WHEN 1 THEN 'Hard  Rock!' WHEN 2 THEN 'Pop'
  WHEN 3 THEN 'concert, rock' WHEN 4 THEN 'NBA, sports' WHEN 5 THEN 'Latin rock' WHEN 6 THEN '' WHEN 7 THEN 'comedy club/standup'
  ELSE 'music of ' || p_name END AS label FROM part)"""
_GENRE = """CASE p_size % 9 WHEN 0 THEN 'Rock' WHEN 1 THEN 'Hard  Rock!' WHEN 2 THEN 'Pop'
  WHEN 3 THEN 'concert, rock' WHEN 4 THEN 'NBA, sports' WHEN 5 THEN 'Latin rock' WHEN 6 THEN ''
  WHEN 7 THEN 'comedy club/standup' ELSE 'music of ' || p_name END"""


@query("b20_genre", f"""
WITH {_GENRE_SQL} SELECT p_partkey, CASE k WHEN 0 THEN 'positive' WHEN 1 THEN 'positive' WHEN 2 THEN 'negative'
  WHEN 3 THEN 'positive' WHEN 4 THEN 'neutral' WHEN 5 THEN 'positive' WHEN 6 THEN 'neutral' WHEN 7 THEN 'neutral'
  ELSE 'neutral' END AS signal FROM g""")
def b20(spark, sf):
    return table(spark, sf, "part").select("p_partkey", labels.genre_signal(F.expr(_GENRE)).alias("signal"))


@query("b21_taxonomy", f"""
WITH {_GENRE_SQL} SELECT p_partkey, CASE k WHEN 0 THEN 'positive' WHEN 1 THEN 'positive' WHEN 2 THEN 'neutral'
  WHEN 3 THEN 'positive' WHEN 4 THEN 'negative' WHEN 5 THEN 'positive' WHEN 6 THEN 'neutral' WHEN 7 THEN 'negative'
  ELSE 'neutral' END AS signal FROM g""")
def b21(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", labels.taxonomy_signal(F.expr(_GENRE)).alias("signal"))


def _votes_sql(words) -> str:
    parts = [f"(contains(t, '{w}'))::INT" for w in words if w not in requests.WHOLE_WORDS]
    parts += [f"(regexp_matches(t, '\\b{w}\\b'))::INT" for w in requests.WHOLE_WORDS if w in words]
    return " + ".join(parts)


@query("b22_topic", f"""
WITH {TITLES_SQL}, v AS (SELECT p_partkey, lower(title) AS t FROM l),
s AS (SELECT p_partkey, t, {_votes_sql(requests.TOPIC_WORDS['vehicles'])} AS a,
  {_votes_sql(requests.TOPIC_WORDS['computer_parts'])} AS b, {_votes_sql(requests.TOPIC_WORDS['home_theater'])} AS c FROM v)
SELECT p_partkey, CASE WHEN regexp_matches(t, '\\b(rtx|gtx)\\b') OR regexp_matches(t, '\\b(gpu|graphics card|video card)\\b')
   THEN 'computer_parts' WHEN greatest(a, b, c) = 0 THEN 'general_marketplace' WHEN a >= b AND a >= c THEN 'vehicles'
   WHEN b >= c THEN 'computer_parts' ELSE 'home_theater' END AS topic FROM s""")
def b22(spark, sf):
    return listings(spark, sf).select("p_partkey", requests.topic("title").alias("topic"))


_REQUEST = """CASE p_size % 4
  WHEN 0 THEN 'find a toyota tacoma under ' || CAST(p_size AS STRING) || 'k miles less than $' || CAST(p_size * 1000 AS STRING) || ' 2015 or newer'
  WHEN 1 THEN 'honda civic under ' || CAST(p_size AS STRING) || '.5k before 2020'
  WHEN 2 THEN 'rtx 3080 at least ' || CAST(p_size AS STRING) || 'gb vram up to ' || CAST(p_size AS STRING) || '00 dollars'
  ELSE 'samsung ' || CAST(p_size + 20 AS STRING) || ' inch 4k oled tv or ddr4 ram at least 16gb over 3000mhz' END"""


@query("b23_constraints", """
SELECT p_partkey,
  CASE p_size % 4 WHEN 0 THEN 'vehicles' WHEN 1 THEN 'vehicles' WHEN 2 THEN 'computer_parts' ELSE 'home_theater' END AS topic,
  CASE p_size % 4 WHEN 0 THEN p_size * 1000 WHEN 1 THEN p_size * 1000 + 500 WHEN 2 THEN p_size * 100 END AS max_price,
  CASE p_size % 4 WHEN 0 THEN p_size * 1000 END AS max_miles,
  CASE p_size % 4 WHEN 0 THEN 2015 END AS min_year, CASE p_size % 4 WHEN 1 THEN 2020 END AS max_year,
  CASE p_size % 4 WHEN 0 THEN 'toyota' WHEN 1 THEN 'honda' END AS vehicle_make,
  CASE p_size % 4 WHEN 0 THEN 'tacoma' WHEN 1 THEN 'civic' END AS vehicle_model
FROM part""")
def b23(spark, sf):
    part = spread(table(spark, sf, "part").select("p_partkey", "p_size"))
    out = requests.with_request_fields(part.withColumn("r", F.expr(_REQUEST)), "r")
    return out.select("p_partkey", "topic", "max_price", "max_miles", "min_year", "max_year",
                      "vehicle_make", "vehicle_model")


@query("b24_request_attrs", """
SELECT p_partkey, CASE p_size % 4 WHEN 3 THEN p_size + 20 END AS size_inches,
  CASE WHEN p_size % 4 = 3 THEN '4k' WHEN p_size % 4 = 0 AND p_size % 10 = 8 THEN '8k'
    WHEN p_size % 4 = 0 AND p_size % 10 = 4 THEN '4k' WHEN p_size % 4 = 0 AND p_size % 10 = 2 THEN '1440p' END AS resolution, CASE p_size % 4 WHEN 3 THEN 'samsung' END AS tv_brand,
  CASE p_size % 4 WHEN 3 THEN 'oled' END AS tv_panel, CASE p_size % 4 WHEN 3 THEN 'ddr4' END AS ram_type,
  CASE p_size % 4 WHEN 2 THEN p_size WHEN 3 THEN 16 END AS min_gb, CASE p_size % 4 WHEN 3 THEN 3000 END AS min_speed_mhz,
  CASE p_size % 4 WHEN 2 THEN p_size END AS min_vram_gb, CASE p_size % 4 WHEN 2 THEN 'RTX 3080' END AS gpu_model,
  CASE p_size % 4 WHEN 2 THEN CAST(p_size AS VARCHAR) WHEN 3 THEN '16' ELSE '' END AS capacities,
  CASE p_size % 4 WHEN 2 THEN p_size WHEN 3 THEN 16 END AS exact_gb,
  CASE p_size % 4 WHEN 0 THEN 'find a toyota tacoma k 2015 or newer' WHEN 1 THEN 'honda civic .5k before 2020'
    WHEN 2 THEN 'rtx 3080 at least ' || p_size || 'gb vram'
    ELSE 'samsung ' || (p_size + 20) || ' inch 4k oled tv or ddr4 ram at least 16gb mhz' END AS phrase
FROM part""")
def b24(spark, sf):
    out = requests.with_request_fields(table(spark, sf, "part").withColumn("r", F.expr(_REQUEST)), "r")
    return out.select(
        "p_partkey", "size_inches", "resolution", "tv_brand", "tv_panel", "ram_type", "min_gb",
        "min_speed_mhz", "min_vram_gb", "gpu_model",
        F.array_join(F.transform("capacities_gb", lambda c: c.cast("string")), ",").alias("capacities"),
        "exact_gb", F.col("search_phrase").alias("phrase"))


_MEAL = """CASE p_size % 5 WHEN 0 THEN 'V-Tofu ' || p_name WHEN 1 THEN 'Veggie  wrap ' || p_name
  WHEN 2 THEN 'Cheese pizza' WHEN 3 THEN 'Grilled chicken ' || p_name ELSE p_name END"""


@query("b25_label_class", """
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'vegetarian' WHEN 1 THEN 'vegetarian' WHEN 2 THEN 'uncertain'
  WHEN 3 THEN 'non_vegetarian' ELSE 'uncertain' END AS meal_class FROM part""")
def b25(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", labels.meal_class(F.expr(_MEAL)).alias("meal_class"))


@query("b25_choose", f"""
WITH o AS (SELECT p_partkey, p_brand || '/' || (p_partkey // 50) AS grp, p_size % 5 AS k, {_MEAL} AS label FROM part),
d AS (SELECT grp, label, min(p_partkey) AS pos, any_value(k) AS k FROM o GROUP BY grp, label),
c AS (SELECT grp, count(*) AS n, count_if(k IN (0, 1)) AS v, count_if(k = 3) AS m,
   arg_min(label, pos) FILTER (WHERE k = 3) AS pick FROM d GROUP BY grp)
SELECT grp, pick AS selected, CASE WHEN n = 2 AND v = 1 AND m = 1 THEN 'two_choice_exclude_vegetarian'
  WHEN m > 0 THEN 'preferred_non_vegetarian' ELSE 'UNCERTAIN_MEAL_SKIPPED' END AS reason FROM c""")
def b25_choose(spark, sf):
    options = table(spark, sf, "part").select(
        "p_partkey", F.expr("p_brand || '/' || CAST(p_partkey DIV 50 AS STRING)").alias("grp"),
        F.expr(_MEAL).alias("label"))
    return labels.choose_meal(options, "grp", "label", "p_partkey")


@query("b26_relevance", f"""
WITH {TITLES_SQL} SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN TRUE
   ELSE regexp_matches(lower(title), '\\btacoma\\b') OR regexp_matches(lower(title), '\\bsmall\\b') END AS relevant FROM l""")
def b26(spark, sf):
    wanted = F.when(F.col("p_size") % 2 == 0, F.lit("the new ex")).otherwise(F.lit("small tacoma for sale"))
    return listings(spark, sf).select("p_partkey", text.is_relevant("title", wanted).alias("relevant"))


_LINE = """'1998-01-02 03:04:05 ' || CASE o_orderpriority WHEN '1-URGENT' THEN '[ERROR] cloud read failed '
  WHEN '2-HIGH' THEN '[warn] connection lost ' WHEN '3-MEDIUM' THEN '[CRITICAL] bad config '
  WHEN '5-LOW' THEN 'request blocked ' ELSE '[INFO] order ' END || o_orderstatus"""


@query("b27_log_level", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'ERROR' WHEN '2-HIGH' THEN 'WARNING'
   WHEN '3-MEDIUM' THEN 'CRITICAL' END AS level,
  o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AS error_line,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'cloud' WHEN '2-HIGH' THEN 'local' WHEN '3-MEDIUM' THEN 'config' ELSE 'api' END AS kind
FROM orders""")
def b27(spark, sf):
    line = F.expr(_LINE)
    return table(spark, sf, "orders").select(
        "o_orderkey", labels.log_level(line).alias("level"),
        labels.is_error_line(line).alias("error_line"), labels.error_class(line).alias("kind"))


@query("b29_payload_shape", """
WITH e AS (SELECT user_id % 4 AS k FROM events)
SELECT CASE k WHEN 0 THEN '{"k": "int"}' WHEN 1 THEN '{"list": [{"token": "[REDACTED]"}, "...(2 items)"], "none": null}'
  WHEN 2 THEN '{"a": {"b": {"c": {"d": {"e": {"deep": "float"}}}}}, "on": "bool"}' END AS shape, count(*) AS n FROM e GROUP BY k""")
def b29(spark, sf):
    """A flat payload, a list of objects with an empty value, six levels, and text that is no JSON."""
    kind = F.col("user_id") % 4
    payload = (
        F.when(kind == 0, F.col("props"))
        .when(kind == 1, F.lit('{"list": [{"token": "x"}, {"token": "y"}], "none": null}'))
        .when(kind == 2, F.lit('{"a": {"b": {"c": {"d": {"e": {"deep": 1.5}}}}}, "on": true}'))
        .otherwise(F.lit("no payload")))
    shapes = table(spark, sf, "events").select(redaction.payload_shape(payload).alias("shape"))
    return shapes.groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


# ---- rules ---------------------------------------------------------------------------

def _rules_column():
    """Rules per kind of title, as one struct column with all fields typed."""
    from gaugeworks import schemas

    k = F.col("p_size") % 6

    def when(value, *kinds):
        return F.when(k.isin(*kinds), value)

    strings = lambda *v: F.array(*[F.lit(x) for x in v])
    fields = {
        "vertical": when("vehicles", 0).when(k.isin(1, 2, 4), "computer_parts"),
        "min_price": when(F.lit(950), 3),
        "max_price": when(F.lit(1050), 0, 5),
        "include_keywords": when(strings("toyota tacoma"), 0).when(k == 1, strings("ram"))
        .when(k == 3, strings("television", "lg", "sony", "small", "large")),
        "require_all_keywords": when(strings("rtx", "red"), 2),
        "exclude_keywords": when(strings("old", "hot"), 1),
        "max_miles": when(F.lit(30000), 0), "min_year": when(F.lit(1980), 0),
        "min_capacity_gb": when(F.lit(32), 1), "min_speed_mhz": when(F.lit(3000), 1),
        "min_vram_gb": when(F.lit(8), 2), "min_gpu_class": when("RTX 3080", 2),
        "min_size_inches": when(F.lit(55), 3), "max_size_inches": when(F.lit(100), 3),
        "hunt_subtype": when("ram", 1).when(k == 2, "gpu").when(k == 4, "storage"),
        "product_family": when("apple_mac_mini", 5), "target_product_type": when("device", 5),
        "storage_form_factor": when("m2", 4),
        "excluded_storage_protocols": F.when((k == 4) & (F.col("p_size") < 20), strings("nvme")),
        "allowed_capacity_gb": when(F.array(F.lit(22528), F.lit(28672)), 4),
        "reject_bulk_lots": F.when((k == 4) & (F.col("p_size") > 30), F.lit(True)),
    }
    return F.struct(*[
        fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.struct_of(schemas.RULES).fields
    ])


@query("f01_first_reason", f"""
WITH {TITLES_SQL}
SELECT p_partkey, CASE p_size % 6
 WHEN 0 THEN CASE WHEN price > 1050 THEN '[vehicles] price $' || price || ' > max_price $1050'
   WHEN p_size * 1000 > 30000 THEN '[vehicles] mileage ' || p_size || ',000 > max_miles 30,000'
   WHEN 1955 + p_size * 2 >= 1960 AND 1955 + p_size * 2 < 1980 THEN '[vehicles] year ' || (1955 + p_size * 2) || ' < min_year 1980' END
 WHEN 1 THEN CASE WHEN contains(title, 'old') THEN '[computer_parts] excluded keyword "old"'
   WHEN contains(title, 'hot') THEN '[computer_parts] excluded keyword "hot"'
   WHEN 2 * p_size < 32 THEN '[computer_parts] capacity ' || (2 * p_size) || 'GB < min_capacity_gb 32GB'
   WHEN 1000 + p_size * 100 < 3000 THEN '[computer_parts] speed ' || (1000 + p_size * 100) || 'MHz < min_speed_mhz 3000MHz' END
 WHEN 2 THEN CASE WHEN NOT contains(title, 'red') THEN '[computer_parts] title missing required keyword "red"'
   WHEN p_size < 8 THEN '[computer_parts] vram ' || p_size || 'GB < min_vram_gb 8GB'
   WHEN {_RANK_SQL} < 27 THEN '[computer_parts] GPU in title is below min_gpu_class "RTX 3080" (tier ' || {_RANK_SQL} || ' < 27)' END
 WHEN 3 THEN CASE WHEN price < 950 THEN 'price $' || price || ' < min_price $950'
   WHEN NOT (contains(title, 'small') OR contains(title, 'large'))
     THEN 'title missing include keyword (any of: "television", "lg", "sony", "small" +1 more)'
   WHEN p_size * 3 BETWEEN 20 AND 54 THEN 'TV size ' || (p_size * 3) || '" < min_size_inches 55"'
   WHEN p_size * 3 BETWEEN 101 AND 120 THEN 'TV size ' || (p_size * 3) || '" > max_size_inches 100"' END
 WHEN 4 THEN CASE WHEN p_size > 30 THEN '[computer_parts] bulk/lot listing rejected'
   WHEN p_size < 20 THEN '[computer_parts] excluded storage protocol "nvme"'
   WHEN p_size NOT IN (22, 28) THEN '[computer_parts] capacity not in allowed set' END
 ELSE CASE WHEN price > 1050 THEN 'price $' || price || ' > max_price $1050' END END AS reason
FROM l""")
def f01(spark, sf):
    judged = rules.with_reason(listings(spark, sf).withColumn("rules", _rules_column()))
    return judged.select("p_partkey", "reason")
