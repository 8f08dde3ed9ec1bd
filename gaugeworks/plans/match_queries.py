"""Queries over listings, saved searches, resolution, shows and keyed sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks import schemas
from gaugeworks.operators import health, listings as ops, resolve, shows
from gaugeworks.functions import labels, text
from gaugeworks.plans.registry import plain, query, table
from gaugeworks.plans.text_queries import TITLES_SQL, listings
from gaugeworks.sinks import tables as sinks

# ---- saved searches, one per supplier ------------------------------------------------

_CATALOG = """s_suppkey AS k, CAST(s_suppkey AS STRING) AS search_id,
  'search_' || CAST(s_suppkey % 40 AS STRING) AS name,
  CASE s_suppkey % 5 WHEN 0 THEN 'vehicles' WHEN 1 THEN 'computer parts' WHEN 2 THEN 'computer parts'
       WHEN 3 THEN 'tv home' ELSE '' END AS category,
  'brand#' || CAST(s_nationkey + 1 AS STRING) AS site_a,
  'brand#' || CAST((s_nationkey + 7) % 25 + 1 AS STRING) AS site_b,
  CASE s_suppkey % 4 WHEN 0 THEN ' Active' WHEN 1 THEN 'paused' WHEN 2 THEN 'ended' ELSE 'draft' END AS status"""


def searches(spark, sf):
    k = F.col("k") % 5
    strings = lambda *v: F.array(*[F.lit(x) for x in v])
    rows = table(spark, sf, "supplier").selectExpr(*_split_top(_CATALOG))
    return rows.select(
        "search_id", "name", "category",
        F.when(F.col("k") % 3 == 0, F.array("site_a")).otherwise(F.array("site_a", "site_b")).alias("source_sites"),
        F.when(F.col("k") % 11 == 10, F.array().cast("array<string>"))
        .when(k == 0, strings("toyota", "tacoma")).when(k == 1, strings("ddr4 kit"))
        .when(k == 2, strings("rtx")).when(k == 3, strings("tv")).otherwise(strings("mini", "PC")).alias("search_terms"),
        F.col("status"), F.when(F.col("k") % 2 == 0, F.lit("two words")).otherwise(F.lit("austin")).alias("location"),
        F.when(k == 4, F.lit(None)).otherwise(F.lit(1050)).cast("int").alias("max_price"),
        F.when(k == 0, strings("toyota hilux")).when(k == 1, strings("kit 2x")).when(k == 2, strings("3080", "3090"))
        .when(k == 3, strings("Inch TV", "inch")).otherwise(F.array().cast("array<string>")).alias("include_keywords"),
        F.when(k == 1, strings("old")).otherwise(F.array().cast("array<string>")).alias("exclude_keywords"),
        F.when(k == 0, F.lit('{"make": "Toyota", "model": "Tacoma", "max_miles": 40000}'))
        .when(k == 1, F.lit('{"min_capacity_gb": 20}'))
        .when(k == 3, F.lit('{"min_size_inches": 40}')).otherwise(F.lit("{}")).alias("adapter_options"),
        F.lit(None).cast("timestamp").alias("created_at"))


def _split_top(block):
    """Columns of a select list, cut at commas outside brackets and quotes."""
    out, depth, quoted, current = [], 0, False, ""
    for ch in block:
        quoted ^= ch == "'"
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth and not quoted:
            out.append(current.strip())
            current = ""
        else:
            current += ch
    return [*out, current.strip()]


SEARCH_SQL = f"""q AS (SELECT {_CATALOG.replace('STRING', 'VARCHAR')} FROM supplier),
f AS (SELECT k, search_id, site_a AS source FROM q WHERE k % 11 <> 10
  UNION ALL SELECT k, search_id, site_b FROM q WHERE k % 11 <> 10 AND k % 3 <> 0)"""

_PASS_SQL = f"""{TITLES_SQL}, {SEARCH_SQL},
m AS (SELECT f.search_id, f.k, l.* FROM f JOIN l ON l.source = f.source WHERE CASE f.k % 5
  WHEN 0 THEN price <= 1050 AND regexp_matches(title, '\\btacoma\\b') AND p_size * 1000 <= 40000
  WHEN 1 THEN price <= 1050 AND contains(title, 'kit 2x') AND NOT contains(title, 'old') AND 2 * p_size >= 20
  WHEN 2 THEN price <= 1050 AND (contains(title, '3080') OR contains(title, '3090'))
  WHEN 3 THEN price <= 1050 AND contains(title, 'inch') AND NOT (p_size * 3 BETWEEN 20 AND 39)
  ELSE TRUE END)"""


def _runnable(spark, sf):
    return ops.compile_searches(searches(spark, sf)).filter("invalid IS NULL")


@query("s08_catalog_scan", """
SELECT s_suppkey, s_suppkey % 4 = 0 AS active, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS site_count,
  CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'x' END AS first_site, s_suppkey % 5 <> 4 AS enabled
FROM supplier""")
def s08(spark, sf):
    from gaugeworks.sources import catalog as src

    raw = table(spark, sf, "supplier").select(
        "s_suppkey", F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'active' ELSE 'ended' END").alias("status"),
        F.expr("""CASE WHEN s_suppkey % 2 = 0 THEN '["a", "b"]' ELSE '["x"]' END""").alias("source_sites"),
        F.expr("CASE s_suppkey % 5 WHEN 4 THEN false WHEN 3 THEN true END").alias("enabled"))
    out = src.decode_lists(raw, ["source_sites"])
    return out.select("s_suppkey", (F.col("status") == "active").alias("active"),
                      F.size("source_sites").alias("site_count"),
                      F.get("source_sites", F.lit(0)).alias("first_site"), "enabled")


@query("s21_list_cell", """
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'a|b c' WHEN 1 THEN 'x|y' WHEN 2 THEN s_name ELSE '' END AS items FROM supplier""")
def s21(spark, sf):
    raw = F.expr("""CASE s_suppkey % 4 WHEN 0 THEN ' ["a", "b c"]' WHEN 1 THEN 'x, y,' WHEN 2 THEN s_name ELSE ' ' END""")
    return table(spark, sf, "supplier").select(
        "s_suppkey", F.array_join(text.lenient_list(raw), "|").alias("items"))


@query("j01_match", f"""
WITH {_PASS_SQL},
sz AS (SELECT source, count(*) AS n FROM l GROUP BY source),
st AS (SELECT link FROM l WHERE p_size <= 10),
c AS (SELECT search_id, source, count(*) AS passed FROM m GROUP BY ALL),
n AS (SELECT search_id, source, count(*) AS fresh FROM
   (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY link ORDER BY search_id, source) = 1) x
   WHERE link NOT IN (SELECT link FROM st) GROUP BY ALL)
SELECT f.search_id, f.source, coalesce(fresh, 0) AS new_count, coalesce(passed, 0) - coalesce(fresh, 0) AS existing_count,
  coalesce(sz.n, 0) - coalesce(passed, 0) AS filtered_count
FROM f LEFT JOIN sz ON sz.source = f.source LEFT JOIN c ON c.search_id = f.search_id AND c.source = f.source
LEFT JOIN n ON n.search_id = f.search_id AND n.source = f.source""")
def j01(spark, sf):
    rows = listings(spark, sf)
    stored = rows.filter("p_size <= 10").select("link")
    return ops.run_counters(rows, _runnable(spark, sf), stored, order=("search_id", "source"))


@query("j01_passing", f"WITH {_PASS_SQL} SELECT search_id, source, link FROM m")
def j01_passing(spark, sf):
    return ops.matches(listings(spark, sf), _runnable(spark, sf)).select("search_id", "source", "link")


@query("j02_fanout", f"WITH {SEARCH_SQL} SELECT search_id, source FROM f")
def j02(spark, sf):
    return ops.fan_out(_runnable(spark, sf)).select("search_id", "source")


@query("j03_rules", f"""
WITH {SEARCH_SQL}
SELECT search_id, name,
  CASE WHEN k % 11 = 10 THEN '' ELSE CASE k % 5 WHEN 0 THEN 'toyota tacoma' WHEN 1 THEN 'ddr4 kit' WHEN 2 THEN 'rtx' WHEN 3 THEN 'tv' ELSE 'mini PC' END END AS query,
  CASE WHEN k % 2 = 0 THEN 'houston' ELSE 'austin' END AS city, 10 AS run_limit,
  CASE k % 5 WHEN 0 THEN 'vehicles' WHEN 1 THEN 'computer_parts' WHEN 2 THEN 'computer_parts' WHEN 3 THEN 'tv_home' END AS vertical,
  CASE WHEN k % 5 = 0 THEN 'Toyota' END AS make, CASE WHEN k % 5 = 0 THEN 'Tacoma' END AS model,
  CASE WHEN k % 5 <> 4 THEN 1050 END AS max_price, CASE WHEN k % 5 = 0 THEN 40000 END AS max_miles,
  CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 END AS include_count,
  CASE WHEN k % 11 = 10 THEN '''' || name || ''' has no search_terms and cannot be executed' END AS invalid
FROM q""")
def j03(spark, sf):
    out = ops.compile_searches(searches(spark, sf))
    r = F.col("rules")
    n = F.when(r["include_keywords"].isNotNull(), F.size(r["include_keywords"]))
    return out.select(
        "search_id", "name", "query", "city", "run_limit", r["vertical"].alias("vertical"),
        r["vehicle_make"].alias("make"), r["vehicle_model"].alias("model"),
        r["max_price"].alias("max_price"), r["max_miles"].alias("max_miles"),
        n.alias("include_count"), "invalid")


@query("j17_sources", """
SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 'craigslist,facebook_marketplace,carsdotcom,offerup'
  WHEN 1 THEN 'craigslist,facebook_marketplace,mercari,offerup,microcenter,swappa,bestbuy,newegg'
  WHEN 2 THEN 'facebook_marketplace,mercari,microcenter,swappa,bestbuy,newegg'
  WHEN 3 THEN 'craigslist,facebook_marketplace,offerup,mercari' WHEN 4 THEN 'bestbuy,microcenter,newegg'
  WHEN 5 THEN 'craigslist,facebook_marketplace,offerup' WHEN 6 THEN 'craigslist' ELSE 'newegg,swappa' END AS sources FROM supplier""")
def j17(spark, sf):
    topic = F.expr("""CASE s_suppkey % 8 WHEN 0 THEN 'vehicles' WHEN 1 THEN 'pc_components' WHEN 2 THEN 'laptops'
      WHEN 3 THEN 'general' WHEN 4 THEN 'retail' WHEN 5 THEN 'home_theater' WHEN 6 THEN 'nothing' ELSE 'vehicles' END""")
    given = F.expr("CASE WHEN s_suppkey % 8 = 7 THEN array(' Newegg', 'nowhere', 'swappa', 'newegg') ELSE array() END")
    return table(spark, sf, "supplier").select(
        "s_suppkey", F.array_join(ops.sources_for(topic, given.cast("array<string>")), ",").alias("sources"))


@query("j18_precedence", f"""
WITH {SEARCH_SQL}, a AS (SELECT q.* FROM q JOIN supplier ON s_suppkey = k WHERE s_acctbal > 4000)
SELECT search_id, name FROM a UNION ALL
SELECT search_id, name FROM q WHERE name NOT IN (SELECT name FROM a)
QUALIFY row_number() OVER (PARTITION BY name ORDER BY search_id) = 1""")
def j18(spark, sf):
    rows = searches(spark, sf).select("search_id", "name")
    rich = table(spark, sf, "supplier").filter("s_acctbal > 4000").select(
        F.col("s_suppkey").cast("string").alias("search_id"))
    return ops.merge_catalogs(rows.join(rich, "search_id"), rows)


@query("a20_status_counts", """
SELECT count(*) AS total, count_if(s_suppkey % 4 = 0) AS active, count_if(s_suppkey % 4 = 1) AS paused,
  count_if(s_suppkey % 4 = 2) AS ended, count_if(s_suppkey % 4 = 3) AS other FROM supplier""")
def a20(spark, sf):
    return ops.status_counts(searches(spark, sf))


@query("a21_scoreboard", f"""
WITH {TITLES_SQL}, {SEARCH_SQL}, b AS (SELECT source, count(*) AS listings, max(p_partkey) AS latest_listing FROM l GROUP BY source),
s AS (SELECT source, count(*) AS searches FROM (SELECT site_a AS source FROM q UNION ALL SELECT site_b FROM q WHERE k % 3 <> 0) GROUP BY source),
j AS (SELECT coalesce(b.source, s.source) AS source, coalesce(listings, 0) AS listings, latest_listing, coalesce(searches, 0) AS searches
  FROM b FULL JOIN s ON b.source = s.source),
e AS (SELECT o_orderkey, 'fetch of brand#' || (o_custkey % 25 + 1) || '; ' || CASE o_orderpriority WHEN '1-URGENT' THEN 'timeout' ELSE 'fine' END AS line FROM orders),
x AS (SELECT j.source, e.o_orderkey, row_number() OVER (PARTITION BY j.source ORDER BY e.o_orderkey DESC) AS rn
  FROM j JOIN e ON contains(e.line, 'timeout') AND contains(e.line, j.source)),
r AS (SELECT source, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS errors FROM x WHERE rn <= 3 GROUP BY source)
SELECT j.*, coalesce(errors, '') AS errors FROM j LEFT JOIN r ON r.source = j.source""")
def a21(spark, sf):
    rows = listings(spark, sf).withColumn("first_seen", F.col("p_partkey"))
    logs = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("line_no"), F.concat(
            F.lit("fetch of brand#"), (F.col("o_custkey") % 25 + 1).cast("string"), F.lit("; "),
            F.when(F.col("o_orderpriority") == "1-URGENT", "timeout").otherwise("fine"),
            F.lit(" @"), F.col("o_orderkey").cast("string")).alias("line"))
    out = ops.source_scoreboard(rows, searches(spark, sf), logs)
    keys = F.transform("recent_errors", lambda line: F.regexp_extract(line, r"@(\d+)$", 1))
    return out.withColumn("errors", F.array_join(keys, ",")).drop("recent_errors")


@query("a26_catalog_audit", f"""
WITH {SEARCH_SQL}
SELECT search_id, concat_ws('; ', CASE WHEN k % 11 = 10 THEN 'empty search_terms' END,
   CASE WHEN k % 5 = 0 AND NOT (k % 7 = 0 ) THEN 'vehicle hunt max_price=$1050 below $10,000 (likely misconfigured unless parts/salvage)' END,
   CASE WHEN k % 5 = 0 AND k % 3 = 1 THEN 'duplicate source_sites entries: [''' || site_a || ''', ''' || site_a || ''']' END,
   CASE WHEN k % 5 = 2 AND k % 11 <> 10 THEN 'overly broad computer_parts search term: '' PC''' END) AS warnings,
  CASE WHEN k % 3 = 1 THEN site_a END AS fixed_sites,
  CASE WHEN k % 11 = 10 AND k % 5 <> 4 THEN CASE k % 5 WHEN 0 THEN 'toyota hilux' WHEN 1 THEN 'kit 2x' WHEN 2 THEN '3080' ELSE 'Inch TV' END END AS fixed_terms
FROM q""")
def a26(spark, sf):
    k = F.col("search_id").cast("int")
    site = F.get("source_sites", F.lit(0))
    rows = searches(spark, sf).withColumns({
        "source_sites": F.when(k % 3 == 1, F.array(site, site)).otherwise(F.col("source_sites")),
        "name": F.when(k % 7 == 0, F.concat("name", F.lit(" engine"))).otherwise(F.col("name")),
        "search_terms": F.when((k % 5 == 2) & (k % 11 != 10), F.array(F.lit("rtx"), F.lit(" PC")))
        .otherwise(F.col("search_terms"))})
    out = ops.audit(rows)
    return out.select("search_id", F.array_join("warnings", "; ").alias("warnings"),
                      F.array_join("fixed_sites", ",").alias("fixed_sites"),
                      F.array_join("fixed_terms", ",").alias("fixed_terms"))


@query("a26_duplicates", f"""
WITH {SEARCH_SQL}, g AS (SELECT name, CASE WHEN k % 11 = 10 THEN -1 ELSE k % 5 END AS t,
   CASE WHEN k % 3 = 0 THEN site_a ELSE least(site_a, site_b) || ',' || greatest(site_a, site_b) END AS s, search_id FROM q)
SELECT name AS name_key, count(*) AS search_count, min(search_id) AS first_search_id, max(search_id) AS last_search_id
FROM g GROUP BY name, t, s HAVING count(*) > 1""")
def a26_duplicates(spark, sf):
    return ops.duplicate_searches(searches(spark, sf)).drop("terms_key", "sites_key")


@query("t04_recent", """
SELECT o_orderkey, epoch_us(o_orderdate) AS o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""")
def t04(spark, sf):
    return plain(ops.recent(table(spark, sf, "orders"), [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 50)
                 .select("o_orderkey", "o_orderdate"))


@query("u03_ordered_distinct", """
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'b,a,c' ELSE 'x' END AS sources FROM supplier""")
def u03(spark, sf):
    raw = F.expr("CASE WHEN s_suppkey % 2 = 0 THEN array('B ', 'a', 'b', 'c', 'A') ELSE array('x', ' X') END")
    return table(spark, sf, "supplier").select(
        "s_suppkey", F.array_join(ops.ordered_distinct(raw), ",").alias("sources"))


# ---- resolution ----------------------------------------------------------------------

# Aliases: each second word of a part name, and full names of one colour; items: part names.
_ALIAS_SQL = """w AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS noun FROM part),
n AS (SELECT DISTINCT p_name AS name FROM part),
al AS (SELECT noun AS alias_key, upper(noun) AS display_name, CASE WHEN length(noun) > 4 THEN 'P-' || noun END AS product_id,
   CASE WHEN length(noun) = 4 THEN 'U-' || noun END AS upc FROM w
  UNION ALL SELECT name, 'Exact ' || name, 'P-' || name, 'U-' || name FROM n WHERE starts_with(name, 'red')
  UNION ALL SELECT split_part(name, ' ', 1), 'Hot', NULL, 'U-hot' FROM n WHERE starts_with(name, 'hot') GROUP BY ALL),
it AS (SELECT p_partkey, CASE WHEN p_size = 50 THEN 'zzz' ELSE p_name END AS normalized_name, CAST(p_size AS DOUBLE) / 4 AS quantity FROM part)"""


def _aliases(spark, sf):
    part = table(spark, sf, "part")
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    nouns = part.select(noun.alias("noun")).distinct().select(
        F.col("noun").alias("alias_key"), F.upper("noun").alias("display_name"),
        F.when(F.length("noun") > 4, F.concat(F.lit("P-"), "noun")).alias("product_id"),
        F.when(F.length("noun") == 4, F.concat(F.lit("U-"), "noun")).alias("upc"))
    names = part.select(F.col("p_name").alias("n")).distinct()
    red = names.filter("startswith(n, 'red')").select(
        F.initcap("n").alias("alias_key"), F.concat(F.lit("Exact "), "n").alias("display_name"),
        F.concat(F.lit("P-"), "n").alias("product_id"), F.concat(F.lit("U-"), "n").alias("upc"))
    hot = names.filter("startswith(n, 'hot')").select(F.split_part("n", F.lit(" "), F.lit(1)).alias("alias_key")
        ).distinct().select("alias_key", F.lit("Hot").alias("display_name"),
                            F.lit(None).cast("string").alias("product_id"), F.lit("U-hot").alias("upc"))
    return nouns.unionByName(red).unionByName(hot).withColumns({
        "search_term": F.lit(None).cast("string"), "notes": F.lit(None).cast("string")})


def _items(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") == 50, "zzz").otherwise(F.col("p_name")).alias("normalized_name"),
        (F.col("p_size").cast("double") / 4).alias("quantity"))


_RESOLVE_SQL = f"""{_ALIAS_SQL},
d AS (SELECT DISTINCT normalized_name FROM it),
ex AS (SELECT d.normalized_name, 1 AS c, a.display_name AS names, a.display_name AS dn, a.product_id, a.upc
  FROM d JOIN al a ON a.alias_key = d.normalized_name),
pa AS (SELECT d.normalized_name, count(*) AS c, string_agg(a.display_name, ', ' ORDER BY a.alias_key) AS names,
   min(a.display_name) AS dn, min(a.product_id) AS product_id, min(a.upc) AS upc
  FROM d JOIN al a ON contains(d.normalized_name, a.alias_key) OR contains(a.alias_key, d.normalized_name)
  WHERE d.normalized_name NOT IN (SELECT normalized_name FROM ex) GROUP BY d.normalized_name),
mt AS (SELECT * FROM ex UNION ALL SELECT * FROM pa),
rs AS (SELECT it.*, CASE WHEN c IS NULL THEN 'MISSING' WHEN c > 1 THEN 'AMBIGUOUS'
   WHEN upc IS NOT NULL OR product_id IS NOT NULL THEN 'EXACT_DEFAULT' ELSE 'NEEDS_SEARCH' END AS status,
   CASE WHEN c = 1 THEN dn END AS matched_alias, CASE WHEN c = 1 THEN product_id END AS product_id,
   CASE WHEN c = 1 THEN upc END AS upc,
   CASE WHEN c IS NULL THEN 'No alias configured' WHEN c > 1 THEN 'Multiple aliases match: ' || names END AS notes
  FROM it LEFT JOIN mt ON mt.normalized_name = it.normalized_name)"""


@query("j10_alias", f"""
WITH {_RESOLVE_SQL} SELECT p_partkey, status, matched_alias, product_id, upc, notes FROM rs""")
def j10(spark, sf):
    out = resolve.resolve_items(_items(spark, sf), _aliases(spark, sf))
    return out.select("p_partkey", "status", "matched_alias", "product_id", "upc", "notes")


@query("j13_resolve", f"""
WITH {_RESOLVE_SQL}, k AS (SELECT *, CASE WHEN status = 'AMBIGUOUS' THEN 'ambiguous' WHEN status = 'MISSING' THEN 'missing'
   WHEN upc IS NULL THEN 'no_upc' END AS failure FROM rs)
SELECT p_partkey, failure, CASE WHEN failure IS NULL THEN greatest(1, CAST(floor(quantity) AS INTEGER)) END AS order_quantity FROM k""")
def j13(spark, sf):
    resolved = resolve.resolve_items(_items(spark, sf), _aliases(spark, sf))
    return resolve.resolve_cart(resolved).select("p_partkey", "failure", "order_quantity")


@query("j11_closure", """
WITH RECURSIVE r AS (SELECT 'node ' || s_suppkey AS f, 'node ' || CASE WHEN s_acctbal < 1000 THEN s_suppkey - 2 ELSE s_suppkey + 1 END AS t
   FROM supplier WHERE s_acctbal <= 8000),
k AS (SELECT 'node ' || s_suppkey AS key FROM supplier),
w AS (SELECT key, key AS node, [key] AS seen, FALSE AS stop FROM k
  UNION ALL SELECT w.key, r.t, list_append(w.seen, r.t), list_contains(w.seen, r.t) FROM w JOIN r ON r.f = w.node WHERE NOT w.stop)
SELECT key AS alias_key, arg_max(node, len(seen)) AS resolved_key FROM w GROUP BY key""")
def j11(spark, sf):
    # Poor suppliers point back, which closes cycles; rich ones point nowhere.
    key = F.concat(F.lit("node "), F.col("s_suppkey").cast("string"))
    supplier = table(spark, sf, "supplier")
    nxt = F.when(F.col("s_acctbal") < 1000, F.col("s_suppkey") - 2).otherwise(F.col("s_suppkey") + 1)
    redirects = supplier.filter("s_acctbal <= 8000").select(
        key.alias("from_key"), F.concat(F.lit("node "), nxt.cast("string")).alias("to_key"))
    return resolve.follow_redirects(supplier.select(key.alias("alias_key")), redirects)


_LEDGER_SQL = """lg AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_suppkey % 5 AS trip_id, 'item ' || l_partkey AS name,
   CASE WHEN l_linenumber % 2 = 0 THEN 'P' || (l_partkey % 97) END AS product_id, CASE WHEN l_linenumber = 3 THEN 'U' || l_suppkey END AS upc,
   l_returnflag = 'R' AS undone FROM lineitem),
cd AS (SELECT p_partkey, p_partkey % 5 AS trip_id, 'item ' || (p_partkey * 3) AS name,
   CASE WHEN p_size % 2 = 0 THEN 'P' || (p_partkey % 500) END AS product_id, CASE WHEN p_size % 3 = 0 THEN 'U' || p_partkey END AS upc FROM part)"""


@query("j12_or_match", f"""
WITH {_LEDGER_SQL}, lv AS (SELECT * FROM lg WHERE NOT undone),
a AS (SELECT trip_id, name, min(id) AS id FROM lv GROUP BY ALL), b AS (SELECT trip_id, product_id, min(id) AS id FROM lv WHERE product_id IS NOT NULL GROUP BY ALL),
c AS (SELECT trip_id, upc, min(id) AS id FROM lv WHERE upc IS NOT NULL GROUP BY ALL)
SELECT cd.p_partkey, least(a.id, b.id, c.id) AS duplicate_id FROM cd LEFT JOIN a ON a.trip_id = cd.trip_id AND a.name = cd.name
LEFT JOIN b ON b.trip_id = cd.trip_id AND b.product_id = cd.product_id LEFT JOIN c ON c.trip_id = cd.trip_id AND c.upc = cd.upc""")
def j12(spark, sf):
    text_of = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    li = table(spark, sf, "lineitem")
    ledger = li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_suppkey") % 5).alias("trip_id"),
        text_of("Item ", F.col("l_partkey")).alias("normalized_name"),
        F.when(F.col("l_linenumber") % 2 == 0, text_of("P", F.col("l_partkey") % 97)).alias("product_id"),
        F.when(F.col("l_linenumber") == 3, text_of("U", F.col("l_suppkey"))).alias("upc"),
        (F.col("l_returnflag") == "R").alias("undone"))
    key = F.col("p_partkey")
    candidates = table(spark, sf, "part").select(
        "p_partkey", (key % 5).alias("trip_id"), text_of("item ", key * 3).alias("normalized_name"),
        F.when(F.col("p_size") % 2 == 0, text_of("P", key % 500)).alias("product_id"),
        F.when(F.col("p_size") % 3 == 0, text_of("U", key)).alias("upc"))
    return resolve.ledger_duplicates(candidates, ledger).select("p_partkey", "duplicate_id")


@query("j14_staples", f"""
WITH {_ALIAS_SQL} SELECT p.p_partkey, p.p_size AS sort_order, coalesce(a.upc IS NOT NULL OR a.product_id IS NOT NULL, FALSE) AS preference_resolved,
  a.display_name AS preferred_product FROM part p LEFT JOIN al a ON (p.p_size <= 40 AND a.alias_key = p.p_name) OR (p.p_size > 40 AND a.alias_key = split_part(p.p_name, ' ', 2) AND a.alias_key NOT LIKE '%g')
WHERE p.p_size > 10""")
def j14(spark, sf):
    staples = table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").alias("sort_order"), (F.col("p_size") > 10).alias("enabled"),
        F.when(F.col("p_size") > 40, F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("s")))
        .otherwise(F.col("p_name")).alias("normalized_key"))
    out = resolve.staples_report(staples, _aliases(spark, sf), enabled_only=True)
    return out.select("p_partkey", "sort_order", "preference_resolved", "preferred_product")


# ---- shows ---------------------------------------------------------------------------

_SHOW = """CASE p_size % 3 WHEN 0 THEN 'ticketmaster' ELSE 'seatgeek' END AS source,
  CAST(p_partkey AS STRING) AS provider_event_id, p_name AS artist_or_title, 'Hall ' || p_type AS venue,
  CASE p_size % 4 WHEN 0 THEN 'Houston' WHEN 1 THEN 'Dallas' WHEN 2 THEN 'Tyler' ELSE 'Boston' END AS city,
  CASE p_size % 4 WHEN 3 THEN 'MA' ELSE 'TX' END AS state,
  '2024-0' || CAST(p_size % 6 + 1 AS STRING) || '-1' || CAST(p_size % 5 AS STRING) || 'T20:00:00' AS starts_at,
  'https://t.example/' || CAST(p_partkey AS STRING) AS ticket_url,
  CASE p_size % 7 WHEN 0 THEN 'Rock' WHEN 1 THEN 'concert' WHEN 2 THEN 'Pop' WHEN 3 THEN 'concert, rock'
    WHEN 4 THEN 'sports' WHEN 5 THEN '' ELSE 'Metal' END AS genre_or_classification"""
_SHOW_SQL = f"""v AS (SELECT {_SHOW.replace('STRING', 'VARCHAR')}, p_size, p_name, p_type FROM part),
sh AS (SELECT *, p_name || '|' || p_type || '|' || starts_at AS ev FROM v)"""


def _shows(spark, sf):
    return shows.normalise(table(spark, sf, "part").selectExpr(*_split_top(_SHOW)))


@query("a22_event_merge", f"""
WITH {_SHOW_SQL} SELECT 'event|' || substr(sha1(lower(p_name) || '|hall ' || lower(p_type) || '|' || replace(left(starts_at, 16), 'T', ' ')), 1, 16) AS event_dedupe_key,
  any_value(artist_or_title) AS artist_or_title, arg_min(ticket_url, (CASE source WHEN 'ticketmaster' THEN 0 ELSE 1 END, ticket_url)) AS ticket_url,
  arg_min(city, (CASE source WHEN 'ticketmaster' THEN 0 ELSE 1 END, ticket_url)) AS city,
  string_agg(DISTINCT source, ', ' ORDER BY source) AS source_label, count(*) AS member_count
FROM sh GROUP BY p_name, p_type, starts_at""")
def a22(spark, sf):
    return shows.merge(_shows(spark, sf)).select(
        "event_dedupe_key", "artist_or_title", "ticket_url", "city", "source_label", "member_count")


@query("a23_duplicates", f"""
WITH {_SHOW_SQL} SELECT any_value(artist_or_title) AS artist_or_title, any_value(venue) AS venue, any_value(starts_at) AS starts_at,
  count(*) AS member_count FROM sh GROUP BY ev HAVING count(*) >= 2""")
def a23(spark, sf):
    return shows.duplicate_groups(_shows(spark, sf)).drop("event_dedupe_key")


@query("a23_duplicate_members", f"""
WITH {_SHOW_SQL}, d AS (SELECT ev FROM sh GROUP BY ev HAVING count(*) >= 2)
SELECT provider_event_id, source || '|' || provider_event_id AS dedupe_key FROM sh WHERE ev IN (SELECT ev FROM d)""")
def a23_members(spark, sf):
    return shows.duplicate_members(_shows(spark, sf)).drop("event_dedupe_key")


@query("a24_label_counts", f"""
WITH {_SHOW_SQL} SELECT CASE WHEN genre_or_classification = '' THEN '(none)' ELSE genre_or_classification END AS label, count(*) AS "count"
FROM v GROUP BY ALL""")
def a24(spark, sf):
    return shows.genre_counts(_shows(spark, sf))


@query("a24_token_counts", f"""
WITH {_SHOW_SQL}, t AS (SELECT trim(unnest(string_split(lower(genre_or_classification), ','))) AS token FROM v)
SELECT token, count(*) AS "count" FROM t WHERE token <> '' GROUP BY token""")
def a24_tokens(spark, sf):
    return shows.taxonomy_counts(_shows(spark, sf))


_FLAG_SQL = """CASE WHEN source = 'seatgeek' THEN p_size % 7 IN (0, 1, 3, 6) ELSE p_size % 7 IN (0, 3, 6) END"""


@query("a25_funnel", f"""
WITH {_SHOW_SQL}, f AS (SELECT *, {_FLAG_SQL} AS keep, {_FLAG_SQL} AND source = 'seatgeek' AND p_size % 7 = 1 AS noise FROM sh),
x AS (SELECT count_if(source = 'ticketmaster') AS primary_returned, count_if(source = 'seatgeek') AS secondary_returned,
  count_if(keep) AS after_genre_filter, count_if(noise) AS noise_hidden, count(DISTINCT CASE WHEN keep AND NOT noise THEN ev END) AS merged_count FROM f)
SELECT *, least(merged_count, 10) AS displayed_count FROM x""")
def a25(spark, sf):
    return shows.funnel(_shows(spark, sf), F.lit("rock"), F.lit(None).cast("string"))


@query("f03_genre_filter", f"""
WITH {_SHOW_SQL} SELECT provider_event_id FROM sh WHERE {_FLAG_SQL}""")
def f03(spark, sf):
    return _shows(spark, sf).filter(
        shows.passes_genre(F.lit("Rock "), F.lit(""))).select("provider_event_id")


@query("f04_noise", f"""
WITH {_SHOW_SQL} SELECT provider_event_id FROM sh WHERE source = 'seatgeek' AND p_size % 7 IN (1, 4, 5)""")
def f04(spark, sf):
    return _shows(spark, sf).filter(
        shows.is_noise(F.lit("rock"), F.lit(None).cast("string"))).select("provider_event_id")


_WATCH = """c_custkey AS watch_id, CASE WHEN c_custkey % 3 = 0 THEN 'red ring' WHEN c_custkey % 3 = 1 AND c_custkey % 5 = 0 THEN 'BOLT' END AS artist,
  CASE WHEN c_custkey % 3 > 0 THEN 'rock' END AS genre,
  CASE c_custkey % 4 WHEN 0 THEN 'nationwide' WHEN 1 THEN ' East  Texas' WHEN 2 THEN 'houston' END AS area,
  CASE WHEN c_custkey % 4 = 3 AND c_custkey % 8 = 3 THEN 'Dallas' END AS city, CAST(NULL AS STRING) AS state, CAST(NULL AS INT) AS radius_miles,
  c_custkey % 6 = 1 AS force, CAST(60 AS INT) AS days_forward, c_custkey % 7 <> 0 AS active"""
_WATCH_SQL = f"wt AS (SELECT {_WATCH.replace('STRING', 'VARCHAR').replace(' AS force', ' AS forced')} FROM customer)"


def _watches(spark, sf):
    return table(spark, sf, "customer").selectExpr(*_split_top(_WATCH))


@query("f06_criteria", f"""
WITH {_WATCH_SQL}, k AS (SELECT watch_id, CASE
  WHEN trim(coalesce(area, '')) = 'nationwide' AND genre IS NOT NULL AND artist IS NULL AND NOT forced
    THEN 'Broad nationwide genre watches are too noisy. Add-item artist:"..." or add force:true to override.'
  WHEN area IS NULL AND city IS NULL AND genre IS NOT NULL AND artist IS NULL
    THEN 'Broad genre watches require area:"..." or city:"...".' END AS reason FROM wt)
SELECT watch_id, reason, reason IS NULL AS valid FROM k""")
def f06(spark, sf):
    return shows.check_criteria(_watches(spark, sf)).select("watch_id", "reason", "valid")


@query("j16_area", f"""
WITH {_WATCH_SQL}, g AS (SELECT * FROM (VALUES ('east texas', 'Tyler', 50), ('east texas', 'Longview', 50), ('east texas', 'Beaumont', 50),
   ('east texas', 'Lufkin', 50), ('east texas', 'Nacogdoches', 50), ('houston', 'Houston', 75)) t(a, c, r))
SELECT watch_id, g.c AS geo_city, g.r AS radius, FALSE AS failed FROM wt JOIN g ON g.a = trim(regexp_replace(lower(area), '\\s+', ' ', 'g'))
UNION ALL SELECT watch_id, NULL, NULL, FALSE FROM wt WHERE area = 'nationwide'
UNION ALL SELECT watch_id, 'Dallas', 75, FALSE FROM wt WHERE area IS NULL AND city IS NOT NULL
UNION ALL SELECT watch_id, NULL, NULL, TRUE FROM wt WHERE area IS NULL AND city IS NULL""")
def j16(spark, sf):
    out = shows.expand_areas(_watches(spark, sf))
    return out.select("watch_id", "geo_city", "radius", F.col("geo_error").isNotNull().alias("failed"))


_ALERT_SQL = f"""{_SHOW_SQL}, {_WATCH_SQL},
ok AS (SELECT * FROM wt WHERE active AND NOT (area IS NULL AND city IS NULL)
  AND NOT (trim(coalesce(area, '')) = 'nationwide' AND artist IS NULL AND NOT forced)),
sd AS (SELECT *, CAST(left(starts_at, 10) AS DATE) AS day FROM sh WHERE CAST(left(starts_at, 10) AS DATE) >= DATE '2024-02-01'),
c AS (SELECT DISTINCT ok.watch_id, ok.artist, ok.genre, sd.* FROM ok JOIN sd ON sd.day <= DATE '2024-02-01' + ok.days_forward
  AND (ok.artist IS NULL OR contains(lower(sd.artist_or_title), lower(ok.artist)))
  AND (trim(coalesce(ok.area, '')) = 'nationwide'
    OR (lower(trim(ok.area)) = 'houston' AND sd.city = 'Houston')
    OR (trim(regexp_replace(lower(ok.area), '\\s+', ' ', 'g')) = 'east texas' AND sd.city = 'Tyler')
    OR (ok.area IS NULL AND sd.city = ok.city AND sd.state = 'TX'))),
kp AS (SELECT * FROM c WHERE artist IS NOT NULL OR ({_FLAG_SQL} AND NOT (source = 'seatgeek' AND p_size % 7 = 1)))"""


@query("j09_watch_alerts", f"""
WITH {_ALERT_SQL} SELECT watch_id, any_value(artist_or_title) AS artist_or_title, any_value(venue) AS venue, any_value(starts_at) AS starts_at,
   count(*) AS member_count FROM kp WHERE (watch_id::VARCHAR, ev) NOT IN (SELECT (provider_event_id, ev) FROM sh) GROUP BY watch_id, ev""")
def j09(spark, sf):
    rows = _shows(spark, sf)
    watches = shows.check_criteria(_watches(spark, sf)).filter("valid").drop("reason", "valid")
    told = rows.join(
        watches.select("watch_id"), F.col("provider_event_id") == F.col("watch_id").cast("string")
    ).select("watch_id", "event_dedupe_key")
    out = shows.watch_alerts(watches, rows, told, F.lit("2024-02-01").cast("date"))
    return out.select("watch_id", "artist_or_title", "venue", "starts_at", "member_count")


@query("t05_rank", f"""
WITH {_SHOW_SQL}, m AS (SELECT any_value(artist_or_title) AS artist_or_title, any_value(venue) AS venue, any_value(starts_at) AS starts_at,
   bool_or(source = 'ticketmaster') AS tm, bool_or(source = 'seatgeek') AS sg FROM sh GROUP BY ev)
SELECT artist_or_title, venue, starts_at, CASE WHEN artist_or_title = 'red ring' THEN 1000 WHEN contains(artist_or_title, 'red ring') THEN 500 ELSE 0 END
  + CASE WHEN tm THEN 100 ELSE 0 END - CASE WHEN sg AND NOT tm THEN 10 ELSE 0 END AS score FROM m""")
def t05(spark, sf):
    out = shows.ranked(shows.merge(_shows(spark, sf)), F.lit(" Red  ring"), F.lit(None).cast("string"))
    return out.select("artist_or_title", "venue", "starts_at", "score")


@query("u01_union", f"""
WITH {_SHOW_SQL} SELECT source, provider_event_id FROM v""")
def u01(spark, sf):
    rows = _shows(spark, sf)
    a = rows.filter("source = 'ticketmaster'").drop("venue")
    return shows.union_providers(a, rows.filter("source = 'seatgeek'")).select("source", "provider_event_id")


# ---- keyed sinks ---------------------------------------------------------------------

def _split_lines(spark, sf):
    """Stored orders (earlier dates) and an incoming batch that overlaps and repeats keys."""
    o = table(spark, sf, "orders")
    stored = o.filter("o_orderdate < '1998-01-01'").select("o_custkey", "o_orderkey", "o_totalprice")
    incoming = o.filter("o_orderdate >= '1996-01-01'").select("o_custkey", "o_orderkey", "o_totalprice")
    return stored, incoming


_SPLIT_SQL = """st AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
inc AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')"""


@query("k01_insert_ignore", f"""
WITH {_SPLIT_SQL} SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM inc
WHERE o_custkey NOT IN (SELECT o_custkey FROM st) GROUP BY o_custkey""")
def k01(spark, sf):
    stored, incoming = _split_lines(spark, sf)
    return sinks.rows_to_insert(stored, incoming, ["o_custkey"], ["o_orderkey"])


@query("k01_counts", f"""
WITH {_SPLIT_SQL}, k AS (SELECT o_custkey, count(*) AS n, o_custkey NOT IN (SELECT o_custkey FROM st) AS fresh FROM inc GROUP BY o_custkey)
SELECT count_if(fresh) AS inserted, CAST(sum(CASE WHEN fresh THEN n - 1 ELSE n END) AS BIGINT) AS skipped FROM k""")
def k01_counts(spark, sf):
    stored, incoming = _split_lines(spark, sf)
    return sinks.insert_counts(stored, incoming, ["o_custkey"])


@query("k02_insert_new", f"""
WITH {TITLES_SQL}, s AS (SELECT source || '/' || (p_partkey % 500) AS link FROM l WHERE p_size < 20),
i AS (SELECT p_partkey, CASE WHEN p_size = 30 THEN '' ELSE source || '/' || (p_partkey % 500) END AS link FROM l WHERE p_size >= 15)
SELECT link, min(p_partkey) AS p_partkey, link NOT IN (SELECT link FROM s) AS is_new FROM i WHERE link <> '' GROUP BY link""")
def k02(spark, sf):
    link = F.concat("source", F.lit("/"), (F.col("p_partkey") % 500).cast("string"))
    rows = listings(spark, sf)
    stored = rows.filter("p_size < 20").select(link.alias("link"))
    incoming = rows.filter("p_size >= 15").select(
        "p_partkey", F.when(F.col("p_size") == 30, "").otherwise(link).alias("link"))
    return sinks.flag_new(stored, incoming, "link", ["p_partkey"])


@query("k03_upsert_seen", """
WITH e AS (SELECT o_custkey, o_orderstatus, o_orderdate AS d, o_orderkey FROM orders),
a AS (SELECT o_custkey, arg_max(o_orderstatus, (d, o_orderkey)) AS s, min(d) AS f, max(d) AS l FROM e WHERE d < TIMESTAMP '1997-01-01' GROUP BY o_custkey),
b AS (SELECT o_custkey, arg_max(o_orderstatus, (d, o_orderkey)) AS s, max(d) AS d FROM e WHERE d >= TIMESTAMP '1997-01-01' GROUP BY o_custkey)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(b.s, a.s) AS status, epoch_us(coalesce(f, b.d)) AS first_seen, epoch_us(coalesce(b.d, l)) AS last_seen
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def k03(spark, sf):
    o = table(spark, sf, "orders")
    last = lambda df: df.groupBy("o_custkey").agg(
        F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"),
        F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"))
    stored = last(o.filter("o_orderdate < '1997-01-01'"))
    incoming = last(o.filter("o_orderdate >= '1997-01-01'")).drop("first_seen").withColumnRenamed("last_seen", "seen_at")
    return plain(sinks.upsert_seen(stored, incoming, ["o_custkey"]))


@query("k04_upsert_latest", """
WITH a AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
b AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, coalesce(b.o_totalprice, a.o_totalprice) AS o_totalprice
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def k04(spark, sf):
    from gaugeworks.operators.ordered import latest_by

    o = table(spark, sf, "orders")
    cols = ["o_custkey", "o_orderkey", "o_totalprice"]
    stored = latest_by(o.filter("o_orderdate < '1997-01-01'").select(*cols), ["o_custkey"], ["o_orderkey"])
    incoming = o.filter("o_orderdate >= '1997-01-01'").select(*cols)
    return sinks.upsert_latest(stored, incoming, ["o_custkey"], "o_orderkey")


@query("k05_archive_append", """
WITH a AS (SELECT DISTINCT user_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-15'),
i AS (SELECT user_id, ts, min(event_id) AS event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL)
SELECT i.user_id AS site_id, epoch_us(i.ts) AS ts, event_id FROM i WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = i.user_id AND a.ts = i.ts)""")
def k05(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("site_id"), "ts", "event_id")
    return plain(sinks.archive_rows(
        e.filter("ts < '2024-01-15'"), e.filter("ts >= '2024-01-10'"), order=["event_id"]))


@query("k06_bootstrap", """
SELECT user_id AS site_id, epoch_us(ts) AS ts FROM events WHERE event_type <> 'error'""")
def k06(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("site_id"),
        F.when(F.col("event_type") != "error", F.col("ts")).alias("ts"))
    return plain(sinks.bootstrap_rows(e.filter("ts < '2000-01-01'"), e))


@query("k07_rolling_rewrite", """
WITH c AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND ts < TIMESTAMP '2024-01-25'),
i AS (SELECT * FROM events)
SELECT user_id AS site_id, epoch_us(ts) AS ts FROM (SELECT user_id, ts FROM c UNION SELECT user_id, ts FROM i)
WHERE ts >= TIMESTAMP '2024-01-29 18:00:00' - INTERVAL 336 HOUR""")
def k07(spark, sf):
    from gaugeworks.plans.bindings import now

    e = table(spark, sf, "events").select(F.col("user_id").alias("site_id"), "ts")
    current = e.filter("ts >= '2024-01-16' AND ts < '2024-01-25'").distinct()
    return plain(sinks.roll_window(current, e, now()))


@query("k08_ledger", f"""
WITH {_ALERT_SQL}, k AS (SELECT DISTINCT watch_id, ev, starts_at FROM kp), told AS (SELECT watch_id, ev FROM k WHERE starts_at < '2024-03')
SELECT watch_id, count(*) AS added FROM k WHERE (watch_id, ev) NOT IN (SELECT watch_id, ev FROM told) GROUP BY watch_id""")
def k08(spark, sf):
    watches = shows.check_criteria(_watches(spark, sf)).filter("valid").drop("reason", "valid")
    none = spark.createDataFrame([], "watch_id long, event_dedupe_key string")
    due = shows.watch_alerts(watches, _shows(spark, sf), none, F.lit("2024-02-01").cast("date"))
    ledger = due.filter("starts_at < '2024-03'").select("watch_id", "event_dedupe_key")
    added = sinks.ledger_rows(ledger, due)
    return added.groupBy("watch_id").agg(F.count(F.lit(1)).alias("added"))


@query("k09_cascade_delete", """
WITH d AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')
SELECT 'parent' AS side, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM d)
UNION ALL SELECT 'child', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM d)""")
def k09(spark, sf):
    parents = table(spark, sf, "customer").withColumnRenamed("c_custkey", "watch_id")
    children = table(spark, sf, "orders").withColumnRenamed("o_custkey", "watch_id")
    kept, rows = sinks.cascade_delete(parents, children, parents.filter("c_mktsegment = 'MACHINERY'"), "watch_id")
    return kept.select(F.lit("parent").alias("side"), F.col("watch_id").alias("id")).unionByName(
        rows.select(F.lit("child").alias("side"), F.col("o_orderkey").alias("id")))


@query("j08_anti", """
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def j08(spark, sf):
    stored = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return sinks.rows_to_insert(stored, table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], ["c_custkey"])


@query("t09_shortest", """
WITH c AS (SELECT p_name || repeat(' ', p_size) || '.' AS t, p_name AS s FROM part)
SELECT s AS signature, arg_min(t, (length(t), t)) AS t FROM c GROUP BY s""")
def t09(spark, sf):
    cards = table(spark, sf, "part").select(
        F.expr("p_name || repeat(' ', p_size) || '.'").alias("t"), "p_name")
    return health.shortest_per_signature(cards, "t", F.col("p_name"))


@query("t10_first", """
WITH k AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'c' || o_custkey END AS id,
   CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS title, o_orderstatus AS link FROM orders)
SELECT coalesce(nullif(id, ''), nullif(title, ''), link) AS key, min(o_orderkey) AS o_orderkey FROM k GROUP BY 1""")
def t10(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.expr("CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'c' || CAST(o_custkey AS STRING) END").alias("id"),
        F.expr("CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END").alias("title"),
        F.col("o_orderstatus").alias("link"))
    out = health.first_with_fallback_key(rows, ["id", "title", "link"], ["o_orderkey"])
    return out.select(F.coalesce(F.nullif("id", F.lit("")), "title", "link").alias("key"), "o_orderkey")
