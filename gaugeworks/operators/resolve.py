"""Free-text item lists to known products: parsing, redirects, alias matching, ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import text
from gaugeworks.operators.joins import contains_pairs
from gaugeworks.session import cut_lineage


def parse_lists(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """One row per distinct item of each list text, in the order written.

    Items repeat when name, quantity and unit agree; the first stays. All of it happens
    inside the row: no shuffle.
    """
    def item(line: Column) -> Column:
        name, amount, unit = text.line_fields(line)
        return F.struct(line.alias("raw_text"), name.alias("normalized_name"),
                        amount.alias("quantity"), unit.alias("unit"))

    items = F.transform(text.list_lines(column), item)

    def identity(x: Column) -> Column:
        return F.concat_ws("|", x["normalized_name"], x["quantity"].cast("string"),
                           F.coalesce(x["unit"], F.lit("None")))

    out = df.withColumn("_items", items).withColumn("_ids", F.transform("_items", identity))
    kept = F.filter("_items", lambda x, i: F.array_position(F.col("_ids"), identity(x)) == i + 1)
    return out.select(*keys, F.posexplode(kept).alias("position", "_item")).select(
        *keys, "position", "_item.*")


def _far_ends(steps: DataFrame, edges: int) -> DataFrame:
    """(_from, _to) after at least as many steps as there are edges, by pointer doubling.

    Round k knows the key 2^k steps on; a chain that ended stays where it is. Each round is
    one equi-join on a checkpointed table and the loop stops once nothing moves.
    """
    jump = steps
    for _ in range(max(1, edges.bit_length())):
        ahead = jump.select(F.col("_from").alias("_to"), F.col("_to").alias("_next"))
        joined = jump.join(ahead, "_to", "left")
        moved = cut_lineage(joined.select(
            "_from", F.coalesce("_next", "_to").alias("_to"), F.col("_next").isNotNull().alias("_moved")))
        jump = moved.select("_from", "_to")
        if moved.filter("_moved").isEmpty():
            break
    return jump


def follow_redirects(keys: DataFrame, redirects: DataFrame, key: str = "alias_key") -> DataFrame:
    """Final key of every key; a chain that returns to a key it has visited ends on it.

    The far ends of chains that never end are exactly the keys on cycles. With the redirects
    of those keys taken out, every chain ends, and it ends where the walk first repeats: at
    the cycle's entry, or at the start itself when that lies on the cycle.
    """
    steps = cut_lineage(redirects.select(
        text.name_key("from_key").alias("_from"), text.name_key("to_key").alias("_to")
    ).groupBy("_from").agg(F.max("_to").alias("_to")))
    edges = steps.count()
    ends = _far_ends(steps, edges)
    sources = steps.select(F.col("_from").alias("_to"))
    on_cycle = ends.join(sources, "_to", "left_semi").select(F.col("_to").alias("_from")).distinct()
    if not on_cycle.isEmpty():
        ends = _far_ends(cut_lineage(steps.join(on_cycle, "_from", "left_anti")), edges)
    settled = ends.select(F.col("_from").alias("_k"), F.col("_to").alias("resolved_key"))
    return keys.join(settled, text.name_key(key) == F.col("_k"), "left").select(
        *keys.columns, F.coalesce("resolved_key", text.name_key(key)).alias("resolved_key"))


STATUSES = ("EXACT_DEFAULT", "NEEDS_SEARCH", "AMBIGUOUS", "MISSING")


def alias_matches(names: DataFrame, aliases: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Match summary per distinct ``normalized_name``: count, the single match, all names.

    The exact key (after redirects) wins; otherwise every alias that contains the name or is
    contained in it counts. Names are made distinct first, so a name asked for by a third
    of all items is matched once.
    """
    distinct = names.select("normalized_name").distinct().withColumn(
        "_key", text.name_key("normalized_name")).filter(F.col("_key") != "")
    if redirects is not None:
        distinct = follow_redirects(distinct, redirects, "_key").drop("_key").withColumnRenamed(
            "resolved_key", "_lookup").withColumn("_key", text.name_key("normalized_name"))
    else:
        distinct = distinct.withColumn("_lookup", F.col("_key"))
    entry = F.struct("display_name", "product_id", "upc", "search_term", "notes")
    known = aliases.select(text.name_key("alias_key").alias("_alias"), entry.alias("_entry"))
    known = known.groupBy("_alias").agg(F.min("_entry").alias("_entry"))
    exact = distinct.join(known, distinct["_lookup"] == known["_alias"]).select(
        "normalized_name", F.lit(1).cast("long").alias("match_count"), "_entry",
        F.col("_entry.display_name").alias("match_names"))
    rest = distinct.join(exact.select("normalized_name"), "normalized_name", "left_anti")
    rest = rest.select("normalized_name", "_key")
    inside = contains_pairs(known, rest, hay_text="_alias", needle_text="_key")
    around = contains_pairs(rest, known, hay_text="_key", needle_text="_alias")
    columns = ["normalized_name", "_alias", "_entry"]
    pairs = inside.select(*columns).unionByName(around.select(*columns)).dropDuplicates(
        ["normalized_name", "_alias"])
    partial = pairs.groupBy("normalized_name").agg(
        F.count(F.lit(1)).alias("match_count"), F.min_by("_entry", "_alias").alias("_entry"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
            F.col("_alias").alias("a"), F.col("_entry.display_name").alias("d")))),
            lambda x: x["d"]), ", ").alias("match_names"))
    return exact.unionByName(partial)


def resolve_items(items: DataFrame, aliases: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Items with status, matched alias and search term."""
    found = alias_matches(items, aliases, redirects)
    joined = items.join(found, "normalized_name", "left")
    one = F.col("match_count") == 1
    pinned = F.coalesce(F.nullif("_entry.upc", F.lit("")),
                        F.nullif("_entry.product_id", F.lit(""))).isNotNull()
    status = (
        F.when(F.col("match_count").isNull(), "MISSING")
        .when(F.col("match_count") > 1, "AMBIGUOUS")
        .when(pinned, "EXACT_DEFAULT").otherwise("NEEDS_SEARCH")
    )
    notes = (
        F.when(F.col("match_count").isNull(), "No alias configured")
        .when(F.col("match_count") > 1,
              F.concat(F.lit("Multiple aliases match: "), F.col("match_names")))
        .otherwise(F.col("_entry.notes"))
    )
    term = F.coalesce(F.when(one, F.nullif("_entry.search_term", F.lit(""))), "normalized_name")
    return joined.select(
        *items.columns, status.alias("status"),
        F.when(one, F.col("_entry.display_name")).alias("matched_alias"),
        F.when(one, F.col("_entry.product_id")).alias("product_id"),
        F.when(one, F.col("_entry.upc")).alias("upc"),
        term.alias("search_term"), notes.alias("notes"))


def resolve_cart(resolved: DataFrame) -> DataFrame:
    """Resolved items with the whole quantity to order and why an item cannot be ordered."""
    no_upc = F.coalesce(F.nullif("upc", F.lit("")), F.lit("")) == ""
    reason = (
        F.when(F.col("status") == "AMBIGUOUS", "ambiguous")
        .when(F.col("status") == "MISSING", "missing")
        .when(no_upc, "no_upc")
    )
    whole = F.greatest(F.lit(1), F.col("quantity").cast("int"))
    return resolved.withColumn("failure", reason).withColumn(
        "order_quantity", F.when(F.col("failure").isNull(), whole))


def ledger_duplicates(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Lowest ledger id of the same trip with equal name, product id or upc, undone rows out.

    An OR join cannot be hashed, so it runs as three equi-joins against the lowest id per
    key (one row per key however often it repeats) and takes the least.
    """
    live = ledger.filter(~F.col("undone")).withColumn("_name", text.name_key("normalized_name"))
    out = candidates.withColumn("_name", text.name_key("normalized_name"))
    hits = []
    for i, key in enumerate(("_name", "product_id", "upc")):
        first = live.filter(F.coalesce(F.col(key), F.lit("")) != "" if key != "_name" else F.lit(True))
        first = first.groupBy("trip_id", key).agg(F.min("id").alias(f"_id{i}"))
        out = out.join(first, ["trip_id", key], "left")
        hits.append(f"_id{i}")
    return out.select(*candidates.columns, F.least(*hits).alias("duplicate_id"))


def staples_report(staples: DataFrame, aliases: DataFrame, enabled_only: bool = False) -> DataFrame:
    """Staples with their preference, resolved when it pins a product."""
    known = aliases.select(
        text.name_key("alias_key").alias("_alias"), F.col("display_name").alias("preferred_product"),
        F.coalesce(F.nullif("upc", F.lit("")), F.nullif("product_id", F.lit(""))).isNotNull().alias("_pin"))
    known = known.groupBy("_alias").agg(
        F.min(F.struct("preferred_product", "_pin")).alias("_k")).select("_alias", "_k.*")
    rows = staples.filter("enabled") if enabled_only else staples
    return rows.join(known, text.name_key("normalized_key") == F.col("_alias"), "left").select(
        *staples.columns, F.coalesce("_pin", F.lit(False)).alias("preference_resolved"),
        "preferred_product")
