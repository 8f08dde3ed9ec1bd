"""Audit of how document filters interact, over every order in which they may be applied.

A document is reduced to a mask, one bit per filter that it fails. What a filter removes at a
step depends on nothing but the mask and the filters before it, so the documents are counted per
(part, mask) first, by mergeable aggregates, and only these cells are folded: for every order of
the broadcast order array ``aggregate`` walks the steps with "still there" as its state and leaves
one struct of weighted counts a step. The structs of a part's cells (at most one a mask) are added
elementwise with ``zip_with``. No document is looked at twice, and what is spread is parts x masks.

Defined cases: a null text is empty, a null source is the empty part; rows that repeat a key each
count, with the key's label (1 if any label row says so); a null key has no label, is smaller than
no key and has no smaller one; a document without a label is neither good nor toxic; an empty
table has no parts and gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import kept_table, words

#: In the order of their bits.
FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 2
MARKS = r"[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

ORDERS = [list(order) for order in permutations(range(len(FILTERS)))]
ORDER_NAMES = ["".join(FILTERS[f] for f in order) for order in ORDERS]


def failures(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``_key, _part, _mask, _text_id`` of every row: the bits of all filters but the last, and a
    digest that stands for the whole text."""
    rows = df.select(F.col(key).alias("_key"), F.coalesce(F.col(source), F.lit("")).alias("_part"),
                     F.coalesce(F.col(text), F.lit("")).alias("_body"))
    rows = rows.withColumn("_words", words(F.col("_body")))
    rows = rows.select(
        "_key", "_part", "_body", F.size("_words").alias("_n"), F.size(F.array_distinct("_words")).alias("_different"),
        F.length("_body").alias("_chars"), F.length(F.regexp_replace("_body", "[^A-Z]+", "")).alias("_capitals"))
    fails = (
        F.col("_n") < MIN_WORDS,
        100 * F.col("_different") < MIN_DISTINCT_PERCENT * F.col("_n"),
        100 * F.col("_capitals").cast("long") > MAX_CAPITALS_PERCENT * F.col("_chars"),
        F.col("_body").rlike(MARKS),
    )
    mask = sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0))
    return rows.select("_key", "_part", mask.alias("_mask"), F.unhex(F.sha2("_body", 256)).alias("_text_id"))


def cells(rows: DataFrame, labels: DataFrame, label_key: str = "doc_id") -> DataFrame:
    """``_part, _mask, n, good, toxic``: rows counted per part and full mask.

    The last filter asks for the least key of a text. These keys go back to their rows by key, so
    the rows of a text that very many documents share are never brought together.
    """
    copy = 1 << FILTERS.index("E")
    label = labels.groupBy(F.col(label_key).alias("_key")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("_good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("_toxic"))
    named = rows.filter("_key IS NOT NULL")
    first = named.groupBy("_text_id").agg(F.min("_key").alias("_key")).withColumn("_first", F.lit(True))
    # Repeated rows of one key are counted before they are spread by it.
    named = named.groupBy("_key", "_text_id", "_part", "_mask").agg(F.count(F.lit(1)).alias("_rows"))
    named = named.join(first, ["_key", "_text_id"], "left").join(label, "_key", "left").select(
        "_part", F.when(F.col("_first"), F.col("_mask")).otherwise(F.col("_mask") + copy).alias("_mask"), "_rows",
        F.coalesce("_good", F.lit(0)).alias("_good"), F.coalesce("_toxic", F.lit(0)).alias("_toxic"))
    unnamed = rows.filter("_key IS NULL").select(
        "_part", "_mask", F.lit(1).cast("long").alias("_rows"), F.lit(0).alias("_good"), F.lit(0).alias("_toxic"))
    return named.unionByName(unnamed).groupBy("_part", "_mask").agg(
        F.sum("_rows").alias("n"), F.sum(F.col("_rows") * F.col("_good")).alias("good"),
        F.sum(F.col("_rows") * F.col("_toxic")).alias("toxic"))


def _counted(counts: dict[str, Column]) -> Column:
    return F.struct(*[counts[name].cast("long").alias(name) for name in COUNTS])


def _weighted(cell: Column, alive: Column, step: Column) -> Column:
    """The counts that a cell adds at one step: its documents are all there or all gone."""
    bit = F.call_function("shiftleft", F.lit(1), step)
    fails = cell["_mask"].bitwiseAND(bit) != 0

    def of(holds: Column, weight: str) -> Column:
        return F.when(holds, cell[weight]).otherwise(0)

    return _counted({
        "kept": of(alive & ~fails, "n"), "removed": of(alive & fails, "n"), "redundant": of(~alive & fails, "n"),
        "unique_fails": of(cell["_mask"] == bit, "n"), "good_lost": of(alive & fails, "good"),
        "toxic_lost": of(alive & fails, "toxic")})


def _fold(cell: Column, order: Column) -> Column:
    """One struct a step of ``order``."""
    kind = "array<struct<" + ",".join(f"{name}:bigint" for name in COUNTS) + ">>"
    start = F.struct(F.lit(True).alias("alive"), F.array().cast(kind).alias("steps"))

    def walk(state: Column, step: Column) -> Column:
        fails = cell["_mask"].bitwiseAND(F.call_function("shiftleft", F.lit(1), step)) != 0
        return F.struct((state["alive"] & ~fails).alias("alive"),
                        F.concat(state["steps"], F.array(_weighted(cell, state["alive"], step))).alias("steps"))

    return F.aggregate(order, start, walk, lambda state: state["steps"])


def audit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
          label_key: str = "doc_id") -> DataFrame:
    """One row per part, order and step: the counts and each filter's ``shapley`` sum."""
    counted = cells(kept_table(failures(df, key, text, source)), labels, label_key)
    # At most one cell a mask: 32 structs in a row, however many documents there are.
    parts = counted.groupBy("_part").agg(F.collect_list(F.struct("_mask", "n", "good", "toxic")).alias("_cells"))
    orders = F.array(*[F.array(*[F.lit(f) for f in order]) for order in ORDERS])
    steps = len(ORDERS) * len(FILTERS)
    zero = F.array_repeat(_counted({name: F.lit(0) for name in COUNTS}), steps)

    def added(total: Column, cell: Column) -> Column:
        own = F.flatten(F.transform("_orders", lambda order: _fold(cell, order)))
        return F.zip_with(total, own, lambda a, b: _counted({name: a[name] + b[name] for name in COUNTS}))

    parts = parts.withColumn("_orders", orders)
    parts = parts.withColumn("_steps", F.aggregate("_cells", zero, added))
    removals = F.zip_with(F.flatten("_orders"), "_steps", lambda f, s: F.struct(f.alias("f"), s["removed"].alias("x")))
    shapley = F.transform(
        F.sequence(F.lit(0), F.lit(len(FILTERS) - 1)), lambda f: F.aggregate(
            removals, F.lit(0).cast("long"), lambda a, r: a + F.when(r["f"] == f, r["x"]).otherwise(0)))
    parts = parts.withColumn("_shapley", shapley)
    names = F.array(*[F.lit(name) for name in ORDER_NAMES])
    out = parts.select(F.col("_part").alias("part"), "_orders", "_shapley", F.posexplode("_steps").alias("_at", "_s"))
    at_order, at_step = F.floor(F.col("_at") / len(FILTERS)).cast("int"), F.col("_at") % len(FILTERS)
    return out.select(
        "part", F.get(names, at_order).alias("filter_order"), (at_step + 1).cast("int").alias("step"), "_s.*",
        F.get("_shapley", F.get(F.get("_orders", at_order), at_step)).alias("shapley"))
