"""Mixing sources to target weights by entropy balancing.

Rates, one a document, are asked for that stay nearest to 1 in relative entropy, are at most
``MAX_RATE``, and give every source its target of tokens. Such rates are exponential tilts:
``min(MAX_RATE, exp(lambda * size / scale))`` with one multiplier a token constraint. The multipliers
solve the convex dual of that problem; as a document counts towards one constraint, the Hessian
is diagonal and a Newton step is a division a source. The steps run as Spark jobs over the table of
(source, size) counts, which holds all that the dual needs to know of the documents, and are kept
inside a bracket that every step narrows.

Rates are then rounded to whole copies. Rows of a source are dealt into segments of bounded size
by key hash; a segment goes from its largest document to its smallest and takes the rate's floor
or ceiling, whichever leaves the running error in tokens smaller. Small documents come last, so they
take up what large ones left; a second turn does the same for sources of a few documents.

Sums of rates are added as whole numbers of 2**-30, so they do not depend on the order in which
tasks end, and reruns agree to the last row.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of its own,
after all others; rows that repeat a key and size count each, and are alike up to the copies that
rounding gives some of them; a null key is a key; an empty table gives no rows; other columns are
not looked at.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import kept_table, words

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
MAX_RATE = 3
#: Rates are whole numbers of 2**-30 wherever they are added up.
ONE = 1 << 30
#: The dual is solved when every source is within this share of its target.
TOLERANCE = 1e-6
#: Every step halves a bracket at least where Newton's step leaves it; this ends any bracket.
MAX_STEPS = 80
#: Rows of a source that are rounded together.
SEGMENT_ROWS = 100_000
#: Up to so many bytes (names and 64 a source) the table of sources is sent to all tasks; beyond, rows
#: and sources are shuffled by source and adaptive execution splits the hot ones.
SENT_BYTES = 8 << 20
#: Repeated rows that one step of the final unpacking holds.
CHUNK = 10_000
WIDE = "decimal(38,0)"


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ranked(sources: DataFrame, column: str) -> DataFrame:
    """``sources`` with ``_rank`` from 0 in code point order, null last, and no single task.

    Rows are numbered inside the partitions of a distributed sort; only partition sizes come to
    the driver, one number a partition.
    """
    ordered = kept_table(sources.orderBy(F.col(column).asc_nulls_last()).withColumn(
        "_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = sorted((r["_p"], r["n"]) for r in ordered.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, {}
    for number, n in sizes:
        starts[number], before = before, before + n
    if not starts:
        return ordered.withColumn("_rank", F.col("_id")).drop("_id")
    start = F.create_map(*[F.lit(x).cast("long") for pair in starts.items() for x in pair])
    return ordered.withColumn("_rank", F.try_element_at(start, part.cast("long")) + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")


def with_targets(sources: DataFrame, weight: str = "_weight", size: str = "source_size") -> DataFrame:
    """``target`` per source: all tokens shared by weight, none above ``MAX_RATE`` times its size.

    What a source cannot take is shared again among the others by weight, until none is above.
    Two sums a round come to the driver; a round that caps no further source is the last.
    """
    total = sources.agg(F.sum(F.col(size).cast(WIDE)).alias("t")).first()["t"] or 0
    cap = MAX_RATE * F.col(size)
    share = 0.0  # what one unit of weight gets
    while True:
        # Sources that were above at a smaller share stay capped: shares never fall.
        capped = F.col(weight) * F.lit(share) > cap
        row = sources.agg(
            F.coalesce(F.sum(F.when(capped, cap.cast(WIDE))), F.lit(0)).alias("c"),
            F.coalesce(F.sum(F.when(~capped, F.col(weight))), F.lit(0)).alias("w")).first()
        following = float(int(total) - int(row["c"])) / float(row["w"]) if row["w"] else share
        if following <= share:
            break
        share = following
    return sources.withColumn("target", F.least(F.col(weight) * F.lit(share), cap.cast("double")))


def _rate(multiplier: Column, size: Column, scale: Column) -> Column:
    """The tilted rate in whole numbers of 2**-30."""
    return F.floor(F.least(F.lit(float(MAX_RATE)), F.exp(multiplier * size / scale)) * ONE + F.lit(0.5)).cast("long")


def solve(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """``_source, _multiplier, _scale`` of every source that has tokens.

    ``cells``: ``_source, size, _n`` with sizes over 0; ``sources``: ``_source, source_size,
    target, _least`` (the smallest size over 0), ``_scale``.
    """
    ratio = F.col("target") / F.col("source_size")
    steepest = F.col("_scale") / F.col("_least")
    below = ratio < 1
    # From all rates of 1 to the multiplier that puts the smallest document at its bound: the
    # target lies between. A target of all that a source can give has its answer at that bound.
    low = F.when(below, F.log(ratio) * steepest).otherwise(0.0)
    high = F.when(below, 0.0).otherwise(math.log(MAX_RATE) * steepest * (1 + 1e-9))
    state = kept_table(sources.filter("source_size > 0").select(
        "_source", "target", "_scale", low.alias("_low"), high.alias("_high"),
        F.when(F.col("target") >= MAX_RATE * F.col("source_size"), high).otherwise(0.0).alias("_multiplier")))
    for _ in range(MAX_STEPS):
        rate = _rate(F.col("_multiplier"), F.col("size"), F.col("_scale"))
        mass = F.col("size").cast(WIDE) * F.col("_n")
        tilted = cells.join(state, "_source").select(
            "_source", rate.alias("_r"), mass.alias("_m"), F.col("size").alias("_size"))
        # A document at the largest rate no longer moves with the multiplier.
        free = F.col("_r") < MAX_RATE * ONE
        sums = tilted.groupBy("_source").agg(
            F.sum((F.col("_m") * F.col("_r")).cast(WIDE)).alias("_f"),
            F.sum(F.when(free, (F.col("_m") * F.col("_r") * F.col("_size")).cast(WIDE))).alias("_g"))
        gap = F.col("target") - F.col("_f").cast("double") / ONE
        slope = F.coalesce(F.col("_g").cast("double"), F.lit(0.0)) / ONE / F.col("_scale")
        state = state.join(sums, "_source").withColumn("_gap", gap).withColumns({
            "_low": F.when(F.col("_gap") > 0, F.col("_multiplier")).otherwise(F.col("_low")),
            "_high": F.when(F.col("_gap") < 0, F.col("_multiplier")).otherwise(F.col("_high")),
            "_done": F.abs("_gap") <= TOLERANCE * F.col("target")})
        step = F.col("_multiplier") + F.try_divide(F.col("_gap"), slope)
        inside = (step > F.col("_low")) & (step < F.col("_high"))
        # A source that is done keeps its multiplier; one without a usable step is bisected.
        state = kept_table(state.select(
            "_source", "target", "_scale", F.when(F.col("_done"), F.col("_multiplier")).when(inside, step).otherwise(
                (F.col("_low") + F.col("_high")) / 2).alias("_multiplier"), "_low", "_high", "_done"))
        if state.filter("NOT _done").isEmpty():
            break
    return state.select("_source", "_multiplier", "_scale")


def _nearest(error: int, unit: int, least: int, most: int) -> int:
    """The whole number of units nearest to ``error``, between ``least`` and ``most``."""
    return max(least, min(most, (2 * error + unit) // (2 * unit)))


def round_segment(sizes, rates, counts):
    """Copies of each group of equal rows, groups in falling size; whole numbers throughout.

    First every row gets its rate's floor or ceiling, whichever keeps the running error in tokens
    smaller. What is left over, as in sources of a few documents, is then taken up by one copy
    more or less a row, within 0 and ``MAX_RATE``, again from large to small.
    """
    rows = [(int(size) * ONE, int(rate), int(n)) for size, rate, n in zip(sizes, rates, counts, strict=True)]
    error, copies = 0, []
    for unit, rate, n in rows:
        floor, part = divmod(rate, ONE)
        error += part * (unit // ONE) * n
        more = _nearest(error, unit, 0, n) if part and unit else 0
        error -= more * unit
        copies.append(floor * n + more)
    for i, (unit, _, n) in enumerate(rows):
        if unit:
            change = _nearest(error, unit, -min(n, copies[i]), min(n, MAX_RATE * n - copies[i]))
            error -= change * unit
            copies[i] += change
    return copies


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        size: Column | None = None) -> DataFrame:
    """Key, source, ``size``, ``source_size``, ``target``, ``rate``, ``copies`` and ``taken`` of every row.

    ``size`` counts the tokens of a row; words unless another is given.
    """
    counted = word_count(F.col(text)) if size is None else size.cast("long")
    rows = kept_table(df.select(F.col(key).alias("_key"), F.col(source).alias("_name"), counted.alias("size")))
    # Numbers stand for the names from here on, and equal rows for each other.
    per_source = rows.groupBy("_name").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("_least"),
        F.count_if(F.col("size") > 0).alias("_filled"))
    weight = F.get(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("_rank") % len(WEIGHTS)).cast("int"))
    sources = ranked(per_source, "_name").withColumn("_weight", weight).withColumnRenamed("_rank", "_source")
    sources = kept_table(with_targets(sources).withColumn("_scale", F.try_divide("source_size", "_filled")))
    held = sources.agg(F.sum(64 + F.coalesce(F.octet_length("_name"), F.lit(0)))).first()[0] or 0

    def sent(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if held <= SENT_BYTES else table

    numbered = kept_table(rows.groupBy("_key", "_name", "size").agg(F.count(F.lit(1)).alias("_n")).join(
        sent(sources.select(F.col("_name").alias("_own"), "_source")), F.col("_name").eqNullSafe(F.col("_own"))).select(
        "_key", "_source", "size", "_n"))
    cells = kept_table(numbered.filter("size > 0").groupBy("_source", "size").agg(F.sum("_n").alias("_n")))
    tilt = solve(cells, sources).drop("_scale")
    about = sources.join(tilt, "_source", "left").select(
        "_source", "_name", "source_size", "target", "_scale", "_multiplier",
        F.ceil(F.col("_rows") / SEGMENT_ROWS).cast("int").alias("_segments"))
    spread = F.xxhash64("_key", "size")
    rated = numbered.join(sent(about.drop("_name", "source_size", "target")), "_source").select(
        "_key", "_source", "size", "_n", F.pmod(spread, F.col("_segments")).alias("_segment"), spread.alias("_hash"),
        F.when(F.col("size") > 0, _rate(F.col("_multiplier"), F.col("size"), F.col("_scale"))).otherwise(0).alias("_rate"))

    def rounded(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("_hash", "ascending"), ("_key", "ascending")])
        copies = round_segment(*(group[name].to_pylist() for name in ("size", "_rate", "_n")))
        return group.select(["_key", "_source", "size", "_n", "_rate"]).append_column("_all", pa.array(copies, pa.int64()))

    kind = rows.schema["_key"].dataType.simpleString()
    out = rated.groupBy("_source", "_segment").applyInArrow(
        rounded, f"_key {kind}, _source long, size long, _n long, _rate long, _all long")
    # Equal rows share their copies, the first ones get one more; they are unpacked in two steps.
    out = out.withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (_n - 1) div {CHUNK})")))
    out = out.withColumn("_row", F.explode(F.expr(
        f"sequence(_chunk * {CHUNK}, least(_n, (_chunk + 1) * {CHUNK}) - 1)")))
    copies = F.expr("_all div _n + if(_row < _all % _n, 1, 0)")
    return out.join(sent(about.select("_source", "_name", "source_size", "target")), "_source").select(
        F.col("_key").alias(key), F.col("_name").alias(source), "size", "source_size", "target",
        (F.col("_rate") / ONE).alias("rate"), copies.cast("long").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"))
