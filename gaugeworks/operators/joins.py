"""As-of, nearest and range joins without cross products.

As-of and nearest joins put both sides into one ordered series per (key, time bucket).
Range joins cut ranges into fixed time cells, so the join is an equi-join on (key, cell)
that adaptive execution can split when a cell is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.ordered import (
    DAY_SECONDS,
    bucket_of,
    carry_last,
    micros,
    seconds_between,
    with_halo,
)


def _stack(left, right, keys, left_ts, right_ts, payload, *, left_first: bool) -> DataFrame:
    """Distinct left instants and all right rows as (keys, _ts, _side, _right); ``_side``
    orders equal instants. However many left rows share an instant, it is solved once."""
    lhs = left.select(*keys, F.col(left_ts).alias("_ts")).distinct().select(
        *keys, "_ts", F.lit(0 if left_first else 1).alias("_side"), F.lit(None).alias("_right"))
    rhs = right.select(
        *keys, F.col(right_ts).alias("_ts"), F.lit(1 if left_first else 0).alias("_side"),
        F.struct(F.col(right_ts).alias("matched_ts"), payload.alias("matched")).alias("_right"),
    )
    return lhs.unionByName(rhs)


def _attach(solved: DataFrame, left: DataFrame, keys: Sequence[str], left_ts: str) -> DataFrame:
    """Left rows with the answer of their instant. The join is an equi-join whose left side
    adaptive execution may split, so a heap of left rows at one instant is no hot task."""
    answers = solved.filter(F.col("_hit").isNotNull()).select(
        *keys, F.col("_ts").alias(left_ts), F.col("_hit.matched").alias("matched"),
        F.col("_hit.matched_ts").alias("matched_ts"))
    return left.join(answers, [*keys, left_ts], "left").select(*left.columns, "matched", "matched_ts")


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    left_ts: str,
    right_ts: str = "ts",
    payload: Column,
    strict: bool = False,
    bucket_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Left rows with ``matched`` / ``matched_ts`` of the latest right row at or before
    ``left_ts`` (strictly before with ``strict``), however far back it lies.

    Right rows must be unique per (keys, right_ts); reduce them first otherwise.
    """
    both = _stack(left, right, keys, left_ts, right_ts, payload, left_first=strict)
    both = carry_last(
        both, keys, ["_ts", "_side"], F.col("_right"), "_hit", bucket_seconds=bucket_seconds
    )
    return _attach(both.filter(F.col("_right").isNull()), left, keys, left_ts)


def asof_within_interval(
    intervals: DataFrame,
    samples: DataFrame,
    keys: Sequence[str] = ("site_id",),
    *,
    payload: Column,
    slack_seconds: int = 600,
    bucket_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Latest sample inside ``[start_ts, end_ts)``, else the latest one before ``end_ts`` that
    is at most ``slack_seconds`` older than it. Both cases are one bound on the sample."""
    joined = asof_backward(
        intervals, samples, keys, left_ts="end_ts", payload=payload, strict=True,
        bucket_seconds=bucket_seconds,
    )
    floor = F.least(
        F.col("start_ts"), F.timestamp_micros(micros("end_ts") - slack_seconds * 1_000_000)
    )
    keep = F.col("matched_ts") >= floor
    return joined.withColumn("matched", F.when(keep, F.col("matched"))).withColumn(
        "matched_ts", F.when(keep, F.col("matched_ts"))
    )


def nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    left_ts: str = "ts",
    right_ts: str = "ts",
    payload: Column,
    tolerance_seconds: float = 600,
    bucket_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Nearest right row on either side, strictly closer than the tolerance; ties go back.

    The tolerance bounds the look-around, so right rows near a bucket edge are repeated in
    the neighbouring bucket and no second pass over the data is needed.
    """
    both = _stack(left, right, keys, left_ts, right_ts, payload, left_first=False)
    both = with_halo(
        both, "_ts", bucket_seconds=bucket_seconds,
        before=tolerance_seconds, after=tolerance_seconds,
    ).filter(F.col("_own") | F.col("_right").isNotNull())
    # One sort serves both sides: the frames of the next and of the last right row share it. A right
    # row at the same instant comes first, so it is the one behind.
    by = ", ".join(f"`{k}`" for k in [*keys, "_bucket"])
    both = both.withColumns({name: F.expr(
        f"{look}(_right) IGNORE NULLS OVER (PARTITION BY {by} ORDER BY _ts, _side)")
        for name, look in (("_b4", "lag"), ("_aft", "lead"))})
    to_back = seconds_between(F.col("_ts"), F.col("_b4.matched_ts"))
    to_ahead = seconds_between(F.col("_aft.matched_ts"), F.col("_ts"))
    back_ok = to_back < tolerance_seconds
    ahead_ok = to_ahead < tolerance_seconds
    hit = F.when(back_ok & (~F.coalesce(ahead_ok, F.lit(False)) | (to_back <= to_ahead)),
                 F.col("_b4")).when(ahead_ok, F.col("_aft"))
    solved = both.filter(F.col("_right").isNull()).withColumn("_hit", hit)
    return _attach(solved, left, keys, left_ts)


def range_join(
    points: DataFrame,
    ranges: DataFrame,
    keys: Sequence[str],
    *,
    point_ts: str = "ts",
    start: str = "start_ts",
    end: str = "end_ts",
    closed: bool = False,
    cell_seconds: int = 3600,
    how: str = "inner",
) -> DataFrame:
    """Pairs of point and range with ``start <= point < end`` (``<= end`` when closed).

    A range is one row for each cell it touches; ``sweep_join`` is the choice for ranges much
    longer than any useful cell.
    """
    last_inside = F.col(end) if closed else F.timestamp_micros(micros(end) - 1)
    cells = F.sequence(bucket_of(start, cell_seconds), bucket_of(last_inside, cell_seconds))
    usable = F.col(end) >= F.col(start) if closed else F.col(end) > F.col(start)
    cut = ranges.filter(usable).withColumn("_cell", F.explode(cells))
    tagged = points.withColumn("_cell", bucket_of(point_ts, cell_seconds))
    p, r = tagged.alias("p"), cut.alias("r")
    same = F.col("p._cell") == F.col("r._cell")
    for key in keys:
        same = same & (F.col(f"p.{key}") == F.col(f"r.{key}"))
    t = F.col(f"p.{point_ts}")
    upper = t <= F.col(f"r.{end}") if closed else t < F.col(f"r.{end}")
    joined = p.join(r, same & (t >= F.col(f"r.{start}")) & upper, how)
    extra = [c for c in ranges.columns if c not in points.columns]
    return joined.select(
        *[F.col(f"p.{c}").alias(c) for c in points.columns],
        *[F.col(f"r.{c}").alias(c) for c in extra],
    )


def sweep_join(
    points: DataFrame,
    ranges: DataFrame,
    keys: Sequence[str],
    *,
    lanes: Sequence[str] = (),
    point_ts: str = "ts",
    start: str = "start_ts",
    end: str = "end_ts",
    closed: bool = False,
    bucket_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """``range_join`` for ranges that do not overlap within a key and lane, as the sessions of a zone.

    Starts and points form one series per lane, and the last start is carried to each point, which
    is inside if that range has not ended. A range is one row however long it lasts; a point is one
    row a lane of its key.
    """
    by = [*keys, *lanes]
    if lanes:
        points_in = points.join(ranges.select(*by).distinct(), list(keys))
    else:
        points_in = points
    lhs = points_in.select(*by, F.col(point_ts).alias("_ts"), F.lit(1).alias("_side"),
                           F.struct(*points.columns).alias("_point"), F.lit(None).alias("_range"))
    usable = F.col(end) >= F.col(start) if closed else F.col(end) > F.col(start)
    rhs = ranges.filter(usable).select(
        *by, F.col(start).alias("_ts"), F.lit(0).alias("_side"), F.lit(None).alias("_point"),
        F.struct(*ranges.columns).alias("_range"))
    both = carry_last(lhs.unionByName(rhs), by, ["_ts", "_side"], F.col("_range"), "_open", bucket_seconds=bucket_seconds)
    last = F.col(f"_open.{end}")
    inside = (F.col("_ts") <= last) if closed else (F.col("_ts") < last)
    extra = [c for c in ranges.columns if c not in points.columns]
    return both.filter(F.col("_point").isNotNull() & inside).select(
        *[F.col(f"_point.{c}").alias(c) for c in points.columns], *[F.col(f"_open.{c}").alias(c) for c in extra])


def interval_value_at(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str] = ("site_id",),
    *,
    point_key: Sequence[str],
    value: str,
    out: str,
    cell_seconds: int = 900,
    disjoint: bool = False,
) -> DataFrame:
    """Value of the earliest-starting interval that contains each point; null without one.

    Say ``disjoint`` when the intervals of a key do not overlap, as those of one meter: a
    point then meets one interval at most and the reduction per point is left out.
    """
    slim = intervals.select(
        *keys, F.col("start_ts").alias("_rs"), F.col("end_ts").alias("_re"),
        F.col(value).alias("_rv"),
    )
    pairs = range_join(
        points, slim, keys, start="_rs", end="_re", cell_seconds=cell_seconds, how="left"
    )
    if disjoint:
        return pairs.select(*points.columns, F.col("_rv").alias(out))
    by = list(dict.fromkeys([*keys, *point_key]))
    rest = [c for c in points.columns if c not in by]
    return pairs.groupBy(*by).agg(
        *[F.first(c).alias(c) for c in rest], F.min_by("_rv", "_rs").alias(out)
    ).select(*points.columns, out)


# ---- substring joins -----------------------------------------------------------------

def _grams(text: Column, n: int) -> Column:
    last = F.length(text) - (n - 1)
    grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, n))
    return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))


COMMON_LETTERS = "etaoinsrhl "


def _filing_piece(needle: Column) -> Column:
    """The piece a needle is filed under: its three-letter piece with the fewest common
    letters, or the whole needle when it is shorter. A row expression, no statistics."""
    def common(piece: Column) -> Column:
        return F.length(piece) - F.length(F.translate(piece, COMMON_LETTERS, ""))

    ranked = F.transform(_grams(needle, 3), lambda g: F.struct(
        common(g).alias("c"), F.xxhash64(g).alias("h"), g.alias("g")))
    return F.when(F.length(needle) < 3, needle).otherwise(F.array_min(ranked)["g"])


#: Needle rows that every task may hold.
FEW_NEEDLES = 10_000


def contains_pairs(
    hay: DataFrame,
    needles: DataFrame,
    *,
    hay_text: str,
    needle_text: str,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Every (hay, needle) row pair whose hay text contains the needle text, each once.

    An exact substring join without a cross product: a needle is filed under one short piece
    of itself and looked up under all pieces of a hay text. ``keys`` must be equal too. Column
    names of the sides must differ except for ``keys``.

    The needles are counted first. Few go to all tasks, and hay rows meet them where they lie. Of
    many, only distinct texts take part, and of these only a number and a piece are spread; a
    text comes back for the containment test where a piece was met, and the other columns of both
    sides after it. Those joins are merged, since the planner takes spread pieces for no larger
    than the files they are made from, and would send them all to the driver.
    """
    keys = list(keys)
    h = F.col(hay_text)
    pieces = F.explode(F.array_distinct(F.concat(_grams(h, 1), _grams(h, 2), _grams(h, 3)))).alias("_gram")
    some = needles.filter(F.length(needle_text) > 0)
    if some.limit(FEW_NEEDLES + 1).count() <= FEW_NEEDLES:
        filed = some.withColumn("_gram", _filing_piece(F.col(needle_text)))
        spread = hay.filter(F.length(hay_text) > 0).select("*", pieces)
        met = spread.join(F.broadcast(filed), [*keys, "_gram"]).filter(F.contains(h, F.col(needle_text)))
        rest = [c for c in hay.columns if c not in (*keys, hay_text)]
        more = [c for c in needles.columns if c not in (*keys, needle_text)]
        return met.select(*keys, needle_text, hay_text, *rest, *more)
    texts = hay.filter(F.length(hay_text) > 0).select(*keys, hay_text).distinct().withColumn(
        "_text", F.xxhash64(hay_text))
    filed = some.select(*keys, needle_text).distinct().withColumn("_gram", _filing_piece(F.col(needle_text)))
    met = texts.select(*keys, "_text", pieces).join(filed.hint("merge"), [*keys, "_gram"]).drop("_gram").distinct()
    hits = met.hint("merge").join(texts, [*keys, "_text"]).filter(
        F.contains(h, F.col(needle_text))).select(*keys, hay_text, needle_text)
    return hay.join(hits.hint("merge"), [*keys, hay_text]).join(needles.hint("merge"), [*keys, needle_text])
