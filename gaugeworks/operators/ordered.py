"""Ordered-series building blocks that never put a whole key into one task.

A window over ``partitionBy(site).orderBy(ts)`` sends every row of a site to one task. One
site may hold a third of the data, so every helper here splits a key into time buckets:

* bounded look-around (a gap or tolerance limit is known): rows near a bucket edge are also
  emitted into the neighbouring bucket (a *halo*), a map-side step, and one window per
  (key, bucket) then sees everything it needs;
* unbounded look-around: each bucket is summarised by one edge row with a partial
  aggregate, the edge rows are carried from bucket to bucket, and the carried value is
  joined back on (key, bucket). The carry window holds one row per bucket of a key.

Keys must not be null. Rows of a bucket are bounded by its width and the sampling rate, so
pick a narrower bucket for faster sampling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

DAY_SECONDS = 86_400
BUCKET = "_bucket"


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a TIMESTAMP column."""
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def seconds_between(later: Column, earlier: Column) -> Column:
    """``later - earlier`` in seconds, fractions kept."""
    return (micros(later) - micros(earlier)) / F.lit(1_000_000.0)


def bucket_of(ts: Column | str, bucket_seconds: int) -> Column:
    """Number of the fixed-width bucket holding ``ts``, by integer division towards minus."""
    width = F.lit(bucket_seconds * 1_000_000).cast("long")
    return F.call_function("div", micros(ts) - F.pmod(micros(ts), width), width)


def _halo_buckets(ts: Column, bucket_seconds: int, before: float, after: float) -> Column:
    """Buckets that must see a row at ``ts``: its own, the earlier one when the row lies
    within ``before`` seconds of its bucket's start, the later one likewise with ``after``."""
    own = bucket_of(ts, bucket_seconds)
    width = bucket_seconds * 1_000_000
    into = micros(ts) - own * F.lit(width)
    early = into <= F.lit(int(before * 1_000_000)) if before else F.lit(False)
    late = F.lit(width) - into <= F.lit(int(after * 1_000_000)) if after else F.lit(False)
    return (
        F.when(early & late, F.array(own, own - 1, own + 1)).when(early, F.array(own, own - 1))
        .when(late, F.array(own, own + 1)).otherwise(F.array(own))
    )


def with_halo(
    df: DataFrame, ts: str, *, bucket_seconds: int, before: float = 0, after: float = 0
) -> DataFrame:
    """Add ``_bucket`` and ``_own``; edge rows also appear, not owned, in the neighbour."""
    if max(before, after) > bucket_seconds:
        raise ValueError("look-around must not exceed the bucket width")
    return (
        df.withColumn(BUCKET, F.explode(_halo_buckets(F.col(ts), bucket_seconds, before, after)))
        .withColumn("_own", F.col(BUCKET).eqNullSafe(bucket_of(ts, bucket_seconds)))
    )


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    payload: Column,
    out: str,
    **options,
) -> DataFrame:
    """Nearest non-null ``payload`` earlier in the order; see :func:`carry_last_of`."""
    return carry_last_of(df, keys, order, {out: payload}, **options)


def carry_last_of(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    payloads: dict[str, Column],
    *,
    inclusive: bool = False,
    backwards: bool = False,
    bucket_seconds: int = DAY_SECONDS,
    bucket: Column | None = None,
) -> DataFrame:
    """For each output name the nearest non-null payload earlier (later when ``backwards``).

    ``order[0]`` must be the TIMESTAMP column unless ``bucket`` brings a number that never falls
    along the order; the rest break ties. ``inclusive`` lets a row see its own payload. Equal to
    ``last(payload, ignorenulls)`` over the whole key, with the key split into buckets. All
    payloads share one window and one table of bucket edges.
    """
    keys = list(keys)
    ranked = F.struct(*[F.col(c) for c in order])
    names = {out: f"_p{i}" for i, out in enumerate(payloads)}
    df = df.withColumns({names[out]: payload for out, payload in payloads.items()})
    df = df.withColumn(BUCKET, bucket_of(order[0], bucket_seconds) if bucket is None else bucket)
    ordering = [F.col(c).desc() if backwards else F.col(c).asc() for c in order]
    inside = (
        Window.partitionBy(*keys, BUCKET)
        .orderBy(*ordering)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    pick = F.min_by if backwards else F.max_by
    edges = df.groupBy(*keys, BUCKET).agg(*[
        pick(p, F.when(F.col(p).isNotNull(), ranked)).alias(f"{p}_edge") for p in names.values()
    ])
    across = (
        Window.partitionBy(*keys)
        .orderBy(F.col(BUCKET).desc() if backwards else F.col(BUCKET).asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = [
        F.last(f"{p}_edge", ignorenulls=True).over(across).alias(f"{p}_carry") for p in names.values()
    ]
    edges = edges.select(*keys, BUCKET, *carried)
    df = df.withColumns({
        f"{p}_inside": F.last(p, ignorenulls=True).over(inside) for p in names.values()
    })
    joined = df.join(edges, [*keys, BUCKET], "left")
    found = {out: F.coalesce(f"{p}_inside", f"{p}_carry") for out, p in names.items()}
    scratch = [f"{p}{end}" for p in names.values() for end in ("", "_inside", "_carry")]
    return joined.withColumns(found).drop(*scratch, BUCKET)


def carry_last_with_ties(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    payloads: dict[str, Column],
    *,
    tie_width: int = 10_000,
    bucket_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """As ``carry_last_of`` in the order of ``ts`` and then of the whole number ``tie``, for data in
    which one instant of a key may hold any number of rows.

    An instant's rows are summarised by one mergeable aggregate, and only these summaries are carried
    along the key. Inside an instant the same is done once more over slices of ``tie_width`` tie
    numbers, so no window holds more than a slice or a bucket of instants.
    """
    keys = list(keys)
    names = {out: f"_t{i}" for i, out in enumerate(payloads)}
    df = df.withColumns({names[out]: payload for out, payload in payloads.items()})
    instants = df.groupBy(*keys, ts).agg(*[
        F.max_by(p, F.when(F.col(p).isNotNull(), F.col(tie))).alias(p) for p in names.values()])
    before = carry_last_of(instants, keys, [ts], {f"{p}_before": F.col(p) for p in names.values()},
                           bucket_seconds=bucket_seconds).drop(*names.values())
    width = F.lit(tie_width)
    slice_of = F.call_function("div", F.col(tie) - F.pmod(F.col(tie), width), width)
    inside = carry_last_of(df, [*keys, ts], [tie], {f"{p}_own": F.col(p) for p in names.values()}, bucket=slice_of)
    out = inside.join(before, [*keys, ts], "left")
    scratch = [f"{p}{end}" for p in names.values() for end in ("", "_own", "_before")]
    return out.withColumns({o: F.coalesce(f"{p}_own", f"{p}_before") for o, p in names.items()}).drop(*scratch)


def gap_sessions(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    gap_seconds: float,
    *,
    best: tuple[Column, Column] | None = None,
    bucket_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Group rows of a key into sessions; a new one starts when the gap exceeds the limit.

    A gap equal to the limit joins. Output: keys, ``session_start``, ``session_end`` (first
    and last row), ``sample_count`` and, with ``best=(value, rank)``, ``best_value`` and
    ``best_rank`` of the top-ranked row.

    Rows of one instant are merged first, with map-side aggregation, so copies never fill a
    bucket. Sessions are then cut inside (key, bucket), and the pieces that reach a bucket
    edge are chained per key: at most two pieces per bucket take part in that second window.
    """
    keys = list(keys)
    gap = F.lit(int(gap_seconds * 1_000_000))
    width = F.lit(bucket_seconds * 1_000_000)
    first = [F.count(F.lit(1)).alias("_n")]
    partial = [F.min("_us").alias("_s"), F.max("_us").alias("_e"), F.sum("_n").alias("_n")]
    merge = [
        F.timestamp_micros(F.min("_s")).alias("session_start"),
        F.timestamp_micros(F.max("_e")).alias("session_end"),
        F.sum("_n").alias("sample_count"),
    ]
    if best is not None:
        value, rank = best
        first += [F.max_by(value, rank).alias("_bv"), F.max(rank).alias("_br")]
        again = [F.max_by("_bv", "_br").alias("_bv"), F.max("_br").alias("_br")]
        partial += again
        merge += [again[0].alias("best_value"), again[1].alias("best_rank")]
    rows = df.groupBy(*keys, ts).agg(*first)
    rows = rows.withColumn("_us", micros(ts)).withColumn(BUCKET, bucket_of(ts, bucket_seconds))
    inside = Window.partitionBy(*keys, BUCKET).orderBy("_us")
    starts = F.when(F.col("_us") - F.lag("_us").over(inside) <= gap, 0).otherwise(1)
    rows = rows.withColumn("_new", starts)
    rows = rows.withColumn(
        "_piece", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    pieces = rows.groupBy(*keys, BUCKET, "_piece").agg(*partial)
    at_edge = (F.col("_s") - F.col(BUCKET) * width <= gap) | (
        (F.col(BUCKET) + 1) * width - F.col("_e") <= gap
    )
    pieces = pieces.withColumn("_chain", F.when(~at_edge, F.col(BUCKET)))
    chain = Window.partitionBy(*keys, "_chain").orderBy("_s")
    pieces = pieces.withColumn(
        "_new", F.when(F.col("_s") - F.lag("_e").over(chain) <= gap, 0).otherwise(1)
    )
    pieces = pieces.withColumn(
        "_sid", F.sum("_new").over(chain.rowsBetween(Window.unboundedPreceding, 0))
    )
    return pieces.groupBy(*keys, "_chain", "_sid").agg(*merge).drop("_chain", "_sid")


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key, as one mergeable aggregate (no window, no sort)."""
    return pick_row(df, keys, order, latest=True)


def earliest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key, as one mergeable aggregate."""
    return pick_row(df, keys, order, latest=False)


def pick_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], *, latest: bool
) -> DataFrame:
    columns = list(df.columns)
    keys = list(keys)
    rest = [c for c in columns if c not in keys]
    ranked = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    choose = F.max_by if latest else F.min_by
    picked = df.groupBy(*keys).agg(choose(F.struct(*rest), ranked).alias("_row"))
    return picked.select(
        *[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in columns]
    )


def top_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """First ``n`` rows per key. The ``row_number <= n`` filter is planned with a map-side
    group limit, so a hot key ships at most ``n`` rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= max(n, 0))
