"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new ones.

Old sizes and new capacities make a flow network in which a byte that stays costs nothing and
one that moves costs one (or a given price per pair of shards). Its solution says how many bytes
go from which old shard to which new one. Rows follow it without being collected: each old shard
is laid out as one line of bytes, large rows first, so that what stays is the head of the line
and what moves is cut from its tail among small rows; a row goes where its middle byte falls.

Lines are cut into groups (old shard, size class, key bucket). One pass sums the groups, their
places in the lines and in the new shards follow from the sums, and a second pass places every
row inside its own group; no task sees a shard. Groups are a bounded table
(shards x size classes x buckets), which is why it may travel to every task.

Law: ``bytes``. New shards differ from their share by about the size of the rows at the cuts.

Defined cases: a null text has no bytes and a checksum of 0; rows without an old shard belong to
shard 0; repeated rows are placed each on its own; an empty table gives no rows; capacities that
do not add up are scaled to the bytes there are; other columns are carried along by ``rewrite``.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.shared import shared_folder

#: Bytes that a row costs besides its text.
ROW_BYTES = 8
#: Eighths of a doubling per size class: 8 bytes to 2 GB make 224 classes at most.
CLASSES_PER_DOUBLING = 8
BUCKETS = 16


@dataclass(frozen=True)
class Transfer:
    old: int
    new: int
    bytes: int


def min_cost_transfers(sizes: dict[int, int], capacities: dict[int, int],
                       price=lambda old, new: int(old != new)) -> list[Transfer]:
    """Cheapest flow from old shards to new ones, by successive shortest paths with potentials.

    The network has one node per shard, so its size does not depend on the rows.
    """
    total, room = sum(sizes.values()), sum(capacities.values())
    if total == 0:
        return []
    scaled, given, seen = {}, 0, 0
    for shard in sorted(capacities):  # shares add up to the total exactly
        seen += capacities[shard]
        scaled[shard] = total * seen // room - given
        given += scaled[shard]
    old, new = sorted(sizes), sorted(scaled)
    source, sink = 0, 1
    node = {("o", s): 2 + i for i, s in enumerate(old)}
    node |= {("n", s): 2 + len(old) + i for i, s in enumerate(new)}
    arcs: list[list[int]] = []  # to, room left, price; an arc's reverse is its neighbour
    leaving: list[list[int]] = [[] for _ in range(2 + len(node))]

    def arc(a: int, b: int, most: int, cost: int) -> None:
        leaving[a].append(len(arcs))
        arcs.append([b, most, cost])
        leaving[b].append(len(arcs))
        arcs.append([a, 0, -cost])

    for s in old:
        arc(source, node["o", s], sizes[s], 0)
    for s in new:
        arc(node["n", s], sink, scaled[s], 0)
    middle = len(arcs)
    for s in old:
        for d in new:
            arc(node["o", s], node["n", d], total, price(s, d))
    potential = [0] * len(leaving)
    while True:
        far = [None] * len(leaving)
        via = [-1] * len(leaving)
        far[source], queue = 0, [(0, source)]
        while queue:
            cost, at = heappop(queue)
            if cost > far[at]:
                continue
            for i in leaving[at]:
                to, left, step = arcs[i]
                reach = cost + step + potential[at] - potential[to]
                if left and (far[to] is None or reach < far[to]):
                    far[to], via[to] = reach, i
                    heappush(queue, (reach, to))
        if far[sink] is None:
            break
        potential = [p + (f if f is not None else 0) for p, f in zip(potential, far, strict=True)]
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = arcs[via[at] ^ 1][0]
        push = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= push
            arcs[i ^ 1][1] += push
    flows, i = [], middle
    for s in old:
        for d in new:
            if arcs[i + 1][1]:
                flows.append(Transfer(s, d, arcs[i + 1][1]))
            i += 2
    return flows


def _size(text: str) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def _grouped(df: DataFrame, key: str, text: str, old: Column) -> DataFrame:
    """``row`` (all columns of ``df``), its key, size, checksum and group: old shard, size class
    (large first), bucket."""
    doubling = F.floor(F.log2("_size") * CLASSES_PER_DOUBLING).cast("int")
    return df.select(
        F.struct(*[df[c] for c in df.columns]).alias("row"), F.col(key).alias("_key"),
        F.coalesce(old.cast("int"), F.lit(0)).alias("_old"), _size(text).alias("_size"),
        F.coalesce(F.crc32(F.col(text)), F.lit(0)).cast("long").alias("_crc"),
    ).withColumns({
        "_class": -doubling,
        "_bucket": F.pmod(F.xxhash64(F.col("_key").cast("string"), "_crc"), F.lit(BUCKETS)).cast("int"),
    })


def _cuts(flows: list[Transfer]) -> dict[int, list[tuple[int, int]]]:
    """Per old shard the ends of its stretches and where they go; what stays comes first."""
    out: dict[int, list[tuple[int, int]]] = {}
    for f in sorted(flows, key=lambda f: (f.old, f.new != f.old, f.new)):
        ends = out.setdefault(f.old, [])
        ends.append((f.bytes + (ends[-1][0] if ends else 0), f.new))
    return out


def _target(cuts: dict[int, list[tuple[int, int]]], middle: Column) -> Column:
    """New shard of a row whose middle lies at ``middle`` of its old shard's line."""
    shards = F.create_map(*[x for old, ends in cuts.items() for x in (F.lit(old), F.array(*[
        F.struct(F.lit(e).cast("long").alias("stop"), F.lit(s).alias("shard")) for e, s in ends]))])
    ends = shards[F.col("_old")]
    hit = F.filter(ends, lambda e: middle < e["stop"])
    return F.coalesce(F.get(hit, 0)["shard"], F.element_at(ends, -1)["shard"])


def assign(df: DataFrame, old: Column, new_shards: int, key: str = "doc_id", text: str = "text",
           capacities: dict[int, int] | None = None) -> tuple[DataFrame, list[Transfer]]:
    """``row``, ``_key``, ``_size``, ``_crc``, ``_old``, ``_shard`` (new) and the rank in its group
    of every row of ``df``; the transfers that they follow."""
    rows = _grouped(df, key, text, old)
    group = ["_old", "_class", "_bucket"]
    sums = rows.groupBy(*group).agg(F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    sizes = {r["_old"]: r["bytes"] for r in sums.groupBy("_old").agg(F.sum("bytes").alias("bytes")).collect()}
    flows = min_cost_transfers(sizes, capacities or dict.fromkeys(range(new_shards), 1))
    if not flows:
        return rows.withColumns({"_rank": F.lit(1), "_shard": F.lit(0)}), flows
    cuts = _cuts(flows)
    line = Window.partitionBy("_old").orderBy("_class", "_bucket")
    before = sums.withColumn("start", F.sum("bytes").over(line) - F.col("bytes")).select(*group, "start")
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Neighbouring groups come to one task, whose rows therefore go to few new shards.
    spread = rows.repartitionByRange(n, *group)
    inside = Window.partitionBy(*group).orderBy("_key", "_crc", "_size")
    placed = (spread.withColumn("_upto", F.sum("_size").over(
                  inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
              .withColumn("_rank", F.row_number().over(inside))
              .join(F.broadcast(before), group))
    placed = placed.withColumn("_shard", _target(
        cuts, F.col("start") + F.col("_upto") - F.expr("_size div 2 + _size % 2")))
    return placed.drop("start", "_upto"), flows


def _slots(placed: DataFrame) -> DataFrame:
    """Adds ``_slot``: groups in order, then ranks inside a group, counted from 0 per new shard."""
    group = ["_shard", "_old", "_class", "_bucket"]
    counts = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"), F.min("_rank").alias("_from"))
    ahead = Window.partitionBy("_shard").orderBy("_old", "_class", "_bucket")
    base = counts.select(*group, (F.sum("_rows").over(ahead) - F.col("_rows") - F.col("_from")).alias("_base"))
    return placed.join(F.broadcast(base), group).withColumn(
        "_slot", (F.col("_base") + F.col("_rank")).cast("long")).drop("_base")


def affected(flows: list[Transfer]) -> set[int]:
    """Shards whose files have to be written anew."""
    return {s for f in flows if f.old != f.new for s in (f.old, f.new)}


def rewrite(df: DataFrame, old: Column, new_shards: int, folder: str | None = None,
            key: str = "doc_id", text: str = "text", capacities: dict[int, int] | None = None) -> DataFrame:
    """Writes the affected shards as folders ``_shard=N`` and returns all rows: ``row`` with the
    columns of ``df``, ``_key``, ``_size``, ``_crc``, ``_old``, ``_shard`` and ``_slot``.

    Written shards are read back from their files. A shard that nothing leaves and nothing
    enters keeps the files it has; its rows come from ``df``.
    """
    folder = folder or shared_folder(df.sparkSession)
    placed, flows = assign(df, old, new_shards, key, text, capacities)
    written = [F.lit(s) for s in sorted(affected(flows))]
    changed = F.col("_shard").isin(*written) if written else F.lit(False)
    placed.filter(changed).write.partitionBy("_shard").parquet(folder)
    rows = df.sparkSession.read.schema(placed.schema).parquet(folder)
    if {f.new for f in flows} - affected(flows):
        rows = rows.unionByName(placed.filter(~changed))
    return _slots(rows)
