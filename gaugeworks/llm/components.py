"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round points every node's neighbours at the smallest node it knows; the tables shrink to
one edge per node and its component's smallest node. Rounds are joins and aggregates on nodes,
kept in the shared folder; only a count and a checksum come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import kept_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (both.filter("v > u").join(least, "u")
            .select(F.least("m", "u").alias("a"), F.col("v").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    others = (edges.join(least, "b").filter("a > m")
              .select(F.col("m").alias("a"), F.col("a").alias("b")))
    return least.select(F.col("m").alias("a"), "b").union(others).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the component's smallest
    node. Repeated, reversed and self edges are allowed, nulls are dropped."""
    now = kept_table(edges.filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        now = kept_table(_small_star(_large_star(now)))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(a, b) AS decimal(38, 0)))")).first()
    return row[0], row[1]
