"""All registered queries of the package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import series
from gaugeworks.operators.ordered import top_n
from gaugeworks.plans import (
    analysis_queries,
    energy_queries,
    health_queries,
    match_queries,
    page_queries,
    state_queries,
    stream_queries,
    text_queries,
)
from gaugeworks.plans.bindings import HOUR, samples
from gaugeworks.plans.registry import ORACLES, QUERIES, Query, plain
from gaugeworks.session import utc_session

_MODULES = (
    energy_queries, text_queries, match_queries, health_queries, page_queries, state_queries,
    stream_queries, analysis_queries,
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    utc_session(spark)
    days = series.daily_energy(
        samples(spark, sf_dir), max_gap_seconds=6 * HOUR, tail_seconds=2 * HOUR
    ).select("site_id", "day", "kwh", "sample_count")
    return plain(top_n(days, ["site_id"], [F.col("kwh").desc(), F.col("day").asc()], 5))


def _in_utc(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(utc_session(spark), sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _in_utc(fn) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
