"""Saved-search catalogs: JSON list cells, defaults, status filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.text import lenient_list


def decode_lists(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """List cells as arrays (JSON, comma list or single value); ``enabled`` defaults to true."""
    out = rows.withColumns({c: lenient_list(c) for c in columns})
    if "enabled" in rows.columns:
        out = out.withColumn("enabled", F.coalesce("enabled", F.lit(True)))
    return out


LIST_COLUMNS = ("source_sites", "search_terms", "include_keywords", "exclude_keywords")


def read_searches(rows: DataFrame, status: str | None = None) -> DataFrame:
    """Catalog table in creation order, optionally of one status."""
    out = decode_lists(rows, [c for c in LIST_COLUMNS if c in rows.columns])
    if status is not None:
        out = out.filter(F.col("status") == status)
    return out.orderBy("created_at")


# Column names a field may have in a foreign table, best first.
COLUMN_NAMES = {
    "title": ("title", "name"), "source": ("source", "site", "adapter"), "price": ("price",),
    "location": ("location", "city"), "link": ("link", "url"),
    "first_seen": ("first_seen", "created_at", "seen_at", "timestamp"),
}


def resolve_columns(columns: Sequence[str], names: dict[str, Sequence[str]]) -> dict[str, str]:
    """Field to the first of its names that exists, fields without one left out."""
    have = set(columns)
    found = {field: next((c for c in options if c in have), None) for field, options in names.items()}
    return {field: column for field, column in found.items() if column is not None}


def with_known_columns(df: DataFrame, names: dict[str, Sequence[str]] = COLUMN_NAMES) -> DataFrame:
    picked = resolve_columns(df.columns, names)
    return df.select(*[F.col(column).alias(field) for field, column in picked.items()])
