"""Uploads and form arrays: parallel arrays become rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zipped(df: DataFrame, *arrays: str, keep: list[str] | None = None) -> DataFrame:
    """A row for each place of the parallel arrays."""
    return df.select(*(keep or []), F.inline(F.arrays_zip(*arrays)))


def form_rules(df: DataFrame) -> DataFrame:
    """Rules from the arrays key, pattern, enabled, message: those with a positive key and a pattern."""
    return zipped(df, "key", "pattern", "enabled", "message").where("key > 0 AND pattern <> ''")


def input_value(body: str, query: str, name: str, default: str | None = None):
    """A value from the map column body if it has the name, else from query, else the default."""
    has = lambda c: F.map_contains_key(c, F.lit(name))
    return F.when(has(body), F.element_at(body, F.lit(name))).when(has(query), F.element_at(query, F.lit(name))).otherwise(F.lit(default))
