"""Point lookups, existence tests and filters built from a whitelist."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_fold(a: Column, b: Column) -> Column:
    """Equality without regard to case."""
    return F.lower(a) == F.lower(b)


def by_key(df: DataFrame, **keys) -> DataFrame:
    """Rows with these values; None stands for null and selects rows where the column is null."""
    return df.where(reduce(and_, [F.col(k).isNull() if v is None else F.col(k) == F.lit(v) for k, v in keys.items()], F.lit(True)))


def by_any_fold(df: DataFrame, value: str, *columns: str) -> DataFrame:
    """Rows in which any of the columns equals value without regard to case."""
    return df.where(reduce(or_, [same_fold(F.col(c), F.lit(value)) for c in columns]))


def filtered(df: DataFrame, filters: dict, allowed: set[str]) -> DataFrame:
    """Equality conditions for the allowed columns; other keys are ignored."""
    return by_key(df, **{k: v for k, v in filters.items() if k in allowed})


def like_prefix(df: DataFrame, column: str, prefix: str, escaped: bool = False) -> DataFrame:
    """Rows whose column starts with prefix. Unless escaped, % and _ in the prefix are wildcards."""
    return df.where(F.col(column).startswith(prefix) if escaped else F.col(column).like(prefix + "%"))


def exists(df: DataFrame) -> bool:
    return not df.limit(1).isEmpty()


def missing(candidates: DataFrame, taken: DataFrame, column: str, other: str) -> DataFrame:
    """Candidates that no row has taken, compared without regard to case."""
    held = taken.select(F.lower(other).alias("_held")).where(F.col("_held").isNotNull())
    return candidates.join(held, F.lower(candidates[column]) == F.col("_held"), "left_anti")


def present(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are known."""
    return rows.join(known.select(*keys), keys, "left_semi")


def first_or_default(df: DataFrame, key: str, value: str, wanted: str, default: str = "") -> DataFrame:
    """One row with the value of a key, the default if there is none."""
    return df.where(F.col(key) == wanted).agg(F.coalesce(F.max(value), F.lit(default)).alias(value))


def as_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """All rows as one map, for tables of codes; keys are to be unique."""
    return df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("entries"))
