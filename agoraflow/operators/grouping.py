"""Grouping into sorted arrays, nested structs and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multimap(df: DataFrame, key: str, value: str, name: str = "values") -> DataFrame:
    """Each key with its distinct values in order."""
    return df.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias(name))


def nested(df: DataFrame, keys: list[str], fields: list[str], name: str) -> DataFrame:
    """Each key with its rows as structs, in order of the fields; all-null structs of outer joins are left out."""
    item = F.when(F.coalesce(*[F.col(f).cast("string") for f in fields]).isNotNull(), F.struct(*fields))
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias(name))


def joined_text(items: Column, separator: str = ", ") -> Column:
    return F.array_join(items, separator)


def prefix_of(code: Column, separator: str = "/") -> Column:
    """A code up to its first separator."""
    return F.split_part(code, F.lit(separator), F.lit(1))
