"""Writes as pure functions from a table and a change to the next table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def updated(df: DataFrame, where: Column, **values) -> DataFrame:
    """df with the given columns set in rows that match; a value may be a column expression."""
    match = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(match, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in values.items()})


def toggled(df: DataFrame, where: Column, column: str, allowed: set[str]) -> DataFrame:
    """df with 1 - column in rows that match; the column is to be allowed."""
    if column not in allowed:
        raise ValueError(f"{column} is not to be toggled")
    return updated(df, where, **{column: 1 - F.col(column)})


def deleted(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def upserted(df: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """df with rows of equal keys replaced by changes and the others added; of several changes the latest by order wins."""
    if order:
        changes = latest(changes, keys, order)
    return df.join(changes.select(*keys), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def insert_ignored(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """df with those rows added whose keys it lacks; of equal keys one row is added."""
    return df.unionByName(rows.dropDuplicates(keys).join(df.select(*keys), keys, "left_anti"))


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order]))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def earliest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.col(o).asc() for o in order]))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def cascaded(child: DataFrame, gone: DataFrame, fk: str, pk: str) -> DataFrame:
    """child without rows that refer to deleted keys."""
    return child.join(gone.select(F.col(pk).alias("_gone")).distinct(), F.col(fk) == F.col("_gone"), "left_anti")


def set_null(child: DataFrame, gone: DataFrame, fk: str, pk: str) -> DataFrame:
    """child with references to deleted keys set to null."""
    marks = gone.select(F.col(pk).alias("_gone")).distinct()
    out = child.join(marks, F.col(fk) == F.col("_gone"), "left")
    return out.withColumn(fk, F.when(F.col("_gone").isNull(), F.col(fk))).drop("_gone")


def reassigned(df: DataFrame, column: str, old, new) -> DataFrame:
    """df with one owner's rows given to another."""
    return updated(df, F.col(column) == old, **{column: new})


def tombstoned(df: DataFrame, where: Column, key: str, name: str, cleared: list[str]) -> DataFrame:
    """Rows that match keep their key; the name becomes deleted_<key> and the cleared columns null."""
    return updated(df, where, **{name: F.concat(F.lit("deleted_"), F.col(key).cast("string")), **{c: None for c in cleared}})


def replaced_group(df: DataFrame, column: str, group, rows: DataFrame) -> DataFrame:
    """df with all rows of a group replaced by rows."""
    return df.where(~F.col(column).eqNullSafe(F.lit(group))).unionByName(rows)
