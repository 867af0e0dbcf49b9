"""Views that resolve references, subtype unions, matrices and interval joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolved(base: DataFrame, *others: tuple[DataFrame, str, str]) -> DataFrame:
    """base with each (table, own key, its key) joined if there is a match. Sizes are left to the optimizer to judge."""
    return reduce(lambda df, o: df.join(o[0], df[o[1]] == o[0][o[2]], "left"), others, base)


def with_author(rows: DataFrame, users: DataFrame, fk: str, pk: str, *names: str, default: str | None = None) -> DataFrame:
    """rows with the author's name, the first of names that is not null."""
    own = users.select(F.col(pk).alias("_author"), F.coalesce(*[F.col(n) for n in names]).alias("author"))
    out = rows.join(own, rows[fk] == own["_author"], "left").drop("_author")
    return out if default is None else out.withColumn("author", F.coalesce("author", F.lit(default)))


def typed_union(**branches: DataFrame) -> DataFrame:
    """The rows of all branches under a column kind with the branch's name; no duplicate is removed."""
    return reduce(DataFrame.unionByName, [df.withColumn("kind", F.lit(kind)) for kind, df in branches.items()])


#: Codes that a matrix may have as columns.
MATRIX_COLUMNS = 10_000


def flag_matrix(rows: DataFrame, columns: DataFrame, held: DataFrame, keys: list[str], name: str = "held") -> DataFrame:
    """Every row key with every column key and whether the pair is held. columns, of one column, is a catalog of codes: of more than
    MATRIX_COLUMNS an error is raised."""
    own = columns.columns[0]
    codes = [r[0] for r in columns.limit(MATRIX_COLUMNS + 1).collect()]
    if len(codes) > MATRIX_COLUMNS:
        raise ValueError(f"more than {MATRIX_COLUMNS} codes")
    kind = columns.schema[0].dataType
    pairs = rows.withColumn(own, F.explode(F.array(*[F.lit(c).cast(kind) for c in codes]) if codes else F.array().cast(f"array<{kind.simpleString()}>")))
    marked = held.select(*keys).distinct().withColumn(name, F.lit(True))
    return pairs.join(marked, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def within(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, how: str = "left_semi") -> DataFrame:
    """Points that lie in [start, end) of a span with the same keys."""
    named = spans.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(start).alias("_start"), F.col(end).alias("_end"))
    same = reduce(Column.__and__, [points[k] == named[f"_{k}"] for k in keys])
    return points.join(named, same & (points[at] >= named["_start"]) & (points[at] < named["_end"]), how)


def marked_members(rows: DataFrame, ids: DataFrame, column: str, key: str, name: str) -> DataFrame:
    """rows with a flag that tells whether their column is among ids."""
    known = ids.select(F.col(key).alias("_known")).distinct()
    return rows.join(known, rows[column] == known["_known"], "left").withColumn(name, F.col("_known").isNotNull()).drop("_known")
