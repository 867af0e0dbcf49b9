"""Tables from Parquet folders and databases, and tables written whole."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: list[str] = NAMES) -> None:
    """Register the folder's tables as views of their names."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int, int] | None = None, **properties: str) -> DataFrame:
    """A database table, read by ranges of a key if bounds (low, high, parts) are given."""
    if key and bounds:
        return spark.read.jdbc(url, name, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=bounds[2], properties=properties)
    return spark.read.jdbc(url, name, properties=properties)


#: What a script is read by: quoted text with doubled or escaped quotes, comments, the end of a statement, anything else.
_TOKEN = re.compile(r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`[^`]*`)|(--[^\n]*|\#[^\n]*|/\*.*?\*/)|(;)|([^'"`;#/-]+|.)""", re.S)


def statements(script: str) -> list[str]:
    """The statements of an SQL script without its comments; semicolons and comment signs in quotes are text."""
    out = [""]
    for m in _TOKEN.finditer(script):
        if m[3]:
            out.append("")
        else:
            out[-1] += " " if m[2] else m[0]
    return [s.strip() for s in out if s.strip()]


def overwrite(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a table; the writer's commit makes the new files appear together."""
    df.write.mode("overwrite").format(fmt).save(path)


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("append").format(fmt).save(path)
