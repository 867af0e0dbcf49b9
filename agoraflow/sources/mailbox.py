"""Mail folders as tables: messages from .eml files, listings, flags and moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agoraflow.functions.mail import message


def eml_files(spark: SparkSession, path: str) -> DataFrame:
    """Messages of .eml files, parsed."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(path)
    return raw.select("path", "modificationTime", "length", message("content").alias("message"))


def folders(names: DataFrame) -> DataFrame:
    """Folders (name, flags) that can be selected, the inbox first, then by name."""
    return names.where(~F.array_contains("flags", "\\Noselect")).orderBy(F.col("name") != "INBOX", "name")


def status(messages: DataFrame) -> DataFrame:
    """Totals, unseen and recent messages of each folder."""
    has = lambda f: F.array_contains("flags", f)
    return messages.groupBy("folder").agg(F.count(F.lit(1)).alias("total"), F.count_if(~has("\\Seen")).alias("unseen"), F.count_if(has("\\Recent")).alias("recent"))


def header_page(messages: DataFrame, folder: str, page: int, size: int) -> DataFrame:
    """The page-th newest `size` messages of a folder by place, highest uid first."""
    size = min(200, max(5, size))
    own = messages.where((F.col("folder") == folder) & (F.col("uid") > 0))
    place = F.row_number().over(W.partitionBy("folder").orderBy(F.col("uid").desc()))
    return own.withColumn("_place", place).where(F.col("_place").between((page - 1) * size + 1, page * size)).drop("_place").orderBy(F.col("uid").desc())


def flagged(messages: DataFrame, uid: int, flag: str, on: bool) -> DataFrame:
    """messages with a flag set or taken from one of them."""
    changed = F.array_union("flags", F.array(F.lit(flag))) if on else F.array_remove("flags", flag)
    return messages.withColumn("flags", F.when(F.col("uid") == uid, changed).otherwise(F.col("flags")))


def moved(messages: DataFrame, uid: int, target: str) -> DataFrame:
    return messages.withColumn("folder", F.when(F.col("uid") == uid, target).otherwise(F.col("folder")))


def accounts(lines: DataFrame, name: str, password_line: str | None) -> DataFrame:
    """Password file lines with an account's line replaced, or removed if there is none to replace it."""
    own = F.startswith("value", F.lit(name + ":"))
    return lines.where(~own) if password_line is None else lines.withColumn("value", F.when(own, password_line).otherwise(F.col("value")))
