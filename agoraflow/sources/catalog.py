"""Configuration and translation catalogs: later entries override earlier ones."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraflow.operators.dml import latest


def config(spark: SparkSession, *domains: dict[str, dict]) -> DataFrame:
    """(domain, key, value, load_seq), values as JSON. A later domain replaces an earlier one of its name whole."""
    merged: dict[str, tuple[int, dict]] = {}
    for seq, part in enumerate(domains):
        for name, values in part.items():
            merged[name] = (seq, values)
    rows = [(name, k, json.dumps(v), seq) for name, (seq, values) in merged.items() for k, v in values.items()]
    return spark.createDataFrame(rows, "domain string, key string, value string, load_seq int")


def catalog(spark: SparkSession, *files: tuple[str, dict]) -> DataFrame:
    """(locale, key, template, load_seq) of (locale, entries) in order; entries that are no texts under text keys are left out."""
    rows = [(locale, k, v, seq) for seq, (locale, entries) in enumerate(files) for k, v in entries.items() if isinstance(k, str) and isinstance(v, str)]
    return spark.createDataFrame(rows, "locale string, key string, template string, load_seq int")


def effective(entries: DataFrame) -> DataFrame:
    """The last entry of each locale and key."""
    return latest(entries, ["locale", "key"], "load_seq").drop("load_seq")


def translated(rows: DataFrame, entries: DataFrame, key: str, locale: str, fallback: Column | None = None, name: str = "label") -> DataFrame:
    """rows with their key's template in a locale, else the fallback, else the key."""
    own = entries.where(F.col("locale") == locale).select(F.col("key").alias("_key"), F.col("template").alias("_template"))
    label = F.coalesce("_template", *([fallback] if fallback is not None else []), F.col(key))
    return rows.join(own, rows[key] == own["_key"], "left").withColumn(name, label).drop("_key", "_template")


def unused(configured: DataFrame, consumed: DataFrame) -> DataFrame:
    """Configured keys that nothing asked for."""
    return configured.join(consumed.select("domain", "key"), ["domain", "key"], "left_anti")
