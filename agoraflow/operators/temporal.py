"""State over time in batch form: gaps, counters, intervals, expiry and ladders of penalties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def flooded(df: DataFrame, key: str, at: str, tie: str, seconds: int) -> DataFrame:
    """df with gap_us since the key's row before and whether it is under the least gap."""
    before = F.lag(micros(F.col(at))).over(W.partitionBy(key).orderBy(at, tie))
    return df.withColumn("gap_us", micros(F.col(at)) - before).withColumn("flood", F.coalesce(F.col("gap_us") < seconds * 1_000_000, F.lit(False)))


def recent_count(df: DataFrame, keys: list[str], at: str, seconds: int, name: str) -> DataFrame:
    """df with the number of the keys' rows in the window that ends at each row, itself included."""
    w = W.partitionBy(*keys).orderBy(micros(F.col(at))).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn(name, F.count(F.lit(1)).over(w))


def since_reset(df: DataFrame, key: str, at: str, tie: str, counted: Column, reset: Column, name: str) -> DataFrame:
    """df with the count of counted rows since the key's last reset."""
    w = W.partitionBy(key).orderBy(at, tie)
    run = F.sum(F.coalesce(reset, F.lit(False)).cast("int")).over(w)
    own = W.partitionBy(key, "_run").orderBy(at, tie)
    return df.withColumn("_run", run).withColumn(name, F.sum(F.coalesce(counted, F.lit(False)).cast("long")).over(own)).drop("_run")


def live(expires: Column, as_of: Column) -> Column:
    """Whether a mute or token still holds: at its very end it does not."""
    return expires > as_of


def expired(expires: Column, as_of: Column) -> Column:
    """Whether a challenge is over: at its very end it is still good."""
    return as_of > expires


def token_status(used: Column, same: Column, expires: Column, as_of: Column) -> Column:
    """used, mismatch, expired or ok, in that order."""
    return F.when(used, "used").when(~same, "mismatch").when(expires < as_of, "expired").otherwise("ok")


def handed_over(sessions: DataFrame, as_of: Column, grace: int) -> DataFrame:
    """sessions with the data of their successor, one hop, while the hand-over is no older than the grace in seconds."""
    after = sessions.select(F.col("id").alias("_id"), F.col("data").alias("_data"))
    fresh = (as_of - F.col("replace_at")) <= grace
    out = sessions.join(after, sessions["replaced_by"] == after["_id"], "left")
    return out.withColumn("served", F.when(F.col("replaced_by").isNotNull() & fresh, F.coalesce("_data", "data")).otherwise(F.col("data"))).drop("_id", "_data")


def penalty_round(tries: Column, ladder: list[dict]) -> Column:
    """The penalty in seconds of the highest enabled round whose number of tries is exceeded, 0 if none is."""
    out = F.lit(0)
    for r in ladder:
        if r["enabled"]:
            out = F.when(tries > r["max_tries"], F.lit(r["penalty"])).otherwise(out)
    return out
