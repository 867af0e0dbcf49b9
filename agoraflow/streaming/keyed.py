"""Streams with state per key: flood control, read-once values and expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def flood_stream(events: DataFrame, key: str, at: str, tie: str, seconds: int) -> DataFrame:
    """Each event with its gap to the key's event before and whether it is under the least gap; state is the last time of a key.

    Within a batch a key's events are taken in order of time; at has to be a timestamp.
    """
    kind = events.schema[key].dataType.simpleString(), events.schema[tie].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at_us", tie])
        last = state.get[0] if state.exists else None
        before = rows["at_us"].shift()
        if last is not None:
            before.iloc[0] = last
        state.update((int(rows["at_us"].iloc[-1]),))
        gap = (rows["at_us"] - before).astype("Int64")
        yield pd.DataFrame({key: k[0], tie: rows[tie].to_numpy(), "gap_us": gap.to_numpy(), "flood": (gap < seconds * 1_000_000).fillna(False).astype(bool).to_numpy()})

    own = events.select(key, tie, F.unix_micros(at).alias("at_us"))
    return own.groupBy(key).applyInPandasWithState(step, f"{key} {kind[0]}, {tie} {kind[1]}, gap_us long, flood boolean", "last long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str, keys: list[str], size: str, lateness: str) -> DataFrame:
    """Events of each key in tumbling windows; a window is told when nothing for it can come any more."""
    return events.withWatermark(at, lateness).groupBy(F.window(at, size), *keys).agg(F.count(F.lit(1)).alias("n"))


def read_once(values: DataFrame, key: str, value: str, kind: str) -> DataFrame:
    """The value of each key at its first pull. kind is put or pull; a second pull of the same put gives nothing."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        out = []
        for rows in batches:
            for what, v in zip(rows[kind], rows[value], strict=True):
                if what == "put":
                    held = v
                else:
                    out.append(held)
                    held = None
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update((held,))
        yield pd.DataFrame({key: [k[0]] * len(out), value: out})

    types = {c: values.schema[c].dataType.simpleString() for c in (key, value)}
    return values.groupBy(key).applyInPandasWithState(step, f"{key} {types[key]}, {value} {types[value]}", f"held {types[value]}", "append", GroupStateTimeout.NoTimeout)


def upsert_batches(path: str, keys: list[str], order: str):
    """A foreachBatch function that keeps the latest row of each key in a table.

    The new table is written beside the old one, with the batch's number in it, and then takes its place; the old one is kept
    until that is done and comes back if a run stopped in between. A batch that comes again changes nothing.
    """
    from agoraflow.operators.dml import upserted

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path
        here, new, old = at(path), at(f"{path}.new"), at(f"{path}.old")
        store = here.getFileSystem(spark._jsc.hadoopConfiguration())
        if not store.exists(here) and store.exists(old):
            store.rename(old, here)
        if store.exists(at(f"{path}/_batch-{number}")):
            return
        rows = spark.read.parquet(path) if store.exists(here) else batch.limit(0)
        upserted(rows, batch, keys, order).write.mode("overwrite").parquet(f"{path}.new")
        store.create(at(f"{path}.new/_batch-{number}")).close()
        store.delete(old, True)
        if store.exists(here):
            store.rename(here, old)
        store.rename(new, here)
        store.delete(old, True)

    return write
