"""Sharding by fixed virtual slots.

Every record hashes to one of SLOTS virtual slots. Bytes are summed per slot, slots are dealt to shards
heaviest first, each to the lightest shard so far, and the slot-to-shard map is stored under a version number.
Rebalancing edits the map and stores it as the next version; the slot of a record never changes.

Defined results: null text has no bytes (size 1, crc32 of nothing, 0); a null id hashes like any other value;
repeated rows are kept, each with a place of its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agoraflow.llm.shared import fresh_path

#: Number of virtual slots: fixed, so all that is gathered per slot has a fixed size.
SLOTS = 4096


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every row."""
    text = F.col(text_col).cast("binary")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    ).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_sizes(slotted: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot; at most one row for each slot reaches the driver."""
    rows = slotted.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return {r["virtual_slot"]: (r["b"], r["n"]) for r in rows}


def deal(sizes: dict[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """A map from slots to shards with near equal bytes: heaviest slot first, to the lightest shard; ties by number."""
    heap, owner = [(0, s) for s in range(shards)], [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (load + sizes.get(slot, 0), shard))
    return owner


def rebalance(owner: list[int], sizes: dict[int, int], shards: int) -> list[int]:
    """Edit a map for other sizes or more shards: slots leave shards above the mean for the lightest one while that evens them out."""
    owner, load, held = list(owner), [0] * shards, [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        load[shard] += sizes.get(slot, 0)
        held[shard].append(slot)
    for shard in range(shards):
        held[shard].sort(key=lambda s: (sizes.get(s, 0), -s))
    while True:
        high, low = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        # the largest slot that lowers the difference
        fit = next((s for s in reversed(held[high]) if 0 < sizes.get(s, 0) < gap), None)
        if fit is None:
            return owner
        held[high].remove(fit)
        held[low].append(fit)
        held[low].sort(key=lambda s: (sizes.get(s, 0), -s))
        load[high], load[low], owner[fit] = load[high] - sizes[fit], load[low] + sizes[fit], low


def store_map(spark: SparkSession, path: str, version: int, owner: list[int]) -> None:
    """Store a version of the map; an existing version is an error."""
    spark.createDataFrame([(i, s) for i, s in enumerate(owner)], "virtual_slot int, shard int").coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """virtual_slot and shard of a version, the latest by default."""
    versions = spark.read.parquet(path)
    version = versions.agg(F.max("version")).first()[0] if version is None else version
    return versions.where(F.col("version") == version).select("virtual_slot", "shard")


def place(slotted: DataFrame, owner: DataFrame, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """Shard of every row and its place there, gapless from 0: rows are numbered within their slot, after all rows of the shard's earlier slots."""
    spark, start, at = slotted.sparkSession, [], {}
    for slot, shard in sorted(map(tuple, owner.collect())):  # SLOTS rows
        start.append((slot, shard, at.get(shard, 0)))
        at[shard] = at.get(shard, 0) + sizes.get(slot, (0, 0))[1]
    starts = spark.createDataFrame(start, "virtual_slot int, shard int, first long")
    order = W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    numbered = slotted.withColumn("n", F.row_number().over(order))
    return numbered.join(F.broadcast(starts), "virtual_slot").withColumn("slot", F.col("first") + F.col("n") - 1).drop("n", "first")


def shard_documents(docs: DataFrame, shards: int = 16, map_path: str | None = None, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot (place in the shard) of every row, near equal bytes in every shard.

    The map is stored as version 1 under map_path, a new folder in the shared one by default.
    """
    spark = docs.sparkSession
    slotted = with_slots(docs, slots=slots)
    sizes = slot_sizes(slotted)
    path = map_path or fresh_path(spark, "slot-map")
    store_map(spark, path, 1, deal({s: b for s, (b, _) in sizes.items()}, shards, slots))
    return place(slotted, load_map(spark, path, 1), sizes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
