"""Sharding over fixed virtual slots, with a versioned slot-to-shard map. DataFrame functions only.

Records hash into a fixed number of virtual slots. Bytes are aggregated per
slot, and a map from slot to shard is stored in versions. Rebalancing edits the
map: a new version moves whole slots, and no record is hashed anew.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir

#: Virtual slots. A parameter of the stored layout, not of the input's size; the driver handles this many numbers.
SLOTS = 4096


def record_slot(key: str = "doc_id", slots: int = SLOTS) -> Column:
    """The virtual slot of a record: decided by its key only. A null key has a slot as well."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def slot_bytes(df: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> list[int]:
    """Bytes in each slot. Aggregated map-side; at most `slots` rows reach the driver."""
    rows = df.select(record_slot(key, slots).alias("v"), record_size(text).alias("size")).groupBy("v").agg(F.sum("size").alias("size")).collect()
    out = [0] * slots
    for r in rows:
        out[r["v"]] = r["size"]
    return out


def record_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def first_map(size: list[int], shards: int) -> list[int]:
    """Version 1 of a map: the largest slot first, each to the shard with the fewest bytes."""
    heap, out = [(0, s) for s in range(shards)], [0] * len(size)
    for v in sorted(range(len(size)), key=lambda v: (-size[v], v)):
        held, s = heapq.heappop(heap)
        out[v] = s
        heapq.heappush(heap, (held + size[v], s))
    return out


def rebalanced_map(old: list[int], size: list[int], shards: int, tolerance: float = 0.02) -> list[int]:
    """The next version: slots leave shards that hold more than the mean, for new or lighter shards. The others stay.

    Slots move out of the fullest shard to the emptiest until those two differ by at most `tolerance` of the mean.
    """
    out, held = list(old), [0] * shards
    by = [[] for _ in range(shards)]
    for v, s in enumerate(old):
        held[s] += size[v]
        by[s].append(v)
    for s in range(shards):
        by[s].sort(key=lambda v: (size[v], v))
    mean = sum(size) / shards
    for _ in range(len(old)):
        full, least = max(range(shards), key=lambda s: (held[s], s)), min(range(shards), key=lambda s: (held[s], s))
        gap = held[full] - held[least]
        fit = [v for v in by[full] if 0 < size[v] < gap]
        if not fit or gap <= tolerance * mean:
            break
        v = max(fit, key=lambda v: (min(size[v], gap - size[v]), -v))
        by[full].remove(v)
        by[least].append(v)
        held[full], held[least], out[v] = held[full] - size[v], held[least] + size[v], least
    return out


class SlotMap:
    """The stored map: one folder per version, each with one row (virtual_slot, shard, bytes) per slot."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"

    def store(self, version: int, shards: list[int], size: list[int]) -> None:
        """Writes one version; an earlier one is never overwritten."""
        pick = lambda values: F.element_at(F.lit(values), (F.col("id") + 1).cast("int"))
        self.spark.range(len(shards)).coalesce(1).select(F.col("id").cast("int").alias("virtual_slot"), pick(shards).cast("int").alias("shard"), pick(size).cast("long").alias("bytes")).write.parquet(f"{self.path}/version={version}")

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema("virtual_slot int, shard int, bytes long").parquet(f"{self.path}/version={version}")


def edit_map(store: SlotMap, version: int, size: list[int], shards: int) -> int:
    """Reads a stored version, moves slots until `shards` shards are near equal, stores the result as the next version and returns its number."""
    held = {r["virtual_slot"]: r["shard"] for r in store.read(version).collect()}  # a row per slot
    store.store(version + 1, rebalanced_map([held[v] for v in range(len(size))], size, shards), size)
    return version + 1


def shard_documents(df: DataFrame, shards: int = 16, slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every record with its shard under law `bytes`, and its place there.

    Version 1 of the map is made from the slots' bytes and stored. Then the map is
    edited for one shard more: the stored version is read, slots leave the fullest
    shards for lighter ones, the new one first, and the result is stored as
    version 2. A record's slot is the same in both. Columns: doc_id, size,
    text_crc32, law, shard (version 1), slot (place in its shard, gapless from 0,
    by virtual slot, doc_id and text), grown_shard (null under this law),
    virtual_slot, map_version, next_shard and next_version (after the edit).

    Equal texts of different ids are dealt apart by their ids, like any others.

    Places are counted per virtual slot and text-hash part and then offset by a
    table with one row per slot and part, so no task sees a whole shard.

    Null keys share one slot; null and empty texts have size 1 and crc32 0;
    repeated rows are placed one by one; other columns are ignored; an empty
    table gives no rows.
    """
    size = slot_bytes(df, key, text, slots)
    store = SlotMap(df.sparkSession)
    store.store(1, first_map(size, shards), size)
    latest = edit_map(store, 1, size, shards + 1)
    now = store.read(1).select("virtual_slot", "shard").join(F.broadcast(store.read(latest).select("virtual_slot", F.col("shard").alias("next_shard"))), "virtual_slot")
    parts = 8
    rows = df.select(
        F.col(key).alias("doc_id"),
        record_size(text).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        record_slot(key, slots).alias("virtual_slot"),
    ).join(F.broadcast(now), "virtual_slot")  # one row per slot: a fixed number
    rows = rows.withColumn("part", F.pmod(F.xxhash64("text_crc32", "size"), F.lit(parts)).cast("int"))
    count = rows.groupBy("shard", "virtual_slot", "part").agg(F.count("*").alias("n"))
    offset = count.select("virtual_slot", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot", "part")) - F.col("n")).alias("before"))
    place = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("at", F.row_number().over(place).cast("long"))
        .join(F.broadcast(offset), ["virtual_slot", "part"])  # slots times parts rows at most
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(1).alias("map_version"), "next_shard", F.lit(latest).alias("next_version"))
    )
