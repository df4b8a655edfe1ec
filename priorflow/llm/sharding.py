"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash, by id and text, into a fixed number of slots, far more than shards. Version 1
of the map, a small table of one row per slot and version, deals slots to shards in turn.
Bytes are added up per slot, and rebalancing edits the map into version 2: only records of
moved slots move. Growing edits it again. Records are placed by the map's newest version.

A slot that holds far more than others, as copies of one record all hash alike, is *heavy*:
its records are dealt anew over all slots by their row, so that copies spread, too.

Records are only read once: their key, size and digest columns are kept as a narrow table
in the shared folder. Everything here is built-in DataFrame functions; the map's edits run
on the driver over ``n_slots`` numbers, whatever the input's size.

Defined results: null ids hash like any other value; null texts have one byte (the end
mark); repeated rows get places of their own; an empty table gives no rows and a
map with empty slots; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import scratch

N_SLOTS = 4096


#: A slot with more than this part of a shard's bytes is heavy.
HEAVY = 0.02


def slot_of(*key, n_slots: int = N_SLOTS):
    return F.pmod(F.xxhash64(*key), F.lit(n_slots)).cast("int")


def rebalanced(sizes: list[int], shards: list[int], n_shards: int, tolerance: float = 0.002) -> list[int]:
    """The map edited for ``n_shards``: slots leave shards that hold more than their part
    (or are no longer there) for those that hold less, largest slots first; all others stay. A
    shard more only takes slots into itself."""
    out, load = list(shards), [0] * n_shards
    homeless = [s for s, shard in enumerate(shards) if shard >= n_shards]
    held: dict[int, list[int]] = {shard: [] for shard in range(n_shards)}
    for s, shard in enumerate(shards):
        if shard < n_shards:
            load[shard] += sizes[s]
            held[shard].append(s)
    part = sum(sizes) / n_shards
    takers = [shard for shard in range(n_shards) if load[shard] < part * (1 - tolerance)]
    for shard in range(n_shards):
        for s in sorted(held[shard], key=lambda s: (-sizes[s], s)):
            if load[shard] - sizes[s] >= part * (1 - tolerance) and load[shard] > part * (1 + tolerance):
                load[shard] -= sizes[s]
                homeless.append(s)
    heap = [(load[shard], shard) for shard in takers or range(n_shards)]
    heapq.heapify(heap)
    for s in sorted(homeless, key=lambda s: (-sizes[s], s)):
        least, shard = heapq.heappop(heap)
        out[s] = shard
        heapq.heappush(heap, (least + sizes[s], shard))
    return out


class SlotMap:
    """The stored map: Parquet rows (version, slot, shard, bytes) below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, version: int, shards: list[int], sizes: list[int]) -> None:
        numbers = ",".join(map(str, shards))
        loads = ",".join(map(str, sizes))
        self.spark.range(1).select(
            F.posexplode(F.arrays_zip(F.split(F.lit(numbers), ",").alias("s"), F.split(F.lit(loads), ",").alias("b"))).alias("slot", "x")
        ).select(F.lit(version).alias("version"), "slot", F.col("x.s").cast("int").alias("shard"), F.col("x.b").cast("long").alias("bytes")).coalesce(
            1
        ).write.mode("append").parquet(self.path)

    def read(self, version: int | None = None) -> DataFrame:
        table = self.spark.read.schema("version int, slot int, shard int, bytes long").parquet(self.path)
        if version is None:
            version = table.agg(F.max("version")).first()[0]
        return table.filter(F.col("version") == version)

    def shards(self, version: int | None = None) -> list[int]:
        return [r.shard for r in self.read(version).orderBy("slot").collect()]


def slot_bytes(records: DataFrame, n_slots: int = N_SLOTS) -> list[int]:
    """Bytes of each slot; at most ``n_slots`` rows reach the driver."""
    sizes = [0] * n_slots
    for row in records.groupBy("vslot").agg(F.sum("size").alias("b")).collect():
        sizes[row.vslot] = row.b
    return sizes


def shard_records(
    docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, part_rows: int = 200_000
) -> DataFrame:
    """Each record's shard and its place there: (id, size, text_crc32, vslot, shard, slot).

    ``slot`` counts from 0 without gaps in each shard. Places are counted in two steps, by
    (virtual slot, part) and over those counts, so no task sees a whole shard, nor all
    records of one slot; parts hold about ``part_rows`` records, however many there are.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        slot_of(F.col(id_col), text, n_slots=n_slots).alias("vslot"),
        F.monotonically_increasing_id().alias("row"),
    )
    records = scratch.keep(narrow, "shard-records")
    sizes = slot_bytes(records, n_slots)
    heavy = [slot for slot, size in enumerate(sizes) if size > HEAVY * sum(sizes) / n_shards]
    if heavy:
        records = records.withColumn("vslot", F.when(F.col("vslot").isin(heavy), slot_of(F.col("vslot"), F.col("row"), n_slots=n_slots)).otherwise(F.col("vslot")))
        sizes = slot_bytes(records, n_slots)
    slot_map = SlotMap(spark, path or scratch.new_path(spark, "slot-map"))
    dealt = [slot % n_shards for slot in range(n_slots)]
    slot_map.write(1, dealt, sizes)
    slot_map.write(2, rebalanced(sizes, dealt, n_shards), sizes)
    chart = slot_map.read().select(F.col("slot").alias("vslot"), "shard")
    parts = max(1, -(-records.count() // (n_slots * part_rows)))
    records = records.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    groups = records.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(chart), "vslot")
    in_shard = W.partitionBy("shard").orderBy("vslot", "part").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select("vslot", "part", "shard", F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("vslot", "part").orderBy("id", "row")) - 1
    return (
        records.withColumn("place", place)
        .join(groups, ["vslot", "part"])
        .select("id", "size", "text_crc32", "vslot", "shard", (F.col("before") + F.col("place")).cast("long").alias("slot"))
    )
