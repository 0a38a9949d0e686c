"""Sharding through fixed virtual slots (operator 6).

A record's slot is a hash of its key, one of SLOTS, for good. Bytes are added up by slot, and a versioned map gives each
slot its shard. The map is a table of versions. Version 1 deals slots out evenly; each rebalancing loads the latest
version, edits single entries (moves and swaps between the fullest and the emptiest shard) and adds the next version, so
most records stay where they are. Growing by a shard edits the map likewise. The map and the sums have SLOTS rows whatever
the input; only they come to the driver.

Places within a shard follow from row counts by slot and input partition, so a slot that holds most of the rows is
numbered by many tasks. Where one slot alone is larger than a shard's share, nothing can make the shards equal: records
are whole and a key's records stay together.

Defined results: a null text has 16 bytes and the checksum of no bytes; null keys are hashed by their text instead;
repeated rows get places of their own, and ties go by the rows' places in the input; a very long text is one record; extra
columns play no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, stored

SLOTS, OVERHEAD = 4096, 16


@dataclass(frozen=True)
class SlotMap:
    version: int
    shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def even(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(1, shards, tuple(s % shards for s in range(slots)))

    def rebalanced(self, sizes: Sequence[int], shards: int | None = None, tolerance: float = 1e-4) -> SlotMap:
        """The next version, whose shards' sizes lie within tolerance of their mean, or as near as moves and swaps get."""
        n = shards or self.shards
        size, at = np.asarray(sizes, np.int64), np.array(self.shard_of)
        load = np.bincount(at, weights=size, minlength=n).astype(np.int64)
        for _ in range(4 * len(size)):
            heavy, light = int(load.argmax()), int(load.argmin())
            gap = int(load[heavy] - load[light])
            if gap <= tolerance * load.mean():
                break
            mine = np.flatnonzero(at == heavy)
            theirs = np.flatnonzero(at == light)
            other = np.r_[0, size[theirs]]  # nothing, or a slot given in exchange
            shift = size[mine][:, None] - other[None, :]
            shift = np.where((shift > 0) & (shift < gap), np.abs(2 * shift - gap), gap + 1)
            x, y = np.unravel_index(shift.argmin(), shift.shape)
            if shift[x, y] >= gap:
                break
            moved = size[mine[x]] - other[y]
            at[mine[x]] = light
            if y:
                at[theirs[y - 1]] = heavy
            load[heavy] -= moved
            load[light] += moved
        return replace(self, version=self.version + 1, shards=n, shard_of=tuple(at.tolist()))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, self.shards, s, x) for s, x in enumerate(self.shard_of)], "version int, shards int, slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the table of versions at path."""
        self.frame(spark).write.mode("append").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given version at path, or the latest."""
        table = spark.read.parquet(path)
        chosen = version if version is not None else table.agg(F.max("version")).first()[0]
        rows = table.where(F.col("version") == chosen).select("slot", "shard", "shards").orderBy("slot").collect()
        return cls(chosen, rows[0].shards, tuple(r.shard for r in rows))

    def column(self, slot: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, self.shard_of)), slot + 1)


def slot_of(key: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), text, F.lit(""))), F.lit(slots)).cast("int")


def records(docs: DataFrame, key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """key, size, text_crc32 and virtual_slot of each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col(key), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot_of(F.col(key), text, slots).alias("virtual_slot"))


def slot_sums(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; slots rows at most."""
    sizes, counts = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect():
        sizes[r.virtual_slot], counts[r.virtual_slot] = r.s, r.n
    return sizes, counts


def rebalance(spark: SparkSession, map_path: str, sizes: Sequence[int], shards: int | None = None) -> SlotMap:
    """Edits the latest map at map_path, adds the new version there and gives it as it was stored."""
    SlotMap.load(spark, map_path).rebalanced(sizes, shards).save(spark, map_path)
    return SlotMap.load(spark, map_path)


def sharded(docs: DataFrame, shards: int = 40, key: str = "doc_id", map_path: str | None = None) -> DataFrame:
    """Each row of docs with its size, checksum, shard and slot, its place in the shard counted from 0 without gaps.

    The latest map at map_path is edited. Without a path a table of maps is begun in the shared folder by an even one.
    """
    spark = docs.sparkSession
    rows = stored(records(docs.select(key, "text"), key).withColumn("tm_row", F.monotonically_increasing_id()), "records")
    sizes, counts = slot_sums(rows)
    if map_path is None:
        map_path = fresh_path(spark, "slot-maps")
        SlotMap.even(shards).save(spark, map_path)
    slots = rebalance(spark, map_path, sizes, shards)
    before, filled = [], [0] * slots.shards  # rows of the same shard in earlier virtual slots
    for slot, shard in enumerate(slots.shard_of):
        before.append(filled[shard])
        filled[shard] += counts[slot]
    part = ["virtual_slot", "tm_part"]
    rows = rows.withColumn("tm_part", F.shiftright("tm_row", 33))  # the partition that wrote the row
    earlier = Window.partitionBy("virtual_slot").orderBy("tm_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*part).agg(F.count("*").alias("tm_n")).select(*part, F.coalesce(F.sum("tm_n").over(earlier), F.lit(0)).alias("tm_start"))
    place = F.row_number().over(Window.partitionBy(*part).orderBy(key, "text_crc32", "size", "tm_row")) - 1
    table = spark.createDataFrame(list(zip(range(SLOTS), slots.shard_of, before)), "virtual_slot int, shard int, tm_before long")
    placed = rows.withColumn("tm_place", place).join(starts, part).join(F.broadcast(table), "virtual_slot")  # SLOTS rows
    return placed.select(
        key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("tm_before") + F.col("tm_start") + F.col("tm_place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slots.version).alias("map_version"),
    )
