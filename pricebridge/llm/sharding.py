"""Fixed virtual slots: records hash into a fixed number of slots; a versioned map says which shard has a slot.

The law is `bytes`: shards get nearly equal sizes. The map is made from the bytes of each slot and edited, never made
anew, when sizes drift or shards are added: an edit moves as few slots as it can. Bytes per slot are the only thing
that reaches the driver: `slots` numbers, whatever the input.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot] for every slot. version grows by one with each edit; moved: the slots that the edit moved."""

    shards: int
    shard_of: tuple[int, ...]
    version: int = 1
    moved: tuple[int, ...] = field(default=())

    @staticmethod
    def first(sizes: list[int], shards: int) -> SlotMap:
        """Slots by falling size, each to the smallest shard so far."""
        heap, at = [(0, s) for s in range(shards)], [0] * len(sizes)
        for slot in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            total, shard = heapq.heappop(heap)
            at[slot] = shard
            heapq.heappush(heap, (total + sizes[slot], shard))
        return SlotMap(shards, tuple(at))

    def totals(self, sizes: list[int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += sizes[slot]
        return out

    def rebalanced(self, sizes: list[int], tolerance: float = 0.01) -> SlotMap:
        """Move slots from the largest to the smallest shard, each move as large as helps, until both are within tolerance of the mean."""
        at, total, moved = list(self.shard_of), self.totals(sizes), []
        mean = sum(total) / self.shards
        owned: list[list[int]] = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(at):
            owned[shard].append(slot)
        for _ in range(len(at)):
            hi, lo = max(range(self.shards), key=lambda s: total[s]), min(range(self.shards), key=lambda s: total[s])
            if total[hi] - mean <= tolerance * mean and mean - total[lo] <= tolerance * mean:
                break
            room = (total[hi] - total[lo]) / 2
            fits = [s for s in owned[hi] if 0 < sizes[s] <= room]
            if not fits:
                break
            slot = max(fits, key=lambda s: (sizes[s], -s))
            owned[hi].remove(slot)
            owned[lo].append(slot)
            at[slot], moved = lo, [*moved, slot]
            total[hi] -= sizes[slot]
            total[lo] += sizes[slot]
        return SlotMap(self.shards, tuple(at), self.version + 1, tuple(sorted(set(moved))))

    def grown(self, sizes: list[int], more: int = 1) -> SlotMap:
        """More shards; slots move into the new ones only, from whichever shard is largest."""
        n, at, total, moved = self.shards + more, list(self.shard_of), [*self.totals(sizes), *[0] * more], []
        mean = sum(total) / n
        for new in range(self.shards, n):
            for slot in sorted(range(len(at)), key=lambda i: (-sizes[i], i)):
                old = at[slot]
                if old < self.shards and total[old] - sizes[slot] >= mean * 0.999 and total[new] + sizes[slot] <= mean * 1.001:
                    at[slot] = new
                    moved.append(slot)
                    total[old] -= sizes[slot]
                    total[new] += sizes[slot]
        return SlotMap(n, tuple(at), self.version + 1, tuple(sorted(moved)))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write this version as path/version=N; a version that is there stays as it is."""
        note = json.dumps({"shards": self.shards, "version": self.version, "moved": self.moved})
        rows = [(slot, shard, note) for slot, shard in enumerate(self.shard_of)]
        spark.createDataFrame(rows, "slot int, shard int, note string").coalesce(1).write.mode("error").parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given version, or the latest."""
        rows = spark.read.parquet(path)
        version = version or rows.agg(F.max("version")).first()[0]
        got = rows.filter(F.col("version") == version).orderBy("slot").collect()
        note = json.loads(got[0]["note"])
        return SlotMap(note["shards"], tuple(r["shard"] for r in got), note["version"], tuple(note["moved"]))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.shard_of)), "virtual_slot int, shard int")


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, virtual_slot of every row. Null texts are empty texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    # a record is its id and its text, so that rows that share an id do not share a slot
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), crc), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of every slot."""
    sizes = [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("size")).collect():
        sizes[r["virtual_slot"]] = r["size"]
    return sizes


def place(rows: DataFrame, slot_map: SlotMap) -> DataFrame:
    """slotted() rows with `shard`, and `slot`: the row's place in its shard, gapless from 0.

    The place is the rows of the shard's earlier virtual slots plus the place in the own one; only virtual slots are
    sorted, never a whole shard. Repeated rows get places of their own.
    """
    spark = rows.sparkSession
    where = F.broadcast(slot_map.frame(spark))  # one row per slot: a fixed number
    counts = rows.groupBy("virtual_slot").agg(F.count("*").alias("n")).join(where, "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    return (
        rows.withColumn("inside", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), "virtual_slot")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("inside")).cast("long").alias("slot"), "virtual_slot")
    )


def shard(docs: DataFrame, shards: int, map_path: str, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    The map at map_path is made if there is none, and else edited for the sizes found now. An empty table gives no
    rows; null ids and null texts are placed like others; other columns are ignored.
    """
    spark, rows = docs.sparkSession, slotted(docs, id_col, text_col, slots)
    sizes = slot_sizes(rows, slots)
    place_ = spark._jvm.org.apache.hadoop.fs.Path(map_path)
    if place_.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place_):
        slot_map = SlotMap.load(spark, map_path)
        edited = slot_map.grown(sizes, shards - slot_map.shards) if shards > slot_map.shards else slot_map
        edited = edited.rebalanced(sizes)
        if edited.moved or edited.shards != slot_map.shards:
            slot_map = SlotMap(edited.shards, edited.shard_of, slot_map.version + 1, edited.moved)
            slot_map.save(spark, map_path)
    else:
        slot_map = SlotMap.first(sizes, shards)
        slot_map.save(spark, map_path)
    return place(rows, slot_map).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", F.lit(slot_map.version).alias("map_version"),
    )
