"""Sharding by fixed virtual slots.

Every record hashes into one of SLOTS virtual slots for good. Bytes are summed
per slot, and a versioned map says which shard holds which slot. Rebalancing
and growing edit the map; records never change their slot.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, text_of, unused_name

SLOTS = 4096
OVERHEAD = 16
#: Shards that differ by less than this part of the mean stay as they are.
TOLERANCE = 0.01


@dataclass(frozen=True)
class SlotMap:
    """owner[slot] is the slot's shard; version counts the edits."""

    version: int
    n_shards: int
    owner: tuple[int, ...]

    @staticmethod
    def balanced(sizes: dict[int, int], n_shards: int, slots: int = SLOTS) -> SlotMap:
        """Version 1: slots from the largest on, each to the shard with the fewest bytes so far."""
        heap = [(0, s) for s in range(n_shards)]
        owner = [0] * slots
        for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
            held, shard = heapq.heappop(heap)
            owner[slot] = shard
            heapq.heappush(heap, (held + sizes.get(slot, 0), shard))
        return SlotMap(1, n_shards, tuple(owner))

    def load(self, sizes: dict[int, int]) -> list[int]:
        held = [0] * self.n_shards
        for slot, shard in enumerate(self.owner):
            held[shard] += sizes.get(slot, 0)
        return held

    def grown(self, sizes: dict[int, int]) -> SlotMap:
        """One more shard, filled to its share with slots of the fullest shards; no other slot moves."""
        new, held, owner = self.n_shards, [*self.load(sizes), 0], list(self.owner)
        share = sum(held) / (new + 1)
        for slot in sorted(range(len(owner)), key=lambda s: (-sizes.get(s, 0), s)):
            size, shard = sizes.get(slot, 0), owner[slot]
            if held[new] + size <= share and held[shard] - size >= share - size:
                owner[slot], held[shard], held[new] = new, held[shard] - size, held[new] + size
        return SlotMap(self.version + 1, new + 1, tuple(owner))

    def rebalanced(self, sizes: dict[int, int], moves: int = SLOTS) -> SlotMap:
        """The same shards after sizes changed: while they differ by over TOLERANCE and it narrows the gap, a slot goes from the fullest to the emptiest."""
        held, owner = self.load(sizes), list(self.owner)
        for _ in range(moves):
            full, empty = max(range(len(held)), key=held.__getitem__), min(range(len(held)), key=held.__getitem__)
            gap = held[full] - held[empty]
            fits = [s for s, o in enumerate(owner) if o == full and 0 < sizes.get(s, 0) < gap] if gap * len(held) > TOLERANCE * sum(held) else []
            if not fits:
                break
            slot = min(fits, key=lambda s: (abs(2 * sizes[s] - gap), s))
            owner[slot] = empty
            held[full] -= sizes[slot]
            held[empty] += sizes[slot]
        return replace(self, version=self.version + 1, owner=tuple(owner)) if tuple(owner) != self.owner else self

    def shrunk(self, sizes: dict[int, int]) -> SlotMap:
        """Without the last shard, whose slots go, from the largest on, to the shard with the fewest bytes; no other slot moves."""
        last, owner = self.n_shards - 1, list(self.owner)
        heap = [(n, s) for s, n in enumerate(self.load(sizes)[:last])]
        heapq.heapify(heap)
        for slot in sorted((s for s, o in enumerate(owner) if o == last), key=lambda s: (-sizes.get(s, 0), s)):
            n, owner[slot] = heapq.heappop(heap)
            heapq.heappush(heap, (n + sizes.get(slot, 0), owner[slot]))
        return SlotMap(self.version + 1, last, tuple(owner))

    def edited(self, sizes: dict[int, int], n_shards: int) -> SlotMap:
        """The next version, for so many shards and these sizes; self where nothing has to move."""
        out = self
        while out.n_shards != n_shards:
            out = out.grown(sizes) if out.n_shards < n_shards else out.shrunk(sizes)
        out = out.rebalanced(sizes)
        return self if out is self else replace(out, version=self.version + 1)

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds the version to the map under path; one that is there already is never written again."""
        if self.version in SlotMap.versions(spark, path):
            raise ValueError(f"the map in {path} has version {self.version} already")
        rows = [(self.n_shards, slot, shard) for slot, shard in enumerate(self.owner)]
        spark.createDataFrame(rows, "n_shards int, slot int, shard int").coalesce(1).write.mode("error").parquet(f"{path}/version={self.version}")

    @staticmethod
    def versions(spark: SparkSession, path: str) -> list[int]:
        """The versions that are complete, oldest first."""
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
        found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
        return sorted(int(f.getPath().getParent().getName().removeprefix("version=")) for f in found or [])

    @staticmethod
    def read(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given version, or the newest. A version has one row per slot."""
        version = version or SlotMap.versions(spark, path)[-1]
        rows = spark.read.parquet(f"{path}/version={version}").orderBy("slot").collect()
        return SlotMap(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows))

    def frame(self, spark: SparkSession, slot_name: str, shard_name: str) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.owner)), f"{slot_name} int, {shard_name} int")


def virtual_slot(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> Column:
    """Id and text decide; only rows that agree in both must share a slot."""
    return F.pmod(F.xxhash64(df[id_col], text_of(df, text_col)), F.lit(slots)).cast("int")


def record_size(df: DataFrame, text_col: str = "text") -> Column:
    return (F.octet_length(text_of(df, text_col)) + OVERHEAD).cast("long")


def slot_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot that has rows; at most `slots` rows reach the driver."""
    sized = df.select(virtual_slot(df, id_col, text_col, slots).alias("v"), record_size(df, text_col).alias("size"))
    return {r["v"]: (r["bytes"], r["n"]) for r in sized.groupBy("v").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}


def assign(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> tuple[DataFrame, SlotMap, dict[int, tuple[int, int]]]:
    """df with the columns _vslot and _shard (or names with more underscores where df has these).

    A map that map_path holds is edited to the sizes and shards of now, as its next version, and only slots that have
    to change shard do; without one, version 1 is made. The newest version is read back from there.
    Rows with null id or text count as any others (null text: empty); an empty table gives no rows.
    Repeated rows share a slot. The map joined to the rows has SLOTS rows, so it is broadcast.
    """
    spark = df.sparkSession
    sizes = slot_sizes(df, id_col, text_col)
    path = map_path or new_path(spark, "slot-map")
    held = {v: b for v, (b, _) in sizes.items()}
    if SlotMap.versions(spark, path):
        old = SlotMap.read(spark, path)
        if (new := old.edited(held, n_shards)) is not old:
            new.save(spark, path)
    else:
        SlotMap.balanced(held, n_shards).save(spark, path)
    chosen = SlotMap.read(spark, path)
    v, s = unused_name(df, "_vslot"), unused_name(df, "_shard")
    return df.withColumn(v, virtual_slot(df, id_col, text_col)).join(F.broadcast(chosen.frame(spark, v, s)), v).select(*df.columns, v, s), chosen, sizes


def sharded(df: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per record: id, size, text_crc32, law, shard, slot, grown_shard.

    law is `bytes`: the slot map evens out bytes, so grown_shard is null. slot is the record's place in its
    shard, gapless from 0: the rows of the shard's earlier virtual slots, then its place in its own by id.
    No window holds more than one virtual slot's ids.
    """
    spark = df.sparkSession
    out, chosen, sizes = assign(df, n_shards, id_col, text_col)
    v, s = out.columns[-2:]
    before, starts = [0] * n_shards, []
    for slot, shard in enumerate(chosen.owner):
        starts.append((slot, before[shard]))
        before[shard] += sizes.get(slot, (0, 0))[1]
    narrow = out.select(
        F.col(id_col).alias("doc_id"), record_size(out, text_col).alias("size"), F.crc32(text_of(out, text_col).cast("binary")).cast("long").alias("text_crc32"), F.col(v).alias("v"), F.col(s).cast("int").alias("shard")
    )
    place = F.row_number().over(Window.partitionBy("v").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        narrow.withColumn("place", place)
        .join(F.broadcast(spark.createDataFrame(starts, "v int, start long")), "v")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
