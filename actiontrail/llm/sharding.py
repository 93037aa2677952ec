"""Sharding through fixed virtual slots.

Each record hashes to one of `N_SLOTS` virtual slots for good; a versioned map says which shard a slot belongs to.
`slot_bytes` sums bytes per slot, `first_map` gives slots to shards largest first, and `rebalanced` edits an earlier
map: only slots that have to move do. Maps are tables (version, vslot, shard) of N_SLOTS rows each, whatever the data.
Law: `bytes` - the shards' sizes are as near to equal as whole slots allow.

The query's map has two versions: the first deals slots round by round before any record is seen, the second is the stored first one,
read back and edited for the bytes that the slots turned out to have.

Records hash by their text, so equal texts share a slot and a shard; null counts as the empty text. Only a group of
copies that outweighs an even shard by itself hashes by doc_id as well: there are fewer such groups than shards. Columns of the
same names as those added are replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from actiontrail.llm.shared import ranked, saved, spread_count

N_SLOTS = 8192
MAP = "version int, vslot int, shard int"


def sized(docs: DataFrame) -> DataFrame:
    """Adds size (UTF-8 bytes of the text plus 1) and text_hash."""
    return docs.withColumn("size", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))


def heavy_groups(rows: DataFrame, shards: int) -> list[int]:
    """Text hashes whose rows hold more than an even shard: fewer than there are shards."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("text_hash").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
    return [r["text_hash"] for r in groups.where((F.col("n") * shards > total) & (F.col("rows") > 1)).collect()]


def slotted(rows: DataFrame, heavy: list[int] = [], n_slots: int = N_SLOTS) -> DataFrame:  # noqa: B006 - never changed
    """Adds vslot to rows with doc_id and text_hash."""
    by_text, by_both = F.xxhash64("text_hash"), F.xxhash64("text_hash", "doc_id")
    chosen = F.when(F.col("text_hash").isin(*heavy), by_both).otherwise(by_text) if heavy else by_text
    return rows.withColumn("vslot", F.pmod(chosen, F.lit(n_slots)).cast("int"))


def slot_bytes(rows: DataFrame) -> dict[int, int]:
    """Bytes of each slot: at most N_SLOTS numbers."""
    return {r["vslot"]: r["n"] for r in rows.groupBy("vslot").agg(F.sum("size").alias("n")).collect()}


def first_map(sizes: dict[int, int], shards: int, n_slots: int = N_SLOTS) -> dict[int, int]:
    """Largest slots first, each to the shard that is lightest so far."""
    heap, out = [(0, s) for s in range(shards)], {}
    for slot in sorted(range(n_slots), key=lambda v: (-sizes.get(v, 0), v)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + sizes.get(slot, 0), shard))
    return out


def rebalanced(old: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """A new version of a map: slots leave shards above the mean for those below, smallest moves last."""
    out = dict(old)
    load = {s: 0 for s in range(shards)}
    held: dict[int, list[int]] = {s: [] for s in range(shards)}
    homeless = []
    for slot, shard in sorted(old.items()):
        if shard in load:
            load[shard] += sizes.get(slot, 0)
            held[shard].append(slot)
        else:
            homeless.append(slot)
    mean = sum(sizes.get(v, 0) for v in old) / shards
    for shard in range(shards):
        for slot in sorted(held[shard], key=lambda v: (-sizes.get(v, 0), v)):
            if 0 < sizes.get(slot, 0) <= load[shard] - mean:
                load[shard] -= sizes[slot]
                homeless.append(slot)
    for slot in sorted(homeless, key=lambda v: (-sizes.get(v, 0), v)):
        to = min(load, key=lambda s: (load[s], s))
        out[slot] = to
        load[to] += sizes.get(slot, 0)
    return out


def dealt_map(shards: int, n_slots: int = N_SLOTS) -> dict[int, int]:
    """A map for slots of which nothing is known yet: round by round."""
    return {slot: slot % shards for slot in range(n_slots)}


def stored_map(maps: DataFrame, version: int) -> dict[int, int]:
    """One version of a stored map: N_SLOTS rows."""
    return {r["vslot"]: r["shard"] for r in maps.where(F.col("version") == version).collect()}


def map_table(spark: SparkSession, version: int, slots: dict[int, int]) -> DataFrame:
    return spark.createDataFrame([(version, s, h) for s, h in sorted(slots.items())], MAP)


def assign(rows: DataFrame, slots: DataFrame, order: list[str]) -> DataFrame:
    """Adds shard and slot: the record's place in its shard, gapless from 0.

    Records are numbered inside their virtual slot, in buckets, as one slot may hold a third of all rows; a slot's first place
    comes from the sizes of the shard's earlier slots, a window over N_SLOTS rows.
    """
    counts = rows.groupBy("vslot").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    places = (slots.join(counts, "vslot")
              .select("vslot", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")))
    numbered = ranked(rows.drop("shard", "slot"), "vslot", order, spread_count(rows), "_nth")
    return (numbered.join(F.broadcast(places), "vslot")
            .withColumn("slot", (F.col("first") + F.col("_nth")).cast("long")).drop("first", "_nth"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: this law has none)."""
    spark = docs.sparkSession
    rows = saved(sized(docs.select("doc_id", "text")).select(
        "doc_id", "size", "text_hash", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")), "sizes")
    narrow = slotted(rows, heavy_groups(rows, shards))
    maps = saved(map_table(spark, 1, dealt_map(shards)), "slot-map")
    edited = map_table(spark, 2, rebalanced(stored_map(maps, 1), slot_bytes(narrow), shards))
    maps = saved(maps.unionByName(edited), "slot-map")
    slots = maps.where("version = 2").drop("version")
    return (assign(narrow, slots, ["doc_id", "text_crc32", "size"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))
