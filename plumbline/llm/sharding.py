"""Sharding over fixed virtual slots.

Records hash into a fixed number of virtual slots (thousands, whatever the number of
shards); bytes are summed per slot; a versioned map says which shard holds
each slot.  Rebalancing edits the map: slots move, records are never rehashed.

Equal texts share a slot unless their group alone outweighs a shard's even share and so fits none;
such a group is spread over slots by doc_id, so that a group of copies may hold any part of all rows and shards stay even.

A stored map is the state: ``shard(..., maps=folder)`` begins with the latest version there, edits it where weights have changed,
and writes the next one beside it; without any, version 1 deals the slots in turn.

Defined results: a null text has 0 bytes and no checksum and forms a group of its own; rows
without doc_id of a group that is spread fall by chance; repeated rows are rows of their own; ties of places within a slot fall to any of the
equal rows; very long texts are hashed whole; with fewer rows than shards, shards stay empty; an empty table gives an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, stash

SLOTS, SHARDS, OVERHEAD = 4096, 40, 16


def first_map(slots: int, shards: int) -> list[int]:
    """Version 1: slots dealt in turn."""
    return [i % shards for i in range(slots)]


def rebalanced(shard_of: list[int], weight: dict[int, int], shards: int) -> list[int]:
    """The map edited so that shards' weights are near equal, starting from the present holders.

    The heaviest shard gives the lightest the slot that evens the two best, until no move helps; then slots are swapped
    likewise.  ``shards`` may be above or below the number in the old map.
    """
    new = [s if s < shards else -1 for s in shard_of]
    load = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, s in enumerate(new):
        if s >= 0:
            load[s] += weight.get(slot, 0)
            held[s].append((weight.get(slot, 0), slot))
    heap = [(x, s) for s, x in enumerate(load)]
    heapq.heapify(heap)
    for w, slot in sorted(((weight.get(i, 0), i) for i, s in enumerate(new) if s < 0), reverse=True):
        x, s = heapq.heappop(heap)
        new[slot], load[s] = s, x + w
        held[s].append((w, slot))
        heapq.heappush(heap, (x + w, s))
    for h in held:
        h.sort()
    for _ in range(20 * len(new)):
        hi, lo = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        half = (load[hi] - load[lo]) / 2
        gain, move = 0.0, None
        for w, slot in held[hi]:
            if 0 < w < 2 * half and (g := half - abs(half - w)) > gain:
                gain, move = g, ((w, slot), None)
        if move is None or gain < half / 2:  # a swap evens them better
            lows = held[lo]
            j = 0
            for w, slot in held[hi]:
                while j + 1 < len(lows) and abs(w - lows[j + 1][0] - half) <= abs(w - lows[j][0] - half):
                    j += 1
                if lows and 0 < (d := w - lows[j][0]) < 2 * half and (g := half - abs(half - d)) > gain:
                    gain, move = g, ((w, slot), lows[j])
        if move is None:
            break
        for (w, slot), a, b in [(move[0], hi, lo), *([(move[1], lo, hi)] if move[1] else [])]:
            held[a].remove((w, slot))
            held[b].append((w, slot))
            held[b].sort()
            load[a], load[b], new[slot] = load[a] - w, load[b] + w, b
    return new


def save_map(spark: SparkSession, path: str, version: int, shard_of: list[int]) -> None:
    """One file a version; an old version stays readable."""
    spark.range(len(shard_of), numPartitions=1).select(F.lit(version).alias("version"), F.col("id").alias("virtual_slot"), lookup(shard_of, F.col("id")).alias("shard")).write.mode("error").parquet(f"{path}/version={version}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of the map that are stored, oldest first."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))


def load_map(spark: SparkSession, path: str, version: int) -> list[int]:
    rows = spark.read.parquet(f"{path}/version={version}").select("virtual_slot", "shard").collect()  # one row a slot
    return [s for _, s in sorted((r["virtual_slot"], r["shard"]) for r in rows)]


def lookup(shard_of: list[int], slot: Column) -> Column:
    return F.element_at(F.lit(shard_of), (slot + 1).cast("int"))


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place within the shard), grown_shard, virtual_slot, map_version of every row."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD
    rows = docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(F.lit(1), text).alias("g"), F.xxhash64(F.lit(2), text).alias("g2"))
    rows = stash(rows)
    groups = rows.groupBy("g", "g2").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    # fewer than ``shards`` groups can be that heavy
    heavy = groups.filter((F.col("bytes") * shards > total) & (F.col("n") > 1)).select("g", "g2", F.lit(True).alias("heavy"))
    salted = rows.join(F.broadcast(heavy), ["g", "g2"], "left")
    key = F.when(F.col("heavy"), F.xxhash64(F.lit(3), "g", F.coalesce(F.col("doc_id").cast("double"), F.rand(5)))).otherwise(F.col("g"))
    placed = stash(salted.select("doc_id", "size", "text_crc32", "g", F.pmod(key, F.lit(slots)).cast("int").alias("virtual_slot")))
    weight = {r["virtual_slot"]: (r["bytes"], r["n"]) for r in placed.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}  # at most ``slots`` rows
    folder = maps or scratch(spark)
    stored = versions(spark, folder)
    if not stored:
        save_map(spark, folder, 1, first_map(slots, shards))
    version = stored[-1] if stored else 1
    one = load_map(spark, folder, version)
    if len(one) != slots:
        raise ValueError(f"the stored map has {len(one)} slots, not {slots}")
    two = rebalanced(one, {k: b for k, (b, _) in weight.items()}, shards)
    if two != one:
        version += 1
        save_map(spark, folder, version, two)
    begin, seen = [0] * slots, [0] * shards
    for i in range(slots):
        begin[i] = seen[two[i]]
        seen[two[i]] += weight.get(i, (0, 0))[1]
    place = F.row_number().over(W.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_last(), "g", "size")).cast("long") - 1
    slot = F.element_at(F.lit(begin).cast("array<bigint>"), F.col("virtual_slot") + 1) + place
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), lookup(two, F.col("virtual_slot")).cast("int").alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"))
