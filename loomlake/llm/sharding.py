"""Sharding by fixed virtual slots (DataFrame functions only).

Each record hashes to one of SLOTS virtual slots.  Bytes and rows are summed per slot, and a versioned
slot-to-shard map, a table of SLOTS rows at every corpus size, says where each slot lives.  The first
version packs the slots by bytes, largest first, onto the lightest shard and is stored; where shards
are uneven, at once or with later documents, rebalance() edits the stored map into its next version, and
grow() does so for one shard more.  Both move slots only and never rehash records.  Law: `bytes`.

A null text has no bytes (size 16, CRC 0); null ids hash like any other value; equal texts with
different ids spread over slots; rows repeated exactly share a slot and one task of a window there.  A
very long text is one record, and a slot's bytes are at least its; only sizes leave the scan.  Ties of a
place go by id, checksum and size.  An empty table gives no rows.  Further input columns do not matter.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, file_system, scratch

SLOTS = 8192
SHARDS = 40
#: Share of the mean by which the heaviest shard may exceed it.
TOLERANCE = 0.001


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return row.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def slot_stats(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each slot: at most SLOTS rows, combined before the shuffle."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def first_map(bytes_of: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Slot to shard: largest slot first, each onto the shard with the fewest bytes so far; empty slots go round."""
    heap, out = [(0, s) for s in range(shards)], {}
    for slot in sorted(range(slots), key=lambda v: (-bytes_of.get(v, 0), v)):
        load, s = heap[0]
        if bytes_of.get(slot, 0) == 0:
            out[slot] = slot % shards
            continue
        out[slot] = s
        heapq.heapreplace(heap, (load + bytes_of[slot], s))
    return out


def rebalance(at: dict[int, int], bytes_of: dict[int, int], shards: int, tolerance: float = TOLERANCE) -> dict[int, int]:
    """An edited map: while the heaviest shard exceeds the mean by the tolerance, its best-fitting slot moves to the lightest."""
    at, load, of = dict(at), [0] * shards, [set() for _ in range(shards)]
    for slot, s in at.items():
        load[s] += bytes_of.get(slot, 0)
        of[s].add(slot)
    mean = sum(load) / shards
    for _ in range(len(at)):
        hi, lo = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[hi] - load[lo]
        fits = [v for v in of[hi] if 0 < bytes_of.get(v, 0) < gap]
        if load[hi] <= mean * (1 + tolerance) or not fits:
            break
        v = min(fits, key=lambda v: (abs(gap - 2 * bytes_of[v]), v))
        at[v] = lo
        of[hi].remove(v)
        of[lo].add(v)
        load[hi] -= bytes_of[v]
        load[lo] += bytes_of[v]
    return at


def grow(at: dict[int, int], bytes_of: dict[int, int], shards: int) -> dict[int, int]:
    """The map for one shard more: slots move into the new shard only, from the heaviest shards, until it has its share."""
    at, load, of = dict(at), [0] * shards, [[] for _ in range(shards)]
    for slot, s in at.items():
        load[s] += bytes_of.get(slot, 0)
        of[s].append(slot)
    for x in of:
        x.sort(key=lambda v: (bytes_of.get(v, 0), -v))
    share, got = sum(load) / (shards + 1), 0
    while got < share:
        hi = max(range(shards), key=lambda s: (load[s], -s))
        fits = [v for v in of[hi] if 0 < bytes_of.get(v, 0) <= share - got]
        if not fits:
            break
        v = fits[-1]
        of[hi].remove(v)
        load[hi] -= bytes_of[v]
        got += bytes_of[v]
        at[v] = shards
    return at


def map_table(spark: SparkSession, at: dict[int, int], version: int, n_of: dict[int, int] | None = None) -> DataFrame:
    """The map as a table (version, vslot, shard, first): first is the place of the slot's first row within its shard."""
    placed, rows = {}, []
    for slot in sorted(at):
        s = at[slot]
        rows.append({"v": slot, "s": s, "f": placed.get(s, 0)})
        placed[s] = placed.get(s, 0) + (n_of or {}).get(slot, 0)
    one = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<v:int,s:int,f:long>>")).alias("m"))
    return one.select(F.lit(version).alias("version"), F.col("m.v").alias("vslot"), F.col("m.s").alias("shard"), F.col("m.f").alias("first"))


def store_map(table: DataFrame, path: str) -> None:
    """Append a version to the stored map; earlier versions stay readable."""
    table.write.mode("append").partitionBy("version").parquet(path)


def has_map(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    m = spark.read.parquet(path)
    v = m.agg(F.max("version")).first()[0] if version is None else version
    return m.where(F.col("version") == v)


def current_map(stats: dict[int, tuple[int, int]], spark: SparkSession, path: str, shards: int, slots: int, tolerance: float = TOLERANCE) -> DataFrame:
    """The newest version of the map stored at path, after what the slots' bytes ask for.

    No map yet: the first packing is stored as version 1.  Then, and for a map stored earlier, a shard
    over the mean by the tolerance makes the edited map the next version.
    """
    bytes_of, n_of = {v: b for v, (b, _) in stats.items()}, {v: n for v, (_, n) in stats.items()}
    if has_map(spark, path):
        stored = load_map(spark, path).collect()  # at most `slots` rows
        at, version = {r.vslot: r.shard for r in stored}, stored[0].version
    else:
        at, version = first_map(bytes_of, shards, slots), 1
        store_map(map_table(spark, at, 1, n_of), path)
    edited = rebalance(at, bytes_of, shards, tolerance)
    if edited != at:
        at, version = edited, version + 1
        store_map(map_table(spark, at, version, n_of), path)
    # where each slot starts within its shard follows from the counts of these documents
    return map_table(spark, at, version, n_of)


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, slot (place within the shard, gapless from 0), version (of the map).

    path: where the map is stored and versioned; without one, a folder of this application's own."""
    spark = docs.sparkSession
    rows = cut(records(docs, id_col, text_col, slots), "records")
    stats = {r.vslot: (r.bytes, r.n) for r in slot_stats(rows).collect()}  # at most `slots` rows
    table = cut(current_map(stats, spark, path or scratch(spark, "slot-maps"), shards, slots), "slot-map")
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    placed = rows.withColumn("__place", place)
    return placed.join(F.broadcast(table), "vslot").select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("first") + F.col("__place")).cast("long").alias("slot"), "version")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version"))
