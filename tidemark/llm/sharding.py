"""Shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions alone.

The ring has RING slots; a row's slot is the head of its key's hash. Each shard owns NODES virtual
nodes at hashed slots; a slot belongs to the first node at or after it, clockwise. Every shard may
hold floor(n / shards) rows, the first n mod shards shards one more, so the loads are at most one
apart whatever the keys are. Rows stay at home while their shard has room (in ring order); the
others continue clockwise to the next shards with room.

What crosses the driver are the counts of the arcs between nodes: shards * NODES numbers at most,
whatever the number of rows. From them follow segments (arc, first rank, shard, first slot). A row
finds its segment by its rank in its arc, which is its rank in its (ring slot, salt) cell plus the
cell's offset, so a key that holds a third of all rows is dealt to SALTS cells.

The key is the text, so equal texts stay together as far as room allows; by NODES * shards, one arc
in a few hundred is cut. Null texts count as empty ones with size 1. Null and repeated ids each get
their own slot (ties in any order: such rows are alike). An empty table gives an empty result. Extra
columns stay, whatever their names; ones named shard or slot are replaced. Very long texts are hashed whole.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import others, table

RING_BITS = 14
NODES = 32
SALTS = 64


def arc_of_slots(shards: int, nodes: int = NODES) -> tuple[list[int], list[int]]:
    """The shard of each arc in ring order, and the arc of each ring slot."""
    size = 1 << RING_BITS
    at = sorted((zlib.crc32(f"shard {s} node {k}".encode()) * 2654435761 % (1 << 32) >> (32 - RING_BITS), s) for s in range(shards) for k in range(nodes))
    arcs, arc = [], 0
    for slot in range(size):
        while arc < len(at) and at[arc][0] < slot:
            arc += 1
        arcs.append(arc % len(at))
    return [s for _, s in at], arcs


def segments(counts: list[int], owner: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) from the arcs' row counts."""
    n = sum(counts)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    used, out, over = [0] * shards, [], []

    def put(arc: int, rank: int, k: int, shard: int) -> None:
        out.append((arc, rank, rank + k, shard, used[shard]))
        used[shard] += k

    for arc, k in enumerate(counts):
        here = min(k, room[owner[arc]] - used[owner[arc]])
        if here:
            put(arc, 0, here, owner[arc])
        if here < k:
            over.append((arc, here))
    for arc, rank in over:
        step = arc
        while rank < counts[arc]:
            step = (step + 1) % len(owner)
            here = min(counts[arc] - rank, room[owner[step]] - used[owner[step]])
            if here:
                put(arc, rank, here, owner[step])
                rank += here
    return out


def small_table(spark: SparkSession, rows: list[tuple], names: str, schema: str) -> DataFrame:
    """A table of a few rows by way of a JSON literal: no Python on the executors."""
    text = json.dumps([dict(zip(names.split(), r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), schema)))


def assign(rows: DataFrame, key: Column, id_: Column, shards: int, nodes: int = NODES) -> DataFrame:
    """rows with shard and slot (gapless from 0 in each shard), in place of columns of these names."""
    spark = rows.sparkSession
    owner, arcs = arc_of_slots(shards, nodes)
    arc_list = F.split(F.lit(",".join(map(str, arcs))), ",").cast("array<int>")
    kept = [F.col(f"`{c}`") for c in others(rows, "shard", "slot")]
    own = F.struct(*kept or [F.lit(None).cast("int").alias("none")]).alias("_row")  # so that no name of it can clash
    placed = rows.select(own, F.xxhash64(key).alias("_pos"), F.xxhash64(id_).bitwiseAND(F.lit(SALTS - 1)).cast("int").alias("_salt"), id_.alias("_id"))
    placed = placed.withColumn("_slot", F.shiftrightunsigned("_pos", 64 - RING_BITS).cast("int")).withColumn("_arc", F.get(arc_list, F.col("_slot")))
    cells = placed.groupBy("_arc", "_slot", "_salt").agg(F.count("*").alias("n"))
    counts = [0] * len(owner)
    for r in cells.groupBy("_arc").agg(F.sum("n").alias("n")).collect():  # shards * nodes rows at most
        counts[r["_arc"]] = r["n"]
    before = Window.partitionBy("_arc").orderBy("_slot", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("_slot", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_slot", "_salt").orderBy("_pos", "_id")) - 1).join(offsets, ["_slot", "_salt"])
    found = small_table(spark, segments(counts, owner, shards), "arc first end shard first_slot", "array<struct<arc:int,first:bigint,end:bigint,shard:int,first_slot:bigint>>")
    rank = F.col("_rank") + F.col("_offset")
    # The segments are shards * nodes, and a few for overflow: fixed by parameters, so safe to broadcast.
    joined = ranked.join(F.broadcast(found), (F.col("_arc") == F.col("arc")) & (rank >= F.col("first")) & (rank < F.col("end")))
    return joined.select(*(["_row.*"] if kept else []), "shard", (F.col("first_slot") + rank - F.col("first")).alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"))
    out = assign(rows, F.col("key"), F.col("doc_id"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op6_sharding": op6_sharding}
ORACLES: dict[str, str] = {}
