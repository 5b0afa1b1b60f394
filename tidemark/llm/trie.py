"""Prefix trie of conversations.

Equal conversations are folded into one member with a weight. Members are dealt by the digest of
their first turn: subtries of first turns that fit are packed into buckets of about ROWS turns, and
applyInPandas builds a trie of dictionaries for each bucket, whose sums come from an iterative postorder.
A first turn whose members have more than ROWS turns left makes a spine node instead, and its
members are dealt again by their next turn, and so on. A member that has more than ROWS turns all to
itself is a chain: its nodes are rows of running sums, without a trie. Spine nodes are summed up from the
subtries below them, the deepest level first; the root comes last.

So a group holds about ROWS turns (a bucket of several subtries perhaps a few times that, as its load is a
random sum of loads up to ROWS), digests and sizes, never texts. Each level of the spine costs a few
jobs: as many levels as the turns that more than ROWS turns' worth of different members share.

Turns go by turn number (null first), then role and text, repeated ones included; null roles and
texts are empty. Rows with a null conv_id belong to no conversation and make no node. Very long texts are
read whole by the digest. An empty table gives no node, not even a root; extra columns are not read.
Turns and prefixes are told apart by 128 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table
from tidemark.llm.turns import CRC_TABLE, crc_sql, numbered, ordered, plain

#: Turns of a subtrie that is built in one piece, and of a bucket on average.
ROWS = 4096
#: Ids that are put together before a digest reads them.
IDS = 4096
BLOCK = 4096
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_rep long"


def digest(*parts: object) -> list[Column]:
    return [F.xxhash64(F.lit(k), *parts) for k in (1, 2)]


def turn_rows(conversations: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, d1, d2, bytes) of each turn, (conv_id, own) of each conversation)."""
    d1, d2 = digest(F.length("role"), "role", "text")
    rows = ordered(plain(conversations, "", **columns).where("conv_id IS NOT NULL"), "conv_id", d1.alias("d1"), d2.alias("d2"), F.octet_length("text").cast("long").alias("bytes"))
    placed, sizes = numbered(rows)
    return placed.select("conv_id", "pos", "d1", "d2", "bytes"), cut(sizes)


def folded(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conv_id, rep, n): rep is the smallest of the conversations with the same n turns. sizes: (conv_id, n)."""
    keyed = [F.bit_xor(F.xxhash64(F.lit(k), "pos", "d1", "d2")).alias(f"s{k}") for k in (3, 4)]
    sums = rows.groupBy("conv_id").agg(*keyed)
    whole = cut(sizes.join(sums, "conv_id", "left").na.fill(0, ["s3", "s4"]))
    reps = whole.groupBy("n", "s3", "s4").agg(F.min("conv_id").alias("rep"))
    return whole.join(reps, ["n", "s3", "s4"]).select("conv_id", "rep", "n")


def dealt(rows: DataFrame, members: DataFrame, limit: int) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """(subtries, chains, spines by level). rows: (c, pos, d1, d2, bytes); members: (c, n, w), n over 0.

    Subtries and chains are members with level, their key (k1, k2) there and that of the node above (p1, p2)."""
    subtries, chains, spines = [], [], []
    live, level = members.withColumns({"p1": F.lit(0).cast("long"), "p2": F.lit(0).cast("long")}), 1
    while True:
        k1, k2 = digest("p1", "p2", "d1", "d2")
        keyed = live.join(rows.where(F.col("pos") == level), "c").select("c", "n", "w", "p1", "p2", k1.alias("k1"), k2.alias("k2"), "bytes")
        loads = keyed.groupBy("k1", "k2").agg(F.sum(F.col("n") - level + 1).alias("load"), F.count("*").alias("m"))
        judged = cut(keyed.join(loads, ["k1", "k2"]).withColumn("level", F.lit(level).cast("long")))
        subtries.append(judged.where(F.col("load") <= limit))
        large = judged.where(F.col("load") > limit)
        if large.isEmpty():
            return subtries, chains, spines
        chains.append(large.where("m = 1"))
        shared = large.where("m > 1")
        spines.append(
            cut(shared.groupBy("k1", "k2", "p1", "p2").agg(F.min("c").alias("conv_id"), F.sum("w").alias("n_convs"), F.max("bytes").alias("bytes"), F.max(F.when(F.col("n") == level, F.col("c"))).alias("end_rep")))
        )
        live, level = shared.where(F.col("n") > level).select("c", "n", "w", F.col("k1").alias("p1"), F.col("k2").alias("p2")), level + 1


def built(group: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the subtries of a bucket: one row for each turn of each member, from the subtrie's level on."""
    group = group.sort_values(["c", "pos"], kind="stable")
    tops: dict[tuple[int, int], int] = {}
    above: dict[tuple[int, int], tuple[int, int]] = {}
    children: list[dict[tuple[int, int], int]] = []
    low, depth, convs, size, end = [], [], [], [], []
    node = -1
    names = ["c", "n", "w", "level", "k1", "k2", "p1", "p2", "pos", "d1", "d2", "bytes"]
    for c, n, w, level, k1, k2, p1, p2, pos, d1, d2, nbytes in zip(*[group[x].tolist() for x in names], strict=True):
        if pos == level:
            into, at = tops, (k1, k2)
            above[at] = (p1, p2)
        else:
            into, at = children[node], (d1, d2)
        node = into.get(at, -1)
        if node < 0:  # members come in the order of c: the first is the smallest
            node = into[at] = len(children)
            children.append({})
            low.append(c)
            depth.append(pos)
            convs.append(0)
            size.append(nbytes)
            end.append(None)
        convs[node] += w
        if pos == n:
            end[node] = c
    leaves, saved, up = [0] * len(children), [0] * len(children), [None] * len(children)
    for top in tops.values():
        stack = [(top, iter(children[top].values()))]
        while stack:
            node, rest = stack[-1]
            child = next(rest, None)
            if child is not None:
                up[child] = low[node]
                stack.append((child, iter(children[child].values())))
                continue
            stack.pop()
            leaves[node] = leaves[node] or 1
            saved[node] += (convs[node] - 1) * size[node]
            if stack:
                leaves[stack[-1][0]] += leaves[node]
                saved[stack[-1][0]] += saved[node]
    key = [(None, None)] * len(children)
    for at, node in tops.items():
        key[node] = above[at]
    whole = lambda x: pd.array(x, "Int64")
    columns = (low, depth, up, convs, [len(x) for x in children], leaves, saved, end, [k[0] for k in key], [k[1] for k in key])
    return pd.DataFrame({name: whole(x) for name, x in zip([x.split()[0] for x in NODE.split(", ")] + ["p1", "p2"], columns, strict=True)})


def chain_nodes(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """The nodes of members that are alone from their level on; sums of sizes run over blocks of turns."""
    long = rows.join(chains.select("c", "n", "w", "level", "p1", "p2"), "c").where(F.col("pos") >= F.col("level")).withColumn("block", F.floor(F.col("pos") / BLOCK))
    later = Window.partitionBy("c").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    behind = long.groupBy("c", "block").agg(F.sum("bytes").alias("b")).select(F.col("c").alias("_c"), F.col("block").alias("_b"), F.coalesce(F.sum("b").over(later), F.lit(0)).alias("behind"))
    own = F.sum("bytes").over(Window.partitionBy("c", "block").orderBy(F.col("pos").desc()))
    top = F.col("pos") == F.col("level")
    first = lambda x: F.when(top, F.col(x)).alias(x)
    return long.withColumn("own", own).join(behind, (F.col("c") == F.col("_c")) & (F.col("block") == F.col("_b"))).select(
        F.col("c").alias("conv_id"), F.col("pos").alias("depth"), F.when(~top, F.col("c")).alias("parent_conv_id"), F.col("w").alias("n_convs"),
        (F.col("pos") < F.col("n")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("w") - 1) * (F.col("own") + F.col("behind"))).alias("saved_tokens"),
        F.when(F.col("pos") == F.col("n"), F.col("c")).alias("end_rep"), first("p1"), first("p2"),
    )


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def tries(rows: DataFrame, members: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(nodes below the root, their tops at level 1). See dealt()."""
    subtries, chains, spines = dealt(rows, members, limit)
    small = union([s.select("c", "n", "w", "level", "k1", "k2", "p1", "p2") for s in subtries])
    loads = small.agg(F.ceil(F.sum(F.col("n") - F.col("level") + 1) / limit)).first()[0] or 1
    bucket = F.pmod(F.xxhash64("k1", "k2"), F.lit(loads)).alias("bucket")
    packed = small.join(rows, "c").where(F.col("pos") >= F.col("level")).select(bucket, *small.columns, "pos", "d1", "d2", "bytes")
    nodes = packed.groupBy("bucket").applyInPandas(lambda group: built(group), f"{NODE}, p1 long, p2 long")
    if chains:
        nodes = nodes.unionByName(chain_nodes(rows, union(chains)))
    nodes = cut(nodes)
    tops = nodes.where("p1 IS NOT NULL")
    done = [nodes.where("p1 IS NULL").drop("p1", "p2")]
    for level in range(len(spines), 0, -1):
        spine = spines[level - 1]
        below = tops.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        summed = spine.join(below, ["k1", "k2"], "left").select(
            "conv_id", F.lit(level).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes") + F.coalesce("saved", F.lit(0))).cast("long").alias("saved_tokens"), "end_rep", "p1", "p2",
        )
        names = spine.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
        known = tops.join(names, ["p1", "p2"], "left")
        done.append(known.where("above IS NOT NULL").withColumn("parent_conv_id", F.col("above")).drop("p1", "p2", "above"))
        tops = cut(known.where("above IS NULL").drop("above").unionByName(summed))
    return union(done), tops


def end_digests(ends: DataFrame) -> DataFrame:
    """(rep, ends_sha256) of (rep, conv_id): ids are put together in order by blocks, and a digest reads the blocks one by one."""
    order = ["rep", "conv_id"]
    placed = cut(ends.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    joined = placed.groupBy("rep", F.floor(F.col("at") / IDS).alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        done: list[tuple] = []
        for b in batches:
            for rep, ids in zip(b.column("rep").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if rep == now:
                    sha.update(b"," + ids.encode())
                    continue
                if sha:
                    done.append((now, sha.hexdigest()))
                now, sha = rep, hashlib.sha256(ids.encode())
            yield batch(done)
            done = []
        if sha:
            yield batch([(now, sha.hexdigest())])

    def batch(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], names=["rep", "ends_sha256"])

    return joined.repartition("rep").sortWithinPartitions("rep", "block").mapInArrow(run, "rep long, ends_sha256 string")


def prefix_trie(rows: DataFrame, sizes: DataFrame, limit: int = ROWS) -> DataFrame:
    """The nodes of the trie over conversations, given as turns (conv_id, pos, d1, d2, bytes) and sizes (conv_id, n), turnless ones
    included: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256). A node's last text is that of turn depth of conv_id."""
    same = cut(folded(rows, sizes))
    members = same.groupBy(F.col("rep").alias("c"), "n").agg(F.count("*").alias("w"))
    own = cut(rows.join(members.where("n > 0").select(F.col("c").alias("conv_id")), "conv_id", "left_semi").withColumnRenamed("conv_id", "c"))
    below, tops = tries(own, members.where("n > 0"), limit)
    whole = same.agg(F.min("conv_id"), F.count("*"), F.min(F.when(F.col("n") == 0, F.col("rep")))).first()
    long = lambda x: F.lit(x).cast("long")
    of_tops = tops.agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).where(F.lit(whole[1] > 0))
    root = of_tops.select(
        long(whole[0]).alias("conv_id"), long(0).alias("depth"), long(None).alias("parent_conv_id"), long(whole[1]).alias("n_convs"), "n_children",
        F.coalesce("leaves", long(1)).alias("n_leaves"), F.coalesce("saved", long(0)).alias("saved_tokens"), long(whole[2]).alias("end_rep"),
    )
    nodes = union([below, tops.withColumn("parent_conv_id", long(whole[0])).drop("p1", "p2"), root])
    shas = end_digests(same.select("rep", "conv_id"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(shas, F.col("end_rep") == F.col("rep"), "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none)).drop("rep", "end_rep")


def rebuilt(rows: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and sizes of conversations rebuilt: the first h turns of conversation c - c % 5, then the own turns behind the first h; h = crc32(c) % 9."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h")
    plans = sizes.select("conv_id", "own", h, (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    plans = cut(plans.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0)))))
    heads = plans.where("k > 0").select("conv_id", "k", "base").join(rows.where("pos <= 8").withColumnRenamed("conv_id", "base"), "base").where("pos <= k")
    tails = rows.join(plans.select("conv_id", "k", "h"), "conv_id").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("k"))
    columns = ["conv_id", "pos", "d1", "d2", "bytes"]
    n = F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return cut(heads.select(*columns).unionByName(tails.select(*columns))), plans.select("conv_id", n.alias("n"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(*turn_rows(table(spark, sf_dir, "conversations"))))


OP11_SQL = f"""
WITH RECURSIVE bits AS (
  {CRC_TABLE}
), t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {crc_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t), bits
), turns AS (
  SELECT convs.conv_id, 0 AS part, pos, role, text FROM convs JOIN t ON t.conv_id = base WHERE pos <= h
  UNION ALL SELECT convs.conv_id, 1, pos, role, text FROM convs JOIN t ON t.conv_id = convs.conv_id WHERE pos > h
), placed AS (
  SELECT conv_id, strlen(text) AS bytes, length(role) || ':' || role || text AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS pos FROM turns
), prefixes AS (
  SELECT conv_id, 0 AS depth, '' AS prefix, CAST(NULL AS VARCHAR) AS above, CAST(0 AS BIGINT) AS bytes FROM convs
  UNION ALL SELECT p.conv_id, pos, md5(prefix || turn), prefix, placed.bytes FROM prefixes AS p JOIN placed ON placed.conv_id = p.conv_id AND placed.pos = p.depth + 1
), nodes AS (
  SELECT prefix, any_value(above) AS above, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS own FROM prefixes GROUP BY prefix
), ends AS (
  SELECT prefix, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(prefix, depth) AS prefix FROM prefixes GROUP BY conv_id) GROUP BY prefix
), children AS (
  SELECT above, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above
), up AS (
  SELECT prefix AS node, prefix AS top FROM nodes UNION ALL SELECT up.node, nodes.above FROM up JOIN nodes ON nodes.prefix = up.top WHERE nodes.above IS NOT NULL
), sums AS (
  SELECT top, count(*) FILTER (children.n IS NULL) AS n_leaves, sum(nodes.own) AS saved FROM up JOIN nodes ON nodes.prefix = up.node LEFT JOIN children ON children.above = up.node GROUP BY top
)
SELECT nodes.conv_id, CAST(nodes.depth AS BIGINT) AS depth, parents.conv_id AS parent_conv_id, nodes.n_convs, coalesce(children.n, 0) AS n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes LEFT JOIN nodes AS parents ON parents.prefix = nodes.above LEFT JOIN children ON children.above = nodes.prefix JOIN sums ON sums.top = nodes.prefix LEFT JOIN ends ON ends.prefix = nodes.prefix
"""

QUERIES = {"op11_trie": op11_trie}
ORACLES = {"op11_trie": OP11_SQL}
