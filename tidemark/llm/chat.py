"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions alone.

Logs often hold a conversation several times, each time with a few turns more. Every turn gets the
rolling hash of its conversation up to it (128 bits: two xors of hashes keyed by position, role and
text). A conversation whose last hash occurs inside a longer one is a prefix of it; an anti-join
retains the maximal ones, of equal ones the smallest conv_id, and these are rendered.

Hot keys. Positions and rolling hashes are made in two levels, within blocks of BLOCK turn numbers
and over blocks, so no task needs a long conversation's turns together; prefix hashes are folded by
partial aggregation before the join, so common first turns are single rows. Rendered conversations
come in parts of one block each, as no row may hold an unbounded conversation.

Turns are ordered by turn, role and text (by its first TIE_CHARS characters, then by a hash), repeated ones included. Null roles render as
the empty role, null texts as empty texts. Null turns come first. Rows with a null conv_id form one
conversation. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table
from tidemark.llm.turns import TIE_CHARS

#: Turn numbers of a block, so that a block has a bounded number of turns where these are distinct.
BLOCK = 256


def plain(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, block, turn, role, text, start, hash): the turns with nulls replaced."""
    rows = turns.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60)))
    return rows.withColumns({"block": block, "start": F.substring("text", 1, TIE_CHARS), "hash": F.xxhash64(F.length("role"), "role", "text")})


def positions(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, n, h1, h2) from plain(): position from 1, turns of the conversation, rolling hashes. No whole texts are shuffled."""
    rows = turns.select("conv_id", "block", "turn", "role", "start", "hash", F.xxhash64(F.lit(1), F.length("role"), "role", "text").alias("more"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "start", "hash")
    placed = rows.withColumn("at", F.row_number().over(inside))
    sizes = placed.groupBy("conv_id", "block").agg(F.count("*").alias("k"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("skip"), F.sum("k").over(Window.partitionBy("conv_id")).alias("n"))
    same = lambda x: x["conv_id"].eqNullSafe(F.col("c")) & (x["block"] == F.col("b"))
    numbered = placed.join(before, same(placed)).withColumn("pos", F.col("at") + F.col("skip"))
    keys = [F.xxhash64(F.lit(s), "pos", "hash", "more").alias(f"k{s}") for s in (1, 2)]
    keyed = cut(numbered.select("conv_id", "block", "pos", "n", *keys))
    # Only now do the hashes know their positions: once more within blocks and over them.
    blocks = keyed.groupBy("conv_id", "block").agg(F.bit_xor("k1").alias("x1"), F.bit_xor("k2").alias("x2"))
    over = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), *[F.coalesce(F.bit_xor(f"x{s}").over(earlier), F.lit(0)).alias(f"b{s}") for s in (1, 2)])
    rolling = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = keyed.withColumns({f"r{s}": F.bit_xor(f"k{s}").over(rolling) for s in (1, 2)}).join(over, same(keyed))
    return rolled.select("conv_id", "pos", "n", *[F.col(f"r{s}").bitwiseXOR(F.col(f"b{s}")).alias(f"h{s}") for s in (1, 2)])


def maximal(placed: DataFrame) -> DataFrame:
    """(conv_id, n, n_equal): the conversations that are no prefix of a longer one; equal ones count as one."""
    ends = placed.where("pos = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    inner = placed.where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return ends.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id", "n", "n_equal")


def render(turns: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, part, n_turns, n_equal, text): the maximal conversations, in parts from 0 in order."""
    rows = plain(turns, **columns)
    keep = cut(maximal(positions(rows)).select(F.col("conv_id").alias("c"), "n", "n_equal"))
    turn = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    lines = rows.join(keep, rows["conv_id"].eqNullSafe(F.col("c"))).select("conv_id", "block", "n", "n_equal", F.struct("turn", "role", "start", "hash", turn.alias("line")).alias("line"))
    parts = lines.groupBy("conv_id", "block", "n", "n_equal").agg(F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda x: x["line"]), "").alias("text"))
    # Blocks are numbered by themselves, without their texts.
    blocks = rows.select("conv_id", "block").distinct()
    numbers = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("block")) - 1).cast("int").alias("part"))
    numbered = parts.join(numbers, parts["conv_id"].eqNullSafe(F.col("c")) & (parts["block"] == F.col("b")))
    return numbered.select("conv_id", "part", F.col("n").alias("n_turns"), "n_equal", "text")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CAST(floor(turn / 256) AS BIGINT) AS block,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations
), h AS (
  SELECT *, string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM t
), ends AS (
  SELECT min(conv_id) AS conv_id, n, prefix, count(*) AS n_equal FROM h WHERE pos = n GROUP BY n, prefix
), keep AS (
  SELECT conv_id, n, n_equal FROM ends WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.pos < h.n AND h.pos = ends.n AND h.prefix = ends.prefix)
), parts AS (
  SELECT t.conv_id, block, t.n AS n_turns, n_equal, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
  FROM t JOIN keep ON t.conv_id IS NOT DISTINCT FROM keep.conv_id GROUP BY ALL
)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY block) - 1 AS INTEGER) AS part, n_turns, n_equal, text FROM parts
"""

QUERIES = {"op7_chat": op7_chat}
ORACLES = {"op7_chat": OP7_SQL}
