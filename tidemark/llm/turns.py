"""Turns of conversations in order, without one task for each conversation.

Rows are dealt to ranges of (conversation, turn, role, text), so a conversation of any length is cut
over many tasks and no group is gathered. Each row gets a number that grows along the order and,
within a range, by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Characters of a text that take part in the order of equal turns and roles before its hash does.
TIE_CHARS = 64
#: The bits of a row's number within its range.
RANGE_BITS = 33


def plain(rows: DataFrame, stand_in: str, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text): null roles and texts replaced by stand_in."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(stand_in))
    return rows.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))


def ordered(turns: DataFrame, *columns: Column) -> DataFrame:
    """(at, *columns) of turns by conversation, turn (null first), role and text, written out. Texts that agree in
    TIE_CHARS characters go by a hash; equal rows in any order, so that a mass of them is cut over ranges as well."""
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "_start", "_hash", "_row")]
    placed = turns.withColumns({"_start": F.substring("text", 1, TIE_CHARS), "_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    return cut(placed.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.monotonically_increasing_id().alias("at"), *columns))


def range_of(at: Column) -> Column:
    return F.shiftright(at, RANGE_BITS)


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with pos, counted from 1 in each conversation; (conv_id, own) with its number of turns), of ordered rows with a conv_id."""
    cells = rows.groupBy("conv_id", range_of(F.col("at")).alias("cell")).agg(F.min("at").alias("first"), F.count("*").alias("k"))
    earlier = Window.partitionBy("conv_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(F.col("conv_id").alias("_c"), F.col("cell").alias("_cell"), "first", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("skip"))
    same = (F.col("conv_id") == F.col("_c")) & (range_of(F.col("at")) == F.col("_cell"))
    placed = rows.join(starts, same).withColumn("pos", F.col("at") - F.col("first") + F.col("skip") + 1)
    return placed.drop("_c", "_cell", "first", "skip"), cells.groupBy("conv_id").agg(F.sum("k").alias("own"))


#: The 256 remainders of crc32, for crc_sql().
CRC_TABLE = "SELECT list(c ORDER BY b) AS crc FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) AS r(b))"


def crc_sql(text: str) -> str:
    """The crc32 of an ASCII text in DuckDB, beside the column crc of CRC_TABLE."""
    codes = f"list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, CAST(length({text}) AS BIGINT) + 1), lambda i: CAST(ord(substr({text}, i, 1)) AS BIGINT)))"
    return f"xor(list_reduce({codes}, lambda x, c: xor(crc[CAST(xor(x, c) & 255 AS INTEGER) + 1], x >> 8)), 4294967295)"
