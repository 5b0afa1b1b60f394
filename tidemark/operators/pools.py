"""Controls from sorted pools and from gaps between targets, without pairing events with the pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Places of a pool to each side of an event's own among which its control is chosen.
NEIGHBOURS = 8
#: The fewest bars between the ends of an interval.
SHORTEST = 3


def blocked(events: DataFrame, bars: DataFrame, back: int) -> DataFrame:
    """(symbol, i, ...) of bars with blocked: whether an event lies on the bar or at most `back` bars behind it. Both have the bar's number i."""
    marks = events.select("symbol", "i").distinct().withColumn("_e", F.lit(1))
    ahead = Window.partitionBy("symbol").orderBy("i").rangeBetween(0, back)
    return bars.join(marks, ["symbol", "i"], "left").withColumn("blocked", F.coalesce(F.max("_e").over(ahead), F.lit(0)) == 1).drop("_e")


def nearest_in_pool(events: DataFrame, pool: DataFrame, by: list[str], target: str, value: str, k: int = NEIGHBOURS) -> DataFrame:
    """events with the row of their pool (by, value, i) as control_i and control_value: the nearest in value among the k before and k + 1 from the event's place in the sorted pool on,
    of equally near ones the nearest in i, then the first; null where the pool is empty.

    Both sides are merged by value, which gives each event its place; then it meets 2k + 1 places."""
    names = events.columns
    ranked = pool.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(value, "i")))
    e = events.withColumn("_id", F.monotonically_increasing_id())
    merged = ranked.select(*by, F.col(value).alias("_v"), F.lit(1).alias("_o"), F.lit(None).cast("struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in events.schema.fields) + ">").alias("_e"), F.lit(None).cast("long").alias("_id")).unionByName(
        e.where(F.col(target).isNotNull()).select(*by, F.col(target).alias("_v"), F.lit(0).alias("_o"), F.struct(*names).alias("_e"), "_id")
    )
    before = Window.partitionBy(*by).orderBy("_v", "_o").rowsBetween(Window.unboundedPreceding, 0)
    placed = merged.withColumn("_p", F.sum("_o").over(before)).where("_o = 0")  # events stand before equal values
    asked = placed.select(*by, "_e", "_id", "_v", F.explode(F.sequence(F.col("_p") - k + 1, F.col("_p") + k + 1)).alias("_r"))
    met = asked.join(ranked.select(*by, "_r", F.col("i").alias("_j"), F.col(value).alias("_w")), [*by, "_r"])
    best = F.min(F.struct(F.round(F.abs(F.col("_w") - F.col("_v")), 12).alias("d"), F.abs(F.col("_j") - F.col("_e.i")).alias("g"), F.col("_j").alias("j"), F.col("_w").alias("w")))
    chosen = met.groupBy("_id").agg(F.first("_e").alias("_e"), best.alias("b")).select("_e.*", F.col("b.j").alias("control_i"), F.col("b.w").alias("control_value"))
    none = e.join(met.select("_id").distinct(), "_id", "left_anti").select(*names, F.lit(None).cast("long").alias("control_i"), F.lit(None).cast("double").alias("control_value"))
    return chosen.unionByName(none)


def gaps(targets: DataFrame, sizes: DataFrame) -> DataFrame:
    """(symbol, start, end): the bars from 0 to n - 1 between targets (symbol, first, last), by number. sizes: (symbol, n)."""
    order = Window.partitionBy("symbol").orderBy("first", "last")
    reached = F.coalesce(F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    inner = targets.select("symbol", (reached + 1).alias("start"), (F.col("first") - 1).alias("end"))
    ends = targets.groupBy("symbol").agg(F.max("last").alias("m"))
    last = sizes.join(ends, "symbol", "left").select("symbol", (F.coalesce("m", F.lit(-1)) + 1).alias("start"), (F.col("n") - 1).alias("end"))
    return inner.unionByName(last).where("end >= start")


def matched_in_duration(targets: DataFrame, sizes: DataFrame, duration: str) -> DataFrame:
    """targets with start, end and mismatch of the interval that overlaps none of them and comes nearest to the duration (bars between its ends), the first of equal ones;
    null where no gap holds SHORTEST.

    Only gaps longer than all before them can be the first that is long enough, so each target looks up one of these by its length, or takes the longest."""
    room = gaps(targets, sizes).withColumn("room", F.col("end") - F.col("start")).where(F.col("room") >= SHORTEST)
    longest = F.max("room").over(Window.partitionBy("symbol").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    records = room.withColumn("_l", longest).where(F.col("_l").isNull() | (F.col("room") > F.col("_l"))).select("symbol", "start", "room")
    e = targets.withColumn("_id", F.monotonically_increasing_id()).withColumn("_d", F.greatest(F.col(duration), F.lit(SHORTEST)))
    # Sorted by length from the longest on, the last record seen before a target is the shortest that suffices.
    kind = "struct<start:bigint,room:bigint>"
    a = records.select("symbol", F.col("room").cast("long").alias("_k"), F.lit(0).alias("_o"), F.struct(F.col("start").cast("long").alias("start"), F.col("room").cast("long").alias("room")).alias("_g"), F.lit(None).cast("long").alias("_id"))
    b = e.select("symbol", F.col("_d").cast("long").alias("_k"), F.lit(1).alias("_o"), F.lit(None).cast(kind).alias("_g"), "_id")
    down = Window.partitionBy("symbol").orderBy(F.col("_k").desc(), "_o").rowsBetween(Window.unboundedPreceding, 0)
    fits = a.unionByName(b).withColumn("_g", F.last("_g", ignorenulls=True).over(down)).where("_o = 1").select("_id", "_g")
    most = records.groupBy("symbol").agg(F.max_by(F.struct(F.col("start").cast("long").alias("start"), F.col("room").cast("long").alias("room")), "room").alias("_m"))
    found = e.join(fits, "_id").join(most, "symbol", "left").withColumn("_c", F.coalesce("_g", "_m"))
    end = F.col("_c.start") + F.least(F.col("_d"), F.col("_c.room"))
    return found.select(*targets.columns, F.col("_c.start").alias("start"), end.alias("end"), F.abs(end - F.col("_c.start") - F.col(duration)).alias("mismatch"))
