"""Joins in time: as-of, containment, ranges, nearest times and overlaps, without looking ahead.

Range joins deal both sides to time buckets as wide as their reach, so each row meets the rows of its
own and neighbouring buckets alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, left_time: str, right_time: str, values: list[str], by: str = "symbol", strict: bool = False) -> DataFrame:
    """left with the values of the last right row of its key at or before left_time (strict: before it).

    One shuffle: both sides are merged by time and the last values carried on."""
    put = F.struct(*[F.col(v) for v in values])
    a = right.where(F.col(right_time).isNotNull()).select(F.col(by).alias("_k"), F.col(right_time).alias("_t"), F.lit(1 if strict else 0).alias("_o"), put.alias("_v"), F.lit(None).cast(left.schema).alias("_l"))
    b = left.select(F.col(by).alias("_k"), F.col(left_time).alias("_t"), F.lit(0 if strict else 1).alias("_o"), F.lit(None).cast(a.schema["_v"].dataType).alias("_v"), F.struct(*left.columns).alias("_l"))
    past = Window.partitionBy("_k").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_v", F.last("_v", ignorenulls=True).over(past)).where(F.col("_o") == (0 if strict else 1))
    return both.select("_l.*", "_v.*")


def children(parents: DataFrame, bars: DataFrame, child: int, parent: int) -> DataFrame:
    """parents with n_children, or null where not exactly every child of the slot is there once."""
    want = parent // child
    inside = bars.groupBy("symbol", (F.col("t") - F.pmod("t", F.lit(parent))).alias("t")).agg(F.count("*").alias("_n"), F.countDistinct("t").alias("_k"), F.count_if(F.pmod("t", F.lit(child)) != 0).alias("_off"))
    good = (F.col("_n") == want) & (F.col("_k") == want) & (F.col("_off") == 0)
    return parents.join(inside, ["symbol", "t"], "left").withColumn("n_children", F.when(good, F.col("_n"))).drop("_n", "_k", "_off")


def within(left: DataFrame, right: DataFrame, left_time: str, right_time: str, before: int, after: int, by: str = "symbol", how: str = "inner") -> DataFrame:
    """Pairs with left_time - before <= right_time <= left_time + after; right columns must have names of their own.

    how="semi": the left rows that meet any, each as often as it is there, by the first right time from left_time - before on."""
    if how == "semi":
        marks = right.select(F.col(by), F.col(right_time).alias("_m")).withColumn("_n", -F.col("_m"))
        return asof(left.withColumn("_at", before - F.col(left_time)), marks, "_at", "_n", ["_m"], by).where(F.col("_m") <= F.col(left_time) + after).drop("_at", "_m")
    width = max(1, before + after)
    b = right.withColumns({"_b": F.floor(F.col(right_time) / width), "_k": F.col(by)}).drop(by)
    a = left.withColumn("_a", F.explode(F.sequence(F.floor((F.col(left_time) - before) / width), F.floor((F.col(left_time) + after) / width))))
    met = a.join(b, (F.col(by) == F.col("_k")) & (F.col("_a") == F.col("_b")) & F.col(right_time).between(F.col(left_time) - before, F.col(left_time) + after))
    # A row lies in several buckets of the left side, but each right row in one: pairs come once.
    return met.drop("_a", "_b", "_k")


def overlaps(left: DataFrame, right: DataFrame, width: int, by: str = "symbol") -> DataFrame:
    """Pairs of inclusive intervals (s, e) and (s2, e2) that meet, each once: in the bucket where the later one starts."""
    a = left.withColumn("_a", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))))
    b = right.withColumnRenamed(by, "_k").withColumn("_b", F.explode(F.sequence(F.floor(F.col("s2") / width), F.floor(F.col("e2") / width))))
    first = F.floor(F.greatest("s", "s2") / width)
    return a.join(b, (F.col(by) == F.col("_k")) & (F.col("_a") == F.col("_b")) & (F.col("s") <= F.col("e2")) & (F.col("s2") <= F.col("e")) & (F.col("_a") == first)).drop("_a", "_b", "_k")


def nearest(pairs: DataFrame, keys: list[str], distance: str, tie: list[str]) -> DataFrame:
    """Of each key's pairs the one of the smallest distance, then of the smallest tie columns."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(distance, *tie))
    return pairs.withColumn("_r", rank).where("_r = 1").drop("_r")


def nearest_time(left: DataFrame, right: DataFrame, left_time: str, right_time: str, reach: int, key: str, out: str = "distance") -> DataFrame:
    """left with right_time, key and out (how far off) of the nearest right row at most reach away; equally near ones by the smallest time, then key. Left rows that meet none go.

    No pair is made: of the right rows of one time the smallest key stands, dealt to the two buckets of time that it can reach,
    and in a bucket the last time before and the first one after are carried on."""
    width = 2 * max(1, reach)
    bucket = lambda t: F.floor(t / width)
    marks = right.groupBy(F.col(right_time).alias("_m")).agg(F.min(key).alias("_i")).where("_m IS NOT NULL")
    marks = marks.withColumn("_b", F.explode(F.sequence(bucket(F.col("_m") - reach), bucket(F.col("_m") + reach))))
    put, none = F.struct("_m", "_i"), F.lit(None)
    a = marks.select("_b", F.col("_m").alias("_t"), put.alias("_v"), none.cast(left.schema).alias("_l"))
    b = left.where(F.col(left_time).isNotNull()).select(bucket(F.col(left_time)).alias("_b"), F.col(left_time).alias("_t"), none.cast(a.schema["_v"].dataType).alias("_v"), F.struct(*left.columns).alias("_l"))
    # By range, rows of one time are peers of the mark at it, whatever their order.
    past = Window.partitionBy("_b").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("_b").orderBy(F.col("_t").desc()).rangeBetween(Window.unboundedPreceding, 0)
    # Along each way the nearest mark is the one of the largest, or the smallest, time.
    met = a.unionByName(b).withColumns({"_p": F.max("_v").over(past), "_n": F.min("_v").over(ahead)}).where(F.col("_l").isNotNull())
    far = lambda c: F.abs(F.col("_t") - F.col(f"{c}._m"))
    found = met.withColumn("_w", F.when(F.col("_n").isNull() | (far("_p") <= far("_n")), F.col("_p")).otherwise(F.col("_n")))
    return found.where(far("_w") <= reach).select("_l.*", F.col("_w._m").alias(right_time), F.col("_w._i").alias(key), far("_w").alias(out))


def away_from(rows: DataFrame, events: DataFrame, time: str, event_time: str, reach: int, by: str = "symbol") -> DataFrame:
    """rows farther than reach from every event of their key: by the last event before and the first after."""
    marks = events.select(F.col(by), F.col(event_time).alias("_e"))
    back = asof(rows, marks.withColumnRenamed("_e", "_before").withColumn("_t1", F.col("_before")), time, "_t1", ["_before"], by)
    ahead = asof(back.withColumn("_neg", -F.col(time)), marks.withColumnRenamed("_e", "_after").withColumn("_t2", -F.col("_after")), "_neg", "_t2", ["_after"], by)
    near = F.coalesce(F.col(time) - F.col("_before") <= reach, F.lit(False)) | F.coalesce(F.col("_after") - F.col(time) <= reach, F.lit(False))
    return ahead.where(~near).drop("_before", "_after", "_neg")
