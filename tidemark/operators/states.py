"""State labels, their runs and transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.series import order


def debounced(rows: DataFrame, state: str = "state", above: str = "above", out: str = "taken") -> DataFrame:
    """rows with the state taken on: WARMUP where it is proposed, TRANSITION where above (1, 0 or -1, the order
    of two averages) changes sign, else a state that two rows in a row propose, and what it was otherwise."""
    past = order().rowsBetween(Window.unboundedPreceding, -1)
    side = F.nullif(F.signum(F.col(above)), F.lit(0.0))
    crossed = F.coalesce(side != F.last(side, ignorenulls=True).over(past), F.lit(False))
    x = rows.withColumn("_crossed", crossed).withColumn("_still", (F.col(state) != "WARMUP") & ~F.col("_crossed"))
    again = F.col("_still") & F.lag("_still").over(order()) & (F.col(state) == F.lag(state).over(order()))
    x = x.withColumn("_taken", F.when(F.col(state) == "WARMUP", "WARMUP").when(F.col("_crossed"), "TRANSITION").when(again, F.col(state)))
    return x.withColumn(out, F.coalesce(F.last("_taken", ignorenulls=True).over(order().rowsBetween(Window.unboundedPreceding, 0)), F.lit("WARMUP"))).drop("_crossed", "_still", "_taken")


def hysteresis(rows: DataFrame, value: str, low: float, high: float, out: str = "high") -> DataFrame:
    """rows with the boolean out: true above high, false below low, else what it was (false at first)."""
    sure = F.when(F.col(value) > high, True).when(F.col(value) < low, False)
    return rows.withColumn(out, F.coalesce(F.last(sure, ignorenulls=True).over(order().rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))


def dwell(rows: DataFrame, state: str = "state") -> DataFrame:
    """(symbol, state, start, end, length): runs of equal states."""
    new = F.coalesce((F.col(state) != F.lag(state).over(order())).cast("int"), F.lit(1))
    runs = rows.withColumn("_new", new).withColumn("_n", F.sum("_new").over(order().rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("symbol", "_n", F.col(state).alias("state")).agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("length")).drop("_n")


def transitions(rows: DataFrame, states: list[str], changes_only: bool = False, state: str = "state") -> DataFrame:
    """(symbol, before, after, n, p): dense counts and shares of neighbouring states."""
    steps = rows.select("symbol", F.lag(state).over(order()).alias("before"), F.col(state).alias("after")).where("before IS NOT NULL")
    if changes_only:
        steps = steps.where("before <> after")
    every = rows.select("symbol").distinct().withColumn("before", F.explode(F.array(*map(F.lit, states)))).withColumn("after", F.explode(F.array(*map(F.lit, states))))
    dense = every.join(steps.groupBy("symbol", "before", "after").agg(F.count("*").alias("n")), ["symbol", "before", "after"], "left").na.fill(0, ["n"])
    return dense.withColumn("p", F.try_divide("n", F.nullif(F.sum("n").over(Window.partitionBy("symbol", "before")), F.lit(0))))


def entropy_bits(rows: DataFrame, state: str = "state") -> DataFrame:
    """(symbol, bits) of the states' shares."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy("symbol"))
    return rows.groupBy("symbol", state).agg(F.count("*").alias("n")).withColumn("p", share).groupBy("symbol").agg((-F.sum(F.col("p") * F.log2("p"))).alias("bits"))


def jaccard(a: DataFrame, b: DataFrame, keys: list[str], by: str = "symbol") -> DataFrame:
    """(by, shared, either, jaccard) of two key sets."""
    both = a.select(*keys).distinct().withColumn("_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("_b", F.lit(1)), keys, "full")
    out = both.groupBy(by).agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"), F.count("*").alias("either"))
    return out.withColumn("jaccard", F.col("shared") / F.col("either"))
