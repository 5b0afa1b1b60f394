"""Causal features of bars. Every function adds columns to bars keyed by symbol and ordered by t."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def order():  # noqa: ANN201
    return Window.partitionBy("symbol").orderBy("t")


def last(n: int):  # noqa: ANN201
    """The frame of the last n rows."""
    return order().rowsBetween(-(n - 1), 0)


def position(bars: DataFrame, out: str = "i") -> DataFrame:
    return bars.withColumn(out, (F.row_number().over(order()) - 1).cast("long"))


def true_range(bars: DataFrame, out: str = "tr") -> DataFrame:
    """Range with the gap to the previous close; the first bar's is high - low."""
    before = F.coalesce(F.lag("close").over(order()), F.col("close"))
    return bars.withColumn(out, F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def full(value: Column, n: int) -> Column:
    """value where n rows are at hand, else null."""
    return F.when(F.count(F.lit(1)).over(last(n)) == n, value)


def atr(bars: DataFrame, n: int = 14, strict: bool = True, out: str = "atr") -> DataFrame:
    """Mean true range of n bars: null before n bars are at hand (strict), or over those there are."""
    mean = F.avg("tr").over(last(n))
    return true_range(bars).withColumn(out, full(mean, n) if strict else mean)


def ema(rows: DataFrame, value: str, alpha: float, out: str, seed: int | None = None) -> DataFrame:
    """Exponential average. seed None: starts with the first value; else null before index seed, where it
    starts with the mean of the values up to it.

    A weighted sum of the past, taken in blocks: cumulative sums within a block, and the sums of the
    few blocks before whose weights are above rounding. No task folds a series value by value."""
    keep = 1 - alpha
    size = max(1, int(math.log(1e4) / -math.log(keep)))
    reach = math.ceil(40 / (size * -math.log(keep)))
    x = position(rows, "_i").withColumns({"_b": F.floor(F.col("_i") / size), "_k": F.pmod("_i", F.lit(size))})
    start = F.avg(value).over(order().rowsBetween(Window.unboundedPreceding, 0)) if seed else F.col(value)
    put = F.when(F.col("_i") > (seed or 0), alpha * F.col(value)).when(F.col("_i") == (seed or 0), start).otherwise(0.0)
    inside = Window.partitionBy("symbol", "_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    scaled = x.withColumn("_u", put).withColumn("_s", F.sum(F.col("_u") * F.pow(F.lit(keep), -F.col("_k"))).over(inside) * F.pow(F.lit(keep), F.col("_k")))
    ends = scaled.where(F.col("_k") == size - 1).select(F.col("symbol").alias("_y"), F.col("_b").alias("_c"), F.col("_s").alias("_e"))
    blocks = Window.partitionBy("_y").orderBy("_c")
    carry = F.lit(0.0)
    for m in range(reach):
        carry = carry + F.coalesce(F.lag("_e", m).over(blocks), F.lit(0.0)) * keep ** (size * m)
    before = ends.select("_y", (F.col("_c") + 1).alias("_c"), carry.alias("_p"))
    joined = scaled.join(before, (F.col("symbol") == F.col("_y")) & (F.col("_b") == F.col("_c")), "left")
    value_ = F.col("_s") + F.coalesce("_p", F.lit(0.0)) * F.pow(F.lit(keep), F.col("_k") + 1)
    return joined.withColumn(out, F.when(F.col("_i") >= (seed or 0), value_)).drop("_i", "_b", "_k", "_u", "_s", "_y", "_c", "_p")


def slope(value: str, unit: str, k: int) -> Column:
    """Change over k bars in units."""
    return F.try_divide(F.col(value) - F.lag(value, k).over(order()), F.col(unit))


def with_efficiency(bars: DataFrame, n: int, out: str = "efficiency") -> DataFrame:
    stepped = bars.withColumn("_step", F.abs(F.col("close") - F.lag("close").over(order())))
    net = F.abs(F.col("close") - F.lag("close", n).over(order()))
    return stepped.withColumn(out, F.try_divide(net, F.nullif(F.sum("_step").over(last(n)), F.lit(0.0)))).drop("_step")


def with_overlap(bars: DataFrame, pairs: int, out: str = "overlap") -> DataFrame:
    """Mean overlap of the last pairs of neighbouring ranges; null where a range is 0 or pairs are missing."""
    h, lo = F.lag("high").over(order()), F.lag("low").over(order())
    least = F.least(F.col("high") - F.col("low"), h - lo)
    share = F.try_divide(F.least("high", h) - F.greatest("low", lo), least)
    one = F.when((least > 0) & h.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))
    marked = bars.withColumn("_o", one)
    return marked.withColumn(out, F.when(F.count("_o").over(last(pairs)) == pairs, F.avg("_o").over(last(pairs)))).drop("_o")


def rank_among_last(value: str, n: int) -> Column:
    """Share of the n values before that are smaller, half for equal ones; null if fewer are there."""
    past = F.collect_list(value).over(order().rowsBetween(-n, -1))
    below = F.size(F.filter(past, lambda x: x < F.col(value))) + 0.5 * F.size(F.filter(past, lambda x: x == F.col(value)))
    return F.when(F.col(value).isNotNull() & (F.size(past) == n), below / n)


def median_of(values: Column) -> Column:
    """Median of an array, the mean of the two middle values; null for an empty one."""
    s = F.sort_array(values)
    n = F.size(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def rolling_median(value: str, n: int, before: bool = False) -> Column:
    """Median of the last n values (before: of the n before), null where they aren't all there."""
    frame = order().rowsBetween(-n, -1) if before else last(n)
    past = F.collect_list(value).over(frame)
    return F.when(F.size(past) == n, median_of(past))


def nearest_rank(value: str, p: float) -> Column:
    """The smallest value that a share p of all values doesn't exceed."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
