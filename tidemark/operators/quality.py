"""Contracts and gaps of gridded series (symbol, t) with a step in seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def invalid_bar() -> Column:
    """A bar that breaks its own order: non-finite prices, low above open or close, high below, negative volume."""
    finite = F.lit(True)
    for c in ("open", "high", "low", "close"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    ordered = (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close")) & (F.col("volume") >= 0)
    return ~F.coalesce(finite & ordered, F.lit(False))


def contract(bars: DataFrame, step: int) -> DataFrame:
    """bars with problem: the first rule that a row breaks, or null."""
    before = F.lag("t").over(Window.partitionBy("symbol").orderBy("t"))
    return bars.withColumn("problem", F.when(F.col("symbol").isNull() | F.col("t").isNull(), "MISSING_KEY").when(invalid_bar(), "INVALID_BAR").when(F.pmod("t", F.lit(step)) != 0, "OFF_GRID").when(F.col("t") <= before, "NOT_INCREASING").when(F.col("t") - before > step, "GAP"))


def missing_slots(bars: DataFrame, step: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """(symbol, t): grid slots from start to end (exclusive; by default each symbol's own range) without a row."""
    span = bars.groupBy("symbol").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    a, b = F.lit(start) if start is not None else F.col("a"), F.lit(end - step) if end is not None else F.col("b")
    grid = span.select("symbol", F.explode(F.sequence(a.cast("long"), b.cast("long"), F.lit(step).cast("long"))).alias("t"))
    return grid.join(bars.select("symbol", "t"), ["symbol", "t"], "left_anti")


def gap_episodes(missing: DataFrame, step: int) -> DataFrame:
    """(symbol, start, end, slots): runs of neighbouring missing slots."""
    island = F.col("t") - F.row_number().over(Window.partitionBy("symbol").orderBy("t")) * step
    return missing.withColumn("island", island).groupBy("symbol", "island").agg(F.min("t").alias("start"), (F.max("t") + step).alias("end"), F.count("*").alias("slots")).drop("island")


def interval_mode(rows: DataFrame) -> DataFrame:
    """(symbol, step): the commonest positive difference of neighbouring times, the smallest of equal ones."""
    step = F.col("t") - F.lag("t").over(Window.partitionBy("symbol").orderBy("t"))
    counts = rows.select("symbol", step.alias("step")).where("step > 0").groupBy("symbol", "step").count()
    return counts.groupBy("symbol").agg(F.max_by("step", F.struct("count", (-F.col("step")).alias("s"))).alias("step"))


def duplicate_classes(rows: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """keys with n rows and whether these are UNIQUE, IDENTICAL or CONFLICTING."""
    n, kinds = F.count("*"), F.countDistinct(F.struct(*payload))
    return rows.groupBy(*keys).agg(n.alias("n"), F.when(n == 1, "UNIQUE").when(kinds == 1, "IDENTICAL").otherwise("CONFLICTING").alias("kind"))


def assert_before(rows: DataFrame, cutoff: int) -> DataFrame:
    """rows, which fail when read if any lies at or after cutoff."""
    return rows.where(F.when(F.col("t") < cutoff, True).otherwise(F.raise_error(F.lit("hold-out rows"))).cast("boolean"))


def require_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once: none if the keys are an identity."""
    return rows.groupBy(*keys).count().where("count > 1")


def invariance(rows: DataFrame, base: list[str], label: str, payload: str, n: int) -> DataFrame:
    """Base ids that haven't n rows, n labels and one payload."""
    got = rows.groupBy(*base).agg(F.count("*").alias("n_rows"), F.countDistinct(label).alias("n_labels"), F.countDistinct(payload).alias("n_payloads"))
    return got.where((F.col("n_rows") != n) | (F.col("n_labels") != n) | (F.col("n_payloads") != 1))
