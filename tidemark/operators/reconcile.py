"""Two tables against each other: by identity, tolerance and multiplicity."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def full_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full join in which null keys equal each other."""
    right = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.lit(True).alias("_right"), *[c for c in b.columns if c not in keys])
    met = a.withColumn("_left", F.lit(True)).join(right, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]), "full")
    own = [F.when(F.col("_left"), F.col(k)).otherwise(F.col(f"_r_{k}")).alias(k) for k in keys]
    return met.select(*own, *[c for c in [*a.columns, *b.columns] if c not in keys])


def by_identity(expected: DataFrame, actual: DataFrame, keys: list[str], numeric: list[str], text: list[str], tolerance: float = 1e-9) -> DataFrame:
    """keys with status (MATCH, MISSING, EXTRA, NONNUMERIC_DIFFERENCE, NUMERIC_DIFFERENCE) and the largest difference.

    Null keys are equal. A number against null is a numeric difference without a size; so is one that can't be compared."""
    a, b = expected.select(*keys, F.struct(*numeric, *text).alias("_a")), actual.select(*keys, F.struct(*numeric, *text).alias("_b"))
    both = full_join(a, b, keys)
    apart = {c: F.abs(F.col(f"_a.{c}") - F.col(f"_b.{c}")) for c in numeric}
    worst = F.greatest(*apart.values(), F.lit(0.0))
    far, differs = F.lit(False), F.lit(False)
    for c in numeric:
        far = far | ~(F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) | F.coalesce(apart[c] <= tolerance, F.lit(False)))
    for c in text:
        differs = differs | ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))
    status = F.when(F.col("_b").isNull(), "MISSING").when(F.col("_a").isNull(), "EXTRA").when(differs, "NONNUMERIC_DIFFERENCE").when(far, "NUMERIC_DIFFERENCE").otherwise("MATCH")
    return both.select(*keys, status.alias("status"), F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), worst).alias("difference"))


def by_multiplicity(expected: DataFrame, actual: DataFrame, columns: list[str]) -> DataFrame:
    """columns with matched, missing and extra counts of equal rows; duplicates count."""
    a, b = expected.groupBy(*columns).agg(F.count("*").alias("_a")), actual.groupBy(*columns).agg(F.count("*").alias("_b"))
    both = full_join(a, b, columns).na.fill(0, ["_a", "_b"])
    return both.select(*columns, F.least("_a", "_b").alias("matched"), F.greatest(F.lit(0), F.col("_a") - F.col("_b")).alias("missing"), F.greatest(F.lit(0), F.col("_b") - F.col("_a")).alias("extra"))


def by_position(expected: DataFrame, actual: DataFrame, keys: list[str], number: str, payload: str) -> DataFrame:
    """Rows of equal keys paired by their order of (number, payload): keys, r, both numbers, difference."""
    rank = lambda x, n: x.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy(number, payload)).alias("r"), F.col(number).alias(n))
    both = full_join(rank(expected, "expected"), rank(actual, "actual"), [*keys, "r"])
    return both.withColumn("difference", F.abs(F.col("expected") - F.col("actual")))
