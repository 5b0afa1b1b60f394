"""Statistics over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def average_rank(rows: DataFrame, value: str, by: str, out: str) -> DataFrame:
    """Ranks from 1, equal values share the mean of theirs."""
    w = Window.partitionBy(by)
    return rows.withColumn(out, F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(by, value)) - 1) / 2)


def spearman(rows: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """(by, n, rho) over rows where both are known."""
    known = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return average_rank(average_rank(known, a, by, "_a"), b, by, "_b").groupBy(by).agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("rho"))


def roc_auc(rows: DataFrame, score: str, label: str, by: str) -> DataFrame:
    """(by, positives, negatives, auc) from average ranks; label is 0 or 1."""
    ranked = average_rank(rows.where(F.col(score).isNotNull()), score, by, "_r")
    sums = ranked.groupBy(by).agg(F.sum(label).alias("positives"), F.sum(1 - F.col(label)).alias("negatives"), F.sum(F.col("_r") * F.col(label)).alias("_s"))
    p, n = F.col("positives"), F.col("negatives")
    return sums.select(by, "positives", "negatives", F.try_divide(F.col("_s") - p * (p + 1) / 2, F.nullif(p * n, F.lit(0))).alias("auc"))


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(a, b).agg(F.count("*").alias("n"))


def cohen_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, kappa) of two labellings."""
    c = contingency(rows, a, b).withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(1))))
    left, right = c.groupBy(F.col(a).alias("v")).agg(F.sum("n").alias("x")), c.groupBy(F.col(b).alias("v")).agg(F.sum("n").alias("y"))
    chance = left.join(right, "v").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("e"))
    seen = c.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col(a) == F.col(b), F.col("n"))), F.lit(0)).alias("o"))
    o, e = F.col("o") / F.col("n"), F.col("e") / (F.col("n") * F.col("n"))
    return seen.crossJoin(chance).select("n", F.try_divide(o - e, F.nullif(1 - e, F.lit(0.0))).alias("kappa"))


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, ari) of two partitions."""
    c = contingency(rows, a, b)
    pairs = lambda x: F.coalesce(F.sum(F.col(x) * (F.col(x) - 1) / 2), F.lit(0.0))
    cells = c.agg(F.sum("n").alias("n"), pairs("n").alias("i"))
    left, right = (c.groupBy(k).agg(F.sum("n").alias("m")).agg(pairs("m").alias(n)) for k, n in ((a, "x"), (b, "y")))
    x = cells.crossJoin(left).crossJoin(right).withColumn("e", F.col("x") * F.col("y") / F.nullif(F.col("n") * (F.col("n") - 1) / 2, F.lit(0.0)))
    return x.select("n", F.try_divide(F.col("i") - F.col("e"), F.nullif((F.col("x") + F.col("y")) / 2 - F.col("e"), F.lit(0.0))).alias("ari"))


def ks_distance(rows: DataFrame, value: str, group: str, by: str) -> DataFrame:
    """(by, ks): the largest difference of two groups' distributions; group is 0 or 1."""
    w = Window.partitionBy(by).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    share = lambda g: F.sum(F.when(F.col(group) == g, 1).otherwise(0)).over(w) / F.nullif(F.sum(F.when(F.col(group) == g, 1).otherwise(0)).over(Window.partitionBy(by)), F.lit(0))
    return rows.withColumn("_d", F.abs(share(0) - share(1))).groupBy(by).agg(F.max("_d").alias("ks"))


def bootstrap_mean(rows: DataFrame, value: str, by: str, replicates: int = 200, seed: int = 7) -> DataFrame:
    """(by, low, high): the 5 and 95 percent points of resampled means. Each row draws its Poisson weight
    for each replicate from its content, so no group is gathered and only (by, replicate) sums are shuffled;
    rows need a column that tells repeated ones apart, or these draw together."""
    unit = (F.pmod(F.xxhash64(F.lit(seed), F.col(by), F.col("_id"), F.col("replicate")), F.lit(1_000_003)) + 0.5) / 1_000_003
    weight, cdf, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(8):
        cdf += p
        weight = weight + F.when(unit > cdf, 1).otherwise(0)
        p /= k + 1
    drawn = rows.withColumn("_id", F.xxhash64(*rows.columns)).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_w", weight)
    means = drawn.groupBy(by, "replicate").agg(F.try_divide(F.sum(F.col("_w") * F.col(value)), F.nullif(F.sum("_w"), F.lit(0))).alias("m"))
    return means.groupBy(by).agg(F.percentile("m", 0.05).alias("low"), F.percentile("m", 0.95).alias("high"))
