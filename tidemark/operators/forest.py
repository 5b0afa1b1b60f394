"""A forest of stumps by sums over bins.

Every tree draws rows with repeats and about the root of the number of columns, tries the quartiles of its drawn values as
cuts and keeps the cut with the least squared error; the forest predicts the mean of its trees. Rows draw a Poisson weight for each
tree from a hash of their keys, the distributed form of drawing with repeats, and columns are told in BINS bins of about equal load;
what is shuffled are sums by (tree, column, bin). A column with no more than BINS different values is cut exactly.

Rows with a null or non-finite value take no part in the fit. Repeated rows with equal keys draw together."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.partitions import known

TREES, BINS, QUARTILES = 80, 256, (0.25, 0.50, 0.75)

Stump = tuple[int, float, float, float]  # column, cut, mean up to it, mean beyond


def poisson(unit: Column) -> Column:
    """A draw of mean 1 from a uniform number."""
    out, below, p = F.lit(0), 0.0, math.exp(-1)
    for k in range(10):
        below += p
        out = out + F.when(unit > below, 1).otherwise(0)
        p /= k + 1
    return out


def drawn(keys: list[str], tree: Column, seed: int) -> Column:
    return poisson((F.pmod(F.xxhash64(F.lit(seed), tree, *keys), F.lit(1_000_003)) + 0.5) / 1_000_003)


def edges_of(rows: DataFrame, columns: list[str]) -> list[list[float]]:
    """Upper edges of each column's bins: all its values if they are few, else quantiles."""
    few = rows.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in columns]).first()
    out = []
    for c in columns:
        if few[c] <= BINS // 2:
            out.append(sorted(r[0] for r in rows.select(c).distinct().collect()))
        else:
            out.append(sorted(set(rows.approxQuantile(c, [k / BINS for k in range(1, BINS + 1)], 0.2 / BINS))))
    return out


def chosen(tree: int, columns: int, seed: int) -> list[int]:
    return sorted(np.random.default_rng([seed, tree]).choice(columns, max(1, math.isqrt(columns)), replace=False).tolist())


def best_cut(bins: list[tuple[int, float, float, float]], edges: list[float]) -> tuple[float, float, float, float] | None:
    """(loss, cut, left mean, right mean) of the quartiles of bins (number, weight, sum, sum of squares); None if none splits."""
    bins = sorted(bins)
    at, w, y, q = (np.array(v, float) for v in zip(*bins, strict=True))
    ahead = np.cumsum(w)
    best = None
    for share in QUARTILES:
        k = int(np.searchsorted(ahead, share * ahead[-1]))
        if k >= len(bins) - 1:
            continue
        left, right = slice(0, k + 1), slice(k + 1, None)
        means = [y[s].sum() / w[s].sum() for s in (left, right)]
        loss = float(q.sum() - sum(m * y[s].sum() for m, s in zip(means, (left, right), strict=True)))
        if best is None or loss < best[0]:
            best = (loss, edges[int(at[k])], *map(float, means))
    return best


def fit(rows: DataFrame, keys: list[str], columns: list[str], target: str, trees: int = TREES, seed: int = 1) -> list[Stump]:
    x = known(rows, [*columns, target]).select(*keys, *[F.col(c).cast("double").alias(c) for c in columns], F.col(target).cast("double").alias(target)).cache()
    try:
        edges = edges_of(x, columns)
        if not all(edges):
            return []
        picks = F.array(*[F.array(*[F.lit(c) for c in chosen(t, len(columns), seed)]) for t in range(trees)])
        each = binned(x, columns, edges).select(*keys, target, "_bins", F.posexplode(picks).alias("tree", "cols"))
        each = each.withColumn("w", drawn(keys, F.col("tree"), seed)).where("w > 0").select("tree", "w", target, "_bins", F.explode("cols").alias("col"))
        sums = each.groupBy("tree", "col", F.get("_bins", F.col("col")).alias("bin")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col(target)).alias("y"), F.sum(F.col("w") * F.col(target) * F.col(target)).alias("q"))
        # At most trees x columns of a tree x bins rows, whatever the number of rows.
        found: dict[tuple[int, int], list] = {}
        for r in sums.collect():
            found.setdefault((r.tree, r.col), []).append((r.bin, r.w, r.y, r.q))
    finally:
        x.unpersist()
    out = []
    for t in range(trees):
        cuts = [(*b, c) for (tree, c), bins in sorted(found.items()) if tree == t and (b := best_cut(bins, edges[c]))]
        if cuts:
            _, at, left, right, c = min(cuts)
            out.append((c, at, left, right))
        elif any(tree == t for tree, _ in found):
            bins = next(b for (tree, _), b in sorted(found.items()) if tree == t)
            mean = sum(b[2] for b in bins) / sum(b[1] for b in bins)
            out.append((0, 0.0, mean, mean))
    return out


def binned(rows: DataFrame, columns: list[str], edges: list[list[float]]) -> DataFrame:
    """rows with _bins: for each column the number of the first edge that its value doesn't exceed. (As an expression, so many edges are more than one generated method may hold.)"""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [np.minimum(np.searchsorted(edge, b.column(c).to_numpy(zero_copy_only=False)), len(edge) - 1) for c, edge in zip(columns, edges, strict=True)]
            bins = pa.ListArray.from_arrays(np.arange(0, (b.num_rows + 1) * len(columns), len(columns), dtype=np.int32), np.column_stack(at).astype(np.int32).ravel())
            yield pa.RecordBatch.from_arrays([*b.columns, bins], names=[*names, "_bins"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, _bins array<int>")


def predict(columns: list[str], forest: list[Stump]) -> Column:
    """The mean of the trees; null if the forest is empty or a value that a tree asks for is null."""
    if not forest:
        return F.lit(None).cast("double")
    parts = [F.when(F.col(columns[c]).isNull(), F.lit(None)).when(F.col(columns[c]) <= at, left).otherwise(right) for c, at, left, right in forest]
    return sum(parts[1:], parts[0]) / len(parts)
