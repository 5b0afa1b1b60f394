"""Linear fits of any number of columns from one pass: the sums of products of all columns (the Gram matrix) by group.

Every fit then works on a matrix of (columns + 2) ** 2 numbers for each group: least squares, ridge and lasso by coordinate
descent, principal axes. Huber's fit weighs rows anew in each of its passes, with the exact median of the residuals as scale.
Rows with a null or non-finite value are left out; a group without rows has no fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut
from tidemark.operators.partitions import known

# Fixed values of the surveyed fits.
LASSO, SWEEPS, DELTA, PASSES, START_RIDGE, RIDGE = 0.03, 200, 1.35, 20, 0.1, 0.01
NORMAL = 0.6745


def gram(rows: DataFrame, by: str, columns: list[str], target: str, weight: Column | None = None) -> DataFrame:
    """(by, n, g): g holds the sums of products of (1, *columns, target), upper triangle row by row."""
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in [*columns, target]]]
    w = F.lit(1.0) if weight is None else weight
    cells = [F.sum(w * z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z))]
    return known(rows, [*columns, target]).groupBy(by).agg(F.count("*").alias("n"), F.array(*cells).alias("g"))


def full(g: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = g
    return out + np.triu(out, 1).T


Fit = Callable[[np.ndarray, np.ndarray, int], np.ndarray]  # products, products with the target, rows


def ridge(penalty: float, intercept: bool = False) -> Fit:
    """Least squares with a penalty, on the intercept as well if asked."""

    def fit(xx: np.ndarray, xy: np.ndarray, n: int) -> np.ndarray:
        held = np.eye(len(xx)) * penalty
        held[0, 0] = penalty if intercept else 0.0
        return np.linalg.pinv(xx + held) @ xy

    return fit


def lasso(alpha: float = LASSO, sweeps: int = SWEEPS) -> Fit:
    """Coordinate descent on the Gram matrix, the intercept free: a coordinate's gradient needs its row alone."""

    def fit(xx: np.ndarray, xy: np.ndarray, n: int) -> np.ndarray:
        beta = np.zeros(len(xx))
        beta[0] = xy[0] / n
        scale = np.diag(xx) / n
        for _ in range(sweeps):
            for j in range(len(beta)):
                pull = (xy[j] - xx[j] @ beta) / n + scale[j] * beta[j]
                shrunk = pull if j == 0 else np.sign(pull) * max(abs(pull) - alpha, 0.0)
                beta[j] = shrunk / (scale[j] or 1.0)
        return beta

    return fit


def fitted(sums: DataFrame, by: str, columns: list[str], fits: dict[str, Fit]) -> DataFrame:
    """(by, model, weights) of gram() rows, weights from the intercept on."""
    size = len(columns) + 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, n, g in zip(b[by], b["n"], b["g"], strict=True):
                m = full(np.asarray(g), size)
                out += [(key, name, f(m[:-1, :-1], m[:-1, -1], int(n)).tolist()) for name, f in fits.items()]
            yield pd.DataFrame(out, columns=[by, "model", "weights"])

    return sums.mapInPandas(run, f"`{by}` {sums.schema[by].dataType.simpleString()}, model string, weights array<double>")


def predicted(columns: list[str], weights: str = "weights") -> Column:
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    return sum((F.get(weights, F.lit(k)) * c for k, c in enumerate(z)), F.lit(0.0))


def medians(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median), exact: rows are ranked by a sort that spills, none are gathered."""
    sizes = rows.groupBy(by).agg(F.count(value).alias("m"))
    ranked = rows.select(by, value).withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(value)))
    middle = ranked.join(sizes, by).where((F.col("_r") >= F.floor((F.col("m") + 1) / 2)) & (F.col("_r") <= F.ceil((F.col("m") + 1) / 2)))
    return middle.groupBy(by).agg(F.avg(value).alias("median"))


def huber(rows: DataFrame, by: str, columns: list[str], target: str, delta: float = DELTA, passes: int = PASSES) -> DataFrame:
    """(by, model, weights): rows count less the further they lie from the fit before, in units of the median residual."""
    x = cut(known(rows, [*columns, target]).select(by, *columns, target))
    now = cut(fitted(gram(x, by, columns, target), by, columns, {"huber": ridge(START_RIDGE)}))
    for _ in range(passes):
        off = x.join(now.select(by, "weights"), by).withColumn("_off", F.abs(F.col(target) - predicted(columns)))
        unit = medians(off, by, "_off").select(by, (F.col("median") / NORMAL).alias("_unit"))
        unit = unit.withColumn("_unit", F.when(F.col("_unit") == 0, F.lit(1.0)).otherwise(F.col("_unit")))
        weight = F.least(F.lit(1.0), delta * F.col("_unit") / F.greatest("_off", F.lit(1e-12)))
        now = cut(fitted(gram(off.join(unit, by), by, columns, target, weight), by, columns, {"huber": ridge(RIDGE, intercept=True)}))
    return now


def axes(sums: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, axis, share, weights): principal axes of the columns of gram() rows, by the share of variance; the largest weight of an axis is positive."""
    size = len(columns) + 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, n, g in zip(b[by], b["n"], b["g"], strict=True):
                m = full(np.asarray(g), size)[:-1, :-1]
                mean = m[0, 1:] / n
                values, vectors = np.linalg.eigh(m[1:, 1:] / n - np.outer(mean, mean))
                total = max(values.clip(0).sum(), 1e-300)
                for axis, j in enumerate(np.argsort(-values, kind="stable")):
                    v = vectors[:, j] * np.sign(vectors[np.abs(vectors[:, j]).argmax(), j])
                    out.append((key, axis + 1, float(max(values[j], 0.0) / total), v.tolist()))
            yield pd.DataFrame(out, columns=[by, "axis", "share", "weights"])

    return sums.mapInPandas(run, f"`{by}` {sums.schema[by].dataType.simpleString()}, axis int, share double, weights array<double>")
