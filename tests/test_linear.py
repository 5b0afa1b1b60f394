"""Linear fits, axes and stumps against numpy."""

import math

import numpy as np

from tidemark.operators import forest as W
from tidemark.operators import linear as L

NAMES = ["a", "b", "c", "d"]


def data(seed=1, n=200):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 2, 0.5, 1] + [0, 1, 0, 3]
    y = x @ [0.5, -1, 0.02, 0] + 2 + rng.standard_t(2, n)
    return x, y


def frame_of(spark, groups):
    rows = [(g, i, *map(float, r), float(v), "x") for g, (x, y) in groups.items() for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame([*rows, ("g0", -1, None, 0.0, 0.0, 0.0, 1.0, "x"), ("none", -1, 1.0, 1.0, 1.0, math.nan, 1.0, "x")], "grp string, id long, a double, b double, c double, d double, y double, g string")


def test_fits_against_numpy(spark):
    groups = {f"g{k}": data(k) for k in range(2)}
    frame = frame_of(spark, groups)
    sums = L.gram(frame, "grp", NAMES, "y")
    found = {(r.grp, r.model): np.array(r.weights) for r in L.fitted(sums, "grp", NAMES, {"ols": L.ridge(0.0), "ridge": L.ridge(1.0), "lasso": L.lasso()}).collect()}
    found |= {(r.grp, r.model): np.array(r.weights) for r in L.huber(frame, "grp", NAMES, "y", passes=6).collect()}
    assert {g for g, _ in found} == {"g0", "g1"}
    for g, (x, y) in groups.items():
        z = np.c_[np.ones(len(x)), x]
        assert np.allclose(found[g, "ols"], np.linalg.lstsq(z, y, rcond=None)[0], atol=1e-8)
        assert np.allclose(found[g, "ridge"], np.linalg.solve(z.T @ z + np.diag([0, 1, 1, 1, 1]), z.T @ y), atol=1e-8)
        b = found[g, "lasso"]
        pull = z.T @ (y - z @ b) / len(x)  # at the optimum: 0 for the intercept, alpha times the sign, or within alpha where the weight is 0
        assert abs(pull[0]) < 1e-6 and all(abs(p - 0.03 * np.sign(w)) < 1e-6 if w else abs(p) <= 0.03 + 1e-6 for p, w in zip(pull[1:], b[1:]))
        h = np.linalg.solve(z.T @ z + np.diag([0, 0.1, 0.1, 0.1, 0.1]), z.T @ y)
        for _ in range(6):
            off = np.abs(y - z @ h)
            w = np.minimum(1, 1.35 * (np.median(off) / 0.6745) / np.maximum(off, 1e-12))
            h = np.linalg.solve((z * w[:, None]).T @ z + 0.01 * np.eye(5), (z * w[:, None]).T @ y)
        assert np.allclose(found[g, "huber"], h, atol=1e-6)
    (row,) = L.axes(sums.where("grp = 'g0'"), "grp", NAMES).where("axis = 1").collect()
    values, vectors = np.linalg.eigh(np.cov(groups["g0"][0].T, bias=True))
    v = vectors[:, -1] * np.sign(vectors[np.abs(vectors[:, -1]).argmax(), -1])
    assert np.allclose(row.weights, v, atol=1e-6) and math.isclose(row.share, values[-1] / values.sum(), rel_tol=1e-9)


def test_stumps_against_rows(spark):
    """With few different values the bins are exact: every tree's cut is the best of its quartiles over its drawn rows."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (150, 4)).astype(float)
    y = np.where(x[:, 1] > 6, 3.0, 0.0) + x[:, 2] * 0.1 + rng.normal(size=150) * 0.2
    frame = frame_of(spark, {"g0": (x, y)})
    forest = W.fit(frame, ["grp", "id"], NAMES, "y", trees=12)
    assert len(forest) == 12
    from pyspark.sql import functions as F

    ids = frame.where("id >= 0 AND grp = 'g0'")
    weights = {r.id: r.w for r in ids.select("id", F.array(*[W.drawn(["grp", "id"], F.lit(t), 1) for t in range(12)]).alias("w")).collect()}
    w = np.array([weights[i] for i in range(150)])
    assert 0.8 < w.mean() < 1.2 and w.max() >= 3
    for t, (c, at, left, right) in enumerate(forest):
        best = None
        for f in W.chosen(t, 4, 1):
            order = np.repeat(np.sort(x[:, f]), w[np.argsort(x[:, f], kind="stable"), t])
            for q in (0.25, 0.5, 0.75):
                cut = order[math.ceil(q * len(order)) - 1]
                low = x[:, f] <= cut
                if w[low, t].sum() and w[~low, t].sum():
                    means = [np.average(y[m], weights=w[m, t]) for m in (low, ~low)]
                    loss = (w[:, t] * (y - np.where(low, *means)) ** 2).sum()
                    if best is None or loss < best[0] - 1e-9:
                        best = (loss, f, cut, *means)
        assert (c, at) == best[1:3] and np.allclose((left, right), best[3:])
    got = {r.id: r.p for r in ids.select("id", W.predict(NAMES, forest).alias("p")).collect()}
    want = np.mean([np.where(x[:, c] <= at, left, right) for c, at, left, right in forest], axis=0)
    assert np.allclose([got[i] for i in range(150)], want)
    assert W.fit(frame.limit(0), ["grp", "id"], NAMES, "y", trees=3) == []
