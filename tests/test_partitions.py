"""k-means grids, agreement, silhouettes, linkage and co-clustering against plain versions."""

import math
from itertools import combinations

import numpy as np

from tidemark.operators import partitions as P


def points(seed, n=120, d=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, d)) * 4
    return centres[rng.integers(0, 4, n)] + rng.normal(size=(n, d))


def frame_of(spark, x):
    return spark.createDataFrame([(i, *map(float, r), "extra") for i, r in enumerate(x)] + [(-1, None, 0.0, 0.0, "extra"), (-2, math.nan, 0.0, 0.0, "extra")], "id long, a double, b double, c double, labels_ string").repartition(5)


def lloyd(x, c):
    for _ in range(100):
        label = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        moved = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(len(c))])
        if np.allclose(moved, c, rtol=0, atol=1e-12):
            return moved
        c = moved
    return c


def ari(a, b):
    n = len(a)
    pairs = lambda v: sum(m * (m - 1) / 2 for m in np.unique(v, return_counts=True)[1])
    same = sum(a[i] == a[j] and b[i] == b[j] for i, j in combinations(range(n), 2))
    chance = pairs(a) * pairs(b) / (n * (n - 1) / 2)
    most = (pairs(a) + pairs(b)) / 2
    return 1.0 if most == chance else (same - chance) / (most - chance)


def test_kmeans_grid_and_agreement(spark):
    x = points(1)
    frame = frame_of(spark, x)
    centres = P.kmeans_grid(frame, ["id"], ["a", "b", "c"], (2, 4), (1, 2, 3))
    assert set(centres) == {(k, s) for k in (2, 4) for s in (1, 2, 3)}
    for (k, seed), c in centres.items():
        first = P.matrix_of(P.sample(frame, ["id"], ["a", "b", "c"], 4, seed), ["a", "b", "c"])[:k]
        want = lloyd(x, first)
        assert np.allclose(c, want[np.argsort(want[:, 0])], atol=1e-9) and (np.diff(c[:, 0]) >= 0).all()
    found = P.labelled(frame, ["a", "b", "c"], centres)
    rows = {r.id: r.labels for r in found.collect()}
    assert set(rows) == set(range(len(x))) and "labels_" in found.columns
    labels = np.array([rows[i] for i in range(len(x))])
    for j, c in enumerate(centres.values()):
        assert (labels[:, j] == ((x[:, None] - c[None]) ** 2).sum(2).argmin(1) + 1).all()
    runs = list(centres)
    for r in P.agreement(found, runs).collect():
        assert math.isclose(r.ari, ari(labels[:, runs.index((r.k, r.a_seed))], labels[:, runs.index((r.k, r.b_seed))]), abs_tol=1e-12)
    assert P.kmeans_grid(frame.limit(0), ["id"], ["a", "b", "c"], (2,), (1,)) == {}


def test_silhouettes_by_definition():
    x = points(2, 330)
    labels = np.random.default_rng(1).integers(0, 3, 330)
    labels[0] = 9  # alone in its cluster
    got = P.silhouettes(x, labels)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(330):
        same = [j for j in range(330) if labels[j] == labels[i] and j != i]
        a = np.mean(far[i, same]) if same else 0.0
        b = min(far[i, labels == u].mean() for u in set(labels) if u != labels[i])
        assert math.isclose(got[i], (b - a) / max(a, b), abs_tol=1e-12)
    assert (P.silhouettes(x, np.zeros(330)) == 0).all()


def plain_linkage(x, k=1):
    clusters, heights = [[i] for i in range(len(x))], []
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    while len(clusters) > k:
        d, a, b = min((far[np.ix_(p, q)].mean(), i, j) for (i, p), (j, q) in combinations(enumerate(clusters), 2))
        clusters[a] = clusters[a] + clusters.pop(b)
        heights.append(d)
    return heights, {frozenset(c) for c in clusters}


def test_heights_of_average_linkage():
    for seed in range(4):
        x = points(seed, 45)
        steps = P.merges(x)
        assert np.allclose([s[0] for s in steps], plain_linkage(x)[0])
        assert steps[-1][3] == 45
        for k in (1, 2, 5, 45):
            labels = P.cut_tree(steps, 45, k)
            assert {frozenset(np.nonzero(labels == j)[0].tolist()) for j in set(labels.tolist())} == plain_linkage(x, k)[1]
            assert labels[0] == 1 and len(set(labels.tolist())) == k
    assert P.merges(np.zeros((1, 2))) == [] and P.cut_tree([], 1, 3).tolist() == [1]


def test_linkage_assigns_every_row(spark):
    x = points(5, 90)
    frame = frame_of(spark, x)
    got = {r.id: r.cluster for r in P.linkage(frame, ["id"], ["a", "b", "c"], 4, most=40).collect()}
    some = P.sample(frame, ["id"], ["a", "b", "c"], 40)
    y = P.matrix_of(some, ["a", "b", "c"])
    labels = P.cut_tree(P.merges(y), 40, 4)
    for r, c in zip(some, labels, strict=True):
        assert got[r.id] == c
    for i in set(range(90)) - {r.id for r in some}:
        means = [np.sqrt(((x[i] - y[labels == j]) ** 2).sum(1)).mean() for j in range(1, 5)]
        assert got[i] == int(np.argmin(means)) + 1
    assert P.linkage(frame.limit(0), ["id"], ["a", "b", "c"], 4).count() == 0


def test_co_clustering_counts(spark):
    x = points(6, 30)
    frame = frame_of(spark, x)
    pairs, agree = P.co_clustered(frame, ["id"], ["a", "b", "c"], 3, replicates=25, most=30)
    y = P.matrix_of(P.sample(frame, ["id"], ["a", "b", "c"], 30), ["a", "b", "c"])
    whole = P.cut_tree(P.merges(y), 30, 3)
    drawn, together, aris = np.zeros((30, 30)), np.zeros((30, 30)), {}
    for r in range(25):
        some = np.sort(np.random.default_rng([7, r]).choice(30, 24, replace=False))
        labels = P.cut_tree(P.merges(y[some]), 24, 3)
        drawn[np.ix_(some, some)] += 1
        together[np.ix_(some, some)] += labels[:, None] == labels[None]
        aris[r] = ari(whole[some], labels)
    got = {(r.a, r.b): (r.drawn, r.together) for r in pairs.collect()}
    assert got == {(a, b): (drawn[a, b], together[a, b]) for a, b in combinations(range(30), 2) if drawn[a, b]}
    assert all(math.isclose(r.ari, aris[r.replicate], abs_tol=1e-12) for r in agree.collect())
