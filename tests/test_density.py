"""Density clusters and neighbour distances against brute force."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import density as D


def clouds(seed, d=2):
    rng = random.Random(seed)
    out = []
    for _ in range(6):
        centre, spread = [rng.uniform(-3, 3) for _ in range(d)], rng.choice([0.02, 0.1, 0.4])
        out += [[c + rng.gauss(0, spread) for c in centre] for _ in range(rng.randrange(2, 60))]
    out += [[rng.uniform(-6, 6) for _ in range(d)] for _ in range(25)]
    out += [out[0]] * 40  # one point that is many rows
    out += [[k * 0.05, 5.0] + [0.0] * (d - 2) for k in range(80)]  # a chain
    rng.shuffle(out)
    return out


def brute(points, eps, least):
    x = np.array(points)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core = near.sum(1) >= least
    label = [None] * len(x)
    for i in range(len(x)):
        if core[i] and label[i] is None:
            todo, label[i] = [i], i
            while todo:
                for j in np.nonzero(near[todo.pop()] & core)[0]:
                    if label[j] is None:
                        label[j] = i
                        todo.append(j)
    for i in range(len(x)):
        if not core[i]:
            label[i] = min((label[j] for j in np.nonzero(near[i] & core)[0]), default=None)
    return label, core.tolist()


@pytest.mark.parametrize(("seed", "d"), [(1, 2), (2, 3)])
def test_clusters_against_brute_force(spark, seed, d):
    points = clouds(seed, d)
    names = [f"x{k}" for k in range(d)]
    rows = [(i, *p) for i, p in enumerate(points)]
    frame = spark.createDataFrame([*rows, (-1, *([None] * d)), (-2, *([float("nan")] * d))], f"id long, {', '.join(f'{n} double' for n in names)}")
    for eps in (0.08, 0.5):
        got = {r.id: (r.cluster and r.cluster.id, r.core) for r in D.dbscan(frame, ["id"], names, eps).collect()}
        label, core = brute(points, eps, 4)
        assert got.pop(-1) == got.pop(-2) == (None, False)
        assert got == {i: (label[i], core[i]) for i in range(len(points))}
        assert len({x for x in label if x is not None}) > 2
    assert D.dbscan(frame.limit(0), ["id"], names, 1.0).count() == 0


def test_distance_of_the_fourth_neighbour(spark):
    points = clouds(3)
    x = np.array(points)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    fourth = np.sort(far + np.eye(len(x)) * 1e9, axis=1)[:, 3]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, a double, b double")
    for share in (0.1, 0.45):
        assert math.isclose(D.neighbour_distance(D.points_of(frame, ["id"], ["a", "b"]), 4, share), np.quantile(fourth, share), rel_tol=1e-12, abs_tol=1e-12)
    assert D.neighbour_distance(D.points_of(frame.limit(3), ["id"], ["a", "b"])) is None


def test_rank_in_bins(spark, monkeypatch):
    monkeypatch.setattr(D, "BINS", 4)
    rng = random.Random(2)
    values = [(round(rng.expovariate(1), 2), rng.randrange(1, 4)) for _ in range(300)]
    folded = {}
    for r, w in values:
        folded[r] = folded.get(r, 0) + w
    flat = sorted(r for r, w in folded.items() for _ in range(w))
    frame = spark.createDataFrame(list(folded.items()), "r double, w long")
    for at in (0.0, 17.25, len(flat) - 1.0):
        assert math.isclose(D.quantile_of_counts(frame, at), np.interp(at, range(len(flat)), flat))


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 20)] + [(500, 500)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in D.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 120), 100), 500: 500}
