"""Literal cases of the cool-down and backbone machines, and the learners against their own definitions."""

import math
from collections import defaultdict

from tidemark.operators import machines as M
from tidemark.plans import stats

SF = "/root/testdata/sf0.001"


def played(machine, rows):
    return [x for r in rows for x in machine.step(r)] + machine.close()


def test_cool_down_by_any_and_own_direction():
    rows = [{"t": 10 * i, "i": i, "direction": d} for i, d in ((0, "LONG"), (5, "SHORT"), (6, "SHORT"), (11, "LONG"), (12, "LONG"), (17, "SHORT"), (18, "SHORT"))]
    # 5: six rows are not over; 11: five after the last; 12: twelve after the first LONG; 17: five after; 18: both are over.
    assert [(i, d) for _, i, d in played(M.CoolDown(), rows)] == [(0, "LONG"), (6, "SHORT"), (12, "LONG"), (18, "SHORT")]


def test_backbone_takes_two_rows_and_three_from_lost_to_active():
    base = ["WARMUP", "ACTIVE", "ACTIVE", "LOST", "LOST", "ACTIVE", "ACTIVE", "ACTIVE", "TRANSITION", "FLATTENING", "ACTIVE", "ACTIVE"]
    rows = [{"t": k, "base": b, "slope": 0.0} for k, b in enumerate(base)]
    want = ["WARMUP", "WARMUP", "ACTIVE", "ACTIVE", "LOST", "LOST", "LOST", "ACTIVE", "TRANSITION", "TRANSITION", "TRANSITION", "ACTIVE"]
    assert [s for _, _, s in played(M.Backbone(), rows)] == want


def test_backbone_is_lost_at_once_when_steep():
    rows = [{"t": 0, "base": "ACTIVE", "slope": 2.0}, {"t": 1, "base": "ACTIVE", "slope": 2.0}, {"t": 2, "base": "LOST", "slope": -1.6}]
    assert [s for _, _, s in played(M.Backbone(), rows)] == ["WARMUP", "ACTIVE", "LOST"]


def test_clusters_are_nearest_their_means(spark):
    names = ["displacement8", "efficiency8", "range8"]
    found = {(r.symbol, r.t): r.cluster for r in stats.kmeans_states(spark, SF).collect()}
    rows = stats.observed(spark, SF).na.drop(subset=names).select("symbol", "t", *names).collect()
    assert set(found) == {(r.symbol, r.t) for r in rows}
    spread = []
    for n in names:
        values = [r[n] for r in rows]
        mean = sum(values) / len(values)
        spread.append((mean, math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1))))
    points = {(r.symbol, r.t): [(r[n] - m) / s for n, (m, s) in zip(names, spread, strict=True)] for r in rows}
    groups = defaultdict(list)
    for k, p in points.items():
        groups[found[k]].append(p)
    centres = {c: [sum(x) / len(g) for x in zip(*g, strict=True)] for c, g in groups.items()}
    assert len(centres) == 3
    near = [min(centres, key=lambda c: math.dist(centres[c], points[k])) == found[k] for k in points]
    assert sum(near) >= 0.97 * len(near)


def test_scores_out_of_fold_match_gradient_zero(spark):
    """At the penalised optimum of the two other thirds each score is the sigmoid of one linear form for a third."""
    import numpy as np

    from tidemark.plans.study import with_third
    from tidemark.sources.bars import bars

    names = ["displacement8", "efficiency8", "range32"]
    found = {(r.symbol, r.t): r.p for r in stats.logistic_out_of_fold(spark, SF).collect()}
    rows = with_third(stats.labelled(spark, SF), bars(spark, SF)).na.drop(subset=names).select("symbol", "t", "third", "up", *names).collect()
    assert set(found) == {(r.symbol, r.t) for r in rows}
    x, y, third = np.array([[r[n] for n in names] for r in rows]), np.array([r.up for r in rows], float), np.array([r.third for r in rows])
    for k in range(3):
        fit = third != k
        mean, deviation = x[fit].mean(0), x[fit].std(0, ddof=1)
        z = np.c_[(x - mean) / deviation, np.ones(len(x))]
        w, penalty = np.zeros(4), np.array([0.1, 0.1, 0.1, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-z[fit] @ w))
            gradient = z[fit].T @ (p - y[fit]) / fit.sum() + penalty * w
            w -= np.linalg.solve((z[fit].T * (p * (1 - p))) @ z[fit] / fit.sum() + np.diag(penalty), gradient)
        want = 1 / (1 + np.exp(-z[~fit] @ w))
        got = np.array([found[(r.symbol, r.t)] for r, here in zip(rows, ~fit, strict=True) if here])
        assert np.abs(got - want).max() < 1e-3


def test_bootstrap_interval_holds_the_mean(spark):
    means = {r.symbol: r.m for r in stats.labelled(spark, SF).groupBy("symbol").avg("x").withColumnRenamed("avg(x)", "m").collect()}
    found = stats.bootstrap_interval(spark, SF).collect()
    assert sorted(r.symbol for r in found) == sorted(means)
    assert all(r.low <= means[r.symbol] <= r.high and r.low < r.high for r in found)
