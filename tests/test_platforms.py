"""Platforms and their null models against plain versions and by hand."""

import math
import random

from tidemark.operators import platforms as P
from tidemark.operators.programs import Program


def stretches(points, band=1.5):
    kernel = Program(P.stretches(band), ["first", "last"])
    return [x for i, (p, v) in enumerate(points) for x in kernel.step({"i": i, "p": p, "v": v})] + kernel.close()


def plain(points, band=1.5):
    out, i = [], 0
    while i < len(points):
        p, v = points[i]
        if not v:
            i += 1
            continue
        off = [abs(x - p) for x, _ in points]
        clear = [o > (band + 0.5) * v for o in off]
        stop = next((j for j in range(i + 2, len(points)) if clear[j] and clear[j - 1]), len(points))
        last = max(j for j in range(i, stop) if off[j] <= band * v)
        out.append((i, last))
        i = last + 1
    return out


def test_by_hand_with_a_step_back():
    # Band 1.5 around 0, clear beyond 2. One close at 3 is no end; 3, 3 is, and the next stretch begins at the first 3's bar, which was read before.
    points = [(0.0, None), (0.0, 1.0), (1.0, 1.0), (3.0, 1.0), (1.4, 1.0), (1.8, 1.0), (3.0, 1.0), (3.1, 1.0), (3.2, 1.0)]
    assert stretches(points) == [(1, 4), (5, 8)]
    # 1.8 lies in the buffer: it counts neither as inside nor towards the end. From 1.8 the band reaches 3.3.
    assert plain(points) == [(1, 4), (5, 8)]
    assert stretches([]) == [] and stretches([(0.0, None)] * 3) == [] and stretches([(0.0, 0.0), (0.0, 2.0)]) == [(1, 1)]


def test_against_the_plain_version():
    for seed in range(60):
        rng, x, points = random.Random(seed), 0.0, []
        for _ in range(300):
            x += rng.gauss(0, rng.choice([0.2, 1.0]))
            points.append((x, rng.choice([None, 0.0, 0.5, 1.0, 2.0])))
        for band in (0.5, 1.5):
            assert stretches(points, band) == plain(points, band)


def test_memory_is_bounded_inside_a_stretch():
    kernel = Program(P.stretches(1.5), ["first", "last"])
    for i in range(3000):
        kernel.step({"i": i, "p": 0.0, "v": 1.0})
    assert len(kernel.rows.kept) <= 3


def test_null_paths_keep_the_changes(spark):
    rng = random.Random(4)
    rows = [(s, t * 3600, math.exp(rng.gauss(0, 0.1))) for s, n in (("a", 50), ("b", 23), ("c", 5)) for t in range(n)]
    found = P.changes(spark.createDataFrame(rows, "symbol string, t long, close double")).cache()
    real = {}
    for r in found.where("dp IS NOT NULL").collect():
        real.setdefault(r.symbol, {})[r.i] = r.dp
    for kind in ("shuffle", "block"):
        paths = {}
        for r in P.resampled(found, 7, kind).collect():
            paths.setdefault((r.symbol, r.replicate), {})[r.i] = r.p
        assert {s for s, _ in paths} == {"a", "b", "c"}
        for (s, _), path in paths.items():
            n = len(real[s])
            if kind == "block" and n <= P.BLOCK:
                assert path == {0: 0.0}  # too few changes for a block
                continue
            assert sorted(path) == list(range(n + 1)) and path[0] == 0
            steps = [path[i] - path[i - 1] for i in range(1, n + 1)]
            if kind == "shuffle":
                assert all(abs(a - b) < 1e-9 for a, b in zip(sorted(steps), sorted(real[s].values()), strict=True))
            else:
                runs = [steps[k : k + P.BLOCK] for k in range(0, n, P.BLOCK)]
                pieces = [[real[s][b + j] for j in range(P.BLOCK)] for b in range(1, n - P.BLOCK + 1)]
                assert all(any(all(abs(x - y) < 1e-9 for x, y in zip(run, piece)) for piece in pieces) for run in runs)
        if kind == "shuffle":
            assert len({tuple(round(x, 9) for _, x in sorted(p.items())) for (s, _), p in paths.items() if s == "a"}) == 7
    found.unpersist()


def test_statistics_by_hand(spark):
    found = spark.createDataFrame([("k", 0, 5), ("k", 6, 8), ("k", 9, 18)], "key string, first long, last long")
    (row,) = P.measured(found, spark.createDataFrame([("k", 20)], "key string, bars long")).collect()
    # Platforms of 6 and 10 bars; known from their sixth bar on: 1 + 5 bars.
    assert (row.platforms, row.coverage, row.median_bars, row.mean_bars, row.forming) == (2, 0.8, 8.0, 8.0, 1 - 6 / 20)
    (none,) = P.measured(found.limit(0), spark.createDataFrame([("k", 20)], "key string, bars long")).collect()
    assert (none.platforms, none.coverage, none.forming) == (0, 0.0, 1.0)
