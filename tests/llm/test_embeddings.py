import random

import numpy as np

from tidemark.llm import embeddings as E


def brute(rows, threshold=0.93):
    fit = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fit[k] = np.array(v, float)
    links = {k: set() for k in range(len(rows))}
    for a in fit:
        for b in fit:
            if a < b and rows[a][2] == rows[b][2] and len(fit[a]) == len(fit[b]):
                if fit[a] @ fit[b] / np.sqrt(fit[a] @ fit[a]) / np.sqrt(fit[b] @ fit[b]) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for k, row in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        low = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
        out.append((str(row[0]), len(links[k]), str(low)))
    return sorted(out)


def got(frame):
    return sorted((str(r.id), r.n_links, str(r.component)) for r in frame.collect())


SCHEMA = "vec_id long, embedding array<float>, label int, id string, node long"


def test_brute_force_in_many_tiles(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 12))
    rows = []
    for k in range(260):
        c = centres[rng.integers(30)]
        v = c + rng.normal(size=12) * rng.choice([0, 0.05, 0.2, 0.27, 0.3])
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(rng.choice([0, 0, 0, 1, 2])), "x", 1))
    rows += [(900, rows[0][1], rows[0][2], "x", 1), (901, [2 * x for x in rows[0][1]], rows[0][2], "x", 1), rows[5]]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA)
    want = brute([r[:3] for r in rows])
    assert sum(r[1] for r in want) > 300
    assert got(E.clusters(frame, tile=40)) == want
    assert got(E.clusters(frame)) == want


def test_odd_rows(spark):
    big = [3e38, 3e38]
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [float("nan"), 1.0], 1), (5, [None, 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [1.0, 1.0], None), (8, [1.0, 1.0], None),
        (9, [1.0, 1.0], 1), (None, big, 1), (10, [1e-40, 1e-40], 1), (11, [1.0, 1.0, 0.0], 1), (None, [-1.0, 0.0], 1), (12, [1.0, 1.0], 2), (9, [1.0, 1.0], 1), (None, [-1.0, 0.0], 1), (13, [-0.0, 1.0], 3), (14, [0.0, 1.0], 3),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    plain = [(i, v and [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    assert got(E.clusters(frame)) == brute(plain)
    assert E.clusters(frame.limit(0)).count() == 0


def test_bound_holds_and_recomputes_few():
    rng = np.random.default_rng(5)
    unit = E.units(rng.normal(size=(300, 1500)))
    q, s, e = E.quantised(unit)
    assert np.abs(q).max() == 127 and np.array_equal(E.product(q[:50], q[:50]), q[:50].astype(np.int64) @ q[:50].astype(np.int64).T)
    off = np.abs(E.product(q, q) * s[:, None] * s - unit @ unit.T)
    assert (off <= e[:, None] + e + e[:, None] * e).all()
    a, b, again = E.linked((unit, q, s, e), (unit, q, s, e), 0.93, 0)
    assert len(a) == 0 and again == 0


def test_group_of_near_copies_returns_no_pairs():
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=64) + rng.normal(size=(1500, 64)) * 0.05
    node, links, low = E.tile_links(np.arange(1500) + 5, np.zeros(1500), np.full(1500, 2), vectors, 0.93)
    assert len(node) == 1500 and set(low.tolist()) == {5} and set(links.tolist()) == {2 * 1499}
