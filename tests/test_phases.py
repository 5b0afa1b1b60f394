"""Local phases by hand, controls against brute force, and sums over clustered input."""

import math
import random
from collections import defaultdict

import pytest

from tidemark.operators import clustered as C
from tidemark.operators import machines as M
from tidemark.operators import pools as P


def played(rows):
    kernel = M.LocalPhase()
    return [x for r in rows for x in kernel.step(r)] + kernel.close()


def bar(t, close, fast=10.0, slow=9.0, top=12.0):
    return {"t": t, "close": close, "high": close + 0.5, "low": close - 0.5, "fast": fast, "slow": slow, "high3": top, "low3": 8.0}


def test_a_correction_by_hand():
    closes = [11.0, 10.0, 10.2, 10.8, 10.1, 10.9, 12.5, 12.4]
    rows = [bar(t, c, top=13.0 if t == 7 else 12.0) for t, c in enumerate(closes)]
    told = [(x[3], x[4], x[5]) for x in played(rows) if x[0] == "BAR"]
    # 10.2 isn't above the bar before's high of 10.5; 10.8 is above 10.7; 10.1 falls back; 10.9 is above 10.6; 12.5 passes the extreme of 12.
    assert told == [("EXPANSION", None, None), ("PULLBACK", "CORRECTION_START", 1), ("PULLBACK", None, 1), ("RECOVERY", "RECOVERY", 1), ("PULLBACK", "RECOVERY_FAILED", 1), ("RECOVERY", "RECOVERY", 1), ("RESUMPTION", "RESUMPTION", 1), ("PULLBACK", "CORRECTION_START", 2)]
    ends = [x for x in played(rows) if x[0] == "CORRECTION"]
    assert [(x[1], x[4], x[5], x[6], x[7], x[10]) for x in ends] == [(6, "RESUMPTION", 1, 1, 6, 3), (7, "OPEN_END", 2, 7, 1, 0)]
    assert ends[0][8] == pytest.approx((12 - 9.5) / 12 * 100) and ends[0][9] == pytest.approx(0.0)


def test_lost_context_by_hand():
    rows = [bar(0, 11.0), bar(1, 10.0), bar(2, 9.9, fast=8.9), bar(3, 9.8, fast=8.8)]
    assert [(x[0], x[2], x[3] if x[0] == "BAR" else x[4]) for x in played(rows)] == [("BAR", 1, "EXPANSION"), ("BAR", 1, "PULLBACK"), ("CORRECTION", 1, "CONTEXT_LOSS"), ("BAR", -1, "CONTEXT_LOSS"), ("BAR", -1, "EXPANSION")]
    # Right behind a resumption nothing is left to lose, but the bar is one of lost context.
    rows = [bar(0, 11.0), bar(1, 10.0), bar(2, 12.5), bar(3, 12.4, fast=8.9, top=13.0)]
    assert [x[3] if x[0] == "BAR" else x[4] for x in played(rows)] == ["EXPANSION", "PULLBACK", "RESUMPTION", "RESUMPTION", "CONTEXT_LOSS"]
    assert played([]) == []


def test_depth_below_an_extreme_of_zero_is_that_of_sql():
    """SQL divides by the extreme: (high - 0) / 0 is infinite, 0 / 0 is no number, and the last bar counts."""
    falls = lambda *bars: [{"t": t, "close": c, "high": h, "low": 0.0, "fast": 9.0, "slow": 10.0, "high3": 12.0, "low3": 0.0} for t, (c, h) in enumerate(bars)]
    depth = lambda rows: [x[8] for x in played(rows) if x[0] == "CORRECTION"]
    assert depth(falls((1.0, 2.0), (1.5, 3.0))) == [math.inf]
    assert [math.isnan(d) for d in depth(falls((1.0, 2.0), (1.5, 0.0)))] == [True]
    assert depth(falls((1.0, 2.0), (1.5, 0.0), (1.6, 1.0))) == [math.inf]


def test_pool_against_brute_force(spark):
    rng = random.Random(2)
    pool = [("a" if k % 3 else "b", k, rng.choice([round(rng.gauss(0, 1), 2), 0.5])) for k in range(200)] + [("a", 999, None)]
    events = [(rng.choice(["a", "b", "c"]), 1000 + k, rng.randrange(200), round(rng.gauss(0, 1), 2)) for k in range(40)] + [("a", 2000, 5, None)]
    got = P.nearest_in_pool(spark.createDataFrame(events, "g string, t long, i long, target double"), spark.createDataFrame(pool, "g string, i long, value double"), ["g"], "target", "value", k=3)
    found = {r.t: (r.control_i, r.control_value) for r in got.collect()}
    assert len(found) == len(events)
    for g, t, i, target in events:
        own = sorted((v, j) for h, j, v in pool if h == g and v is not None)
        if target is None or not own:
            assert found[t] == (None, None)
            continue
        at = sum(v < target for v, _ in own)
        near = own[max(0, at - 3) : at + 4]
        _, _, j, v = min((round(abs(v - target), 12), abs(j - i), j, v) for v, j in near)
        assert found[t] == (j, v)


def test_blocked_bars(spark):
    bars = spark.createDataFrame([("a", i) for i in range(12)], "symbol string, i long")
    events = spark.createDataFrame([("a", 5), ("a", 5), ("b", 3)], "symbol string, i long")
    assert sorted(r.i for r in P.blocked(events, bars, 3).where("blocked").collect()) == [2, 3, 4, 5]


def test_durations_against_brute_force(spark):
    rng = random.Random(5)
    for _ in range(3):
        n, targets = 60, []
        for _ in range(rng.randrange(1, 7)):
            a = rng.randrange(55)
            targets.append(("s", a, min(59, a + rng.randrange(1, 12)), rng.randrange(1, 25)))
        targets = sorted(set(targets))
        got = P.matched_in_duration(spark.createDataFrame(targets, "symbol string, first long, last long, d long"), spark.createDataFrame([("s", n), ("none", 5)], "symbol string, n long"), "d").collect()
        free = [(a, b) for a in range(n) for b in range(a + 3, n) if all(b < x or a > y for _, x, y, _ in targets)]
        for r in got:
            want = min(((abs(b - a - r.d), a, b) for a, b in free), default=(None, None, None))
            assert (r.mismatch, r.start, r.end) == want
        assert len(got) == len(targets)


def sums():
    """A function that workers get by value, as they don't know this module."""
    return lambda rows: [(len(rows), float(sum(r["x"] for r in rows)))]


def test_clustered_sums_over_partition_borders(spark):
    rng, rows = random.Random(1), []
    for k in range(40):
        rows += [(k, float(rng.randrange(9))) for _ in range(rng.choice([1, 2, 30]))]
    rows += [(None, 1.0), (None, 2.0)]
    want = defaultdict(list)
    for k, x in rows:
        want[k].append(x)
    for parts in (1, 3, 7, 50):
        frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "k long, x double")
        got = {r.k: (r.n, r.total) for r in C.flushed(frame, "k", sums(), "n long, total double").collect()}
        assert got == {k: (len(v), sum(v)) for k, v in want.items()}


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_a_key_that_returns_is_an_error(spark, parts):
    rows = [(1, 1.0), (2, 1.0), (3, 1.0), (1, 1.0)]
    frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "k long, x double")
    with pytest.raises(ValueError, match="KEY_RETURNS"):
        C.flushed(frame, "k", sums(), "n long, total double")


def test_clustered_input_without_rows(spark):
    assert C.flushed(spark.createDataFrame([], "k long, x double"), "k", sums(), "n long, total double").count() == 0
