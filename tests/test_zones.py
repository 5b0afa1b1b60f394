"""The zone machine: literal cases of each decider, every output row against its definition, and causality."""

import random
from statistics import median

import pytest

from tidemark.operators import zones as Z
from tidemark.operators.programs import Program, Rows

NAMES = ["kind", *Z.COLUMNS]


def featured(closes, spread=0.4):
    """Bars around closes with the features of Z.features(), in plain Python."""
    rows, e27, e200, unit = [], None, None, None
    for i, c in enumerate(closes):
        o = closes[i - 1] if i else c
        h, lo = max(o, c) + spread, min(o, c) - spread
        tr = max(h - lo, abs(h - o), abs(lo - o))
        e27, e200, unit = (x if old is None else a * x + (1 - a) * old for x, old, a in ((c, e27, 2 / 28), (c, e200, 2 / 201), (tr, unit, 1 / 14)))
        r = {"i": i, "t": i * 3600, "open": o, "high": h, "low": lo, "close": c, "ema27": e27, "ema200": e200, "atr": unit, "gap": e27 - e200, "body_high": max(o, c), "body_low": min(o, c)}
        back = lambda k, c: rows[i - k][c] if i >= k else None  # noqa: B023, E731
        step = lambda c, k: r[c] - back(k, c) if i >= k else None  # noqa: B023, E731
        r["change"], gap1 = step("ema27", 1), step("gap", 1)
        r["gap6"] = step("gap", 6) / unit if i >= 6 else None
        r["context"] = i >= 6 and e27 > e200 and e200 > back(6, "ema200")
        falling = i >= 2 and e27 < back(2, "ema27") or i >= 3 and e27 < back(3, "ema27")
        r["core"] = bool(r["context"] and r["change"] < 0 and falling and c < e27)
        r["aligned"] = bool(r["context"] and c > e27 and r["change"] > 0 and gap1 >= 0)
        r["discord"] = int(c <= e27) + int(i > 0 and r["change"] <= 0) + int(i > 0 and gap1 < 0)
        for name, (n, width, net) in Z.BANDS.items():
            past = [x["ema27"] for x in rows[-n:]] if i >= n else []
            r[f"{name.lower()}_low"], r[f"{name.lower()}_high"] = (min(past), max(past)) if past else (None, None)
            r[f"{name.lower()}_compact"] = bool(past and max(past) - min(past) <= width * unit and abs(past[-1] - past[0]) <= net * unit)
        rows.append(r)
    return rows


def walk(seed, n=700):
    """A drifting walk with flat, rising and falling stretches."""
    rng, x, out = random.Random(seed), 100.0, []
    while len(out) < n:
        drift, noise = rng.choice([(0.0, 0.25), (0.35, 0.6), (0.5, 0.3), (-0.4, 0.5), (0.05, 0.15), (0.9, 0.4), (-0.9, 0.4)])
        for _ in range(rng.randrange(10, 70)):
            x = max(5.0, x + drift + rng.gauss(0, noise))
            out.append(x)
    return out[:n]


def played(rows, model):
    kernel = Program(Z.parents(model), NAMES, Z.with_streak)
    steps = [[dict(zip(NAMES, x, strict=True)) for x in kernel.step(dict(r))] for r in rows]
    return steps, [dict(zip(NAMES, x, strict=True)) for x in kernel.close()]


@pytest.fixture(scope="module")
def runs():
    out = []
    for seed in range(60):
        rows = featured(walk(seed))
        for model in Z.MODELS:
            steps, end = played(rows, model)
            out.append((rows, model, [x for s in steps for x in s] + end))
    return out


def of(found, kind):
    return [x for x in found if x["kind"] == kind]


def at(t):
    return t // 3600


def test_every_kind_and_way_is_met(runs):
    met = {x["kind"] for _, _, found in runs for x in found}
    assert met == set(Z.TABLES)
    assert {"CONFIRMED_PARENT_UP_RESOLUTION", "CONFIRMED_PARENT_DOWN_RESOLUTION", "OPEN_AT_TRAIN_END"} == {x["resolution"] for _, _, f in runs for x in of(f, "PARENT")}
    assert "CONFIRMED" in {x["status"] for _, m, f in runs if m == "JOINT" for x in of(f, "JOINT")}
    joints = {(x["status"], x["reason"]) for _, _, f in runs for x in of(f, "JOINT")}
    assert {("CONFIRMED", "JOINT_PERSISTENCE_CONFIRMED"), ("FAILED", "PRICE_DEEP_RECLAIM"), ("FAILED", "JOINT_12_BAR_CRITERIA_NOT_MET")} <= joints
    assert {"RETURN_REARM", "NEW_BAND_REARM"} == {x["kind_of"] for _, _, f in runs for x in of(f, "REARM")}


def test_candidates_against_their_definition(runs):
    for rows, _, found in runs:
        for c in of(found, "CANDIDATE"):
            way, a, b = 1 if c["direction"] == "UP" else -1, at(c["start"]), at(c["decision"])
            out = [way * (r["close"] - c["frozen"]) > 0 for r in rows]
            deep = [way * (c["frozen"] - r["close"]) > 0.15 * r["atr"] for r in rows]

            def accepts(k):
                n = k - a + 1
                share = min(sum(out[a : k + 1]), sum(way * (r["close"] - r["ema27"]) > 0 for r in rows[a : k + 1])) / n
                ends = out[k] or way < 0 and rows[k]["close"] <= c["frozen"] + 0.1 * rows[k]["atr"]
                three = any(all(deep[j : j + 3]) for j in range(a, k - 1))
                return n >= 4 and share >= 0.6 and ends and not three and (way < 0 or all(r["ema27"] > r["ema200"] for r in rows[a : k + 1]))

            first = next((k for k in range(a, min(a + 12, len(rows))) if accepts(k) or k >= a + 2 and all(deep[k - 2 : k + 1])), min(a + 11, len(rows) - 1))
            assert b == first and c["outside"] == sum(out[a : b + 1]) and c["bars"] == b - a + 1
            assert (c["status"] == f"LOCAL_ACCEPTED_{c['direction']}_DEPARTURE") == accepts(b)
            assert way * (rows[a]["close"] - c["frozen"]) > 0.15 * rows[a]["atr"] and c["unit"] == rows[a]["atr"]


def test_joints_against_their_definition(runs):
    for rows, _, found in runs:
        bands = {(e["zone"], e["regime"]): e for e in of(found, "EMA_REGIME")}
        regimes = {(p["zone"], p["phase"]): p for p in of(found, "PRICE_REGIME")}
        frozen = {(c["zone"], c["phase"]): c["frozen"] for c in of(found, "CANDIDATE")}
        for j in of(found, "JOINT"):
            way, a, b = 1 if j["direction"] == "UP" else -1, at(j["start"]), at(j["decision"])
            e, p, bound = bands[j["zone"], j["regime"]], regimes[j["zone"], j["phase"]], frozen[j["zone"], j["phase"]]
            assert e["qualified"] and e["direction"] == p["direction"] == j["direction"] and p["decision"] < j["start"] and e["decision"] <= j["start"]
            edge = e["band_high"] if way > 0 else e["band_low"]
            seen = rows[a : b + 1]
            out, past = sum(way * (r["close"] - bound) > 0 for r in seen), sum(way * (r["ema27"] - edge) > 0 for r in seen)
            assert (j["outside"], j["beyond"], j["bars"]) == (out, past, len(seen))
            last = rows[b]
            good = len(seen) == 12 and out >= 8 and past >= 8 and way * (last["ema27"] - edge) > 0 and way * (last["gap"] - rows[a]["gap"]) > 0 and (last["close"] > bound and last["ema27"] > last["ema200"] if way > 0 else last["close"] < bound or last["close"] <= bound + 0.1 * last["atr"])
            if j["reason"] in ("JOINT_PERSISTENCE_CONFIRMED", "JOINT_12_BAR_CRITERIA_NOT_MET"):
                assert good == (j["status"] == "CONFIRMED")


def test_bounds_and_their_versions(runs):
    n = 0
    for rows, model, found in runs:
        for z in of(found, "PARENT"):
            grown = [x for x in of(found, "EXTENSION") if x["zone"] == z["zone"]]
            assert [x["version"] for x in grown] == list(range(2, 2 + len(grown))) and z["version"] == 1 + len(grown)
            bounds = {"UP": z["first_upper"], "DOWN": z["first_lower"]}
            for x in grown:
                n += 1
                way = 1 if x["direction"] == "UP" else -1
                out = [r for r in rows[at(x["start"]) : at(x["t"]) + 1] if way * (r["close"] - x["old_bound"]) > 0]
                bodies = sorted((r["body_high"] if way > 0 else r["body_low"] for r in out), reverse=way > 0)[:3]
                assert x["old_bound"] == bounds[x["direction"]] and x["new_bound"] == (max if way > 0 else min)(x["old_bound"], median(bodies)) and len(out) == x["outside"] >= 3
                bounds[x["direction"]] = x["new_bound"]
            assert (z["upper"], z["lower"]) == (bounds["UP"], bounds["DOWN"])
            low = sorted(r["body_low"] for r in rows[at(z["start"]) : at(z["bounds_at"]) + 1])[:3]
            assert z["first_lower"] == median(low) and z["start"] <= z["trigger"] and rows[at(z["trigger"])]["core"]
        assert model != "FIXED" or not of(found, "EXTENSION")
    assert n > 20


def test_regimes_of_the_average(runs):
    for rows, _, found in runs:
        for e in of(found, "EMA_REGIME"):
            n, a, b = Z.BANDS[e["scale"]][0], at(e["start"]), at(e["decision"])
            past = [r["ema27"] for r in rows[a - n : a]]
            assert (e["band_low"], e["band_high"]) == (min(past), max(past)) and b > a
            way, edge = (1, e["band_high"]) if e["direction"] == "UP" else (-1, e["band_low"])
            assert way * (rows[a]["ema27"] - edge) > 0.1 * rows[a]["atr"] and way * (rows[b]["ema27"] - edge) > 0
            if e["reason"] == "EMA_RETURN_TERMINATION":
                k = at(e["end"])
                assert e["band_low"] <= rows[k]["ema27"] <= e["band_high"]


def test_bars_tell_bounds_before_the_bar_and_do_not_overlap(runs):
    for _, _, found in runs:
        times = [(x["zone"], x["t"]) for x in of(found, "BAR")]
        assert len(times) == len(set(times))
        zones = [(z["start"], z["end"]) for z in of(found, "PARENT")]
        assert all(a[1] < b[0] for a, b in zip(zones, zones[1:], strict=False))


def test_prefix_never_changes_what_was_put_out():
    rows = featured(walk(3))
    steps, _ = played(rows, "JOINT")
    for n in (150, 333, 600):
        shorter, _ = played(rows[:n], "JOINT")
        assert shorter == steps[:n]


def test_memory_is_bounded_between_zones():
    rows = featured([100 + 0.01 * k for k in range(5000)])
    kernel = Program(Z.parents("JOINT"), NAMES, Z.with_streak)
    most = 0
    for r in rows:
        kernel.step(r)
        most = max(most, len(kernel.rows.kept))
    assert most <= Z.KEEP + 2


def fixed(rows):
    out = Rows()
    for r in rows:
        out.kept.append(r)
    out.ended = True
    return out


def finish(steps):
    try:
        while True:
            next(steps)
    except StopIteration as e:
        return e.value


def bars(closes, **more):
    return fixed([{"close": c, "atr": 1.0, "ema27": 9.0, "ema200": 8.0, "body_high": c, "body_low": c - 0.2, "high": c + 0.5, "low": c - 0.5, "gap": 1.0, "t": k} | {n: v[k] for n, v in more.items()} for k, c in enumerate(closes)])


def test_candidate_by_hand():
    # Bound 10: out, out, back a little, out: three of four outside on the fourth bar.
    c = finish(Z.local_candidate(bars([10.3, 10.2, 9.95, 10.4, 10.5]), 0, 1, 10.0))
    assert (c["accepted"], c["at"], c["outside"], c["first"]) == (True, 3, 3, 0)
    # Two of four, then three deep reclaims in a row end it on the fifth bar.
    c = finish(Z.local_candidate(bars([10.3, 10.2, 9.8, 9.7, 9.6, 11.0]), 0, 1, 10.0))
    assert (c["accepted"], c["at"], c["reason"]) == (False, 4, "THREE_CONSECUTIVE_DEEP_RECLAIMS")
    # A third outside for twelve bars decides nothing.
    c = finish(Z.local_candidate(bars([10.3, 9.9, 9.9] * 5), 0, 1, 10.0))
    assert (c["accepted"], c["at"], c["reason"]) == (False, 11, "MAX_DECISION_BARS_REACHED")


def test_shelf_by_hand():
    seen = bars([10.3, 10.2, 9.9, 10.6, 12.0]).span(0, 4)
    assert Z.shelf(seen, 1, 10.0, 1.0) == 10.6  # of 12.0, 10.6, 10.3 the median; the wick at 12.5 counts for nothing
    assert Z.shelf(seen, 1, 10.0, 5.0) is None  # the median close, 10.45, isn't half a unit of 5 above
    assert Z.shelf(bars([10.3, 9.9, 10.2, 9.9, 10.6]).span(0, 4), 1, 10.0, 1.0) is None  # never two in a row
    assert Z.shelf(seen[:2], 1, 10.0, 1.0) is None


def test_joint_by_hand():
    ema = {"low": 8.5, "high": 8.8, "edge": 8.8}
    grow = [1 + 0.1 * k for k in range(12)]
    assert finish(Z.joint_probation(bars([10.3] * 12, gap=grow), 0, 1, 10.0, ema))["status"] == "CONFIRMED"
    assert finish(Z.joint_probation(bars([10.3] * 12), 0, 1, 10.0, ema))["reason"] == "JOINT_12_BAR_CRITERIA_NOT_MET"  # the gap doesn't grow
    assert finish(Z.joint_probation(bars([10.3] * 8 + [9.95] * 3 + [10.1], gap=grow), 0, 1, 10.0, ema))["status"] == "CONFIRMED"
    back = finish(Z.joint_probation(bars([10.3, 9.8, 9.8, 9.8, 10.3]), 0, 1, 10.0, ema))
    assert (back["reason"], back["at"]) == ("PRICE_DEEP_RECLAIM", 3)
    home = finish(Z.joint_probation(bars([10.3] * 5, ema27=[9.0, 8.6, 9.0, 8.6, 8.7]), 0, 1, 10.0, ema))
    assert (home["reason"], home["at"]) == ("EMA_RETURN_INSIDE_BAND", 4)
    assert finish(Z.joint_probation(bars([10.3] * 5), 0, 1, 10.0, ema))["reason"] == "INSUFFICIENT_BARS"
