"""Chains of episodes against a plain version over whole lists, a case that rewinds by hand, and causality."""

import pytest
from test_zones import featured, walk

from tidemark.operators import sections as X
from tidemark.operators import zones as Z
from tidemark.operators.programs import Program

NAMES = ["kind", *X.COLUMNS]


def prepared(closes):
    rows = featured(closes)
    for i, r in enumerate(rows):
        r["gap1"] = r["gap"] - rows[i - 1]["gap"] if i else None
        r["other"] = bool(i and r["ema27"] < r["ema200"] and r["close"] < r["ema27"] and r["change"] < 0 and r["gap1"] <= 0)
        r["cross"] = bool(i and r["ema27"] <= r["ema200"] and rows[i - 1]["ema27"] > rows[i - 1]["ema200"])
        r["trigger"] = None
    for start, trigger in section_starts(rows):
        rows[start]["trigger"] = trigger
    return rows


def section_starts(rows):
    """(start, first trigger) of merged windows, window by window."""
    three = lambda i, c: i >= 3 and sum(r[c] for r in rows[i - 3 : i + 1]) >= 3
    out, reached = [], None
    for g, r in enumerate(rows):
        if not r["core"]:
            continue
        runs = [e for e in range(max(0, g - 30) + 3, g) if three(e, "aligned")]
        begin = max(k for k in range(runs[-1] + 1) if rows[k]["aligned"]) + 1 if runs else max(0, g - 12)
        loose = lambda k, n: rows[k]["context"] and rows[k]["discord"] >= n
        start = next(k for k in range(begin, g + 1) if loose(k, 2) or k < g and loose(k, 1) and loose(k + 1, 1))
        end = next((i for i in range(g, len(rows)) if three(i, "aligned") or three(i, "other")), len(rows) - 1)
        gap = range(0) if reached is None else range(reached + 1, start)
        merged = reached is not None and (start <= reached or not any(three(i, "aligned") for i in range(max(reached + 4, 3), start)) or len(gap) < 4 and sum(rows[k]["aligned"] for k in gap) < 3)
        if not merged:
            out.append((start, g))
        reached = end if reached is None else max(reached, end)
    return out


def plain(rows, version):
    """[(start, effective, confirmed, resolution, attempts)], attempts as (type, effective, detected, status, failed at, reason)."""
    last, out, used = len(rows) - 1, [], -1
    n_of = lambda c, a, b: sum(bool(c(r)) for r in rows[max(0, a) : b + 1])
    above, below = (lambda r: r["close"] > r["ema27"]), (lambda r: r["close"] < r["ema27"])
    rising, widening, aligned = (lambda r: (r["change"] or 0) >= 0), (lambda r: (r["gap1"] or 0) >= 0), (lambda r: r["aligned"])

    def renewed(j):
        r = rows[j]
        if r["core"]:
            return j, "CORE_TRIGGER"
        if min(r["discord"], rows[j - 1]["discord"]) >= 2:
            return j - 1, "TWO_DISCORDANT_BARS"
        if n_of(below, j - 2, j) >= 2 and r["change"] < 0 and r["gap1"] < 0:
            return next(k for k in (j - 2, j - 1, j) if below(rows[k])), "THREE_BAR_PRICE_FAST_GAP_DISPUTE"
        if r["cross"]:
            return j, "EMA27_CROSS_BELOW_EMA200"
        if version != "R5" and n_of(below, j - 3, j) >= 3 and r["change"] < 0:
            return j - 3, "THREE_OF_FOUR_BELOW_EMA27"

    def turned(j, effective):
        if rows[j]["ema27"] > rows[j]["ema200"]:
            return j, "EMA27_RETURNED_ABOVE_EMA200"
        if j - 3 >= effective and n_of(aligned, j - 3, j) >= 3:
            return j, "RECOVERY_ATTEMPT_FORMED"
        if n_of(above, j - 3, j) >= 3:
            return j - 3, "PRICE_RETURNED_ABOVE_EMA27"

    for start, r in enumerate(rows):
        if r["trigger"] is None or start <= used:
            continue
        run = Z.last_run(_Kept(rows), r["trigger"])
        # The high of the aligned run: its bars are those back to the first one that isn't aligned, before its first streak's end.
        if run:
            a = run[1]
            while a > 0 and rows[a - 1]["aligned"]:
                a -= 1
            before = max(x["high"] for x in rows[a : run[0] + 1])
        else:
            before = max(x["high"] for x in rows[max(0, start - 12) : max(0, start - 1) + 1])
        i = from_ = start
        attempts, result = [], (last, last, "OPEN_AT_TRAIN_END")
        while i <= last:
            good = [k for k in range(i - 3, i + 1) if rows[k]["aligned"]] if i - 3 >= from_ else []
            bad = [k for k in range(i - 3, i + 1) if rows[k]["other"]] if i - 3 >= from_ else []
            if len(good) >= 3:
                kind, level = "RECOVERY", None
                if version != "R3":
                    ceiling = max(x["high"] for x in rows[start:i])
                    c, u = rows[i]["close"], rows[i]["atr"]
                    if version == "R4":
                        facts = [(c - rows[i]["ema27"]) / u >= 0.75, c > ceiling or (c - ceiling) / u >= 0.25, rows[i]["ema27"] > rows[i - 3]["ema27"] and n_of(lambda x: (x["change"] or 0) > 0, i - 3, i) >= 3, rows[i]["gap"] > rows[i - 3]["gap"] and n_of(lambda x: (x["gap1"] or 0) > 0, i - 3, i) >= 3, n_of(aligned, i - 3, i) >= 3, n_of(above, i - 5, i) >= 5]
                        n = sum(facts)
                        kind = "STRONG_RECOVERY" if n >= 4 and (facts[0] or facts[1]) else "MODERATE_RECOVERY" if n >= 3 else "WEAK_RECOVERY"
                        if kind == "WEAK_RECOVERY":
                            attempts.append((kind, good[0], i, "INTERNAL_WEAK_RECOVERY", None, None))
                            i += 1
                            continue
                    else:
                        level = max(before, ceiling)
                        resets = c > level and (c - level) / u >= 0.15 and n_of(above, i - 3, i) >= 3 and rows[i]["change"] > 0 and rows[i]["ema27"] > rows[i]["ema200"]
                        kind = "STRUCTURAL_RESET" if resets else "INTERNAL_RECOVERY"
                bars, a, b, c, d, e = X.PROBATIONS[kind]
                end = min(last, i + bars)
                fails = next((f for j in range(i + 1, end + 1) if (f := renewed(j))), None)
                if not fails and end == i + bars:
                    span = rows[i + 1 : end + 1]
                    ok = n_of(above, i + 1, end) >= a and n_of(rising, i + 1, end) >= b and n_of(widening, i + 1, end) >= c and n_of(aligned, end - 3, end) >= d and all(x["ema27"] > x["ema200"] for x in span)
                    ok = ok and (not e or sum(x["close"] > level for x in span) >= e)
                    if ok:
                        at = next(k for k in range(good[0], end + 1) if level is None or rows[k]["close"] > level or kind != "STRUCTURAL_RESET")
                        status = {"RECOVERY": "CONFIRMED_RECOVERED_LONG", "INTERNAL_RECOVERY": "CONFIRMED_PERSISTENT_INTERNAL_RECOVERY"}.get(kind, f"CONFIRMED_{kind}")
                        attempts.append((kind, good[0], i, status, None, None))
                        result = (at, end, status)
                        break
                    fails = end, {"RECOVERY": "RECOVERY_PROBATION", "STRONG_RECOVERY": "ADAPTIVE_RECOVERY", "MODERATE_RECOVERY": "ADAPTIVE_RECOVERY"}.get(kind, kind) + "_THRESHOLDS_NOT_MET"
                attempts.append((kind, good[0], i, f"FAILED_{kind}" if fails else "CENSORED_BY_TRAIN_END", *(fails or (None, None))))
            elif len(bad) >= 3:
                end = min(last, i + 8)
                fails = next((f for j in range(i + 1, end + 1) if (f := turned(j, bad[0]))), None)
                if not fails and end == i + 8:
                    if n_of(lambda x: x["ema27"] < x["ema200"], i + 1, end) >= 7 and n_of(below, i + 1, end) >= 6 and n_of(lambda x: x["change"] <= 0, i + 1, end) >= 6:
                        result = (bad[0], end, "CONFIRMED_NEW_DOWN_CONFIGURATION")
                        break
                    fails = end, "NEW_CONFIGURATION_THRESHOLDS_NOT_MET"
            else:
                i += 1
                continue
            if not fails:
                break
            i = from_ = fails[0]
        used = result[1]
        out.append((start, *result, attempts))
    return out


class _Kept(list):
    """Rows as the program's helpers read them."""

    def __init__(self, rows):
        super().__init__(rows)

    def span(self, a, b):
        return self[a : b + 1]


def played(rows, version):
    kernel = Program(X.chains(version), NAMES, Z.with_streak)
    steps = [[dict(zip(NAMES, x, strict=True)) for x in kernel.step(dict(r))] for r in rows]
    return steps, [dict(zip(NAMES, x, strict=True)) for x in kernel.close()]


def told(found):
    at = lambda t: None if t is None else t // 3600
    out = []
    for s in (x for x in found if x["kind"] == "SECTION"):
        tries = [(x["type"], at(x["effective"]), at(x["detected"]), x["status"], at(x["failed_at"]), x["reason"]) for x in found if x["kind"] == "ATTEMPT" and x["section"] == s["section"]]
        out.append((at(s["start"]), at(s["effective"]), at(s["confirmed"]), s["resolution"], tries))
    return out


@pytest.mark.parametrize("version", X.VERSIONS)
def test_against_the_plain_version(version):
    met, sections = set(), 0
    for seed in range(40):
        rows = prepared(walk(seed, 500))
        steps, end = played(rows, version)
        found = [x for s in steps for x in s] + end
        assert told(found) == plain(rows, version)
        sections += len(told(found))
        met |= {x["resolution"] for x in found if x["kind"] == "SECTION"} | {x["reason"] for x in found if x["kind"] in ("ATTEMPT", "CONFIGURATION")}
        for s in (x for x in found if x["kind"] == "SECTION"):
            span = rows[s["start"] // 3600 : s["effective"] // 3600 + 1]
            assert (s["high"], s["low"]) == (max(r["high"] for r in span), min(r["low"] for r in span))
            assert s["episodes"] == sum(x["kind"] == "EPISODE" and x["section"] == s["section"] for x in found)
    assert sections > 40 and {"CORE_TRIGGER", "OPEN_AT_TRAIN_END", "CONFIRMED_NEW_DOWN_CONFIGURATION"} <= met
    assert {"R3": "CONFIRMED_RECOVERED_LONG", "R4": "CONFIRMED_STRONG_RECOVERY", "R5": "CONFIRMED_STRUCTURAL_RESET"}[version] in met


def hand(n, aligned=(), discordant=()):
    """Bars of a calm rising trend; the aligned ones recover, the discordant ones dispute."""
    rows = []
    for i in range(n):
        good, bad = i in aligned, i in discordant
        rows.append({"t": i * 3600, "high": 11.0, "low": 9.0, "close": 10.5 if not bad else 9.5, "ema27": 10.0, "ema200": 9.0, "gap": 1.0, "gap1": 0.1 if not bad else -0.1, "change": 0.1 if not bad else -0.1, "atr": 1.0, "context": True, "aligned": good, "discord": 3 if bad else 0, "core": False, "other": False, "cross": False, "body_high": 10.5, "body_low": 9.5, "trigger": None})
    rows[5]["trigger"] = 6
    return rows


def test_a_failure_rewinds_by_hand():
    # Recovered bars 6, 7, 8 are detected on bar 8. Bars 9 and 10 are discordant: the failure is seen on 10 and begins on 9.
    # The next episode starts on 9: its bars 11, 12, 13 recover, detected on 13 - bars 10 to 13 lie from 9 on.
    rows = hand(60, aligned={6, 7, 8, *range(11, 60)}, discordant={9, 10})
    steps, end = played(rows, "R3")
    found = [x for s in steps for x in s] + end
    tries = [(x["effective"] // 3600, x["detected"] // 3600, x["status"], x["failed_at"] and x["failed_at"] // 3600, x["reason"]) for x in found if x["kind"] == "ATTEMPT"]
    assert tries == [(6, 8, "FAILED_RECOVERY", 9, "TWO_DISCORDANT_BARS"), (11, 13, "CONFIRMED_RECOVERED_LONG", None, None)]
    assert [(x["start"] // 3600, x["end"] // 3600) for x in found if x["kind"] == "EPISODE"] == [(5, 8), (9, 13)]
    (section,) = [x for x in found if x["kind"] == "SECTION"]
    assert (section["effective"] // 3600, section["confirmed"] // 3600, section["episodes"], section["failed"]) == (11, 37, 2, 1)


def test_strength_by_hand():
    rows = hand(12, aligned=range(4, 12))
    for i, r in enumerate(rows):
        r["ema27"], r["gap"] = 10 + 0.1 * i, 1 + 0.1 * i
        r["close"] = r["ema27"] + 0.3
    kept = _Kept(rows)
    # Separation 0.3 and the ceiling fail; averages, gap, alignment and persistence hold: four, but neither of price: moderate.
    assert X.strength(kept, 11, 20.0)["type"] == "MODERATE_RECOVERY" and X.strength(kept, 11, 20.0)["score"] == 4
    # Above the ceiling it is strong.
    assert X.strength(kept, 11, 11.0)["type"] == "STRONG_RECOVERY" and X.strength(kept, 11, 11.0)["score"] == 5
    for r in rows:
        r["change"], r["gap1"] = -0.1, -0.1
    assert X.strength(kept, 11, 20.0) == {"type": "WEAK_RECOVERY", "score": 2, "ceiling": 20.0, "clearance": rows[11]["close"] - 20.0}


def test_prefix_never_changes_what_was_put_out():
    rows = prepared(walk(5, 500))
    for version in X.VERSIONS:
        steps, _ = played(rows, version)
        assert played(rows[:311], version)[0] == steps[:311]
