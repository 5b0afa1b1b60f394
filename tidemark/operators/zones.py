"""Disputed price zones and their hierarchical parent machine, as one program with typed outputs.

A zone begins where agreement with a rising trend is lost, gets an upper bound from the bodies of the
last aligned run and a lower bound from a first reaction, and then lives by three nested deciders: a local
candidate (closes beyond a bound), a regime of the fast average (departure from its own narrow band), and a joint
probation of both, which alone resolves the zone. Bounds are versioned: accepted shelves outside widen
them by the median of bodies, never by wicks.

All outputs come from one run as a tagged union; table() takes one kind out of it."""

from __future__ import annotations

from collections.abc import Generator
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import machines as M
from tidemark.operators.programs import Program, Rows, Step

# Fixed values of the surveyed rules.
CLEARANCE, RECLAIM, SHELF, RETEST = 0.15, 0.15, 0.10, 0.10  # in units of the true-range mean
LEAST, MOST, MAJORITY, RECLAIMS = 4, 12, 0.60, 3
JOINT_BARS, JOINT_OUTSIDE, JOINT_BEYOND, INSIDE_ENDS = 12, 8, 8, 2
DEPARTURE = 0.10
BANDS = {"SHORT": (12, 0.60, 0.35), "LONG": (24, 0.90, 0.50)}  # bars, widest band, largest net change
SEED_BARS, SEED_FALLBACK, RUN_REACH, LOOK_BACK = 18, 8, 30, 12
#: Rows that the program keeps behind its cursor: the aligned run's search and the fallback seed, with some to spare.
KEEP = 64

MODELS = ("JOINT", "SHORT_BAND", "PRICE_ONLY", "FIXED")

#: The outputs by kind: name and type of their columns. Columns of one name have one type.
TABLES = {
    "PARENT": "zone long, model string, start long, trigger long, bounds_at long, bounds_by string, first_upper double, first_lower double, upper double, lower double, version long, phases long, candidates long, joints long, failed_joints long, direction string, resolution string, effective long, end long",
    "PHASE": "zone long, model string, phase long, phase_type string, direction string, start long, effective long, decision long",
    "CANDIDATE": "zone long, model string, phase long, direction string, start long, decision long, status string, reason string, frozen double, unit double, bars long, outside long, longest_outside long, longest_reclaim long, effective long",
    "PRICE_REGIME": "zone long, model string, phase long, direction string, start long, effective long, decision long, outside long, reason string, end long",
    "EMA_REGIME": "zone long, model string, regime long, scale string, direction string, start long, decision long, class string, qualified boolean, band_low double, band_high double, reason string, end long",
    "REARM": "zone long, model string, scale string, kind_of string, t long, previous long",
    "JOINT": "zone long, model string, phase long, regime long, direction string, start long, decision long, status string, reason string, bars long, outside long, beyond long, longest_reclaim long, longest_inside long",
    "EXTENSION": "zone long, model string, phase long, direction string, start long, t long, old_bound double, new_bound double, version long, outside long, wick double",
    "EVENT": "zone long, model string, seq long, t long, before string, after string, event string, upper double, lower double",
    "BAR": "zone long, model string, t long, state string, upper double, lower double, version long, price_direction string, ema_direction string",
}


def columns_of(kind: str) -> dict[str, str]:
    return dict(c.split() for c in TABLES[kind].split(", "))


COLUMNS = {c: t for kind in TABLES for c, t in columns_of(kind).items()}


def beyond(row: dict, way: int, bound: float) -> bool:
    return way * (row["close"] - bound) > 0


def reclaimed(row: dict, way: int, bound: float) -> bool:
    return way * (bound - row["close"]) > RECLAIM * row["atr"]


def still_out(row: dict, way: int, bound: float) -> bool:
    """Beyond, or below a lower bound's retest."""
    return beyond(row, way, bound) or way < 0 and row["close"] <= bound + RETEST * row["atr"]


def name_of(way: int) -> str:
    return "UP" if way > 0 else "DOWN"


def middle_of_extremes(values: list[float], way: int) -> float:
    """Median of the three values furthest to the side of way."""
    return median(sorted(values, reverse=way > 0)[:3])


def last_run(rows: Rows, trigger: int) -> tuple[int, int] | None:
    """(last bar of the aligned run before the trigger, bar of its first streak's end): three of four bars aligned, at most RUN_REACH back."""
    for end in range(trigger - 1, max(0, trigger - RUN_REACH) + 2, -1):
        aligned = [k for k in range(end - 3, end + 1) if rows[k]["aligned"]]
        if len(aligned) >= 3:
            streak = last = aligned[0]
            while streak + 1 <= end and rows[streak + 1]["aligned"]:
                streak += 1
            last = aligned[-1]
            while last + 1 < trigger and rows[last + 1]["aligned"]:
                last += 1
            return last, streak
    return None


def zone_start(rows: Rows, trigger: int, run: tuple[int, int] | None) -> int:
    """The first bar behind the run with two discordant facts, or one on it and on the next."""
    loose = lambda k, n: rows[k]["context"] and rows[k]["discord"] >= n
    restored = lambda k: any(sum(r["aligned"] for r in rows.span(j - 3, j)) >= 3 for j in range(max(k + 3, 3), trigger + 1))
    for k in range(run[0] + 1 if run else max(0, trigger - LOOK_BACK), trigger + 1):
        if (loose(k, 2) or k < trigger and loose(k, 1) and loose(k + 1, 1)) and (run or not restored(k)):
            return k
    return trigger


def upper_seed(rows: Rows, start: int, run: tuple[int, int] | None) -> tuple[float, float]:
    """(bound, wick) from the run's bodies, or from the bars before the start. A streak's extremes come with its bars (see with_streak())."""
    if run:
        last, streak = run
        head, rest = rows[streak], rows.span(streak + 1, last)
        return middle_of_extremes([*head["streak_bodies"], *[r["body_high"] for r in rest]], 1), max([head["streak_high"], *[r["high"] for r in rest]])
    before = rows.span(max(0, start - LOOK_BACK), max(0, start - 1))
    return middle_of_extremes([r["body_high"] for r in before], 1), max(r["high"] for r in before)


def lower_seed(rows: Rows, start: int, wick: float) -> Generator[None, None, tuple[int, float | None, str]]:
    """(bar, bound, rule): the first reaction from a low, or after SEED_BARS a range that holds; bound None if neither."""
    low, crossings, last = float("inf"), 0, start
    for k in range(start, start + SEED_BARS):
        if not (yield from rows.has(k)):
            break
        row, last = rows[k], k
        low = min(low, row["low"])
        crossings += k > start and (row["close"] >= row["ema27"]) != (rows[k - 1]["close"] >= rows[k - 1]["ema27"])
        recent = rows.span(max(start, k - 2), k)
        rising = len(recent) == 3 and recent[0]["close"] < recent[1]["close"] < recent[2]["close"]
        nearing = k >= 2 and all(rows[j]["close"] - rows[j]["ema27"] > rows[j - 1]["close"] - rows[j - 1]["ema27"] for j in (k - 1, k))
        near = nearing or any(r["close"] > r["ema27"] for r in recent)
        if rising and near and wick - low >= row["atr"] and row["close"] - low >= 0.75 * row["atr"]:
            return k, middle_of_extremes([r["body_low"] for r in rows.span(start, k)], -1), "LOWER_REACTION_CONFIRMED"
    seen = rows.span(start, last)
    inside = sum(low <= r["close"] <= wick for r in seen) / len(seen)
    if len(seen) >= SEED_FALLBACK and wick - low >= 1.25 * rows[last]["atr"] and crossings >= 2 and inside >= 0.70:
        return last, middle_of_extremes([r["body_low"] for r in seen], -1), "BOUNDS_FALLBACK_CONFIRMED"
    return last, None, "BOUNDS_NOT_CONFIRMED"


def shelf(seen: list[dict], way: int, bound: float, unit: float) -> float | None:
    """The bound that an accepted extension proposes: three closes outside, two in a row, their median clear of the bound."""
    out = [r for r in seen if beyond(r, way, bound)]
    pairs = any(beyond(a, way, bound) and beyond(b, way, bound) for a, b in zip(seen, seen[1:], strict=False))
    if len(out) < 3 or not pairs or way * (median(r["close"] for r in out) - bound) < SHELF * unit:
        return None
    best = middle_of_extremes([r["body_high" if way > 0 else "body_low"] for r in out], way)
    return max(bound, best) if way > 0 else min(bound, best)


class Zone:
    """What is true of the zone that is alive."""

    def __init__(self, number: int, model: str, start: int, upper: float, lower: float) -> None:
        self.number, self.model, self.start = number, model, start
        self.bounds, self.version = {1: upper, -1: lower}, 1
        self.events = self.phases = self.candidates = self.joints = self.failed = 0
        self.price: dict | None = None  # the price regime outside a bound
        self.ema: dict | None = None  # the regime of the average outside its band
        self.departing: dict | None = None  # the average's departure before it is confirmed
        self.regimes, self.armed, self.confirmed_at, self.new_band = 0, True, None, False
        self.open_phase: dict | None = None

    def out(self, kind: str, **values: object) -> dict:
        return {"kind": kind, "zone": self.number, "model": self.model, **values}

    def event(self, row: dict, before: str, after: str, event: str) -> dict:
        self.events += 1
        return self.out("EVENT", seq=self.events, t=row["t"], before=before, after=after, event=event, upper=self.bounds[1], lower=self.bounds[-1])

    def bar(self, row: dict, state: str) -> dict:
        return self.out("BAR", t=row["t"], state=state, upper=self.bounds[1], lower=self.bounds[-1], version=self.version, price_direction=self.price and name_of(self.price["way"]), ema_direction=self.ema and name_of(self.ema["way"]))

    def widen(self, seen: list[dict], way: int, unit: float, phase: int) -> list[dict]:
        """An accepted extension over the bars seen, or nothing."""
        old = self.bounds[way]
        new = shelf(seen, way, old, unit)
        if new is None:
            return []
        self.bounds[way] = new
        self.version += 1
        wick = max(r["high"] for r in seen) if way > 0 else min(r["low"] for r in seen)
        return [self.out("EXTENSION", phase=phase, direction=name_of(way), start=seen[0]["t"], t=seen[-1]["t"], old_bound=old, new_bound=new, version=self.version, outside=sum(beyond(r, way, old) for r in seen), wick=wick)]

    def end_price(self, row: dict, reason: str) -> list[dict]:
        p, phase, self.price, self.open_phase = self.price, self.open_phase, None, None
        return [phase, self.out("PRICE_REGIME", phase=p["phase"], direction=name_of(p["way"]), start=p["start_t"], effective=p["effective"], decision=p["decision"], outside=p["outside"], reason=reason, end=row["t"])]

    def end_ema(self, row: dict | None, reason: str | None) -> dict:
        e, self.ema = self.ema, None
        return self.out("EMA_REGIME", regime=e["regime"], scale=e["scale"], direction=name_of(e["way"]), start=e["start_t"], decision=e["decision"], **{"class": e["class"]}, qualified=e["qualified"], band_low=e["low"], band_high=e["high"], reason=reason, end=row and row["t"])

    def scale(self, i: int) -> str:
        return "SHORT" if self.model == "SHORT_BAND" or i - self.start < BANDS["LONG"][0] else "LONG"

    def see_average(self, i: int, row: dict) -> list[dict]:
        """One bar of the average's regime: its return into the band, a departure, or its confirmation on the next bar."""
        if self.model in ("PRICE_ONLY", "FIXED"):
            return []
        out = []
        if self.ema:
            inside = self.ema["low"] <= row["ema27"] <= self.ema["high"]
            self.ema["inside"] = self.ema["inside"] + 1 if inside else 0
            if self.ema["inside"] >= INSIDE_ENDS:
                out.append(self.out("REARM", scale=self.ema["scale"], kind_of="RETURN_REARM", t=row["t"], previous=self.ema["decision"]))
                out.append(self.end_ema(row, "EMA_RETURN_TERMINATION"))
                self.armed, self.new_band = True, False
        scale = self.scale(i)
        if self.departing is None:
            self.departing = self.departure(i, row, scale)
            return out
        d, self.departing = self.departing, None
        if d["scale"] != scale and self.model != "SHORT_BAND" or d["way"] * (row["ema27"] - d["edge"]) <= 0:
            return out
        if self.ema:  # a new band takes over from a regime that never returned
            out.append(self.end_ema(None, None))
        if self.new_band and self.confirmed_at is not None:
            out.append(self.out("REARM", scale=d["scale"], kind_of="NEW_BAND_REARM", t=row["t"], previous=self.confirmed_at[1]))
        qualified = d["way"] * (row["gap6"] or 0.0) > 0
        classes = {(1, True): "UP_AWAY_FROM_EMA200", (1, False): "UP_GAP_NOT_EXPANDING", (-1, True): "DOWN_TOWARD_EMA200", (-1, False): "DOWN_GAP_NOT_SHRINKING"}
        self.regimes += 1
        self.ema = d | {"regime": self.regimes, "decision": row["t"], "at": i, "class": classes[d["way"], qualified], "qualified": qualified, "inside": 0}
        self.confirmed_at, self.armed, self.new_band = (i, row["t"]), False, False
        return out

    def departure(self, i: int, row: dict, scale: str) -> dict | None:
        low, high, compact = (row[f"{scale.lower()}_{c}"] for c in ("low", "high", "compact"))
        if low is None or not compact:
            return None
        up = row["ema27"] > high + DEPARTURE * row["atr"] and (row["change"] or 0.0) > 0
        down = row["ema27"] < low - DEPARTURE * row["atr"] and (row["change"] or 0.0) < 0
        if not (up or down):
            return None
        if not self.armed:
            if i - BANDS[scale][0] <= self.confirmed_at[0]:  # the band still holds bars of the last regime
                return None
            self.armed = self.new_band = True
        return {"scale": scale, "way": 1 if up else -1, "edge": high if up else low, "low": low, "high": high, "start_t": row["t"]}


def local_candidate(rows: Rows, i: int, way: int, bound: float) -> Generator[None, None, dict]:
    """Decides within MOST bars whether closes beyond a bound are a departure."""
    seen: list[dict] = []
    outside = confirming = run = reclaims = longest_out = longest_in = 0
    first, above_slow = None, True
    for k in range(i, i + MOST):
        if not (yield from rows.has(k)):
            break
        row = rows[k]
        seen.append(row)
        out, back = beyond(row, way, bound), reclaimed(row, way, bound)
        first = k if out and first is None else first
        outside, confirming = outside + out, confirming + (way * (row["close"] - row["ema27"]) > 0)
        run, reclaims = run + 1 if out else 0, reclaims + 1 if back else 0
        longest_out, longest_in = max(longest_out, run), max(longest_in, reclaims)
        above_slow = above_slow and row["ema27"] > row["ema200"]
        enough = min(outside, confirming) >= MAJORITY * len(seen)
        if len(seen) >= LEAST and enough and still_out(row, way, bound) and longest_in < RECLAIMS and (way < 0 or above_slow):
            return {"at": k, "accepted": True, "reason": None, "first": first, "seen": seen, "outside": outside, "longest_outside": longest_out, "longest_reclaim": longest_in}
        if reclaims >= RECLAIMS:
            break
    reason = "THREE_CONSECUTIVE_DEEP_RECLAIMS" if reclaims >= RECLAIMS else "MAX_DECISION_BARS_REACHED"
    return {"at": i + len(seen) - 1, "accepted": False, "reason": reason, "first": None, "seen": seen, "outside": outside, "longest_outside": longest_out, "longest_reclaim": longest_in}


def joint_probation(rows: Rows, i: int, way: int, bound: float, ema: dict) -> Generator[None, None, dict]:
    """JOINT_BARS bars in which price and average stay out together; a reclaim or a return aborts."""
    outside = past = deep = inside = most_deep = most_inside = n = 0
    status, reason = "FAILED", "INSUFFICIENT_BARS"
    for k in range(i, i + JOINT_BARS):
        if not (yield from rows.has(k)):
            break
        row, n = rows[k], n + 1
        outside, past = outside + beyond(row, way, bound), past + (way * (row["ema27"] - ema["edge"]) > 0)
        deep = deep + 1 if reclaimed(row, way, bound) else 0
        inside = inside + 1 if ema["low"] <= row["ema27"] <= ema["high"] else 0
        most_deep, most_inside = max(most_deep, deep), max(most_inside, inside)
        if deep >= RECLAIMS or inside >= INSIDE_ENDS:
            reason = "PRICE_DEEP_RECLAIM" if deep >= RECLAIMS else "EMA_RETURN_INSIDE_BAND"
            break
        if n == JOINT_BARS:
            grown = way * (row["gap"] - rows[i]["gap"]) > 0
            held = outside >= JOINT_OUTSIDE and past >= JOINT_BEYOND and still_out(row, way, bound) and way * (row["ema27"] - ema["edge"]) > 0
            confirmed = held and grown and (way < 0 or row["ema27"] > row["ema200"])
            status, reason = ("CONFIRMED", "JOINT_PERSISTENCE_CONFIRMED") if confirmed else ("FAILED", "JOINT_12_BAR_CRITERIA_NOT_MET")
    return {"at": i + n - 1, "status": status, "reason": reason, "bars": n, "outside": outside, "beyond": past, "longest_reclaim": most_deep, "longest_inside": most_inside}


def live(rows: Rows, zone: Zone, i: int) -> Generator[dict | None, None, dict | None]:
    """The zone's bars from i on until it is resolved; None if the rows end before."""
    while (yield from rows.has(i)):
        row = rows[i]
        yield from zone.see_average(i, row)
        yield zone.bar(row, "ACTIVE")
        p = zone.price
        if p:
            bound = zone.bounds[p["way"]]
            p["outside"] += beyond(row, p["way"], bound)
            p["reclaims"] = p["reclaims"] + 1 if reclaimed(row, p["way"], bound) else 0
            if p["reclaims"] >= RECLAIMS:
                yield from zone.widen(rows.span(p["start"], i), p["way"], p["unit"], p["phase"])
                yield from zone.end_price(row, "PRICE_RETURN_TERMINATION")
                yield zone.event(row, "PRICE_OUTSIDE", "ACTIVE", "PRICE_RETURN_TERMINATION")
        p, e = zone.price, zone.ema
        if p and e and e["qualified"] and p["way"] == e["way"]:
            zone.joints += 1
            yield zone.event(row, "ACTIVE", "JOINT", "JOINT_OVERLAP_START")
            j = yield from joint_probation(rows, i, p["way"], zone.bounds[p["way"]], e)
            last = rows[j["at"]]
            for r in rows.span(i + 1, j["at"]):
                yield zone.bar(r, "JOINT")
            yield zone.out("JOINT", phase=p["phase"], regime=e["regime"], direction=name_of(p["way"]), start=row["t"], decision=last["t"], **{k: v for k, v in j.items() if k != "at"})
            if j["status"] == "CONFIRMED":
                resolution = f"CONFIRMED_PARENT_{name_of(p['way'])}_RESOLUTION"
                yield from zone.end_price(last, "PARENT_RESOLUTION")
                yield zone.event(last, "JOINT", "RESOLVED", resolution)
                return {"at": j["at"], "direction": name_of(p["way"]), "resolution": resolution, "effective": p["effective"]}
            zone.failed += 1
            zone.open_phase["phase_type"] = f"INTERNAL_FAILED_JOINT_{name_of(p['way'])}_RESOLUTION"
            yield zone.event(last, "JOINT", "ACTIVE", "FAILED_JOINT")
            if j["reason"] == "PRICE_DEEP_RECLAIM":
                yield from zone.widen(rows.span(p["start"], j["at"]), p["way"], p["unit"], p["phase"])
                yield from zone.end_price(last, "FAILED_JOINT_PRICE_DEEP_RECLAIM")
            if j["reason"] == "EMA_RETURN_INSIDE_BAND":
                yield zone.end_ema(last, "FAILED_JOINT_EMA_RETURN")
            i = j["at"] + 1
            continue
        way = next((w for w in (1, -1) if w * (row["close"] - zone.bounds[w]) > CLEARANCE * row["atr"]), 0)
        if p is None and way:
            bound, direction = zone.bounds[way], name_of(way)
            zone.candidates, zone.phases = zone.candidates + 1, zone.phases + 1
            c = yield from local_candidate(rows, i, way, bound)
            last = rows[c["at"]]
            for r in c["seen"][1:]:
                yield zone.bar(r, "CANDIDATE")
            effective = rows_t(c["seen"], c["first"], i)
            widened = [] if c["accepted"] or zone.model == "FIXED" else zone.widen(c["seen"], way, row["atr"], zone.phases)
            status = f"LOCAL_ACCEPTED_{direction}_DEPARTURE" if c["accepted"] else f"LOCAL_ACCEPTED_{direction}_EXTENSION" if widened else f"LOCAL_REJECTED_{direction}_EXCURSION"
            counts = {k: c[k] for k in ("reason", "outside", "longest_outside", "longest_reclaim")}
            yield zone.out("CANDIDATE", phase=zone.phases, direction=direction, start=row["t"], decision=last["t"], status=status, frozen=bound, unit=row["atr"], bars=len(c["seen"]), effective=effective, **counts)
            yield from widened
            phase = zone.out("PHASE", phase=zone.phases, phase_type=status.replace("LOCAL_ACCEPTED", "INTERNAL" if c["accepted"] else "INTERNAL_ACCEPTED").replace("LOCAL_REJECTED", "INTERNAL_REJECTED"), direction=direction, start=row["t"], effective=effective, decision=last["t"])
            if not c["accepted"]:
                yield phase
            elif zone.model in ("PRICE_ONLY", "FIXED"):
                yield phase
                yield zone.event(last, "CANDIDATE", "RESOLVED", f"CONFIRMED_PARENT_{direction}_RESOLUTION")
                return {"at": c["at"], "direction": direction, "resolution": f"CONFIRMED_PARENT_{direction}_RESOLUTION", "effective": effective}
            else:
                zone.open_phase = phase  # a failed joint may still rename it
                zone.price = {"way": way, "phase": zone.phases, "start": i, "start_t": row["t"], "effective": effective, "decision": last["t"], "unit": row["atr"], "outside": c["outside"], "reclaims": 0}
                yield zone.event(last, "CANDIDATE", "PRICE_OUTSIDE", "LOCAL_ACCEPTED_DEPARTURE")
            i = c["at"] + 1
            continue
        i += 1
        rows.forget(min(i - KEEP, zone.price["start"] if zone.price else i))
    return None


def rows_t(seen: list[dict], k: int | None, first: int) -> int | None:
    return None if k is None else seen[k - first]["t"]


def parents(model: str):  # noqa: ANN201
    """The program of a model: JOINT needs both regimes to resolve a zone, SHORT_BAND with the short band alone;
    PRICE_ONLY takes the first departure, FIXED as well and never widens a bound."""

    def program(rows: Rows) -> Step:
        cursor = number = 0
        while True:
            trigger = cursor
            while (yield from rows.has(trigger)) and not rows[trigger]["core"]:
                trigger += 1
                rows.forget(trigger - KEEP)
            if trigger >= len(rows):
                return
            run = last_run(rows, trigger)
            start = zone_start(rows, trigger, run)
            if start < cursor:
                cursor = trigger + 1
                continue
            first_upper, wick = upper_seed(rows, start, run)
            at, first_lower, rule = yield from lower_seed(rows, start, wick)
            if first_lower is None:
                cursor = trigger + 1  # rewinds: later triggers among the bars just seen get their turn
                continue
            number += 1
            zone = Zone(number, model, start, first_upper, first_lower)
            seeds = {"start": rows[start]["t"], "trigger": rows[trigger]["t"], "bounds_at": rows[at]["t"], "bounds_by": rule, "first_upper": first_upper, "first_lower": first_lower}
            yield zone.event(rows[start], "NO_PARENT", "BUILDING", "PARENT_START")
            yield zone.event(rows[at], "BUILDING", "ACTIVE", "BOUNDS_CONFIRMED")
            resolved = yield from live(rows, zone, at + 1)
            end = resolved["at"] if resolved else len(rows) - 1
            reason = "PARENT_RESOLUTION" if resolved else "TRAIN_END"
            if zone.price:
                yield from zone.end_price(rows[end], reason)
            if zone.ema:
                yield zone.end_ema(rows[end], reason)
            r = resolved or {"direction": None, "resolution": "OPEN_AT_TRAIN_END", "effective": None}
            yield zone.out("PARENT", **seeds, upper=zone.bounds[1], lower=zone.bounds[-1], version=zone.version, phases=zone.phases, candidates=zone.candidates, joints=zone.joints, failed_joints=zone.failed, end=rows[end]["t"], **{k: r[k] for k in ("direction", "resolution", "effective")})
            cursor = end + 1

    return program


def with_streak(row: dict, before: dict | None) -> None:
    """The largest bodies and the high of the aligned streak that a row ends."""
    if row["aligned"]:
        old = before if before and before["aligned"] else {"streak_bodies": [], "streak_high": row["high"]}
        row["streak_bodies"] = sorted([row["body_high"], *old["streak_bodies"]], reverse=True)[:3]
        row["streak_high"] = max(row["high"], old["streak_high"])


def features(bars: DataFrame) -> DataFrame:
    """Bars with what the program asks of each: averages, unit, agreement, triggers and the average's bands before the bar."""
    x = S.true_range(bars)
    for value, alpha, out in (("close", 2 / 28, "ema27"), ("close", 2 / 201, "ema200"), ("tr", 1 / 14, "atr")):
        x = S.ema(x, value, alpha, out)
    back = lambda c, n=1: F.lag(c, n).over(S.order())
    true = lambda c: F.coalesce(c, F.lit(False))
    x = x.withColumn("gap", F.col("ema27") - F.col("ema200"))
    x = x.withColumns({"change": F.col("ema27") - back("ema27"), "gap1": F.col("gap") - back("gap"), "gap6": F.try_divide(F.col("gap") - back("gap", 6), "atr"), "context": true((F.col("ema27") > F.col("ema200")) & (F.col("ema200") > back("ema200", 6)))})
    falling = (F.col("ema27") < back("ema27", 2)) | (F.col("ema27") < back("ema27", 3))
    against = [F.col("close") <= F.col("ema27"), F.col("change") <= 0, F.col("gap1") < 0]
    x = x.withColumns(
        {
            "body_high": F.greatest("open", "close"), "body_low": F.least("open", "close"),
            "core": F.col("context") & true(F.col("change") < 0) & true(falling) & (F.col("close") < F.col("ema27")),
            "aligned": F.col("context") & (F.col("close") > F.col("ema27")) & true(F.col("change") > 0) & true(F.col("gap1") >= 0),
            "discord": sum((true(a).cast("long") for a in against), F.lit(0).cast("long")),
        }
    )
    for name, (n, width, net) in BANDS.items():
        frame, low, high = S.order().rowsBetween(-n, -1), f"{name.lower()}_low", f"{name.lower()}_high"
        full = lambda c, frame=frame, n=n: F.when(F.count("ema27").over(frame) == n, c.over(frame))
        x = x.withColumns({low: full(F.min("ema27")), high: full(F.max("ema27"))})
        x = x.withColumn(f"{name.lower()}_compact", true((F.col(high) - F.col(low) <= width * F.col("atr")) & (F.abs(back("ema27") - back("ema27", n)) <= net * F.col("atr"))))
    asked = "t open high low close ema27 ema200 atr gap change gap6 context core aligned discord body_high body_low short_low short_high short_compact long_low long_high long_compact"
    return x.select("symbol", *asked.split())


def run(bars: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """The tagged union of all outputs of every symbol and model."""
    keyed = features(bars).withColumn("model_", F.explode(F.array(*[F.lit(m) for m in models]))).withColumn("key", F.concat_ws("|", "symbol", "model_"))
    names = ["kind", *COLUMNS]
    rows = keyed.drop("symbol", "model_")
    made = M.run_by_key(rows, "key", ["t"], lambda key: Program(parents(key.rsplit("|", 1)[1]), names, with_streak), ", ".join(["kind string", *[f"{c} {t}" for c, t in COLUMNS.items()]]))
    return made.withColumn("symbol", F.expr("substring(key, 1, length(key) - length(substring_index(key, '|', -1)) - 1)"))


def table(outputs: DataFrame, kind: str) -> DataFrame:
    return outputs.where(F.col("kind") == kind).select("symbol", *columns_of(kind))
