"""Sequential state machines over keyed, ordered rows.

A kernel is a generator-like object with step(row) -> list of output tuples and close() -> the same.
Rows of a key reach one task in order and are read as a stream: a task holds one kernel's state, never
a key's rows. The same kernels run under Structured Streaming (tidemark.streaming.replay)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def run(rows: DataFrame, key: str, order: list[str], kernel: Callable[[], object], schema: str) -> DataFrame:
    """(key, *schema): what the kernel of each key makes of its rows in order."""
    return run_by_key(rows, key, order, lambda _: kernel(), schema)


def run_by_key(rows: DataFrame, key: str, order: list[str], kernel: Callable[[object], object], schema: str) -> DataFrame:
    """run() with a kernel that depends on the key."""
    columns = rows.columns
    types: StructType = _parse_datatype_string(f"{key} {rows.schema[key].dataType.simpleString()}, {schema}")
    arrow = to_arrow_schema(types)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, machine, out = None, None, []

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], f.type) for k, f in enumerate(arrow)], schema=arrow)

        for batch in batches:
            for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                row = dict(zip(columns, values, strict=True))
                if machine is None or row[key] != now:
                    if machine is not None:
                        out += [(now, *x) for x in machine.close()]
                    now, machine = row[key], kernel(row[key])
                out += [(now, *x) for x in machine.step(row)]
            if out:
                yield batch_of(out)
                out = []
        if machine is not None and (out := [(now, *x) for x in machine.close()]):
            yield batch_of(out)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(sweep, types)


class Debounce:
    """A state is taken on once two rows in a row propose it; a crossing makes TRANSITION at once, WARMUP holds
    at once, and both forget what was proposed. The stream's form of states.debounced."""

    def __init__(self) -> None:
        self.state, self.before = "WARMUP", None

    def step(self, row: dict) -> list[tuple]:
        proposed = row["state"]
        if proposed == "WARMUP":
            self.state, self.before = "WARMUP", None
        elif row.get("crossed"):
            self.state, self.before = "TRANSITION", None
        else:
            if proposed == self.before:
                self.state = proposed
            self.before = proposed
        return [(row["t"], proposed, self.state)]

    def close(self) -> list[tuple]:
        return []


class Greedy:
    """Keeps the first of rows that lie closer than `reach` to the last one kept."""

    def __init__(self, reach: int) -> None:
        self.reach, self.kept = reach, None

    def step(self, row: dict) -> list[tuple]:
        if self.kept is None or row["t"] >= self.kept + self.reach:
            self.kept = row["t"]
            return [(row["t"],)]
        return []

    def close(self) -> list[tuple]:
        return []


class MoveAge:
    """Bars since the running move began: it turns once the close retreats by `turn` units from its extreme."""

    def __init__(self, turn: float = 2.0) -> None:
        self.turn, self.side, self.age, self.extreme = turn, 0, 0, None

    def step(self, row: dict) -> list[tuple]:
        close, unit = row["close"], row["atr"]
        if self.extreme is None:
            self.extreme = close
        elif unit:
            if self.side == 0 and abs(close - self.extreme) >= self.turn * unit:
                self.side, self.age, self.extreme = (1 if close > self.extreme else -1), 0, close
            elif self.side and self.side * (self.extreme - close) >= self.turn * unit:
                self.side, self.age, self.extreme = -self.side, 0, close
            else:
                self.age += 1
                if self.side and self.side * (close - self.extreme) > 0:
                    self.extreme = close
        return [(row["t"], self.side, self.age, float(self.extreme))]

    def close(self) -> list[tuple]:
        return []


class Hysteresis:
    """ON above `high`, OFF below `low`, else what it was."""

    def __init__(self, low: float, high: float) -> None:
        self.low, self.high, self.on = low, high, False

    def step(self, row: dict) -> list[tuple]:
        x = row["x"]
        if x is not None:
            self.on = x > self.high or self.on and x >= self.low
        return [(row["t"], self.on)]

    def close(self) -> list[tuple]:
        return []


class Zone:
    """Breakouts of a band need `confirm` closes in a row beyond it by `margin` units; the band then starts anew."""

    def __init__(self, length: int = 12, margin: float = 0.15, confirm: int = 2) -> None:
        self.length, self.margin, self.confirm = length, margin, confirm
        self.seed: list[dict] = []
        self.start, self.top, self.bottom, self.side, self.n, self.version = None, None, None, 0, 0, 0

    def step(self, row: dict) -> list[tuple]:
        if self.top is None:
            self.seed.append(row)
            if len(self.seed) < self.length:
                return []
            self.start, self.top, self.bottom = self.seed[0]["t"], max(r["high"] for r in self.seed), min(r["low"] for r in self.seed)
            self.seed, self.side, self.n = [], 0, 0
            return [("OPEN", row["t"], self.start, self.top, self.bottom, self.version, 0)]
        beyond = self.margin * (row["atr"] or 0.0)
        side = 1 if row["close"] > self.top + beyond else -1 if row["close"] < self.bottom - beyond else 0
        self.n = self.n + 1 if side and side == self.side else int(side != 0)
        self.side = side
        if self.n < self.confirm:
            return []
        out = [("EXIT", row["t"], self.start, self.top, self.bottom, self.version, side)]
        self.top, self.version = None, self.version + 1
        return out

    def close(self) -> list[tuple]:
        return [] if self.top is None else [("CENSORED", None, self.start, self.top, self.bottom, self.version, 0)]


class Backtest:
    """One position at a time: signal on a close, fill at the next open with slippage, a stop `stop` units away
    (hit within the bar), exit at the open after the side turns; costs on both fills; the rest is closed at the end."""

    def __init__(self, stop: float = 1.5, slippage: float = 0.0005, fee: float = 0.001) -> None:
        self.stop, self.slippage, self.fee = stop, slippage, fee
        self.order, self.leave, self.position, self.last = 0, False, None, None

    def out(self, t: int, price: float, reason: str) -> tuple:
        p, self.position = self.position, None
        gross = p["side"] * (price / p["price"] - 1)
        return (p["t"], t, p["side"], p["price"], price, reason, p["bars"], gross, gross - 2 * self.fee, p["mfe"], p["mae"])

    def step(self, row: dict) -> list[tuple]:
        done, self.last = [], row
        if self.position and self.leave:
            done.append(self.out(row["t"], row["open"] * (1 - self.position["side"] * self.slippage), "TURN"))
        if self.order and not self.position and row["open"] > 0:
            price = row["open"] * (1 + self.order * self.slippage)
            stop = price - self.order * self.stop * row["atr_before"]
            self.position = {"t": row["t"], "side": self.order, "price": price, "stop": stop, "bars": 0, "mfe": 0.0, "mae": 0.0}
        self.order, self.leave = 0, False
        if p := self.position:
            p["bars"] += 1
            best, worst = (row["high"], row["low"]) if p["side"] > 0 else (row["low"], row["high"])
            p["mfe"], p["mae"] = max(p["mfe"], p["side"] * (best / p["price"] - 1)), min(p["mae"], p["side"] * (worst / p["price"] - 1))
            if p["side"] * (worst - p["stop"]) <= 0:
                done.append(self.out(row["t"], p["stop"], "STOP"))
            elif row["side"] == -p["side"]:
                self.leave = True
        if not self.position and row["signal"] and row["atr_before"]:
            self.order = row["signal"]
        return done

    def close(self) -> list[tuple]:
        return [self.out(self.last["t"], self.last["close"], "END")] if self.position else []


class CoolDown:
    """Keeps a candidate `any_` rows after the last one kept and `same` rows after the last of its direction."""

    def __init__(self, any_: int = 6, same: int = 12) -> None:
        self.any, self.same, self.last, self.of = any_, same, None, {}

    def step(self, row: dict) -> list[tuple]:
        i, way = row["i"], row["direction"]
        if self.last is not None and i - self.last < self.any or way in self.of and i - self.of[way] < self.same:
            return []
        self.last = self.of[way] = i
        return [(row["t"], i, way)]

    def close(self) -> list[tuple]:
        return []


class Backbone:
    """A state is taken on after two rows that propose it, after three from LOST to ACTIVE; WARMUP, TRANSITION and
    a LOST steeper than `steep` count at once."""

    def __init__(self, steep: float = -1.5) -> None:
        self.steep, self.state, self.candidate, self.n = steep, "WARMUP", None, 0

    def step(self, row: dict) -> list[tuple]:
        base = row["base"]
        if base in ("WARMUP", "TRANSITION") or base == self.state or base == "LOST" and row["slope"] < self.steep:
            self.state, self.candidate, self.n = base, None, 0
        else:
            self.n = self.n + 1 if base == self.candidate else 1
            self.candidate = base
            if self.n >= (3 if (self.state, base) == ("LOST", "ACTIVE") else 2):
                self.state, self.candidate, self.n = base, None, 0
        return [(row["t"], base, self.state)]

    def close(self) -> list[tuple]:
        return []


def ratio(a: float, b: float) -> float:
    """a / b as SQL divides doubles: infinite over zero, NaN for 0 / 0."""
    return a / b if b else a * math.inf


class LocalPhase:
    """Phases of price in the averages' direction: a close against it opens a correction (PULLBACK), a close beyond the bar before turns it to
    RECOVERY, one beyond the extreme of the three bars before the correction is its RESUMPTION, and averages that change sides its CONTEXT_LOSS.
    Two kinds of output: BAR for every row, CORRECTION when one ends; a resumed one is over with that bar."""

    def __init__(self) -> None:
        self.n, self.c, self.last = 0, None, None

    def ended(self, row: dict, status: str) -> tuple:
        c, self.c = self.c, None
        return ("CORRECTION", row["t"], c["way"], None, status, c["number"], c["start"], c["bars"], c["depth"], c["near"], c["tries"])

    def bar(self, row: dict, way: int, phase: str, event: str | None, number: int | None) -> tuple:
        return ("BAR", row["t"], way, phase, event, number, None, None, None, None, None)

    def step(self, row: dict) -> list[tuple]:
        way, before, self.last = 1 if row["fast"] > row["slow"] else -1, self.last, row
        done, out = self.c == "RESUMED", []
        held = None if done else self.c
        turned = self.of * (row["fast"] - row["slow"]) <= 0 if self.c else False
        if done or turned:
            if held:
                out.append(self.ended(row, "CONTEXT_LOSS"))
            self.c = None
        if turned:
            return [*out, self.bar(row, way, "CONTEXT_LOSS", "CONTEXT_LOSS", None)]
        event = None
        if self.c is None:
            if before is None or way * (row["close"] - before["close"]) >= 0:
                return [*out, self.bar(row, way, "EXPANSION", None, None)]
            self.n, self.of, event = self.n + 1, way, "CORRECTION_START"
            extreme = row["high3"] if way > 0 else row["low3"]
            self.c = {"number": self.n, "way": way, "start": row["t"], "extreme": extreme, "furthest": row["low"] if way > 0 else row["high"], "bars": 0, "depth": 0.0, "near": None, "tries": 0, "back": False}
        c, way = self.c, self.of
        c["bars"] += 1
        c["furthest"] = min(c["furthest"], row["low"]) if way > 0 else max(c["furthest"], row["high"])
        deep = ratio(way * (c["extreme"] - c["furthest"]), c["extreme"]) * 100
        c["depth"] = 0.0 if deep < 0 else deep
        near = ratio(abs(row["close"] - row["fast"]), row["fast"]) * 100
        c["near"] = near if c["near"] is None or near < c["near"] or c["near"] != c["near"] else c["near"]
        move, past = way * (row["close"] - before["close"]), way * (row["close"] - c["extreme"])
        if c["back"] and move < 0 and past <= 0:
            c["back"], c["tries"], phase, event = False, c["tries"] + 1, "PULLBACK", "RECOVERY_FAILED"
        elif past > 0:
            out.append(self.bar(row, way, "RESUMPTION", "RESUMPTION", c["number"]))
            out.append(self.ended(row, "RESUMPTION"))
            self.c = "RESUMED"
            return out
        elif move > 0 and way * (row["close"] - before["high" if way > 0 else "low"]) > 0:
            c["tries"] += not c["back"]
            c["back"], phase, event = True, "RECOVERY", "RECOVERY"
        else:
            phase = "RECOVERY" if c["back"] else "PULLBACK"
        return [*out, self.bar(row, way, phase, event, c["number"])]

    def close(self) -> list[tuple]:
        return [self.ended(self.last, "OPEN_END")] if self.c and self.c != "RESUMED" else []


LOCAL = "kind string, t long, way int, phase string, event string, number long, start long, bars long, depth double, near double, tries long"
TRADE = "entry_t long, exit_t long, side int, entry double, exit double, reason string, bars int, gross double, net double, mfe double, mae double"
