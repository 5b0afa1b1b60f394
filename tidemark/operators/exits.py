"""Exits of independent entries: every signal is a trade of its own, and each of six rules ends it in its own way.

A signal on a bar fills at the next bar's open, with slippage; its stop is the extreme of the last STOP_BARS bars. On every later bar the
stop comes first, then the turn of the regime, then the rule; what a close decides fills at the next open. The last bar of the data is
only closed on. R0: two closes beyond the average. R1: the stop moves to the entry and its costs once a unit was gained, the bar's own
extreme included. R2: a unit is given back of one and a half or more. R3: half of a unit or more is given back. R4: a close beyond the average warns, one back inside
cancels, another beyond it or beyond the warning bar's extreme ends. R5: R3 and R4."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators import machines as M

# Fixed values of the surveyed rules.
SLIP, FEE, STOP_BARS = 0.0005, 0.001, 5
EVEN_AT, GIVE_FROM, GIVE, HALF_FROM = 1.0, 1.5, 1.0, 1.0
RULES = ("R0", "R1", "R2", "R3", "R4", "R5")
SCHEMA = "rule string, side int, signal_t long, entry_t long, exit_t long, entry double, stop double, exit double, reason string, bars int, gross double, net double, mfe double, mae double, capture double, giveback double, even boolean"


class Trade:
    def __init__(self, rule: str, side: int, signal: dict, row: dict, stop: float) -> None:
        self.rule, self.side, self.signal_t, self.entry_t, self.unit = rule, side, signal["t"], row["t"], signal["atr"]
        self.entry = row["open"] * (1 + side * SLIP)
        self.stop = self.first_stop = stop
        self.best = self.worst = 0.0
        self.best_price, self.even, self.warned, self.bars = self.entry, False, None, 0

    def gain(self, price: float) -> float:
        return self.side * (price - self.entry) / self.unit

    def judge(self, row: dict, before: dict | None) -> str | None:
        """The reason for which a bar ends the trade; a stop's begins with its name."""
        s = self.side
        good, bad = (row["high"], row["low"]) if s > 0 else (row["low"], row["high"])
        if self.gain(good) > self.best:
            self.best, self.best_price = self.gain(good), good
        self.worst = min(self.worst, self.gain(bad))
        if self.rule == "R1" and self.best >= EVEN_AT and not self.even:
            self.even, self.stop = True, self.entry * (1 + s * (2 * FEE + SLIP))
        if s * (bad - self.stop) <= 0:
            return "BREAK_EVEN_STOP" if self.even else "STOP_A"
        if s * row["regime"] < 0:
            return "REGIME_FLIP"
        now = self.gain(row["close"])
        off = lambda r: s * (r["close"] - r["ema27"]) < 0
        if self.rule == "R0" and before and off(before) and off(row):
            return "EMA27_TWO_CLOSES"
        if self.rule == "R2" and self.best >= GIVE_FROM and self.best - now >= GIVE:
            return "ATR_GIVEBACK"
        if self.rule in ("R3", "R5") and self.best >= HALF_FROM and now <= 0.5 * self.best:
            return "MFE_50_GIVEBACK"
        if self.rule in ("R4", "R5"):
            if self.warned is None:
                self.warned = row if off(row) else None
            elif s * (row["close"] - row["ema27"]) > 0:
                self.warned = None
            elif off(row) or s * (row["close"] - self.warned["low" if s > 0 else "high"]) < 0:
                return "EMA27_HYSTERESIS"
        return None

    def out(self, row: dict, price: float, reason: str, bars: int) -> tuple:
        paid = price * (1 - self.side * SLIP)
        gross = self.side * (paid - self.entry) / self.entry
        reach = abs(self.best_price - self.entry)
        realised = self.side * (paid - self.entry)
        return (self.rule, self.side, self.signal_t, self.entry_t, row["t"], self.entry, self.first_stop, paid, reason, bars, gross, gross - 2 * FEE, self.best, self.worst, realised / reach if reach else None, self.best - self.gain(paid), self.even)


class Exits:
    """A bar is judged when the next one is there, as the last one is only closed on. Holds the open trades."""

    def __init__(self) -> None:
        self.open: list[Trade] = []
        self.before: dict | None = None
        self.last: dict | None = None
        self.recent: list[dict] = []

    def step(self, row: dict) -> list[tuple]:
        out, kept, last = [], [], self.last
        for trade in self.open:
            trade.bars += 1
            reason = trade.judge(last, self.before)
            if reason is None:
                kept.append(trade)
            elif reason in ("STOP_A", "BREAK_EVEN_STOP"):
                out.append(trade.out(last, trade.stop, reason, trade.bars))
            else:
                out.append(trade.out(row, row["open"], reason, trade.bars + 1))
        self.open = kept
        if last and last["signal"] and last["atr"]:
            stop = min(r["low"] for r in self.recent) if last["signal"] > 0 else max(r["high"] for r in self.recent)
            self.open += [Trade(rule, last["signal"], last, row, stop) for rule in RULES]
        self.before, self.last = last, row
        self.recent = [*self.recent, row][-STOP_BARS:]
        return out

    def close(self) -> list[tuple]:
        return [t.out(self.last, self.last["close"], "END_OF_DATA", t.bars + 1) for t in self.open]


def run(rows: DataFrame) -> DataFrame:
    """(symbol, trade columns) of rows (symbol, t, open, high, low, close, atr, ema27, regime, signal); regime is 1, -1 or 0, signal the side to enter on the next bar or 0."""
    return M.run(rows, "symbol", ["t"], Exits, SCHEMA)
