"""Exit rules by hand."""

import pytest

from tidemark.operators import exits as X


def bars(rows):
    """(open, high, low, close, average, regime, signal) by bar."""
    names = ("open", "high", "low", "close", "ema27", "regime", "signal")
    return [{"t": t, "atr": 1.0, **dict(zip(names, r, strict=True))} for t, r in enumerate(rows)]


def played(rows):
    kernel = X.Exits()
    out = [x for r in bars(rows) for x in kernel.step(r)] + kernel.close()
    return {x[0]: x for x in out}


CALM = (100.0, 100.2, 99.8, 100.0, 99.0, 1, 0)
ENTRY = 100.0 * 1.0005


def test_long_trade_by_hand():
    rows = [
        CALM, (100.0, 100.2, 99.5, 100.1, 99.0, 1, 1),  # the signal; its stop is 99.5
        (100.0, 101.7, 99.9, 101.6, 99.0, 1, 0),  # fills at 100.05 with slippage; best 1.65: the stop of R1 moves to 100.3, which the bar's own low has passed
        (101.6, 101.6, 100.5, 100.6, 100.8, 1, 0),  # gives back 1.1 of 1.65: R2 and R3 and R5 go at the next open; below the average: a warning, R0's first close
        (100.6, 100.7, 100.25, 100.4, 100.7, 1, 0),  # second close below: R0 and R4 go at the next open
        (100.2, 100.3, 99.0, 99.2, 100.5, 1, 0), CALM,
    ]
    got = played(rows)
    told = {k: (x[4], x[8], x[9], round(x[7], 6)) for k, x in got.items()}
    paid = lambda price: round(price * 0.9995, 6)
    assert told == {
        "R0": (5, "EMA27_TWO_CLOSES", 4, paid(100.2)), "R1": (2, "BREAK_EVEN_STOP", 1, paid(ENTRY * 1.0025)), "R2": (4, "ATR_GIVEBACK", 3, paid(100.6)),
        "R3": (4, "MFE_50_GIVEBACK", 3, paid(100.6)), "R4": (5, "EMA27_HYSTERESIS", 4, paid(100.2)), "R5": (4, "MFE_50_GIVEBACK", 3, paid(100.6)),
    }
    for x in got.values():
        assert x[5] == pytest.approx(ENTRY) and x[6] == 99.5 and x[12] == pytest.approx(101.7 - ENTRY) and x[11] == pytest.approx(x[10] - 0.002)


def test_stop_comes_first_and_the_last_bar_is_only_closed_on():
    signal = (100.0, 100.2, 99.5, 100.1, 99.0, 1, 1)
    fall = played([CALM, signal, (100.0, 103.0, 99.4, 102.0, 99.0, -1, 0), CALM])
    assert {(k, x[8], x[9]) for k, x in fall.items()} == {(r, "BREAK_EVEN_STOP" if r == "R1" else "STOP_A", 1) for r in X.RULES}
    last = played([CALM, signal, (100.0, 103.0, 99.0, 102.0, 99.0, -1, 0)])
    assert {(x[8], x[9], x[4]) for x in last.values()} == {("END_OF_DATA", 1, 2)} and all(x[14] is None for x in last.values())


def test_short_trade_leaves_with_the_regime_and_a_warning_can_be_called_off():
    rows = [CALM, (100.0, 100.5, 99.9, 99.9, 101.0, -1, -1), (100.0, 100.1, 99.5, 99.6, 101.0, -1, 0), (99.6, 100.2, 99.5, 100.1, 100.0, -1, 0), (100.0, 100.1, 99.4, 99.5, 100.0, -1, 0), (99.5, 100.0, 99.4, 99.8, 99.7, 1, 0), (99.9, 99.9, 99.9, 99.9, 99.7, 1, 0), CALM]
    got = played(rows)
    # Bar 3 closes beyond the average, bar 4 is back: the warning is gone. Bar 5 turns the regime.
    assert {x[8] for x in got.values()} == {"REGIME_FLIP"} and {x[4] for x in got.values()} == {6}
    assert got["R4"][7] == pytest.approx(99.9 * 1.0005)
