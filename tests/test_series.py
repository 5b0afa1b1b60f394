"""Literal cases of the causal features, with null, tied, repeated and empty inputs."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import series as S

BAR = "symbol string, t long, open double, high double, low double, close double, volume double"


def bars(spark, rows, symbol="a"):
    """rows: (high, low, close)."""
    return spark.createDataFrame([(symbol, k * 3600, c, h, lo, c, 1.0) for k, (h, lo, c) in enumerate(rows)], BAR)


def column(df, name):
    return [r[name] for r in df.orderBy("t").collect()]


def test_true_range_takes_gaps_and_starts_with_the_range(spark):
    assert column(S.true_range(bars(spark, [(12.0, 8.0, 10.0), (16.0, 14.0, 15.0), (11.0, 9.0, 10.0)])), "tr") == [4.0, 6.0, 6.0]


def test_strict_atr_waits_for_its_window_and_partial_does_not(spark):
    x = bars(spark, [(101 + 0.4 * k, 99 + 0.4 * k, 100 + 0.4 * k) for k in range(31)])
    strict, partial = column(S.atr(x), "atr"), column(S.atr(x, strict=False), "atr")
    assert strict[:13] == [None] * 13 and strict[13] == pytest.approx(2.0) and partial[0] == pytest.approx(2.0)


def test_seeded_average_starts_with_the_mean_and_then_folds(spark):
    x = bars(spark, [(101 + 0.4 * k, 99 + 0.4 * k, 100 + 0.4 * k) for k in range(31)])
    got = column(S.ema(x, "close", 2 / 28, "e", seed=26), "e")
    assert got[:26] == [None] * 26 and got[26] == pytest.approx(105.2) and got[27] == pytest.approx(105.6)


@pytest.mark.parametrize("alpha", [2 / 10, 2 / 28, 1 / 14])
def test_blocked_average_equals_the_fold(spark, alpha):
    closes = [100 + ((k * 7919) % 211) / 7 for k in range(400)]
    x = bars(spark, [(c + 1, c - 1, c) for c in closes])
    got, want = column(S.ema(x, "close", alpha, "e"), "e"), [closes[0]]
    for c in closes[1:]:
        want.append(want[-1] + alpha * (c - want[-1]))
    assert got == pytest.approx(want, rel=1e-9)


def test_flat_and_disjoint_and_equal_bars(spark):
    flat = bars(spark, [(5.0, 5.0, 5.0)] * 4)
    assert column(S.with_overlap(flat, 1), "overlap") == [None] * 4
    assert column(S.with_efficiency(flat, 2), "efficiency") == [None] * 4
    apart = bars(spark, [(2.0, 1.0, 1.5), (4.0, 3.0, 3.5)])
    assert column(S.with_overlap(apart, 1), "overlap")[1] == 0.0
    same = bars(spark, [(2.0, 1.0, 1.5)] * 2)
    assert column(S.with_overlap(same, 1), "overlap")[1] == 1.0


def test_rank_among_the_values_before(spark):
    x = bars(spark, [(float(k % 5) + 1, 0.0, float(k % 5)) for k in range(96)] + [(100.0, 0.0, 99.0)])
    got = column(x.withColumn("p", S.rank_among_last("close", 96)), "p")
    assert got[:96] == [None] * 96 and got[96] == 1.0


def test_nearest_rank(spark):
    five, four = spark.createDataFrame([(float(k),) for k in range(1, 6)], "x double"), spark.createDataFrame([(float(k),) for k in range(1, 5)], "x double")
    for df, want in ((five, [2, 3, 4]), (four, [2, 2, 3])):
        assert list(df.agg(*[S.nearest_rank("x", p).alias(f"p{k}") for k, p in enumerate((0.3, 0.5, 0.7))]).first()) == want


def test_later_rows_change_nothing_before_them(spark):
    rows = [(10 + (k * 37 % 11), 5 - (k * 17 % 3), 7 + (k * 29 % 5) / 2) for k in range(60)]
    make = lambda r: S.ema(S.with_overlap(S.atr(bars(spark, [(float(a), float(b), float(c)) for a, b, c in r])), 4), "close", 2 / 10, "e").select("t", "atr", "overlap", "e").orderBy("t").collect()
    short, long = make(rows[:45]), make(rows[:45] + [(1000.0 * a, b, 1000.0 * c) for a, b, c in rows[45:]])
    for a, b in zip(short, long[:45], strict=True):
        assert (a.t, a.atr, a.overlap) == (b.t, b.atr, b.overlap) and a.e == pytest.approx(b.e, rel=1e-12)


def test_empty_bars_give_empty_features(spark):
    x = S.ema(S.atr(bars(spark, []).where(F.lit(True))), "close", 0.2, "e")
    assert x.count() == 0
