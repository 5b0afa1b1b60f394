"""Joins, quality, machines, reconciliation and statistics on small literal tables."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import events as E
from tidemark.operators import joins as J
from tidemark.operators import machines as M
from tidemark.operators import quality as Q
from tidemark.operators import reconcile as R
from tidemark.operators import states as T
from tidemark.operators import stats as X
from tidemark.plans.study import detected_in
from tidemark.sources import files
from tidemark.sources.files import canonical_hash

HOUR, DAY = 3600, 86400


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_asof_takes_the_last_row_known_and_equal_times_count(spark):
    left = spark.createDataFrame([("a", DAY + 4 * HOUR), ("a", DAY), ("a", HOUR), ("b", DAY)], "symbol string, at long")
    right = spark.createDataFrame([("a", DAY, "old"), ("a", 2 * DAY, "new"), ("a", None, "lost")], "symbol string, known long, v string")
    assert rows_of(J.asof(left, right, "at", "known", ["v"]).fillna("-"), "symbol", "at", "v") == [("a", HOUR, "-"), ("a", DAY, "old"), ("a", DAY + 4 * HOUR, "old"), ("b", DAY, "-")]
    assert rows_of(J.asof(left, right, "at", "known", ["v"], strict=True).where("v IS NOT NULL"), "at") == [(DAY + 4 * HOUR,)]


def test_children_are_all_or_nothing(spark):
    parents = spark.createDataFrame([("a", 0), ("a", 4 * HOUR), ("a", 8 * HOUR), ("a", 12 * HOUR)], "symbol string, t long")
    times = [0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 10]
    bars = spark.createDataFrame([("a", k * HOUR) for k in times] + [("a", 11 * HOUR), *[("a", 12 * HOUR + k * HOUR + (k == 2)) for k in range(4)]], "symbol string, t long")
    assert rows_of(J.children(parents, bars, HOUR, 4 * HOUR).fillna(-1), "t", "n_children") == [(0, 4), (4 * HOUR, -1), (8 * HOUR, -1), (12 * HOUR, -1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_range_and_overlap_joins_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    a = [("ab"[rng.randrange(2)], k, rng.randrange(500)) for k in range(60)]
    b = [("ab"[rng.randrange(2)], k, rng.randrange(500)) for k in range(60)]
    left, right = spark.createDataFrame(a, "symbol string, i long, t long"), spark.createDataFrame(b, "symbol string, j long, u long")
    assert rows_of(J.within(left, right, "t", "u", 20, 5), "i", "j") == sorted((i, j) for s, i, t in a for z, j, u in b if s == z and t - 20 <= u <= t + 5)
    spans = [(s, k, t, t + rng.randrange(90)) for s, k, t in a], [(s, k, t, t + rng.randrange(90)) for s, k, t in b]
    x, y = spark.createDataFrame(spans[0], "symbol string, i long, s long, e long"), spark.createDataFrame(spans[1], "symbol string, j long, s2 long, e2 long")
    assert rows_of(J.overlaps(x, y, 64), "i", "j") == sorted((i, j) for p, i, s, e in spans[0] for q, j, s2, e2 in spans[1] if p == q and s <= e2 and s2 <= e)
    away = J.away_from(left, right.select("symbol", "u"), "t", "u", 3)
    assert rows_of(away, "i") == sorted((i,) for s, i, t in a if not any(s == z and abs(t - u) <= 3 for z, _, u in b))


def test_contract_names_the_first_rule_broken(spark):
    good = (1.0, 2.0, 0.5, 1.5, 1.0)
    rows = [("a", 0, *good), ("a", 10, *good), ("a", 10, *good), ("a", 25, *good), ("a", 50, *good), ("a", 60, float("nan"), 2.0, 0.5, 1.5, 1.0), ("a", 70, 1.0, 0.8, 0.5, 1.5, 1.0), (None, 80, *good)]
    df = spark.createDataFrame(rows, "symbol string, t long, open double, high double, low double, close double, volume double")
    got = Q.contract(df, 10).groupBy("problem").count()
    assert dict(tuple(r) for r in got.collect()) == {None: 2, "NOT_INCREASING": 1, "OFF_GRID": 1, "GAP": 1, "INVALID_BAR": 2, "MISSING_KEY": 1}


def test_gaps_duplicates_and_identities(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("a", 10, "x"), ("a", 40, "x"), ("a", 40, "x"), ("a", 60, "x"), ("a", 60, "y")], "symbol string, t long, v string")
    missing = Q.missing_slots(df, 10)
    assert rows_of(missing, "t") == [(20,), (30,), (50,)]
    assert rows_of(Q.gap_episodes(missing, 10), "start", "end", "slots") == [(20, 40, 2), (50, 60, 1)]
    assert rows_of(Q.duplicate_classes(df, ["symbol", "t"], ["v"]), "t", "n", "kind") == [(0, 1, "UNIQUE"), (10, 1, "UNIQUE"), (40, 2, "IDENTICAL"), (60, 2, "CONFLICTING")]
    assert rows_of(Q.require_unique(df, ["t"]), "t") == [(40,), (60,)]
    with pytest.raises(Exception, match="hold-out rows"):
        Q.assert_before(df, 60).collect()


def test_episodes_split_at_the_gap_itself(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 7, 2), ("a", 15, 3), ("a", 15, 4), ("b", 3, 5)], "symbol string, t long, event_id long")
    assert rows_of(E.episodes(df, 8), "event_id", "episode_start", "episode_end", "member_count") == [(1, 0, 15, 2), (2, 0, 15, 2), (3, 15, 23, 2), (4, 15, 23, 2), (5, 3, 11, 1)]


def test_components_join_spans_through_others(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 2, 3), ("a", 9, 12), ("a", 13, 14)], "symbol string, s long, e long")
    assert rows_of(E.interval_components(df), "s", "component_start") == [(0, 0), (2, 0), (9, 0), (13, 13)]


def test_machines_run_key_by_key_in_order(spark):
    states = ["UP", "DOWN", "UP", "UP", "DOWN", "DOWN", "TRANSITION", "UP"]
    rows = [(k, t, s) for k in "ab" for t, s in enumerate(states)]
    random.Random(3).shuffle(rows)
    got = M.run(spark.createDataFrame(rows, "symbol string, t long, state string"), "symbol", ["t"], M.Debounce, "t long, proposed string, state string")
    want = ["WARMUP", "WARMUP", "WARMUP", "UP", "UP", "DOWN", "DOWN", "DOWN"]
    assert rows_of(got, "symbol", "t", "state") == [(k, t, s) for k in "ab" for t, s in enumerate(want)]


def test_greedy_is_not_a_running_maximum(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 4, 5, 9, 10, 20)], "symbol string, t long")
    assert rows_of(M.run(df, "symbol", ["t"], lambda: M.Greedy(5), "t long"), "t") == [(0,), (5,), (10,), (20,)]


def test_hysteresis_holds_between_its_bounds():
    m = M.Hysteresis(0.4, 0.7)
    assert [m.step({"t": k, "x": x})[0][1] for k, x in enumerate([0.5, 0.8, 0.5, None, 0.3, 0.6])] == [False, True, True, True, False, False]


def test_backtest_stops_first_and_closes_at_the_end():
    bar = lambda t, o, h, lo, c, side, signal=0: {"t": t, "open": o, "high": h, "low": lo, "close": c, "side": side, "signal": signal, "atr_before": 1.0}
    m = M.Backtest(stop=1.5, slippage=0.0, fee=0.0)
    out = [x for b in (bar(0, 10, 10, 10, 10, 1, 1), bar(1, 10, 11, 9, 10.5, 1), bar(2, 10.5, 12, 8, 11, 1, 1), bar(3, 11, 12, 10, 12, 1)) for x in m.step(b)] + m.close()
    assert [(x[0], x[1], x[4], x[5]) for x in out] == [(1, 2, 8.5, "STOP"), (3, 3, 12, "END")]


def test_transitions_are_dense_and_entropy_in_bits(spark):
    df = spark.createDataFrame([("a", t, s) for t, s in enumerate("UUDU")], "symbol string, t long, state string")
    got = {(r.before, r.after): r.n for r in T.transitions(df, ["D", "U"]).collect()}
    assert got == {("D", "D"): 0, ("D", "U"): 1, ("U", "D"): 1, ("U", "U"): 1}
    even = spark.createDataFrame([("a", t, s) for t, s in enumerate("UD")], "symbol string, t long, state string")
    assert T.entropy_bits(even).first()["bits"] == pytest.approx(1.0)


def test_reconciliation_by_identity_and_multiplicity(spark):
    schema = "k long, x double, s string"
    a = spark.createDataFrame([(1, 1.0, "u"), (2, 2.0, "v"), (3, 3.0, "w"), (4, 4.0, "x")], schema)
    b = spark.createDataFrame([(1, 1.0 + 1e-12, "u"), (2, 2.5, "v"), (3, 3.0, "z"), (5, 5.0, "y")], schema)
    assert rows_of(R.by_identity(a, b, ["k"], ["x"], ["s"]), "k", "status") == [(1, "MATCH"), (2, "NUMERIC_DIFFERENCE"), (3, "NONNUMERIC_DIFFERENCE"), (4, "MISSING"), (5, "EXTRA")]
    one, two = spark.createDataFrame([(1, "a")] * 3 + [(2, "b")], "k long, s string"), spark.createDataFrame([(1, "a")] * 2 + [(3, "c")], "k long, s string")
    assert rows_of(R.by_multiplicity(one, two, ["k", "s"]), "k", "matched", "missing", "extra") == [(1, 2, 1, 0), (2, 0, 1, 0), (3, 0, 0, 1)]


def test_statistics_of_small_tables(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 0), ("a", 2.0, 4.0, 0), ("a", 3.0, 9.0, 1), ("a", 4.0, 16.0, 1)], "symbol string, x double, y double, up long")
    assert X.spearman(df, "x", "y", "symbol").first()["rho"] == pytest.approx(1.0)
    assert X.roc_auc(df, "x", "up", "symbol").first()["auc"] == pytest.approx(1.0)
    assert X.ks_distance(df, "x", "up", "symbol").first()["ks"] == pytest.approx(1.0)
    labels = df.select(F.col("up").cast("string").alias("a"), F.col("up").cast("string").alias("b"))
    assert X.cohen_kappa(labels, "a", "b").first()["kappa"] == pytest.approx(1.0)
    assert X.adjusted_rand(labels, "a", "b").first()["ari"] == pytest.approx(1.0)


def test_debounce_with_cross_reset_equals_the_machine(spark):
    """By hand: two rows take a state on, a crossing is TRANSITION at once and forgets what was proposed."""
    rows = [("WARMUP", 0, "WARMUP"), ("UP", 1, "WARMUP"), ("UP", 1, "UP"), ("DOWN", 1, "UP"), ("TRANSITION", 1, "UP"), ("TRANSITION", 1, "TRANSITION"), ("DOWN", -1, "TRANSITION"), ("DOWN", -1, "TRANSITION"),
            ("DOWN", 0, "DOWN"), ("DOWN", -1, "DOWN"), ("UP", 1, "TRANSITION"), ("UP", 1, "TRANSITION"), ("UP", 1, "UP"), ("WARMUP", 1, "WARMUP"), ("UP", 1, "WARMUP"), ("UP", 1, "UP")]
    df = spark.createDataFrame([("a", t, s, x) for t, (s, x, _) in enumerate(rows)], "symbol string, t long, state string, above int")
    assert rows_of(T.debounced(df), "t", "taken") == [(t, w) for t, (_, _, w) in enumerate(rows)]
    machine, before = M.Debounce(), 0
    for t, (s, x, want) in enumerate(rows):
        crossed, before = bool(x and before and x != before), x or before
        assert machine.step({"t": t, "state": s, "crossed": crossed}) == [(t, s, want)]


def test_hysteresis_equals_the_machine(spark):
    values = [None, 0.5, 0.8, 0.5, None, 0.4, 0.39, 0.5, 0.71, 0.7]
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate(values)], "symbol string, t long, x double")
    m = M.Hysteresis(0.4, 0.7)
    assert rows_of(T.hysteresis(df, "x", 0.4, 0.7), "t", "high") == [m.step({"t": t, "x": v})[0] for t, v in enumerate(values)]


def test_detector_reads_the_childs_own_steps(spark):
    """The step from the parent into the child (bar 8) is no counter motion of the child."""
    base = [10.0 + k for k in range(8)]  # parent rises
    bar = lambda t, c, o: ("a", t, o, max(o, c) + 0.5, min(o, c) - 0.5, c)
    def found(child):
        closes = base + child
        rows = [bar(t, c, closes[t - 1] if t else c) for t, c in enumerate(closes)]
        d = spark.createDataFrame(rows, "symbol string, t long, open double, high double, low double, close double")
        return {(r.t, r.intact) for r in detected_in(d).where("factor = 0.8").collect()}
    assert found([16.5, 16.6, 16.7, 16.8, 18.8]) == set()  # falls into the child alone, then rises throughout
    assert found([17.5, 17.2, 17.1, 17.0, 19.5]) == {(12, True)}
    assert found([17.5, 9.0, 9.2, 9.1, 19.5]) == {(12, False)}  # a close beyond the parent's boundary of 9.5


def test_a_number_against_null_differs(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, None, "x"), (None, 3.0, "x"), (4, 1.0, None)], "k long, v double, s string")
    b = spark.createDataFrame([(1, 5.0, "x"), (2, None, "x"), (None, 3.0, "x"), (4, 1.0, None)], "k long, v double, s string")
    got = {r.k: r.status for r in R.by_identity(a, b, ["k"], ["v"], ["s"]).collect()}
    assert got == {1: "NUMERIC_DIFFERENCE", 2: "MATCH", None: "MATCH", 4: "MATCH"}
    assert [tuple(r) for r in R.by_multiplicity(a.where("k IS NULL"), b.where("k IS NULL"), ["k", "v", "s"]).collect()] == [(None, 3.0, "x", 1, 0, 0)]


def test_semi_range_join_keeps_repeated_rows(spark):
    left = spark.createDataFrame([("a", 10), ("a", 10), ("a", 100), ("b", 10)], "symbol string, t long")
    right = spark.createDataFrame([("a", 14), ("a", 7), ("a", 200)], "symbol string, at long")
    assert rows_of(J.within(left, right, "t", "at", 5, 5, how="semi"), "symbol", "t") == [("a", 10), ("a", 10)]
    assert rows_of(J.within(left, right, "t", "at", 2, 4, how="semi"), "symbol", "t") == [("a", 10), ("a", 10)]
    assert rows_of(J.within(left, right, "t", "at", 2, 3, how="semi"), "symbol", "t") == []


def test_canonical_hash_tells_cells_apart(spark):
    digest = lambda rows: canonical_hash(spark.createDataFrame(rows, "a string, b string"), ["a", "b"]).first().digest
    assert len({digest([("x|y", "z")]), digest([("x", "y|z")]), digest([(None, "z")]), digest([("~", "z")])}) == 4
    assert digest([("a", "b"), ("c", None)]) == digest([("c", None), ("a", "b")])


def test_files_sources(spark, tmp_path):
    (tmp_path / "bars.csv").write_text("timestamp_utc,open,high,low,close,volume,turnover\n2024-01-01T00:00:00Z,1,3,1,2,5,9\n2024-01-01T04:00:00Z,2,2,2,2,0,0\n")
    path = str(tmp_path / "bars.csv")
    assert [tuple(r) for r in files.bars_of(files.scan_csv(spark, path, files.BAR_SCHEMA), "x").select("symbol", "t", "high").collect()] == [("x", 1704067200, 3.0), ("x", 1704081600, 2.0)]
    assert files.scan_text_csv(spark, path).first().open == "1"
    sha = files.file_hashes(spark, path).first().sha256
    assert files.pinned(spark, path, sha, files.BAR_SCHEMA).count() == 2
    with pytest.raises(ValueError):
        files.pinned(spark, path, "0" * 64, files.BAR_SCHEMA)
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert files.scan_json(spark, str(tmp_path / "log.jsonl"), "a long").agg({"a": "sum"}).first()[0] == 3
    times = spark.createDataFrame([("1704067200",), ("1704067200000",), ("2024-01-01T00:00:00Z",), ("x",)], "v string")
    assert [r.t for r in times.select(files.epoch_of(F.col("v"))).collect()] == [1704067200, 1704067200, 1704067200, None]
    rows = spark.range(3)
    files.publish(rows, f"{tmp_path}/s", f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f").count() == 3
    with pytest.raises(ValueError):
        files.publish(rows, f"{tmp_path}/s", f"{tmp_path}/f", checks=rows)


def test_nearest_time_equals_brute_force_and_makes_no_pair(spark):
    rng = random.Random(8)
    left = [(k, rng.randrange(-400, 400)) for k in range(300)] + [(300, None), (7, 5)]
    right = [(rng.randrange(10**6), rng.choice([rng.randrange(-400, 400), 50])) for _ in range(40)] + [(1, None), (2, 3000)]
    a, b = spark.createDataFrame(left, "event_id long, t long"), spark.createDataFrame(right, "near_id long, near_t long")
    got = J.nearest_time(a, b, "t", "near_t", 10, "near_id")
    want = []
    for e, t in left:
        near = [(abs(t - u), u, n) for n, u in right if t is not None and u is not None and abs(t - u) <= 10]
        want += [(e, t, u, n, d) for d, u, n in [min(near)]] if near else []
    assert sorted(map(tuple, got.select("event_id", "t", "near_t", "near_id", "distance").collect())) == sorted(want)
    # Many rows at one place: the query's plan has no join whose rows grow with their product.
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert J.nearest_time(a, b.where("false"), "t", "near_t", 10, "near_id").count() == 0
