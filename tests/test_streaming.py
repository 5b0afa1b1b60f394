"""Streaming state under shuffled arrival equals the batch; duplicates and conflicts are told apart."""

import random
from datetime import datetime, timedelta, timezone
from functools import partial
from types import SimpleNamespace

import pandas as pd

from tidemark.operators import machines as M
from tidemark.streaming import replay as R

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)


def arrivals(rng, symbols=3, n=60):
    """Rows five minutes apart, each delayed by up to 40 minutes: (arrival, symbol, ts, x)."""
    rows = []
    for s in range(symbols):
        x = 10.0
        for k in range(n):
            x += rng.gauss(0, 0.6)
            rows.append((k * 5 + rng.uniform(0, 40), f"s{s}", BASE + timedelta(minutes=5 * k), round(x, 3)))
    return rows


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    rows = arrivals(rng)
    again, other = rows[20], rows[70]
    rows += [(again[0] + 1, *again[1:]), (other[0] + 1, other[1], other[2], other[3] + 1)]
    rows.sort()
    schema = "symbol string, ts timestamp, close double, atr double"
    for k in range(0, len(rows), 12):  # one file is one micro-batch
        spark.createDataFrame([(*r[1:], 1.0) for r in rows[k : k + 12]], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k:04d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    made = R.in_order(stream, "symbol", "ts", partial(M.MoveAge, 1.0), "t long, side int, age int, extreme double", late="1 hour")
    found = R.drained(made, f"{tmp_path}/out").collect()
    last = max(r[2] for r in rows) - timedelta(hours=1)
    want = []
    for s in ("s0", "s1", "s2"):
        kernel = M.MoveAge(1.0)
        for ts, x in sorted({(r[2], r[3]) for r in rows if r[1] == s and (r[1], r[2], r[3]) != (other[1], other[2], other[3] + 1)}):
            us = int((ts - BASE).total_seconds()) * 1_000_000 + int(BASE.timestamp()) * 1_000_000
            out = [(s, us, *x) for x in kernel.step({"t": us, "close": x, "atr": 1.0})]
            want += out if ts <= last else []
    assert sorted((r.symbol, r.us, r.t, r.side, r.age, r.extreme) for r in found if r.kind == "ROW") == sorted(want)
    odd = sorted((r.kind, r.symbol) for r in found if r.kind != "ROW")
    # Held rows tell equal ones from others; had the first been let go by then, Spark's watermark would have dropped the second.
    assert odd == [("CONFLICT", other[1]), ("DUPLICATE", again[1])]


class Fake:
    """State and timers of one key in memory, with the number of calls."""

    def __init__(self):
        self.calls, self.map, self.values, self.timers = 0, {}, {}, set()

    def getMapState(self, name, *_):  # noqa: N802
        return SimpleNamespace(containsKey=self.has, getValue=lambda k: self.map[k], updateValue=self.put, removeKey=self.drop, keys=lambda: iter(list(self.map)))

    def getValueState(self, name, *_):  # noqa: N802
        return SimpleNamespace(exists=lambda: name in self.values, get=lambda: self.values[name], update=lambda v: self.values.update({name: v}), clear=lambda: self.values.pop(name, None))

    def has(self, k):
        self.calls += 1
        return k in self.map

    def put(self, k, v):
        self.calls += 1
        self.map[k] = v

    def drop(self, k):
        self.calls += 1
        del self.map[k]

    def registerTimer(self, ms):  # noqa: N802
        self.timers.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.timers.discard(ms)


def test_state_is_called_by_slices_not_by_rows():
    fake = Fake()
    p = R.InOrder(["k", "ts", "id", "close", "atr"], "ts", "id", partial(M.MoveAge, 1.0), ["t", "side", "age", "extreme"])
    p.init(fake)
    rng = random.Random(4)
    rows = [("a", pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=rng.randrange(6 * 3600)), k, rng.gauss(0, 3), 1.0) for k in range(4000)]
    frame = pd.DataFrame(rows, columns=["k", "ts", "id", "close", "atr"])
    assert not list(p.handleInputRows(("a",), iter([frame[:1500], frame[1500:]]), None))
    assert fake.timers == {int(frame.ts.min().value // 10**6)}
    got, marks = [], [int(pd.Timestamp(f"2024-01-01 0{h}:30").value // 10**6) for h in (2, 4)] + [2**50]
    for ms in marks:
        fake.timers.clear()
        passed = SimpleNamespace(getCurrentWatermarkInMs=lambda ms=ms: ms)
        got += [r for f in p.handleExpiredTimer(("a",), passed, None) for r in f.itertuples(index=False, name=None)]
        left = [int(r[1].value // 10**6) for r in rows if int(r[1].value // 10**6) > ms]
        assert fake.timers == ({min(left)} if left else set())
    kernel = M.MoveAge(1.0)
    want = [("a", "ROW", us, i, *made) for us, i, x in sorted((int(r[1].value // 1000), r[2], r[3]) for r in rows) for made in kernel.step({"t": us, "close": x, "atr": 1.0})]
    assert got == want and not fake.map and fake.calls < 100
