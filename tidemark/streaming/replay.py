"""The batch operators over unbounded inputs: bars by watermarked windows, episodes by sessions, and
state machines with the kernels of tidemark.operators.machines."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructType, _parse_datatype_string

from tidemark.operators.lineage import shared_folder
from tidemark.sources.bars import HOUR

#: Microseconds of a slice of held rows, and rows that are gathered before the slices they belong to are written.
SLICE, WAITING = HOUR * 1_000_000, 200_000


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """(symbol, event_id, ts, value) from a folder of Parquet files of events."""
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.select(F.col("event_type").alias("symbol"), "event_id", "ts", "value")


def bars(stream: DataFrame, hours: int = 4, late: str = "1 hour") -> DataFrame:
    """Bars that are emitted once the watermark has passed them; later events are dropped."""
    when = F.struct("ts", "event_id")
    made = stream.withWatermark("ts", late).groupBy("symbol", F.window("ts", f"{hours} hours").alias("w")).agg(
        F.min_by("value", when).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", when).alias("close"), F.count("*").alias("volume"), F.sum("value").alias("turnover"),
    )
    return made.select("symbol", F.unix_seconds("w.start").alias("t"), "open", "high", "low", "close", "volume", "turnover")


def episodes(stream: DataFrame, hours: int = 2, late: str = "1 hour") -> DataFrame:
    """Sessions of events; a gap of exactly `hours` splits, as in batch: the session's gap is a microsecond less."""
    gap = f"{hours * HOUR - 1} seconds 999999 microseconds"
    made = stream.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("member_count"), F.max("ts").alias("last"))
    return made.select("symbol", F.unix_seconds("w.start").alias("episode_start"), (F.unix_seconds("last") + hours * HOUR).alias("episode_end"), "member_count")


def machine(stream: DataFrame, key: str, kernel: Callable[[], object], schema: str) -> DataFrame:
    """(key, *schema) from a kernel of each key; rows must arrive in order of their batches, and are sorted by t within one."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = [c.split()[0] for c in schema.split(",")]

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        k = pickle.loads(state.get[0]) if state.exists else kernel()  # noqa: S301  our own state
        # A key's rows of one micro-batch are sorted together; the source's files_per_trigger bounds them.
        rows = pd.concat(list(batches)).sort_values("t").to_dict("records")
        out = [(keys[0], *x) for r in rows for x in k.step(r)]
        state.update((pickle.dumps(k),))
        yield pd.DataFrame(out, columns=[key, *names])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {schema}", "kernel binary", "append", GroupStateTimeout.NoTimeout)


class InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them and then gives them to the kernel in order.

    State: the held rows by their place (time, tie) in slices of time, the kernel, and the time of the one timer that is
    set, that of the earliest held row. A slice is read and written as one value, for many rows at a time. A row whose
    place is held already is a DUPLICATE if it is equal, else a CONFLICT; the first to arrive counts. Rows behind the
    watermark never get here: Spark drops them."""

    def __init__(self, columns: list[str], time: str, tie: str, kernel: Callable[[], object], out: list[str]) -> None:
        self.columns, self.time, self.tie, self.kernel, self.out = columns, time, tie, kernel, out
        self.kept = [c for c in columns if c != time]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", StructType().add("slice", LongType()), StructType().add("rows", BinaryType()))
        self.machine = handle.getValueState("machine", StructType().add("kernel", BinaryType()))
        self.timer = handle.getValueState("timer", StructType().add("ms", LongType()))

    def wait_for(self, us: int) -> None:
        """One timer, for the earliest row."""
        ms, now = us // 1000, self.timer.get()[0] if self.timer.exists() else None
        if now is None or ms < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def told(self, key: object, kind: str, us: int, tie: int, made: tuple = ()) -> tuple:
        return (key, kind, us, tie, *(made or (None,) * len(self.out)))

    def frame(self, rows: list[tuple], key: str) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[key, "kind", "us", "tie", *self.out]).astype({"us": "int64", "tie": "int64"})

    def rows_of(self, part: int) -> dict[tuple[int, int], tuple]:
        """The held rows of a slice by place."""
        return pickle.loads(self.held.getValue((part,))[0]) if self.held.containsKey((part,)) else {}  # noqa: S301  our own state

    def hold(self, key: object, fresh: dict[int, list[tuple]]) -> list[tuple]:
        """Holds rows by slice, and tells those whose place is taken."""
        odd = []
        for part, arrived in fresh.items():
            rows = self.rows_of(part)
            for place, row in arrived:
                if place not in rows:
                    rows[place] = row
                else:
                    odd.append(self.told(key, "DUPLICATE" if repr(rows[place]) == repr(row) else "CONFLICT", *place))
            self.held.updateValue((part,), (pickle.dumps(rows),))
        if fresh:
            self.wait_for(min(place[0] for place, _ in fresh[min(fresh)]))
        return odd

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        fresh: dict[int, list[tuple]] = {}
        waiting = 0
        for batch in chain(rows, [None]):
            if batch is not None:
                times = (batch[self.time].astype("datetime64[ns]").astype("int64") // 1000).tolist()
                ties = batch[self.tie].tolist() if self.tie else repeat(0)
                for us, tie, *row in zip(times, ties, *[batch[c] for c in self.kept]):
                    fresh.setdefault(us // SLICE, []).append(((us, int(tie)), tuple(row)))
                waiting += len(batch)
            if batch is None or waiting >= WAITING:
                if odd := self.hold(key[0], fresh):
                    yield self.frame(odd, self.columns[0])
                fresh, waiting = {}, 0

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        machine = pickle.loads(self.machine.get()[0]) if self.machine.exists() else self.kernel()  # noqa: S301  our own state
        for part in sorted(int(k[0]) for k in self.held.keys()):  # noqa: SIM118
            rows, out = self.rows_of(part), []
            ready = sorted(p for p in rows if p[0] // 1000 <= passed)
            for place in ready:
                row = dict(zip(self.kept, rows.pop(place), strict=True))
                out += [self.told(key[0], "ROW", *place, made) for made in machine.step(row | {"t": place[0]})]
            if out:
                yield self.frame(out, self.columns[0])
            if rows:  # later slices wait as well
                if ready:
                    self.held.updateValue((part,), (pickle.dumps(rows),))
                self.wait_for(min(rows)[0])
                break
            self.held.removeKey((part,))
        self.machine.update((pickle.dumps(machine),))

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, key: str, time: str, kernel: Callable[[], object], schema: str, late: str = "1 hour", tie: str = "") -> DataFrame:
    """(key, kind, us, tie, *schema): a kernel of each key over rows that may arrive in any order within the watermark's delay; it sees their time as t, in microseconds.

    kind ROW is what the kernel puts out once the watermark has passed a row; DUPLICATE and CONFLICT name rows that arrived for a place
    already taken. Needs the RocksDB state store. The stream gives what a batch over the same rows in order gives."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    columns = [key, *[c for c in stream.columns if c != key]]
    made: StructType = _parse_datatype_string(f"{key} {stream.schema[key].dataType.simpleString()}, kind string, us long, tie long, {schema}")
    processor = InOrder(columns, time, tie, kernel, [f.name for f in made.fields[4:]])
    return stream.select(*columns).withWatermark(time, late).groupBy(key).transformWithStateInPandas(processor, made, "Append", "EventTime")


def drained(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """All that a stream emits for what its source holds now, written to Parquet (with the checkpoint) under
    folder, which the cluster shares: by default a new one in spark.checkpoint.dir."""
    spark = stream.sparkSession
    if folder is None:
        folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
