"""Replays of the events table as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import machines as M
from tidemark.sources.bars import bars_sql
from tidemark.streaming import replay as R


def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-hour bars of a stream over the events, with what the watermark has closed."""
    # The glob keeps a single file a valid source of a stream.
    out = R.drained(R.bars(R.event_stream(spark, f"{sf_dir}/events.parqu[e]t")))
    return out.withColumn("turnover", F.round("turnover", 4))


def stream_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A switch over each symbol's values, on above 80 and off below 40, as a stream that puts late rows in order."""
    stream = R.event_stream(spark, f"{sf_dir}/events.parqu[e]t").select("symbol", "ts", "event_id", F.col("value").alias("x"))
    found = R.drained(R.in_order(stream, "symbol", "ts", Switch, "on boolean, x double", tie="event_id"))
    return found.where("kind = 'ROW'").select("symbol", F.col("tie").alias("event_id"), F.col("us").alias("at"), "on")


class Switch:
    """The hysteresis of tidemark.operators.machines over events."""

    def __init__(self) -> None:
        self.inner = M.Hysteresis(40.0, 80.0)

    def step(self, row: dict) -> list[tuple]:
        return [(on, row["x"]) for _, on in self.inner.step({"t": row["t"], "x": row["x"]})]


HYSTERESIS_SQL = """WITH e AS (SELECT event_type AS symbol, event_id, epoch_us(ts) AS "at", CASE WHEN value > 80 THEN 1 WHEN value < 40 THEN 0 END AS turn FROM events)
SELECT symbol, event_id, "at", coalesce(last_value(turn IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY "at", event_id ROWS UNBOUNDED PRECEDING), 0) = 1 AS "on"
FROM e QUALIFY "at" // 1000 <= (SELECT epoch_ms(max(ts)) FROM events) - 3600000"""

QUERIES = {"stream_replay": stream_replay, "stream_hysteresis": stream_hysteresis}
ORACLES = {"stream_hysteresis": HYSTERESIS_SQL, "stream_replay": f"SELECT * REPLACE (round(turnover, 4) AS turnover) FROM ({bars_sql()}) WHERE (t + 14400) * 1000 <= (SELECT epoch_ms(max(ts)) FROM events) - 3600000"}
