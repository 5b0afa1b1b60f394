"""Bars (open, high, low, close by symbol and grid slot) from event tables, and between grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3600
KEYS = ("symbol", "t")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Whole seconds since the epoch of a timestamp, read as UTC."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1_000_000).cast("long")


def slot(t: Column, step: int) -> Column:
    """Start of the grid slot of step seconds that t lies in."""
    return (t - F.pmod(t, F.lit(step))).cast("long")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, event_id, at, t, value) from the events table: at in microseconds, t in seconds."""
    events = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(F.col("event_type").alias("symbol"), "event_id", at.alias("at"), F.floor(at / 1_000_000).cast("long").alias("t"), "value")


def resample_ticks(rows: DataFrame, step: int) -> DataFrame:
    """Bars of step seconds from ticks; open and close by (at, event_id). Partial aggregates meet per slot."""
    when = F.struct("at", "event_id")
    return rows.groupBy("symbol", slot(F.col("t"), step).alias("t")).agg(
        F.min_by("value", when).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", when).alias("close"),
        F.count("*").alias("volume"), F.sum("value").alias("turnover"),
    )


def resample_bars(bars: DataFrame, child: int, parent: int, complete: bool = True) -> DataFrame:
    """Bars of parent seconds from bars of child seconds; complete: only where every child is there."""
    out = bars.groupBy("symbol", slot(F.col("t"), parent).alias("p")).agg(
        F.min_by("open", "t").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "t").alias("close"),
        F.sum("volume").alias("volume"), F.sum("turnover").alias("turnover"), F.count("*").alias("n"), F.countDistinct("t").alias("k"),
    )
    if complete:
        out = out.where((F.col("n") == parent // child) & (F.col("k") == parent // child))
    return out.withColumnRenamed("p", "t").drop("n", "k")


def bars(spark: SparkSession, sf_dir: str, hours: int = 4) -> DataFrame:
    return resample_ticks(ticks(spark, sf_dir), hours * HOUR)


def bars_sql(hours: int = 4) -> str:
    step = hours * HOUR
    return f"""SELECT event_type AS symbol, CAST(epoch_us(ts) // 1000000 // {step} * {step} AS BIGINT) AS t,
      arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
      count(*) AS volume, sum(value) AS turnover FROM events GROUP BY 1, 2"""
