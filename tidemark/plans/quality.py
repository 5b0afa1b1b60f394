"""Data quality of series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quality as Q
from tidemark.sources.bars import HOUR, bars, bars_sql, resample_bars, ticks

DAY = 86400
#: The span of the events: whole days from the first to the last of them.
SPAN_SQL = f"(SELECT min(epoch_us(ts)) // 1000000 // {DAY} * {DAY} AS span_start, (max(epoch_us(ts)) // 1000000 // {DAY} + 1) * {DAY} AS span_end FROM events) AS span"
TICKS = "SELECT event_type AS symbol, event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS t, value, user_id FROM events"


def span(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """The whole days of the events, one row from their statistics."""
    low, high = ticks(spark, sf_dir).agg(F.min("t"), F.max("t")).first()
    return (0, 0) if low is None else (low // DAY * DAY, (high // DAY + 1) * DAY)


def grid_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.missing_slots(bars(spark, sf_dir, 1), HOUR, *span(spark, sf_dir))


GAPS_SQL = f"""WITH b AS ({bars_sql(1)}), grid AS (SELECT symbol, CAST(x AS BIGINT) AS t FROM (SELECT symbol, unnest(range(span_start, span_end, {HOUR})) AS x FROM (SELECT DISTINCT symbol FROM b), {SPAN_SQL}))
SELECT symbol, t FROM grid WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.symbol = grid.symbol AND b.t = grid.t)"""


def gap_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.gap_episodes(grid_gaps(spark, sf_dir), HOUR)


EPISODES_SQL = f"""WITH m AS ({GAPS_SQL}), i AS (SELECT *, t - row_number() OVER (PARTITION BY symbol ORDER BY t) * {HOUR} AS island FROM m)
SELECT symbol, min(t) AS start, max(t) + {HOUR} AS "end", count(*) AS slots FROM i GROUP BY symbol, island"""


def interval_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.interval_mode(bars(spark, sf_dir, 1))


MODE_SQL = f"""WITH b AS ({bars_sql(1)}), d AS (SELECT symbol, t - lag(t) OVER (PARTITION BY symbol ORDER BY t) AS step FROM b), c AS (SELECT symbol, step, count(*) AS n FROM d WHERE step > 0 GROUP BY ALL)
SELECT symbol, step FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, step) = 1"""


def duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one type in one minute, as duplicates of a minute grid; payload: the value in whole tens."""
    rows = ticks(spark, sf_dir).select("symbol", (F.col("t") - F.pmod("t", F.lit(600))).alias("t"), F.floor(F.col("value") / 10).alias("tens"))
    return Q.duplicate_classes(rows, ["symbol", "t"], ["tens"])


DUPLICATES_SQL = f"""WITH r AS (SELECT symbol, t // 600 * 600 AS t, floor(value / 10) AS tens FROM ({TICKS}))
SELECT symbol, t, count(*) AS n, CASE WHEN count(*) = 1 THEN 'UNIQUE' WHEN count(DISTINCT tens) = 1 THEN 'IDENTICAL' ELSE 'CONFLICTING' END AS kind FROM r GROUP BY symbol, t"""


def ohlc_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose close is shifted by the volume parity, so that some break their order."""
    broken = bars(spark, sf_dir).withColumn("close", F.when(F.pmod("volume", F.lit(3)) == 0, F.col("high") + 1).otherwise(F.col("close")))
    return broken.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(Q.invalid_bar()).alias("violations"))


VIOLATIONS_SQL = f"""WITH b AS (SELECT * REPLACE (CASE WHEN volume % 3 = 0 THEN high + 1 ELSE close END AS close) FROM ({bars_sql()}))
SELECT symbol, count(*) AS n, count(*) FILTER (WHERE NOT (low <= least(open, close) AND high >= greatest(open, close) AND volume >= 0)) AS violations FROM b GROUP BY symbol"""


def row_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.contract(bars(spark, sf_dir, 1), HOUR).groupBy("symbol", F.coalesce("problem", F.lit("OK")).alias("problem")).agg(F.count("*").alias("n"))


CONTRACT_SQL = f"""WITH b AS (SELECT *, lag(t) OVER (PARTITION BY symbol ORDER BY t) AS pt FROM ({bars_sql(1)}))
SELECT symbol, CASE WHEN NOT (low <= least(open, close) AND high >= greatest(open, close)) THEN 'INVALID_BAR' WHEN t % {HOUR} <> 0 THEN 'OFF_GRID' WHEN t - pt > {HOUR} THEN 'GAP' ELSE 'OK' END AS problem, count(*) AS n FROM b GROUP BY ALL"""


def readiness_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """READY if every slot of the span has a valid bar, PARTIAL with half of them, else NOT_READY."""
    start, end = span(spark, sf_dir)
    want = (end - start) // HOUR
    inside = bars(spark, sf_dir, 1).where(F.col("t").between(start, end - HOUR))
    got = inside.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(Q.invalid_bar()).alias("invalid"), F.min("t").alias("first"), F.max("t").alias("last"))
    status = F.when((F.col("n") == want) & (F.col("invalid") == 0), "READY").when(F.col("n") * 2 >= want, "PARTIAL").otherwise("NOT_READY")
    return got.select("symbol", "n", "invalid", (F.lit(want) - F.col("n")).alias("missing"), (F.col("first") - start).alias("missing_before"), (F.lit(end - HOUR) - F.col("last")).alias("missing_after"), status.alias("status"))


READY_SQL = f"""WITH b AS (SELECT b.*, span_start, span_end, (span_end - span_start) // {HOUR} AS want FROM ({bars_sql(1)}) b, {SPAN_SQL})
SELECT symbol, count(*) AS n, count(*) FILTER (WHERE NOT (low <= least(open, close) AND high >= greatest(open, close))) AS invalid, any_value(want) - count(*) AS missing,
  min(t) - any_value(span_start) AS missing_before, any_value(span_end) - {HOUR} - max(t) AS missing_after,
  CASE WHEN count(*) = any_value(want) THEN 'READY' WHEN count(*) * 2 >= any_value(want) THEN 'PARTIAL' ELSE 'NOT_READY' END AS status FROM b GROUP BY symbol"""


def cross_interval_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-hour bars made of 1-hour bars against those made of ticks."""
    made, direct = resample_bars(bars(spark, sf_dir, 1), HOUR, 4 * HOUR, complete=False), bars(spark, sf_dir)
    both = made.alias("m").join(direct.alias("d"), ["symbol", "t"], "full")
    worst = F.greatest(*[F.abs(F.col(f"m.{c}") - F.col(f"d.{c}")) for c in ("open", "high", "low", "close")])
    return both.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(worst <= 1e-9).alias("equal"), F.round(F.max(worst), 6).alias("worst"))


CROSS_SQL = f"""WITH m AS (SELECT symbol, t // {4 * HOUR} * {4 * HOUR} AS t, arg_min(open, t) AS open, max(high) AS high, min(low) AS low, arg_max(close, t) AS close FROM ({bars_sql(1)}) GROUP BY ALL),
w AS (SELECT symbol, greatest(abs(m.open - d.open), abs(m.high - d.high), abs(m.low - d.low), abs(m.close - d.close)) AS worst FROM m FULL JOIN ({bars_sql()}) d USING (symbol, t))
SELECT symbol, count(*) AS n, count(*) FILTER (worst <= 1e-9) AS equal, round(max(worst), 6) AS worst FROM w GROUP BY symbol"""


def identity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of line items that aren't one row each: order and part, and order and line."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    one = Q.require_unique(lines, ["l_orderkey", "l_linenumber"]).agg(F.count("*").alias("by_line"))
    return one.crossJoin(Q.require_unique(lines, ["l_orderkey", "l_partkey"]).agg(F.count("*").alias("by_part")))


IDENTITY_SQL = """SELECT (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS by_line,
  (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1)) AS by_part"""


def holdout_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.assert_before(bars(spark, sf_dir, 24), span(spark, sf_dir)[1]).groupBy("symbol").agg(F.count("*").alias("n"), F.max("t").alias("last"))


def unknown_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types outside a closed list, with their counts."""
    known = spark.createDataFrame([("click",), ("view",), ("purchase",)], "symbol string")
    return ticks(spark, sf_dir).join(F.broadcast(known), "symbol", "left_anti").groupBy("symbol").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (grid_gaps, gap_episodes, interval_mode, duplicate_classes, ohlc_violations, row_contract, readiness_status, cross_interval_equality, identity_check, holdout_guard, unknown_vocabulary)}
ORACLES = {
    "grid_gaps": GAPS_SQL, "gap_episodes": EPISODES_SQL, "interval_mode": MODE_SQL, "duplicate_classes": DUPLICATES_SQL, "ohlc_violations": VIOLATIONS_SQL,
    "row_contract": CONTRACT_SQL, "readiness_status": READY_SQL, "cross_interval_equality": CROSS_SQL, "identity_check": IDENTITY_SQL,
    "holdout_guard": f"SELECT symbol, count(*) AS n, max(t) AS last FROM ({bars_sql(24)}) GROUP BY symbol",
    "unknown_vocabulary": "SELECT event_type AS symbol, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY 1",
}
