"""Joins in time over bars and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.sources.bars import HOUR, bars, bars_sql, ticks

DAY = 24 * HOUR
TICKS = "SELECT event_type AS symbol, event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS t, value, user_id FROM events"
BIG = 95.0


def asof_daily_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-hour bars with the last daily close known when they end."""
    left = bars(spark, sf_dir).select("symbol", "t", (F.col("t") + 4 * HOUR).alias("emit_at"))
    right = bars(spark, sf_dir, 24).select("symbol", (F.col("t") + DAY).alias("known_at"), F.col("t").alias("day"), F.col("close").alias("day_close"))
    out = J.asof(left, right, "emit_at", "known_at", ["day", "day_close"])
    return out.select("symbol", "t", F.coalesce("day", F.lit(-1)).alias("day"), "day_close", F.when(F.col("day").isNull(), "UNKNOWN").otherwise("KNOWN").alias("state"))


ASOF_DAILY_SQL = f"""WITH b AS ({bars_sql()}), d AS (SELECT symbol, t + {DAY} AS known_at, t AS day, close AS day_close FROM ({bars_sql(24)}))
SELECT b.symbol, b.t, coalesce(day, -1) AS day, day_close, CASE WHEN day IS NULL THEN 'UNKNOWN' ELSE 'KNOWN' END AS state FROM b ASOF LEFT JOIN d ON b.symbol = d.symbol AND b.t + {4 * HOUR} >= d.known_at"""


def asof_parent_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1-hour bars with the direction of the last 4-hour bar that had closed; unmatched ones go."""
    child = bars(spark, sf_dir, 1).select("symbol", "t", (F.col("t") + HOUR).alias("close_time"))
    parent = bars(spark, sf_dir).select("symbol", (F.col("t") + 4 * HOUR).alias("parent_close"), F.when(F.col("close") >= F.col("open"), "UP").otherwise("DOWN").alias("parent"))
    return J.asof(child, parent, "close_time", "parent_close", ["parent_close", "parent"]).where("parent IS NOT NULL")


ASOF_PARENT_SQL = f"""WITH c AS (SELECT symbol, t, t + {HOUR} AS close_time FROM ({bars_sql(1)})), p AS (SELECT symbol, t + {4 * HOUR} AS parent_close, CASE WHEN close >= open THEN 'UP' ELSE 'DOWN' END AS parent FROM ({bars_sql()}))
SELECT c.symbol, c.t, c.close_time, parent_close, parent FROM c ASOF JOIN p ON c.symbol = p.symbol AND c.close_time >= p.parent_close"""


def children_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = J.children(bars(spark, sf_dir).select("symbol", "t"), bars(spark, sf_dir, 1), HOUR, 4 * HOUR)
    return out.select("symbol", "t", F.coalesce("n_children", F.lit(-1)).alias("n_children"))


CHILDREN_SQL = f"""WITH b AS ({bars_sql()}), c AS (SELECT symbol, t // 14400 * 14400 AS t, count(*) AS n FROM ({bars_sql(1)}) GROUP BY ALL)
SELECT b.symbol, b.t, CASE WHEN n = 4 THEN n ELSE -1 END AS n_children FROM b LEFT JOIN c ON b.symbol = c.symbol AND b.t = c.t"""


def big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of very high value."""
    return ticks(spark, sf_dir).where(F.col("value") >= BIG).select("symbol", "event_id", "t")


BIG_SQL = f"SELECT symbol, event_id, t FROM ({TICKS}) WHERE value >= {BIG}"


def nearest_within_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest purchase within two hours of each big event of the other types."""
    a = big(spark, sf_dir).where("symbol <> 'purchase'")
    b = big(spark, sf_dir).where("symbol = 'purchase'").select(F.col("event_id").alias("near_id"), F.col("t").alias("near_t"))
    met = J.nearest_time(a, b, "t", "near_t", 2 * HOUR, "near_id")
    return J.nearest(met, ["event_id"], "distance", ["near_t", "near_id"]).select("event_id", "near_id", "distance")


NEAREST_SQL = f"""WITH e AS ({BIG_SQL}) SELECT a.event_id, b.event_id AS near_id, abs(a.t - b.t) AS distance FROM e a JOIN e b ON a.symbol <> 'purchase' AND b.symbol = 'purchase' AND b.t BETWEEN a.t - 7200 AND a.t + 7200
QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t), b.t, b.event_id) = 1"""


def range_pairs_60m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every earlier big event of the same type within the hour before."""
    a = big(spark, sf_dir)
    b = a.select("symbol", F.col("event_id").alias("earlier_id"), F.col("t").alias("earlier_t"))
    return J.within(a, b, "t", "earlier_t", HOUR, 0).where("earlier_id <> event_id").select("symbol", "event_id", "earlier_id", (F.col("t") - F.col("earlier_t")).alias("lag"))


RANGE_SQL = f"""WITH e AS ({BIG_SQL}) SELECT a.symbol, a.event_id, b.event_id AS earlier_id, a.t - b.t AS lag FROM e a JOIN e b ON a.symbol = b.symbol AND b.t BETWEEN a.t - 3600 AND a.t AND a.event_id <> b.event_id"""


def spans(spark: SparkSession, sf_dir: str, name: str, hours: int) -> DataFrame:
    suffix = "" if name == "a" else "2"
    return bars(spark, sf_dir, hours).where(F.col("close") > F.col("open")).select("symbol", F.col("t").alias(f"s{suffix}"), (F.col("t") + hours * HOUR - 1).alias(f"e{suffix}"))


def interval_overlap_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rising 4-hour bars and the rising 6-hour bars that they meet."""
    pairs = J.overlaps(spans(spark, sf_dir, "a", 4), spans(spark, sf_dir, "b", 6), DAY)
    return pairs.select("symbol", "s", "s2", (F.least("e", "e2") - F.greatest("s", "s2") + 1).alias("shared"))


OVERLAP_SQL = f"""WITH a AS (SELECT symbol, t AS s, t + 14399 AS e FROM ({bars_sql(4)}) WHERE close > open), b AS (SELECT symbol, t AS s2, t + 21599 AS e2 FROM ({bars_sql(6)}) WHERE close > open)
SELECT a.symbol, s, s2, least(e, e2) - greatest(s, s2) + 1 AS shared FROM a JOIN b ON a.symbol = b.symbol AND s <= e2 AND s2 <= e"""


def point_in_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Big events and the first rising 6-hour bar that holds them, or OUTSIDE."""
    zones = spans(spark, sf_dir, "b", 6)
    points = big(spark, sf_dir).withColumns({"s": F.col("t"), "e": F.col("t")})
    hits = J.nearest(J.overlaps(points, zones, DAY), ["event_id"], "s2", ["e2"]).select("event_id", F.col("s2").alias("zone"))
    return points.join(hits, "event_id", "left").select("event_id", F.coalesce(F.col("zone").cast("string"), F.lit("OUTSIDE")).alias("zone"))


ZONE_SQL = f"""WITH e AS ({BIG_SQL}), b AS (SELECT symbol, t AS s2, t + 21599 AS e2 FROM ({bars_sql(6)}) WHERE close > open), h AS (SELECT event_id, min(s2) AS zone FROM e JOIN b ON e.symbol = b.symbol AND t BETWEEN s2 AND e2 GROUP BY 1)
SELECT event_id, coalesce(CAST(zone AS VARCHAR), 'OUTSIDE') AS zone FROM e LEFT JOIN h USING (event_id)"""


def exists_within_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-hour bars with a big event of their type within 12 hours of their start."""
    marks = big(spark, sf_dir).select("symbol", F.col("t").alias("at"))
    return J.within(bars(spark, sf_dir).select("symbol", "t"), marks, "t", "at", 12 * HOUR, 12 * HOUR, how="semi")


EXISTS_SQL = f"WITH b AS ({bars_sql()}), e AS ({BIG_SQL}) SELECT symbol, t FROM b WHERE EXISTS (SELECT 1 FROM e WHERE e.symbol = b.symbol AND e.t BETWEEN b.t - 43200 AND b.t + 43200)"


def exclusion_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1-hour bars farther than two hours from every big event of their type."""
    return J.away_from(bars(spark, sf_dir, 1).select("symbol", "t"), big(spark, sf_dir), "t", "t", 2 * HOUR).select("symbol", "t")


AWAY_SQL = f"WITH b AS ({bars_sql(1)}), e AS ({BIG_SQL}) SELECT symbol, t FROM b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.symbol = b.symbol AND e.t BETWEEN b.t - 7200 AND b.t + 7200)"

QUERIES = {f.__name__: f for f in (asof_daily_closed, asof_parent_state, children_all_or_nothing, nearest_within_tolerance, range_pairs_60m, interval_overlap_map, point_in_zone, exists_within_window, exclusion_anti_join)}
ORACLES = {
    "asof_daily_closed": ASOF_DAILY_SQL, "asof_parent_state": ASOF_PARENT_SQL, "children_all_or_nothing": CHILDREN_SQL, "nearest_within_tolerance": NEAREST_SQL, "range_pairs_60m": RANGE_SQL,
    "interval_overlap_map": OVERLAP_SQL, "point_in_zone": ZONE_SQL, "exists_within_window": EXISTS_SQL, "exclusion_anti_join": AWAY_SQL,
}
