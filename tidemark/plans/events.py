"""Events, episodes and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import events as E
from tidemark.operators import joins as J
from tidemark.operators import machines as M
from tidemark.plans.joins import BIG_SQL, big
from tidemark.sources.bars import HOUR, bars, bars_sql

DAY = 24 * HOUR


def funding_percentile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.percentile_events(bars(spark, sf_dir), "close", 10 * DAY, 30)
    return out.select("symbol", "t", F.round("share", 6).alias("share"), "side")


FUNDING_SQL = f"""WITH b AS ({bars_sql()}), p AS (SELECT symbol, t, close, list(close) OVER (PARTITION BY symbol ORDER BY t RANGE BETWEEN {10 * DAY} PRECEDING AND 1 PRECEDING) AS past FROM b),
q AS (SELECT symbol, t, coalesce(len(past), 0) AS n, len(list_filter(past, lambda x: x <= close)) / len(past) AS share FROM p)
SELECT symbol, t, round(CASE WHEN n >= 30 THEN share END, 6) AS share, CASE WHEN n < 30 THEN 'INSUFFICIENT_HISTORY' WHEN share <= 0.05 THEN 'LOW' ELSE 'HIGH' END AS side FROM q WHERE n < 30 OR share <= 0.05 OR share >= 0.95"""


def oi_robust_z_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.robust_z_events(bars(spark, sf_dir, 1), "volume", 5 * DAY, 60, z=2.0)
    return out.select("symbol", "t", F.round("z", 5).alias("z"), "side")


Z_SQL = f"""WITH b AS ({bars_sql(1)}), d AS (SELECT symbol, t, ln(volume) - ln(lag(volume) OVER (PARTITION BY symbol ORDER BY t)) AS d FROM b),
p AS (SELECT *, array_agg(d) FILTER (WHERE d IS NOT NULL) OVER (PARTITION BY symbol ORDER BY t RANGE BETWEEN {5 * DAY} PRECEDING AND 1 PRECEDING) AS past FROM d),
m AS (SELECT symbol, t, d, coalesce(len(past), 0) AS n, past, list_sort(past) AS s FROM p WHERE d IS NOT NULL),
k AS (SELECT *, (s[(n - 1) // 2 + 1] + s[n // 2 + 1]) / 2 AS m FROM m),
a AS (SELECT *, list_sort([abs(x - m) FOR x IN past])[(n - 1) // 2 + 1] AS mad FROM k),
z AS (SELECT symbol, t, n, mad, CASE WHEN n >= 60 AND mad > 0 THEN 0.67448975 * (d - m) / mad END AS z FROM a),
w AS (SELECT symbol, t, round(z, 5) AS z, CASE WHEN n < 60 THEN 'INSUFFICIENT_HISTORY' WHEN mad <= 0 THEN 'ZERO_MAD' WHEN z >= 2 THEN 'EXPANSION' WHEN z <= -2 THEN 'CONTRACTION' END AS side FROM z)
SELECT * FROM w WHERE side IS NOT NULL"""


def joint_events_60m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every extreme close with the volume shocks of the hour before."""
    f = E.percentile_events(bars(spark, sf_dir, 1), "close", 5 * DAY, 60).where("side IN ('LOW', 'HIGH')").select("symbol", "t", "side")
    o = E.robust_z_events(bars(spark, sf_dir, 1), "volume", 5 * DAY, 60, z=2.0).where("side IN ('EXPANSION', 'CONTRACTION')").select("symbol", F.col("t").alias("o_t"), F.col("side").alias("o_side"))
    return J.within(f, o, "t", "o_t", HOUR, 0).select("symbol", "t", "o_t", F.concat_ws("|", "side", "o_side").alias("side"))


JOINT_SQL = f"""WITH f AS ({FUNDING_SQL.replace(bars_sql(), bars_sql(1)).replace(str(10 * DAY), str(5 * DAY)).replace("n >= 30", "n >= 60").replace("n < 30", "n < 60")}), o AS ({Z_SQL})
SELECT f.symbol, f.t, o.t AS o_t, f.side || '|' || o.side AS side FROM f JOIN o ON f.symbol = o.symbol AND f.t - o.t BETWEEN 0 AND 3600 WHERE f.side IN ('LOW', 'HIGH') AND o.side IN ('EXPANSION', 'CONTRACTION')"""


def episodes_query(hours: int):  # noqa: ANN201
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return E.episodes(big(spark, sf_dir), hours * HOUR).select("symbol", "event_id", "t", "episode_start", "episode_end", "member_count", "is_representative")

    gap = hours * HOUR
    sql = f"""WITH e AS ({BIG_SQL}), n AS (SELECT *, CASE WHEN t - lag(t) OVER w < {gap} THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY symbol ORDER BY t, event_id)),
k AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY t, event_id) AS n FROM n)
SELECT symbol, event_id, t, min(t) OVER w AS episode_start, max(t) OVER w + {gap} AS episode_end, count(*) OVER w AS member_count, new = 1 AS is_representative FROM k WINDOW w AS (PARTITION BY symbol, n)"""
    return run, sql


def interval_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = big(spark, sf_dir).select("symbol", "event_id", F.col("t").alias("s"), (F.col("t") + HOUR).alias("e"))
    out = E.interval_components(spans)
    return out.groupBy("symbol", "component_start").agg(F.count("*").alias("members"), F.max("e").alias("component_end"))


COMPONENTS_SQL = f"""WITH e AS (SELECT symbol, t AS s, t + 3600 AS e FROM ({BIG_SQL})), n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY symbol ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM e),
k AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM n)
SELECT symbol, min(s) AS component_start, count(*) AS members, max(e) AS component_end FROM k GROUP BY symbol, n"""


def greedy_non_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = big(spark, sf_dir).select("symbol", "t").distinct()
    return M.run(rows, "symbol", ["t"], lambda: M.Greedy(2 * HOUR), "t long")


GREEDY_SQL = f"""WITH RECURSIVE e AS (SELECT DISTINCT symbol, t FROM ({BIG_SQL})), k AS (SELECT symbol, min(t) AS t FROM e GROUP BY symbol UNION ALL
SELECT k.symbol, (SELECT min(e.t) FROM e WHERE e.symbol = k.symbol AND e.t >= k.t + 7200) AS t FROM k WHERE k.t IS NOT NULL)
SELECT symbol, t FROM k WHERE t IS NOT NULL"""

_e = {f"episodes_{h}h": episodes_query(h) for h in (1, 2, 8, 24)}
QUERIES = {k: v[0] for k, v in _e.items()} | {f.__name__: f for f in (funding_percentile_events, oi_robust_z_events, joint_events_60m, interval_components, greedy_non_overlap)}
ORACLES = {k: v[1] for k, v in _e.items()} | {"funding_percentile_events": FUNDING_SQL, "oi_robust_z_events": Z_SQL, "joint_events_60m": JOINT_SQL, "interval_components": COMPONENTS_SQL, "greedy_non_overlap": GREEDY_SQL}
