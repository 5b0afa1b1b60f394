"""Platforms of four-hour bars, their null models and their stability, with recursive SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import platforms as P
from tidemark.sources.bars import bars, bars_sql

REPLICATES = 200
BANDS, LEASTS = (1.2, 1.5, 2.0), (5, 6, 8)


def platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch by bar number, and whether it is a platform; known_at is the bar from which it is known as one."""
    found = P.changes(bars(spark, sf_dir))
    rows = P.segments(P.with_volatility(found.select(F.col("symbol").alias("key"), "i", "p")))
    size = F.col("last") - F.col("first") + 1
    return rows.select(F.col("key").alias("symbol"), "first", "last", size.alias("bars"), (size >= P.LEAST).alias("platform"), F.when(size >= P.LEAST, F.col("first") + P.LEAST - 1).alias("known_at"))


def platform_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.against_null(P.changes(bars(spark, sf_dir)), REPLICATES)
    return found.select("symbol", "model", "statistic", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("real", "null_mean", "null_deviation", "p")])


def platform_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.overlap_of_grid(P.changes(bars(spark, sf_dir)), BANDS, LEASTS)
    return found.select("symbol", "a", "b", F.round(F.col("overlap") + 1e-9, 6).alias("overlap"))


C_SQL = f"""c AS MATERIALIZED (SELECT symbol, i, p, p - lag(p) OVER (PARTITION BY symbol ORDER BY i) AS dp FROM (SELECT symbol, ln(close) AS p, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i FROM ({bars_sql()}) WHERE close > 0))"""
#: Of paths q (key, i, p) with a band w: rows v with volatility, and the stretches z. A state reads one bar: as the start of a stretch, or as its continuation.
WALK_SQL = """v AS MATERIALIZED (SELECT key, i, w, round(p, 9) AS p, CASE WHEN count(dp) OVER f >= 3 THEN round(stddev_pop(dp) OVER f, 9) END AS v, max(i) OVER (PARTITION BY key, w) AS final
  FROM (SELECT *, p - lag(p) OVER (PARTITION BY key, w ORDER BY i) AS dp FROM q) WINDOW f AS (PARTITION BY key, w ORDER BY i ROWS 13 PRECEDING)),
s AS (SELECT key, w, final, CAST(0 AS BIGINT) AS next, false AS inside, CAST(-1 AS BIGINT) AS first, CAST(-1 AS BIGINT) AS last, CAST(0 AS DOUBLE) AS centre, CAST(0 AS DOUBLE) AS unit, 0 AS n, false AS done FROM (SELECT DISTINCT key, w, final FROM v)
  UNION ALL SELECT key, w, final, CASE WHEN ends THEN l + 1 ELSE next + 1 END, live AND NOT ends, f0, l, c0, u0, CASE WHEN ends THEN 0 ELSE k END, ends
  FROM (SELECT *, live AND (k >= 2 OR next = final) AS ends FROM (SELECT s.key, s.w, s.final, s.next, s.inside OR coalesce(v.v, 0) > 0 AS live, CASE WHEN s.inside THEN s.first ELSE s.next END AS f0, CASE WHEN s.inside THEN s.centre ELSE v.p END AS c0, CASE WHEN s.inside THEN s.unit ELSE v.v END AS u0,
      CASE WHEN NOT s.inside THEN s.next WHEN abs(v.p - s.centre) <= s.w * s.unit THEN s.next ELSE s.last END AS l, CASE WHEN s.inside AND abs(v.p - s.centre) > (s.w + 0.5) * s.unit THEN s.n + 1 ELSE 0 END AS k
    FROM s JOIN v ON v.key = s.key AND v.w = s.w AND v.i = s.next))),
z AS MATERIALIZED (SELECT key, w, first, last, last - first + 1 AS bars FROM s WHERE done)"""
PLATFORMS_SQL = f"""WITH RECURSIVE {C_SQL}, q AS (SELECT symbol AS key, i, p, CAST(1.5 AS DOUBLE) AS w FROM c), {WALK_SQL}
SELECT key AS symbol, first, last, bars, bars >= 6 AS platform, CASE WHEN bars >= 6 THEN first + 5 END AS known_at FROM z"""


def chance_sql(*parts: str) -> str:
    text = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


NULLS_SQL = f"""WITH RECURSIVE {C_SQL}, n AS (SELECT symbol, count(*) AS n FROM c WHERE dp IS NOT NULL GROUP BY symbol), r AS (SELECT range AS r FROM range({REPLICATES})),
m AS (SELECT symbol, 'shuffle' AS model, r, row_number() OVER (PARTITION BY symbol, r ORDER BY {chance_sql("symbol", "r", "i")}, i) AS i, dp FROM c, r WHERE dp IS NOT NULL
  UNION ALL SELECT d.symbol, 'block', d.r, d.i, c.dp FROM (SELECT symbol, r, b * 6 + k + 1 AS i, {chance_sql("symbol", "r", "b")} % (n - 6) + 1 + k AS place FROM (SELECT symbol, n, r, unnest(range((n - 1) // 6 + 1)) AS b FROM n, r WHERE n > 6), (SELECT range AS k FROM range(6)) WHERE b * 6 + k + 1 <= n) d JOIN c ON c.symbol = d.symbol AND c.i = d.place),
q AS (SELECT symbol || '|' || model || '|' || r AS key, i, sum(dp) OVER (PARTITION BY symbol, model, r ORDER BY i) AS p, CAST(1.5 AS DOUBLE) AS w FROM m UNION ALL SELECT symbol || '|' || model || '|' || r, 0, 0.0, 1.5 FROM (SELECT DISTINCT symbol, model, r FROM m) UNION ALL SELECT symbol, i, p, 1.5 FROM c), {WALK_SQL},
k AS (SELECT key, count(*) AS size FROM q GROUP BY key), t AS (SELECT k.key, CAST(count(*) FILTER (bars >= 6) AS DOUBLE) AS platforms, coalesce(sum(bars) FILTER (bars >= 6), 0) / any_value(size) AS coverage, coalesce(quantile_cont(bars, 0.5) FILTER (bars >= 6), 0.0) AS median_bars FROM k LEFT JOIN z ON z.key = k.key GROUP BY k.key),
u AS (UNPIVOT (SELECT key, platforms, CAST(coverage AS DOUBLE) AS coverage, CAST(median_bars AS DOUBLE) AS median_bars FROM t) ON platforms, coverage, median_bars INTO NAME statistic VALUE value)
SELECT a.key AS symbol, split_part(b.key, '|', 2) AS model, a.statistic, round(any_value(a.value) + 1e-9, 5) AS real, round(avg(b.value) + 1e-9, 5) AS null_mean, round(stddev_pop(b.value) + 1e-9, 5) AS null_deviation, round(avg(CAST(b.value >= a.value AS INT)) + 1e-9, 5) AS p
FROM u a JOIN u b ON b.statistic = a.statistic AND split_part(b.key, '|', 1) = a.key AND b.key <> a.key WHERE NOT contains(a.key, '|') GROUP BY a.key, split_part(b.key, '|', 2), a.statistic"""
OVERLAP_SQL = f"""WITH RECURSIVE {C_SQL}, q AS (SELECT symbol AS key, i, p, w FROM c, (SELECT unnest([1.2, 1.5, 2.0]::DOUBLE[]) AS w)), {WALK_SQL}, g AS (SELECT w, unnest([5, 6, 8]) AS least FROM (SELECT unnest([1.2, 1.5, 2.0]::DOUBLE[]) AS w)),
marks AS (SELECT key, g.w || '/' || least AS setting, (g.w * 100 + least) AS rank, unnest(range(first, last + 1)) AS i FROM z JOIN g ON g.w = z.w AND bars >= least),
pairs AS (SELECT a.w || '/' || a.least AS a, b.w || '/' || b.least AS b FROM g a JOIN g b ON a.w * 100 + a.least < b.w * 100 + b.least)
SELECT k.key AS symbol, a, b, round(coalesce((SELECT count(*) FROM marks x JOIN marks y ON x.key = y.key AND x.i = y.i WHERE x.key = k.key AND x.setting = a AND y.setting = b) / nullif((SELECT count(DISTINCT i) FROM marks x WHERE x.key = k.key AND setting IN (a, b)), 0), 1.0) + 1e-9, 6) AS overlap
FROM (SELECT DISTINCT symbol AS key FROM c) k, pairs"""

QUERIES = {f.__name__: f for f in (platforms, platform_nulls, platform_overlap)}
ORACLES = {"platforms": PLATFORMS_SQL, "platform_nulls": NULLS_SQL, "platform_overlap": OVERLAP_SQL}
