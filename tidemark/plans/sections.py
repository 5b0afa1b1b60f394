"""Windows and sections of dispute with SQL, and the tables of their chains of episodes."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import sections as X
from tidemark.plans.features import CORE, OVER
from tidemark.sources.bars import bars, bars_sql

LAST4 = "OVER (PARTITION BY symbol ORDER BY t ROWS 3 PRECEDING)"
UP_TO = "OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING)"
BARS_SQL = f"""{CORE.replace(bars_sql(), bars_sql(1))}, e AS (SELECT *, list_reduce(closes, lambda a, b: a * (26.0 / 28) + b * (2.0 / 28)) AS f, list_reduce(closes, lambda a, b: a * (199.0 / 201) + b * (2.0 / 201)) AS s, list_reduce(trs, lambda a, b: a * (13.0 / 14) + b * (1.0 / 14)) AS u FROM atr),
d AS (SELECT symbol, t, i, high, close, u, f, s, f - lag(f) {OVER} AS df, f - s - lag(f - s) {OVER} AS dg, coalesce(f > s AND s > lag(s, 6) {OVER}, false) AS context, coalesce(f < lag(f, 2) {OVER} OR f < lag(f, 3) {OVER}, false) AS falls FROM e),
x AS (SELECT *, context AND coalesce(df < 0, false) AND falls AND close < f AS core, context AND close > f AND coalesce(df > 0 AND dg >= 0, false) AS aligned, coalesce(f < s AND close < f AND df < 0 AND dg <= 0, false) AS other,
  CAST(close <= f AS INT) + CAST(coalesce(df <= 0, false) AS INT) + CAST(coalesce(dg < 0, false) AS INT) AS discord FROM d)"""
WINDOWS_SQL = f"""{BARS_SQL},
y AS (SELECT *, i >= 3 AND sum(CAST(aligned AS INT)) {LAST4} >= 3 AS back3, i >= 3 AND sum(CAST(other AS INT)) {LAST4} >= 3 AS other3, max(CASE WHEN aligned THEN i END) {UP_TO} AS last_aligned,
  min(CASE WHEN aligned THEN i END) {LAST4} AS back_first, min(CASE WHEN other THEN i END) {LAST4} AS other_first, max(i) OVER (PARTITION BY symbol) AS last,
  context AND (discord >= 2 OR (discord >= 1 AND coalesce(lead(context) {OVER} AND lead(discord) {OVER} >= 1, false))) AS opens FROM x),
c AS (SELECT o.symbol, o.i AS trigger, o.last, (SELECT max(r.i) FROM y r WHERE r.symbol = o.symbol AND r.back3 AND r.i < o.i AND r.i >= greatest(0, o.i - 30) + 3) AS run_at, (SELECT min(r.i) FROM y r WHERE r.symbol = o.symbol AND r.i >= o.i AND (r.back3 OR r.other3)) AS done_at FROM y o WHERE core),
r AS (SELECT c.*, y.last_aligned AS run_end FROM c LEFT JOIN y ON y.symbol = c.symbol AND y.i = c.run_at),
w AS (SELECT r.symbol, r.trigger, (SELECT min(y.i) FROM y WHERE y.symbol = r.symbol AND opens AND y.i >= coalesce(r.run_end + 1, greatest(0, r.trigger - 12))) AS start, run_end,
  CASE WHEN y.back3 THEN y.back_first WHEN y.other3 THEN y.other_first ELSE r.last END AS candidate, coalesce(done_at, r.last) AS "end", CASE WHEN y.back3 THEN 'RECOVERED_LONG' WHEN y.other3 THEN 'NEW_DOWN_CONFIGURATION' ELSE 'OPEN_AT_TRAIN_END' END AS resolution
  FROM r LEFT JOIN y ON y.symbol = r.symbol AND y.i = r.done_at)"""
SECTIONS_CTE = f"""{WINDOWS_SQL},
g AS (SELECT *, max("end") OVER (PARTITION BY symbol ORDER BY trigger ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM w),
h AS (SELECT g.*, reached IS NULL OR (start > reached AND EXISTS (SELECT 1 FROM y WHERE y.symbol = g.symbol AND back3 AND y.i BETWEEN greatest(reached + 4, 3) AND g.start - 1)
  AND NOT (start - reached - 1 < 4 AND (SELECT count(*) FROM y WHERE y.symbol = g.symbol AND aligned AND y.i BETWEEN reached + 1 AND g.start - 1) < 3)) AS apart FROM g),
k AS (SELECT *, sum(CAST(apart AS INT)) OVER (PARTITION BY symbol ORDER BY trigger) AS section FROM h),
z AS (SELECT symbol, CAST(section AS BIGINT) AS section, min(start) AS start, min(trigger) AS trigger, max(trigger) AS last_trigger, max("end") AS "end", arg_max(resolution, "end" * 1000000000 + trigger) AS resolution, count(*) AS triggers FROM k GROUP BY symbol, section)"""


def dispute_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.windows(X.features(bars(spark, sf_dir, 1)))


def dispute_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = X.features(bars(spark, sf_dir, 1))
    return X.sections(x, X.windows(x))


def window_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trigger with what three of four bars from it on do first: recover (RECOVERED_LONG) or take the other configuration."""
    return dispute_windows(spark, sf_dir).select("symbol", "trigger", "resolution", (F.col("end") - F.col("trigger")).alias("bars"))


def recovery_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar of a merged section on which three of four bars have recovered, graded by six facts; the ceiling is the section's high before the bar."""
    x = X.features(bars(spark, sf_dir, 1))
    count = lambda c, n: F.sum(F.coalesce(c, F.lit(False)).cast("int")).over(S.last(n))
    back = lambda c: F.lag(c, 3).over(S.order())
    x = x.withColumns({"recovered": count(F.col("aligned"), 4), "above6": count(F.col("close") > F.col("ema27"), 6), "rising4": count(F.col("change") > 0, 4), "wider4": count(F.col("gap1") > 0, 4), "faster": F.col("ema27") > back("ema27"), "wider": F.col("gap") > back("gap")})
    parts = X.sections(x, X.windows(x)).select(F.col("symbol").alias("_s"), "section", F.col("start").alias("_a"), F.col("end").alias("_b"))
    # Sections don't overlap: each bar meets the last one that began before it.
    met = x.join(parts, (F.col("symbol") == F.col("_s")) & (F.col("i") >= F.col("_a")) & (F.col("i") <= F.col("_b")))
    inside = Window.partitionBy("symbol", "section").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("ceiling", F.max("high").over(inside)).where((F.col("i") - 3 >= F.col("_a")) & (F.col("recovered") >= 3) & (F.col("atr") > 0))
    separate = F.round((F.col("close") - F.col("ema27")) / F.col("atr"), 9) >= X.EXTENSION
    clear = (F.col("close") > F.col("ceiling")) | (F.round((F.col("close") - F.col("ceiling")) / F.col("atr"), 9) >= X.CLEAR)
    facts = [separate, clear, F.col("faster") & (F.col("rising4") >= 3), F.col("wider") & (F.col("wider4") >= 3), F.col("recovered") >= 3, F.col("above6") >= X.PERSISTENT]
    score = sum((F.coalesce(f, F.lit(False)).cast("long") for f in facts), F.lit(0).cast("long"))
    met = met.withColumns({"score": score, "price": separate | clear})
    grade = F.when((F.col("score") >= X.STRONG) & F.col("price"), "STRONG_RECOVERY").when(F.col("score") >= X.MODERATE, "MODERATE_RECOVERY").otherwise("WEAK_RECOVERY")
    return met.select("symbol", "t", "section", "score", grade.alias("strength"))


STRENGTH_SQL = f"""{SECTIONS_CTE},
wide AS (SELECT *, sum(CAST(aligned AS INT)) {LAST4} AS recovered, sum(CAST(close > f AS INT)) OVER (PARTITION BY symbol ORDER BY t ROWS 5 PRECEDING) AS above6, sum(CAST(coalesce(df > 0, false) AS INT)) {LAST4} AS rising4,
  sum(CAST(coalesce(dg > 0, false) AS INT)) {LAST4} AS wider4, f > lag(f, 3) {OVER} AS faster, f - s > lag(f - s, 3) {OVER} AS wider FROM x),
met AS (SELECT wide.*, z.section, z.start, max(high) OVER (PARTITION BY wide.symbol, z.section ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ceiling FROM wide JOIN z ON z.symbol = wide.symbol AND wide.i BETWEEN z.start AND z."end"),
facts AS (SELECT *, round((close - f) / u, 9) >= 0.75 AS separate, close > ceiling OR round((close - ceiling) / u, 9) >= 0.25 AS clear FROM met WHERE i - 3 >= start AND recovered >= 3 AND u > 0),
graded AS (SELECT *, CAST(separate AS BIGINT) + CAST(clear AS BIGINT) + CAST(coalesce(faster, false) AND rising4 >= 3 AS BIGINT) + CAST(coalesce(wider, false) AND wider4 >= 3 AS BIGINT) + 1 + CAST(above6 >= 5 AS BIGINT) AS score FROM facts)
SELECT symbol, t, section, CAST(score AS BIGINT) AS score, CASE WHEN score >= 4 AND (separate OR clear) THEN 'STRONG_RECOVERY' WHEN score >= 3 THEN 'MODERATE_RECOVERY' ELSE 'WEAK_RECOVERY' END AS strength FROM graded"""


def chain_table(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return X.table(X.run(bars(spark, sf_dir, 1)), kind)


DECLARED = (dispute_windows, dispute_sections, window_resolution, recovery_strength)
QUERIES = {f.__name__: f for f in DECLARED} | {f"chain_{kind.lower()}s": partial(chain_table, kind=kind) for kind in X.TABLES}
ORACLES = {
    "dispute_windows": f"{WINDOWS_SQL} SELECT * FROM w",
    "dispute_sections": f"{SECTIONS_CTE} SELECT * FROM z",
    "window_resolution": f'{WINDOWS_SQL} SELECT symbol, trigger, resolution, "end" - trigger AS bars FROM w',
    "recovery_strength": STRENGTH_SQL,
}
