"""Corrections, cool-downs, backbones and the sequential machines, with recursive SQL beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import machines as M
from tidemark.plans.features import CORE, OVER
from tidemark.plans.states import A_SQL, model_a
from tidemark.sources.bars import bars, bars_sql

HOURLY = CORE.replace(bars_sql(), bars_sql(1))


def recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


# Kernels against SQL: one row a bar, the state of the bar before beside it.
MOVE_AGE_SQL = f"""{recursive(CORE)}, b AS MATERIALIZED (SELECT symbol, t, i, close, atr FROM atr), m AS (
  SELECT symbol, t, i, 0 AS side, 0 AS age, close AS extreme FROM b WHERE i = 0
  UNION ALL SELECT symbol, t, i, CASE WHEN starts THEN CAST(sign(close - e) AS INTEGER) WHEN turns THEN -s ELSE s END, CASE WHEN starts OR turns THEN 0 WHEN coalesce(atr, 0) <> 0 THEN a + 1 ELSE a END,
    CASE WHEN starts OR turns OR (coalesce(atr, 0) <> 0 AND s * (close - e) > 0) THEN close ELSE e END
  FROM (SELECT b.symbol, b.t, b.i, b.close, b.atr, m.side AS s, m.age AS a, m.extreme AS e, coalesce(b.atr <> 0 AND m.side = 0 AND abs(b.close - m.extreme) >= 2 * b.atr, false) AS starts,
    coalesce(b.atr <> 0 AND m.side <> 0 AND m.side * (m.extreme - b.close) >= 2 * b.atr, false) AS turns FROM m JOIN b ON b.symbol = m.symbol AND b.i = m.i + 1))
SELECT symbol, t, side, age, extreme FROM m"""

ZONE_SQL = f"""{recursive(CORE)}, b AS MATERIALIZED (SELECT symbol, t, i, high, low, close, atr, max(i) OVER (PARTITION BY symbol) AS final FROM atr), m AS (
  SELECT symbol, t, i, final, 1 AS k, t AS start, high AS top, low AS bottom, 0 AS side, 0 AS n, 0 AS version, '' AS kind FROM b WHERE i = 0
  UNION ALL SELECT symbol, t, i, final, k, start, top, bottom, side, n, version, CASE WHEN seeding AND k = 12 THEN 'OPEN' WHEN NOT seeding AND n >= 2 THEN 'EXIT' ELSE '' END FROM (
    SELECT symbol, t, i, final, seeding, CASE WHEN seeding THEN had + 1 ELSE 12 END AS k, CASE WHEN seeding AND had = 0 THEN t ELSE p_start END AS start,
      CASE WHEN NOT seeding THEN p_top WHEN had = 0 THEN high ELSE greatest(p_top, high) END AS top, CASE WHEN NOT seeding THEN p_bottom WHEN had = 0 THEN low ELSE least(p_bottom, low) END AS bottom,
      CASE WHEN seeding THEN 0 ELSE s END AS side, CASE WHEN seeding OR s = 0 THEN 0 WHEN s = p_side THEN p_n + 1 ELSE 1 END AS n, v AS version
    FROM (SELECT b.*, m.start AS p_start, m.top AS p_top, m.bottom AS p_bottom, m.side AS p_side, m.n AS p_n, m.kind = 'EXIT' OR m.k < 12 AS seeding, CASE WHEN m.kind = 'EXIT' THEN 0 ELSE m.k END AS had,
      m.version + CASE WHEN m.kind = 'EXIT' THEN 1 ELSE 0 END AS v, CASE WHEN b.close > m.top + 0.15 * coalesce(b.atr, 0) THEN 1 WHEN b.close < m.bottom - 0.15 * coalesce(b.atr, 0) THEN -1 ELSE 0 END AS s
      FROM m JOIN b ON b.symbol = m.symbol AND b.i = m.i + 1)))
SELECT symbol, kind, t, start, top, bottom, version, side FROM m WHERE kind <> ''
UNION ALL SELECT symbol, 'CENSORED', NULL, start, top, bottom, version, 0 FROM m WHERE i = final AND k = 12 AND kind <> 'EXIT'"""

BACKTEST_SQL = f"""{recursive(HOURLY)}, e AS (SELECT *, list_reduce(closes, lambda a, b: a * (26.0 / 28) + b * (2.0 / 28)) AS ema FROM atr), f AS (SELECT symbol, t, i, open, high, low, close, CASE WHEN close > ema THEN 1 ELSE -1 END AS side, lag(atr_partial) {OVER} AS ab FROM e),
b AS MATERIALIZED (SELECT *, CASE WHEN side <> lag(side) {OVER} THEN side ELSE 0 END AS signal, max(i) OVER (PARTITION BY symbol) AS final FROM f),
m AS (SELECT symbol || '@' || v.k AS key, symbol, CAST(v.k AS DOUBLE) AS w, i, final, t, close, CAST(NULL AS BIGINT) AS pt, 0 AS ps, CAST(0 AS DOUBLE) AS price, CAST(0 AS DOUBLE) AS stop, 0 AS n, CAST(0 AS DOUBLE) AS mfe, CAST(0 AS DOUBLE) AS mae, false AS leave, CASE WHEN coalesce(ab, 0) <> 0 THEN signal ELSE 0 END AS ord,
    CAST(NULL AS VARCHAR) AS reason, CAST(0 AS DOUBLE) AS paid FROM b, (VALUES ('1.0'), ('1.5'), ('2.5')) AS v(k) WHERE i = 0
  UNION ALL SELECT key, symbol, w, i, final, t, close, pt, ps, price, stop, n, mfe, mae, live AND NOT hit AND row_side = -ps, CASE WHEN (NOT live OR hit) AND coalesce(ab, 0) <> 0 THEN signal ELSE 0 END,
    CASE WHEN turned THEN 'TURN' WHEN live AND hit THEN 'STOP' END, CASE WHEN turned THEN open * (1 - ps * 0.0005) ELSE stop END
  FROM (SELECT *, pt IS NOT NULL AND NOT turned AS live, coalesce(ps * (worst - stop) <= 0, false) AS hit, CASE WHEN turned THEN n0 ELSE n0 + 1 END AS n,
      CASE WHEN turned THEN mfe0 ELSE greatest(mfe0, ps * (best / price - 1)) END AS mfe, CASE WHEN turned THEN mae0 ELSE least(mae0, ps * (worst / price - 1)) END AS mae
    FROM (SELECT *, CASE WHEN ps > 0 THEN high ELSE low END AS best, CASE WHEN ps > 0 THEN low ELSE high END AS worst FROM (
      SELECT key, symbol, w, i, final, t, open, high, low, close, ab, signal, row_side, has AND leave AS turned, CASE WHEN enters THEN t WHEN has THEN pt END AS pt, CASE WHEN enters THEN ord ELSE ps END AS ps,
        CASE WHEN enters THEN open * (1 + ord * 0.0005) ELSE price END AS price, CASE WHEN enters THEN open * (1 + ord * 0.0005) - ord * w * ab ELSE stop END AS stop,
        CASE WHEN enters THEN 0 ELSE n END AS n0, CASE WHEN enters THEN 0 ELSE mfe END AS mfe0, CASE WHEN enters THEN 0 ELSE mae END AS mae0
      FROM (SELECT b.symbol, b.i, b.final, b.t, b.open, b.high, b.low, b.close, b.ab, b.signal, b.side AS row_side, m.key, m.w, m.pt, m.ps, m.price, m.stop, m.n, m.mfe, m.mae, m.leave, m.ord,
        m.pt IS NOT NULL AND m.reason IS NULL AS has, m.ord <> 0 AND NOT (m.pt IS NOT NULL AND m.reason IS NULL) AND b.open > 0 AS enters FROM m JOIN b ON b.symbol = m.symbol AND b.i = m.i + 1))))),
x AS (SELECT key, pt, t, ps, price, CASE WHEN reason IS NULL THEN close ELSE paid END AS paid, coalesce(reason, 'END') AS reason, n, mfe, mae FROM m WHERE reason IS NOT NULL OR (i = final AND pt IS NOT NULL))
SELECT key, pt AS entry_t, t AS exit_t, ps AS side, round(price + 1e-9, 6) AS entry, round(paid + 1e-9, 6) AS exit, reason, n AS bars, round(ps * (paid / price - 1) + 1e-9, 6) AS gross, round(ps * (paid / price - 1) - 0.002 + 1e-9, 6) AS net, round(mfe + 1e-9, 6) AS mfe, round(mae + 1e-9, 6) AS mae FROM x"""


def corrections(spark: SparkSession, sf_dir: str, ahead: int = 20) -> DataFrame:
    """Runs of bars that close against the averages' order of the bar before, by symbol and order: how deep they go, how
    near to the averages, whether a slope changed its sign, and when the extreme before them was passed (within `ahead` bars)."""
    before = lambda c: F.lag(c).over(S.order())
    x = S.position(model_a(spark, sf_dir)).withColumns({"side": F.signum(F.col("fast") - F.col("slow")), "step": F.col("close") - before("close")})
    x = x.withColumns({"way": before("side"), "base": before("close"), "extreme": F.when(before("side") > 0, before("high")).otherwise(before("low")), "df0": F.signum(before("df")), "ds0": F.signum(before("ds"))})
    x = x.withColumn("against", F.coalesce(F.col("way") * F.col("step") < 0, F.lit(False)))
    new = F.col("against") & ~F.coalesce(before("against") & (before("way") == F.col("way")), F.lit(False))
    x = x.withColumn("run", F.sum(new.cast("long")).over(S.order())).withColumn("next", F.collect_list(F.struct("high", "low")).over(S.order().rowsBetween(1, ahead)))
    first = lambda c: F.min_by(c, "i")
    rows = x.where("against").groupBy("symbol", "run").agg(
        F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("bars"), first("way").cast("long").alias("side"), first("base").alias("base"), first("extreme").alias("extreme"), first("df0").alias("df0"), first("ds0").alias("ds0"),
        F.max_by("next", "i").alias("next"), F.min("close").alias("least"), F.max("close").alias("most"), F.min(F.abs(F.try_divide(F.col("close"), F.col("fast")) - 1)).alias("near_fast"), F.min(F.abs(F.try_divide(F.col("close"), F.col("slow")) - 1)).alias("near_slow"),
        F.collect_set(F.signum("df")).alias("dfs"), F.collect_set(F.signum("ds")).alias("dss"),
    )
    other = lambda signs, sign: F.exists(signs, lambda s: (s != 0) & (s != F.coalesce(F.col(sign), F.lit(0.0))))
    passed = F.transform("next", lambda b, k: F.when(F.when(F.col("side") > 0, b["high"] > F.col("extreme")).otherwise(b["low"] < F.col("extreme")), k + 1))
    depth = F.try_divide(F.greatest(F.abs(F.col("least") - F.col("base")), F.abs(F.col("most") - F.col("base"))), F.col("base"))
    return rows.select("symbol", "start", "end", "side", "bars", F.round(100 * depth + 1e-9, 5).alias("depth"), *[F.round(100 * F.col(c) + 1e-9, 5).alias(c) for c in ("near_fast", "near_slow")], other("dfs", "df0").alias("fast_turned"), other("dss", "ds0").alias("slow_turned"), F.array_min(F.filter(passed, lambda k: k.isNotNull())).cast("long").alias("passed_after"))


CORRECTIONS_SQL = f"""{A_SQL}, q AS (SELECT a.*, atr.i, atr.high, atr.low, sign(a.fast - a.slow) AS side FROM a JOIN atr USING (symbol, t)),
l AS (SELECT *, lag(side) {OVER} AS way, lag(close) {OVER} AS base, CASE WHEN lag(side) {OVER} > 0 THEN lag(high) {OVER} ELSE lag(low) {OVER} END AS extreme, sign(lag(df) {OVER}) AS df0, sign(lag(ds) {OVER}) AS ds0 FROM q),
g AS (SELECT *, coalesce(way * (close - base) < 0, false) AS against FROM l), n AS (SELECT *, against AND NOT coalesce(lag(against) {OVER} AND lag(way) {OVER} = way, false) AS new FROM g), r AS (SELECT *, sum(CAST(new AS INT)) {OVER} AS run FROM n),
c AS (SELECT symbol, min(t) AS start, max(t) AS "end", max(i) AS last, count(*) AS bars, arg_min(way, i) AS side, arg_min(base, i) AS base, arg_min(extreme, i) AS extreme, max(abs(close - base0)) AS deep, min(abs(close / nullif(fast, 0) - 1)) AS near_fast, min(abs(close / nullif(slow, 0) - 1)) AS near_slow,
    bool_or(sign(df) <> 0 AND sign(df) <> coalesce(f0, 0)) AS fast_turned, bool_or(sign(ds) <> 0 AND sign(ds) <> coalesce(s0, 0)) AS slow_turned
  FROM (SELECT *, first_value(base) OVER v AS base0, first_value(df0) OVER v AS f0, first_value(ds0) OVER v AS s0 FROM r WHERE against WINDOW v AS (PARTITION BY symbol, run ORDER BY t)) GROUP BY symbol, run)
SELECT c.symbol, start, "end", CAST(any_value(c.side) AS BIGINT) AS side, any_value(bars) AS bars, round(100 * any_value(deep / nullif(base, 0)) + 1e-9, 5) AS depth, round(100 * any_value(near_fast) + 1e-9, 5) AS near_fast, round(100 * any_value(near_slow) + 1e-9, 5) AS near_slow,
  coalesce(any_value(fast_turned), false) AS fast_turned, coalesce(any_value(slow_turned), false) AS slow_turned, min(CASE WHEN CASE WHEN c.side > 0 THEN b.high > extreme ELSE b.low < extreme END THEN b.i - last END) AS passed_after
FROM c LEFT JOIN atr b ON b.symbol = c.symbol AND b.i BETWEEN last + 1 AND last + 20 GROUP BY c.symbol, start, "end" """


def generated_events(spark: SparkSession, sf_dir: str, most_crosses: int = 30) -> DataFrame:
    """Hourly candidates: a move of two ATR over 30 bars, a first step back and a closing distance to the average, where the
    slow average isn't crossed too often; an event bars any other for 6 bars and its own direction for 12."""
    x = S.ema(S.ema(S.atr(bars(spark, sf_dir, 1), strict=False), "close", 2 / 28, "near"), "close", 2 / 201, "far")
    back = lambda c, n=1: F.lag(c, n).over(S.order())
    x = S.position(x).withColumns({"gap": F.col("close") - F.col("near"), "above": F.signum(F.round(F.col("close") - F.col("far"), 9))})
    x = x.withColumn("crossed", F.when(F.col("above") * back("above") < 0, 1).otherwise(0))
    x = x.withColumns({"move": F.round(F.try_divide(F.col("close") - back("close", 29), "atr"), 9), "step": F.col("close") - back("close"), "closing": F.round(F.col("gap") - back("gap", 3), 9), "from": F.round(F.try_divide("gap", "atr"), 9), "crosses": F.sum("crossed").over(S.last(49))})
    calm = (F.col("i") >= 50) & (F.col("crosses") <= most_crosses) & (F.col("atr") > 0)
    up = calm & (F.col("move") <= -2) & (F.col("step") > 0) & (F.col("closing") > 0) & (F.col("from") >= -1.5)
    down = calm & (F.col("move") >= 2) & (F.col("step") < 0) & (F.col("closing") < 0) & (F.col("from") <= 1.5)
    found = x.select("symbol", "t", "i", F.when(up, "LONG").when(down, "SHORT").alias("direction")).where("direction IS NOT NULL")
    return M.run(found, "symbol", ["i"], M.CoolDown, "t long, i long, direction string")


GENERATED_SQL = f"""{recursive(HOURLY)}, e AS (SELECT *, list_reduce(closes, lambda a, b: a * (26.0 / 28) + b * (2.0 / 28)) AS near, list_reduce(closes, lambda a, b: a * (199.0 / 201) + b * (2.0 / 201)) AS far FROM atr),
g AS (SELECT *, close - near AS gap, sign(round(close - far, 9)) AS above FROM e), h AS (SELECT *, CAST(coalesce(above * lag(above) {OVER} < 0, false) AS INT) AS crossed FROM g),
k AS (SELECT symbol, t, i, atr_partial AS u, round((close - lag(close, 29) {OVER}) / nullif(atr_partial, 0), 9) AS move, close - pc AS step1, round(gap - lag(gap, 3) {OVER}, 9) AS closing, round(gap / nullif(atr_partial, 0), 9) AS away, sum(crossed) OVER (PARTITION BY symbol ORDER BY t ROWS 48 PRECEDING) AS crosses FROM h),
d AS (SELECT symbol, t, i, CASE WHEN move <= -2 AND step1 > 0 AND closing > 0 AND away >= -1.5 THEN 'LONG' WHEN move >= 2 AND step1 < 0 AND closing < 0 AND away <= 1.5 THEN 'SHORT' END AS direction FROM k WHERE i >= 50 AND crosses <= 30 AND u > 0),
c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i) AS n FROM d WHERE direction IS NOT NULL),
m AS (SELECT symbol, t, i, direction, n, true AS kept, i AS last, CASE WHEN direction = 'LONG' THEN i ELSE -1000 END AS long, CASE WHEN direction = 'SHORT' THEN i ELSE -1000 END AS short FROM c WHERE n = 1
  UNION ALL SELECT symbol, t, i, direction, n, kept, CASE WHEN kept THEN i ELSE last END, CASE WHEN kept AND direction = 'LONG' THEN i ELSE long END, CASE WHEN kept AND direction = 'SHORT' THEN i ELSE short END
  FROM (SELECT c.*, m.last, m.long, m.short, c.i - m.last >= 6 AND c.i - CASE WHEN c.direction = 'LONG' THEN m.long ELSE m.short END >= 12 AS kept FROM m JOIN c ON c.symbol = m.symbol AND c.n = m.n + 1))
SELECT symbol, t, i, direction FROM m WHERE kept"""


def backbone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slow backbone: ACTIVE, FLATTENING or LOST by the slow average's slope in the averages' direction, taken on
    after two bars, from LOST to ACTIVE after three; a steep adverse slope is LOST at once, TRANSITION always."""
    x = S.position(S.atr(model_a(spark, sf_dir), strict=False))
    side = F.when(F.col("fast") > F.col("slow"), 1).when(F.col("fast") < F.col("slow"), -1).otherwise(0)
    x = x.withColumn("side", side).withColumn("slope", F.round(F.col("side") * S.slope("slow", "atr", 12), 9)).withColumn("along", F.avg(F.when(F.col("side") * F.col("ds") > 0, 1.0).otherwise(0.0)).over(S.last(12)))
    base = F.when((F.col("i") < 24) | F.col("slope").isNull(), "WARMUP").when(F.col("side") == 0, "TRANSITION").when((F.col("slope") < -0.5) | ((F.col("along") < 0.5) & (F.col("slope") <= 0)), "LOST").when((F.col("slope") > 0.5) & (F.col("along") >= 0.75), "ACTIVE").otherwise("FLATTENING")
    rows = x.select("symbol", "t", base.alias("base"), "slope")
    return M.run(rows, "symbol", ["t"], M.Backbone, "t long, base string, state string")


BACKBONE_SQL = f"""{recursive(A_SQL)}, q AS (SELECT a.*, i, atr_partial AS u, CASE WHEN fast > slow THEN 1 WHEN fast < slow THEN -1 ELSE 0 END AS side FROM a JOIN atr USING (symbol, t)),
s AS (SELECT *, round(side * (slow - lag(slow, 12) {OVER}) / nullif(u, 0), 9) AS slope, avg(CASE WHEN side * ds > 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY symbol ORDER BY t ROWS 11 PRECEDING) AS along FROM q),
b AS MATERIALIZED (SELECT symbol, t, i, slope, CASE WHEN i < 24 OR slope IS NULL THEN 'WARMUP' WHEN side = 0 THEN 'TRANSITION' WHEN slope < -0.5 OR (along < 0.5 AND slope <= 0) THEN 'LOST' WHEN slope > 0.5 AND along >= 0.75 THEN 'ACTIVE' ELSE 'FLATTENING' END AS base FROM s),
m AS (SELECT symbol, t, i, base, CASE WHEN base IN ('WARMUP', 'TRANSITION') THEN base ELSE 'WARMUP' END AS state, CASE WHEN base IN ('WARMUP', 'TRANSITION') THEN NULL ELSE base END AS candidate, CASE WHEN base IN ('WARMUP', 'TRANSITION') THEN 0 ELSE 1 END AS n FROM b WHERE i = 0
  UNION ALL SELECT symbol, t, i, base, CASE WHEN now OR n1 >= CASE WHEN state = 'LOST' AND base = 'ACTIVE' THEN 3 ELSE 2 END THEN base ELSE state END,
    CASE WHEN now OR base = state OR n1 >= CASE WHEN state = 'LOST' AND base = 'ACTIVE' THEN 3 ELSE 2 END THEN NULL ELSE base END, CASE WHEN now OR base = state OR n1 >= CASE WHEN state = 'LOST' AND base = 'ACTIVE' THEN 3 ELSE 2 END THEN 0 ELSE n1 END
  FROM (SELECT b.*, m.state, b.base IN ('WARMUP', 'TRANSITION') OR (b.base = 'LOST' AND b.slope < -1.5 AND m.state <> 'LOST') AS now, CASE WHEN b.base = m.state THEN 0 WHEN b.base = m.candidate THEN m.n + 1 ELSE 1 END AS n1 FROM m JOIN b ON b.symbol = m.symbol AND b.i = m.i + 1))
SELECT symbol, t, base, state FROM m"""

QUERIES = {f.__name__: f for f in (corrections, generated_events, backbone)}
ORACLES = {"corrections": CORRECTIONS_SQL, "generated_events": GENERATED_SQL, "backbone": BACKBONE_SQL, "move_age": MOVE_AGE_SQL, "zone_machine": ZONE_SQL, "backtest_grid": BACKTEST_SQL}
