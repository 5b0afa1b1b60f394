"""Six exits of every crossing of the fast average with the regime, over hourly bars, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import exits as X
from tidemark.plans.cycles import HOURLY
from tidemark.plans.features import OVER
from tidemark.sources.bars import bars

PRICES = ("entry", "stop", "exit", "gross", "net", "mfe", "mae", "capture", "giveback")


def signalled(spark: SparkSession, sf_dir: str, warm: int = 20) -> DataFrame:
    x = S.ema(S.ema(S.atr(bars(spark, sf_dir, 1), strict=False), "close", 2 / 28, "ema27"), "close", 2 / 201, "ema200")
    back = lambda c, n=1: F.lag(c, n).over(S.order())
    x = S.position(x).withColumns({"ema27": F.round("ema27", 9), "ema200": F.round("ema200", 9), "atr": F.round("atr", 9)})
    slope = F.col("ema200") - back("ema200", warm)
    up = (F.col("close") > F.col("ema200")) & (slope > 0) & (F.col("ema27") > F.col("ema200"))
    down = (F.col("close") < F.col("ema200")) & (slope < 0) & (F.col("ema27") < F.col("ema200"))
    x = x.withColumn("regime", F.when(up, 1).when(down, -1).otherwise(0))
    rises = (back("close") <= back("ema27")) & (F.col("close") > F.col("ema27")) & (F.col("regime") > 0)
    falls = (back("close") >= back("ema27")) & (F.col("close") < F.col("ema27")) & (F.col("regime") < 0)
    return x.select("symbol", "t", "open", "high", "low", "close", "atr", "ema27", "regime", F.when(rises, 1).when(falls, -1).otherwise(0).alias("signal"))


def exit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.run(signalled(spark, sf_dir))
    return found.select("symbol", "rule", "side", "signal_t", "entry_t", "exit_t", "reason", "bars", "even", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in PRICES])


EXIT_SQL = f"""{HOURLY}, e AS (SELECT symbol, t, i, open, high, low, close, round(atr_partial, 9) AS u, round(list_reduce(closes, lambda a, b: a * (26.0 / 28) + b * (2.0 / 28)), 9) AS f, round(list_reduce(closes, lambda a, b: a * (199.0 / 201) + b * (2.0 / 201)), 9) AS s FROM atr),
r AS (SELECT *, CASE WHEN close > s AND s - lag(s, 20) {OVER} > 0 AND f > s THEN 1 WHEN close < s AND s - lag(s, 20) {OVER} < 0 AND f < s THEN -1 ELSE 0 END AS regime, max(i) OVER (PARTITION BY symbol) AS final,
  min(low) OVER w AS low5, max(high) OVER w AS high5, lead(t) {OVER} AS next_t, lead(open) {OVER} AS next_open FROM e WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS 4 PRECEDING)),
g AS (SELECT *, CASE WHEN lag(close) {OVER} <= lag(f) {OVER} AND close > f AND regime > 0 THEN 1 WHEN lag(close) {OVER} >= lag(f) {OVER} AND close < f AND regime < 0 THEN -1 ELSE 0 END AS signal FROM r),
trades AS (SELECT symbol, i AS si, t AS signal_t, signal AS side, u AS unit, next_t AS entry_t, next_open * (1 + signal * 0.0005) AS entry, CASE WHEN signal > 0 THEN low5 ELSE high5 END AS stop, final FROM g WHERE signal <> 0 AND u <> 0 AND next_t IS NOT NULL),
b AS (SELECT trades.*, rules.rule, g.i, g.t, g.high, g.low, g.close, g.f, g.regime, g.next_t, g.next_open, side * (CASE WHEN side > 0 THEN g.high ELSE g.low END - entry) / unit AS up, side * (CASE WHEN side > 0 THEN g.low ELSE g.high END - entry) / unit AS dn,
    side * (g.close - entry) / unit AS now, side * (g.close - g.f) < 0 AS off, coalesce(side * (p.close - p.f) < 0, false) AS off_before, p.i > si AS held_before
  FROM trades CROSS JOIN (SELECT unnest(['R0', 'R1', 'R2', 'R3', 'R4', 'R5']) AS rule) rules JOIN g ON g.symbol = trades.symbol AND g.i > si AND g.i < trades.final JOIN g p ON p.symbol = g.symbol AND p.i = g.i - 1),
c AS (SELECT *, greatest(0, max(up) OVER w) AS best, least(0, min(dn) OVER w) AS worst FROM b WINDOW w AS (PARTITION BY symbol, si, rule ORDER BY i)),
d AS (SELECT *, rule = 'R1' AND best >= 1 AS moved, CASE WHEN rule = 'R1' AND best >= 1 THEN entry * (1 + side * 0.0025) ELSE stop END AS active FROM c),
x AS (SELECT *, CASE WHEN side * (CASE WHEN side > 0 THEN low ELSE high END - active) <= 0 THEN CASE WHEN moved THEN 'BREAK_EVEN_STOP' ELSE 'STOP_A' END WHEN side * regime < 0 THEN 'REGIME_FLIP' WHEN rule = 'R0' AND off_before AND off THEN 'EMA27_TWO_CLOSES'
    WHEN rule = 'R2' AND best >= 1.5 AND best - now >= 1 THEN 'ATR_GIVEBACK' WHEN rule IN ('R3', 'R5') AND best >= 1 AND now <= 0.5 * best THEN 'MFE_50_GIVEBACK' WHEN rule IN ('R4', 'R5') AND held_before AND off_before AND off THEN 'EMA27_HYSTERESIS' END AS reason FROM d),
h AS (SELECT symbol, si, rule, min(i) FILTER (reason IS NOT NULL) AS hit, max(i) AS latest FROM x GROUP BY ALL),
o AS (SELECT x.symbol, x.rule, side, signal_t, entry_t, entry, stop, unit, moved AS even, best, worst, CASE WHEN hit IS NULL THEN z.t WHEN reason IN ('STOP_A', 'BREAK_EVEN_STOP') THEN x.t ELSE x.next_t END AS exit_t,
    CASE WHEN hit IS NULL THEN z.close WHEN reason IN ('STOP_A', 'BREAK_EVEN_STOP') THEN active ELSE x.next_open END * (1 - side * 0.0005) AS paid, coalesce(reason, 'END_OF_DATA') AS reason, x.i - x.si + CASE WHEN hit IS NOT NULL AND reason IN ('STOP_A', 'BREAK_EVEN_STOP') THEN 0 ELSE 1 END AS bars
  FROM h JOIN x ON x.symbol = h.symbol AND x.si = h.si AND x.rule = h.rule AND x.i = coalesce(hit, latest) JOIN g z ON z.symbol = x.symbol AND z.i = x.final
  UNION ALL SELECT trades.symbol, rules.rule, side, signal_t, entry_t, entry, stop, unit, false, 0, 0, z.t, z.close * (1 - side * 0.0005), 'END_OF_DATA', 1 FROM trades CROSS JOIN (SELECT unnest(['R0', 'R1', 'R2', 'R3', 'R4', 'R5']) AS rule) rules JOIN g z ON z.symbol = trades.symbol AND z.i = trades.final WHERE si + 1 = trades.final)
SELECT symbol, rule, side, signal_t, entry_t, exit_t, reason, bars, even, round(entry + 1e-9, 6) AS entry, round(stop + 1e-9, 6) AS stop, round(paid + 1e-9, 6) AS exit, round(side * (paid - entry) / entry + 1e-9, 6) AS gross, round(side * (paid - entry) / entry - 0.002 + 1e-9, 6) AS net,
  round(best + 1e-9, 6) AS mfe, round(worst + 1e-9, 6) AS mae, round(side * (paid - entry) / nullif(best * unit, 0) + 1e-9, 6) AS capture, round(best - side * (paid - entry) / unit + 1e-9, 6) AS giveback FROM o"""

QUERIES = {"exit_rules": exit_rules}
ORACLES = {"exit_rules": EXIT_SQL}
