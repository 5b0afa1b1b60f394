"""State models over averages, their runs and transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import joins as J
from tidemark.operators import machines as M
from tidemark.operators import states as T
from tidemark.plans.features import CORE, OVER
from tidemark.sources.bars import HOUR, bars

STATES = ["DOWN", "TRANSITION", "UP"]


def model_a(spark: SparkSession, sf_dir: str, hours: int = 4) -> DataFrame:
    """UP or DOWN where the order of two averages and both their slopes agree, else TRANSITION."""
    x = S.ema(S.ema(bars(spark, sf_dir, hours), "close", 2 / 10, "fast"), "close", 2 / 28, "slow")
    x = x.withColumns({"df": F.col("fast") - F.lag("fast").over(S.order()), "ds": F.col("slow") - F.lag("slow").over(S.order())})
    up, down = (F.col("fast") > F.col("slow")) & (F.col("df") > 0) & (F.col("ds") > 0), (F.col("fast") < F.col("slow")) & (F.col("df") < 0) & (F.col("ds") < 0)
    return x.withColumn("state", F.when(up, "UP").when(down, "DOWN").otherwise("TRANSITION"))


A_SQL = f"""{CORE}, e AS (SELECT symbol, t, close, list_reduce(closes, lambda a, b: a * 0.8 + b * 0.2) AS fast, list_reduce(closes, lambda a, b: a * (26.0 / 28) + b * (2.0 / 28)) AS slow FROM atr),
d AS (SELECT *, fast - lag(fast) {OVER} AS df, slow - lag(slow) {OVER} AS ds FROM e),
a AS (SELECT *, CASE WHEN fast > slow AND df > 0 AND ds > 0 THEN 'UP' WHEN fast < slow AND df < 0 AND ds < 0 THEN 'DOWN' ELSE 'TRANSITION' END AS state FROM d)"""


def state_model_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_a(spark, sf_dir).select("symbol", "t", "state")


def state_model_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and slow slope beyond its noise, then whether the averages' distance grows."""
    x = model_a(spark, sf_dir).withColumn("abs_ds", F.abs("ds"))
    x = x.withColumn("eps", 1.5 * S.rolling_median("abs_ds", 20)).withColumn("gap", F.col("fast") - F.col("slow"))
    x = x.withColumn("dg", F.col("gap") - F.lag("gap").over(S.order()))
    side = F.when((F.col("gap") > 0) & (F.col("ds") > F.col("eps")), 1).when((F.col("gap") < 0) & (F.col("ds") < -F.col("eps")), -1).otherwise(0)
    phase = F.when(F.col("dg") * F.col("side") > F.col("eps"), "EXPANDING").when(F.col("dg") * F.col("side") < -F.col("eps"), "WEAKENING").otherwise("STABLE")
    x = x.withColumn("side", F.coalesce(side, F.lit(0)))
    return x.select("symbol", "t", F.when(F.col("side") == 0, "TRANSITION").otherwise(F.concat(F.when(F.col("side") > 0, "UP_").otherwise("DOWN_"), phase)).alias("state"))


B_SQL = f"""{A_SQL}, n AS (SELECT *, fast - slow AS gap, CASE WHEN count(ds) OVER w = 20 THEN 1.5 * quantile_cont(abs(ds), 0.5) OVER w END AS eps FROM a WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS 19 PRECEDING)),
g AS (SELECT *, gap - lag(gap) {OVER} AS dg, CASE WHEN gap > 0 AND ds > eps THEN 1 WHEN gap < 0 AND ds < -eps THEN -1 ELSE 0 END AS side FROM n)
SELECT symbol, t, CASE WHEN side = 0 THEN 'TRANSITION' ELSE CASE WHEN side > 0 THEN 'UP_' ELSE 'DOWN_' END || CASE WHEN dg * side > eps THEN 'EXPANDING' WHEN dg * side < -eps THEN 'WEAKENING' ELSE 'STABLE' END END AS state FROM g"""


def debounced_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proposed state counts from its second row in a row; a crossing of the averages is TRANSITION at once."""
    x = model_a(spark, sf_dir).select("symbol", "t", F.when(F.col("ds").isNull(), "WARMUP").otherwise(F.col("state")).alias("proposed"), (F.col("fast") - F.col("slow")).alias("above"))
    return T.debounced(x, "proposed", "above", "state").select("symbol", "t", "proposed", "state")


PAST = "OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
DEBOUNCED_SQL = f"""{A_SQL}, p AS (SELECT symbol, t, CASE WHEN ds IS NULL THEN 'WARMUP' ELSE state END AS proposed, nullif(sign(fast - slow), 0) AS side FROM a),
c AS (SELECT *, coalesce(side <> last_value(side IGNORE NULLS) {PAST}, false) AS crossed FROM p), s AS (SELECT *, proposed <> 'WARMUP' AND NOT crossed AS still FROM c),
k AS (SELECT *, CASE WHEN proposed = 'WARMUP' THEN 'WARMUP' WHEN crossed THEN 'TRANSITION' WHEN still AND lag(still) {OVER} AND proposed = lag(proposed) {OVER} THEN proposed END AS taken FROM s)
SELECT symbol, t, proposed, coalesce(last_value(taken IGNORE NULLS) {OVER}, 'WARMUP') AS state FROM k"""


def hysteresis_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.atr(bars(spark, sf_dir)).withColumn("p", S.rank_among_last("atr", 30))
    return T.hysteresis(rows, "p", 0.4, 0.7).select("symbol", "t", "high")


HYSTERESIS_SQL = f"""{CORE}, l AS (SELECT symbol, t, atr, list(atr) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS before FROM atr),
p AS (SELECT symbol, t, CASE WHEN atr IS NOT NULL AND len(list_filter(before, lambda x: x IS NOT NULL)) = 30 THEN (len(list_filter(before, lambda x: x < atr)) + len(list_filter(before, lambda x: x <= atr))) / 60.0 END AS p FROM l),
s AS (SELECT symbol, t, CASE WHEN p > 0.7 THEN true WHEN p < 0.4 THEN false END AS sure FROM p)
SELECT symbol, t, coalesce(last_value(sure IGNORE NULLS) {OVER}, false) AS high FROM s"""


def dwell_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = T.dwell(model_a(spark, sf_dir))
    return runs.groupBy("symbol", "state").agg(F.count("*").alias("runs"), F.sum("length").alias("bars"), F.max("length").alias("longest"), F.round(F.percentile("length", 0.5), 6).alias("median"))


DWELL_SQL = f"""{A_SQL}, n AS (SELECT symbol, t, state, CASE WHEN state = lag(state) {OVER} THEN 0 ELSE 1 END AS new FROM a), k AS (SELECT *, sum(new) {OVER} AS n FROM n), r AS (SELECT symbol, state, count(*) AS length FROM k GROUP BY symbol, n, state)
SELECT symbol, state, count(*) AS runs, CAST(sum(length) AS BIGINT) AS bars, max(length) AS longest, round(quantile_cont(length, 0.5), 6) AS median FROM r GROUP BY ALL"""


def transition_matrix_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.transitions(model_a(spark, sf_dir), STATES).withColumn("p", F.round("p", 6))


def transition_matrix_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.transitions(model_a(spark, sf_dir), STATES, changes_only=True).withColumn("p", F.round("p", 6))


def matrix_sql(where: str) -> str:
    return f"""{A_SQL}, s AS (SELECT symbol, lag(state) {OVER} AS before, state AS after FROM a), c AS (SELECT symbol, before, after, count(*) AS n FROM s WHERE before IS NOT NULL {where} GROUP BY ALL),
v(x) AS (VALUES ('DOWN'), ('TRANSITION'), ('UP')), g AS (SELECT symbol, b.x AS before, f.x AS after FROM (SELECT DISTINCT symbol FROM a), v b, v f),
dense AS (SELECT symbol, before, after, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (symbol, before, after))
SELECT *, round(n / nullif(sum(n) OVER (PARTITION BY symbol, before), 0), 6) AS p FROM dense"""


def scale_relation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1-hour states against the 4-hour state that had closed."""
    child = model_a(spark, sf_dir, 1).select("symbol", "t", F.col("state").alias("child"), (F.col("t") + HOUR).alias("closed"))
    parent = model_a(spark, sf_dir).select("symbol", (F.col("t") + 4 * HOUR).alias("known"), F.col("state").alias("parent"))
    met = J.asof(child, parent, "closed", "known", ["parent"]).where("parent IS NOT NULL")
    relation = F.when(F.col("parent") == "TRANSITION", "PARENT_TRANSITION").when(F.col("child") == "TRANSITION", "LOWER_TRANSITION").when(F.col("child") == F.col("parent"), F.concat(F.lit("ALIGNED_"), "parent")).otherwise("LOWER_OPPOSES_PARENT")
    return met.groupBy("symbol", relation.alias("relation")).agg(F.count("*").alias("n"))


def scale_sql() -> str:
    from tidemark.sources.bars import bars_sql

    hourly = A_SQL.replace(bars_sql(), bars_sql(1))
    return f"""SELECT symbol, relation, count(*) AS n FROM (SELECT c.symbol, CASE WHEN p.state = 'TRANSITION' THEN 'PARENT_TRANSITION' WHEN c.state = 'TRANSITION' THEN 'LOWER_TRANSITION' WHEN c.state = p.state THEN 'ALIGNED_' || p.state ELSE 'LOWER_OPPOSES_PARENT' END AS relation
FROM ({hourly} SELECT symbol, t, state, t + 3600 AS closed FROM a) c ASOF JOIN ({A_SQL} SELECT symbol, t + 14400 AS known, state FROM a) p ON c.symbol = p.symbol AND c.closed >= p.known) GROUP BY ALL"""


def state_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.entropy_bits(model_a(spark, sf_dir)).withColumn("bits", F.round("bits", 6))


def volatility_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ATR against the median of the 96 before: LOW under 0.8, HIGH over 1.2, UNKNOWN with fewer."""
    x = S.atr(bars(spark, sf_dir), strict=False).withColumn("ratio", F.try_divide("atr", S.rolling_median("atr", 96, before=True)))
    regime = F.when(F.col("ratio").isNull(), "UNKNOWN").when(F.col("ratio") < 0.8, "LOW").when(F.col("ratio") > 1.2, "HIGH").otherwise("NORMAL")
    return x.select("symbol", "t", F.round(F.col("ratio") + 1e-9, 6).alias("ratio"), regime.alias("regime"))


REGIME_SQL = f"""{CORE}, m AS (SELECT symbol, t, atr_partial / CASE WHEN count(*) OVER w = 96 THEN quantile_cont(atr_partial, 0.5) OVER w END AS ratio FROM atr WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING))
SELECT symbol, t, round(ratio + 1e-9, 6) AS ratio, CASE WHEN ratio IS NULL THEN 'UNKNOWN' WHEN ratio < 0.8 THEN 'LOW' WHEN ratio > 1.2 THEN 'HIGH' ELSE 'NORMAL' END AS regime FROM m"""


def move_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.run(S.atr(bars(spark, sf_dir)).select("symbol", "t", "close", "atr"), "symbol", ["t"], lambda: M.MoveAge(2.0), "t long, side int, age int, extreme double")


def zone_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.atr(bars(spark, sf_dir)).select("symbol", "t", "high", "low", "close", "atr")
    return M.run(rows, "symbol", ["t"], M.Zone, "kind string, t long, start long, top double, bottom double, version int, side int")


QUERIES = {f.__name__: f for f in (state_model_a, state_model_b, debounced_state, hysteresis_state, dwell_stats, transition_matrix_full, transition_matrix_changes, scale_relation_stats, state_entropy, volatility_regime, move_age, zone_machine)}
ORACLES = {
    "state_model_a": f"{A_SQL} SELECT symbol, t, state FROM a", "state_model_b": B_SQL, "dwell_stats": DWELL_SQL, "transition_matrix_full": matrix_sql(""), "transition_matrix_changes": matrix_sql("AND before <> after"),
    "debounced_state": DEBOUNCED_SQL, "hysteresis_state": HYSTERESIS_SQL, "scale_relation_stats": scale_sql(), "volatility_regime": REGIME_SQL,
    "state_entropy": f"{A_SQL}, c AS (SELECT symbol, state, count(*) AS n FROM a GROUP BY ALL), p AS (SELECT symbol, n / sum(n) OVER (PARTITION BY symbol) AS p FROM c) SELECT symbol, round(-sum(p * log2(p)), 6) AS bits FROM p GROUP BY symbol",
}
