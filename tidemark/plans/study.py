"""Event studies: observations, detections, matched controls, contrasts and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import joins as J
from tidemark.operators import states as T
from tidemark.plans.features import CORE, OVER
from tidemark.sources.bars import HOUR, bars

FACTORS = (0.8, 1.0, 1.2)


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared_in(bars(spark, sf_dir))


def prepared_in(rows: DataFrame) -> DataFrame:
    x = S.position(S.with_overlap(S.atr(rows, strict=False), 4, "overlap4"))
    return x.withColumns({"step": F.col("close") - F.lag("close").over(S.order()), "range": F.col("high") - F.col("low")})


PREPARED_SQL = f"""{CORE}, p AS (SELECT symbol, t, i, open, high, low, close, atr_partial AS atr, tr, close - pc AS step, high - low AS range,
  CASE WHEN count(o) OVER w = 4 THEN avg(o) OVER w END AS overlap4 FROM atr WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS 3 PRECEDING))"""


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacement, range and efficiency in units of ATR over the last 4, 8 and 32 bars, signed by the 8-bar direction."""
    x = prepared(spark, sf_dir)
    sign = F.when(F.col("close") >= F.lag("close", 8).over(S.order()), 1).when(F.lag("close", 8).over(S.order()).isNull(), 1).otherwise(-1)
    x = x.withColumn("sign", sign)
    cells = {}
    for n in (4, 8, 32):
        cells[f"displacement{n}"] = F.try_divide(F.col("sign") * (F.col("close") - F.lag("close", n).over(S.order())), "atr")
        cells[f"range{n}"] = S.full(F.try_divide(F.max("high").over(S.last(n)) - F.min("low").over(S.last(n)), "atr"), n)
        cells[f"efficiency{n}"] = F.try_divide(F.abs(F.col("close") - F.lag("close", n).over(S.order())), F.nullif(F.sum("tr").over(S.last(n)), F.lit(0.0)))
    return x.withColumns(cells)


NAMES = [f"{k}{n}" for n in (4, 8, 32) for k in ("displacement", "range", "efficiency")]
OBSERVED_SQL = f"""{PREPARED_SQL}, g AS (SELECT *, CASE WHEN close < lag(close, 8) {OVER} THEN -1 ELSE 1 END AS sign FROM p), ob AS (SELECT symbol, t, i, {", ".join(
  f"sign * (close - lag(close, {n}) {OVER}) / nullif(atr, 0) AS displacement{n}, CASE WHEN i >= {n - 1} THEN (max(high) OVER (PARTITION BY symbol ORDER BY t ROWS {n - 1} PRECEDING) - min(low) OVER (PARTITION BY symbol ORDER BY t ROWS {n - 1} PRECEDING)) / nullif(atr, 0) END AS range{n}, abs(close - lag(close, {n}) {OVER}) / nullif(sum(tr) OVER (PARTITION BY symbol ORDER BY t ROWS {n - 1} PRECEDING), 0) AS efficiency{n}"
  for n in (4, 8, 32))} FROM g)"""


def state_observations_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each bar and field, with its validity."""
    long = observed(spark, sf_dir).unpivot(["symbol", "t"], NAMES, "field", "value")
    return long.select("symbol", "t", "field", F.round(F.col("value") + 1e-9, 5).alias("value"), F.when(F.col("value").isNull(), "NO_HISTORY").otherwise("VALID").alias("validity"))


LONG_SQL = f"""{OBSERVED_SQL}, u AS ({" UNION ALL ".join(f"SELECT symbol, t, '{n}' AS field, {n} AS value FROM ob" for n in NAMES)})
SELECT symbol, t, field, round(value + 1e-9, 5) AS value, CASE WHEN value IS NULL THEN 'NO_HISTORY' ELSE 'VALID' END AS validity FROM u"""


def direction_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars since the close last moved against its present direction."""
    x = prepared(spark, sf_dir).withColumn("up", F.when(F.col("step") >= 0, 1).otherwise(0))
    turn = F.when(F.coalesce(F.col("up") != F.lag("up").over(S.order()), F.lit(True)), F.col("i"))
    origin = F.last(turn, ignorenulls=True).over(S.order().rowsBetween(Window.unboundedPreceding, 0))
    return x.select("symbol", "t", origin.alias("origin"), (F.col("i") - origin).alias("age"))


RUNS_SQL = f"""{PREPARED_SQL}, x AS (SELECT symbol, t, i, CASE WHEN step >= 0 THEN 1 ELSE 0 END AS up FROM p), y AS (SELECT *, CASE WHEN up = lag(up) {OVER} THEN NULL ELSE i END AS turn FROM x)
SELECT symbol, t, max(turn) {OVER} AS origin, i - max(turn) {OVER} AS age FROM y"""


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected_in(bars(spark, sf_dir))


def detected_in(rows: DataFrame) -> DataFrame:
    """Parent of bars i-12..i-5, child of i-4..i: an adverse step within the child, balance, then a step back in the
    parent's direction. intact: no close of the child lies beyond the parent's boundary."""
    x = prepared_in(rows)
    lag = lambda c, n: F.lag(c, n).over(S.order())
    x = x.withColumn("side", F.when(lag("close", 5) >= lag("close", 12), 1).otherwise(-1)).where("i >= 0")
    adverse = F.lit(False)
    for n in (0, 1, 2, 3):
        adverse = adverse | (F.col("side") * lag("step", n) < 0)
    parent = S.order().rowsBetween(-12, -5)
    boundary = F.when(F.col("side") > 0, F.min("low").over(parent)).otherwise(F.max("high").over(parent))
    child = S.order().rowsBetween(-4, 0)
    intact = F.when(F.col("side") > 0, F.min("close").over(child) >= boundary).otherwise(F.max("close").over(child) <= boundary)
    late, early = (F.col("range") + lag("range", 1)) / 2, (lag("range", 3) + lag("range", 4)) / 2
    made = x.withColumns({"adverse": adverse, "boundary": boundary, "intact": intact, "late": late, "early": early, "push": F.col("side") * F.col("step") / F.greatest("atr", F.lit(1e-12))})
    rows = made.where("i >= 12 AND adverse").withColumn("factor", F.explode(F.array(*map(F.lit, FACTORS))))
    balance = (F.col("overlap4") >= 0.35 * F.col("factor")) | (F.col("late") <= F.col("early"))
    return rows.where(F.coalesce(balance, F.lit(False)) & (F.col("push") >= 0.5 * F.col("factor")))


DETECTED_SQL = f"""{PREPARED_SQL}, l AS (SELECT *, CASE WHEN lag(close, 5) {OVER} >= lag(close, 12) {OVER} THEN 1 ELSE -1 END AS side, {", ".join(f"lag(step, {n}) {OVER} AS s{n}" for n in (0, 1, 2, 3))},
  (range + lag(range, 1) {OVER}) / 2 AS late, (lag(range, 3) {OVER} + lag(range, 4) {OVER}) / 2 AS early,
  min(low) OVER pw AS plow, max(high) OVER pw AS phigh, min(close) OVER cw AS clow, max(close) OVER cw AS chigh FROM p
  WINDOW pw AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 12 PRECEDING AND 5 PRECEDING), cw AS (PARTITION BY symbol ORDER BY t ROWS 4 PRECEDING)),
det AS (SELECT *, CASE WHEN side > 0 THEN plow ELSE phigh END AS boundary, CASE WHEN side > 0 THEN clow >= plow ELSE chigh <= phigh END AS intact, side * step / greatest(atr, 1e-12) AS push
FROM l, (VALUES (0.8), (1.0), (1.2)) AS v(factor) WHERE i >= 12 AND (side * s0 < 0 OR side * s1 < 0 OR side * s2 < 0 OR side * s3 < 0) AND coalesce(overlap4 >= 0.35 * factor OR late <= early, false) AND side * step / greatest(atr, 1e-12) >= 0.5 * factor)"""


def detector_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(spark, sf_dir).select("symbol", "t", F.col("factor").cast("double").alias("factor"), F.col("side").cast("long").alias("side"), "boundary", "intact")


def boundary_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections by factor, and those whose parent boundary held."""
    return detected(spark, sf_dir).groupBy("symbol", F.col("factor").cast("double").alias("factor")).agg(F.count("*").alias("raw"), F.count_if("intact").alias("intact"))


def factor_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the detections of the outer factors with those of factor 1."""
    d = detected(spark, sf_dir).withColumn("factor", F.col("factor").cast("double"))
    one = d.where("factor = 1.0")
    parts = [T.jaccard(d.where(F.col("factor") == f), one, ["symbol", "t"]).withColumn("factor", F.lit(f)) for f in (0.8, 1.2)]
    return parts[0].unionByName(parts[1]).select("symbol", "factor", "shared", "either", F.round("jaccard", 6).alias("jaccard"))


JACCARD_SQL = f"""{DETECTED_SQL}, k AS (SELECT symbol, t, CAST(factor AS DOUBLE) AS factor FROM det), one AS (SELECT symbol, t FROM k WHERE factor = 1), f AS (SELECT unnest([0.8, 1.2]) AS factor),
u AS (SELECT symbol, t, f.factor FROM k JOIN f ON k.factor = f.factor UNION SELECT symbol, t, f.factor FROM one, f)
SELECT u.symbol, CAST(u.factor AS DOUBLE) AS factor, count(*) FILTER (WHERE k.t IS NOT NULL AND one.t IS NOT NULL) AS shared, count(*) AS "either", round(count(*) FILTER (WHERE k.t IS NOT NULL AND one.t IS NOT NULL) / count(*), 6) AS jaccard
FROM u LEFT JOIN k ON k.symbol = u.symbol AND k.t = u.t AND k.factor = u.factor LEFT JOIN one ON one.symbol = u.symbol AND one.t = u.t GROUP BY u.symbol, u.factor"""


def with_third(rows: DataFrame, of: DataFrame) -> DataFrame:
    """rows with the third (0 to 2) of the whole span of the bars `of` that t lies in."""
    span = of.agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))  # one row
    third = F.floor((F.col("t") - F.col("_t0")) * 3 / (F.col("_t1") - F.col("_t0") + 1)).cast("long")
    return rows.join(F.broadcast(span)).withColumn("third", third).drop("_t0", "_t1")


THIRD_SQL = "(SELECT min(t) AS t0, max(t) AS t1 FROM bars)"


def third_sql(t: str = "t") -> str:
    return f"CAST(({t} - t0) * 3 // (t1 - t0 + 1) AS BIGINT)"


def thirds_by_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = with_third(detected(spark, sf_dir).where("factor = 1.0"), bars(spark, sf_dir))
    return hits.groupBy("third", F.when(F.col("side") > 0, "UP").otherwise("DOWN").alias("direction")).agg(F.count("*").alias("n"))


THIRDS_SQL = f"""{DETECTED_SQL} SELECT {third_sql()} AS third, CASE WHEN side > 0 THEN 'UP' ELSE 'DOWN' END AS direction, count(*) AS n FROM det, {THIRD_SQL} WHERE factor = 1 GROUP BY ALL"""


def episodes_and_free_bars(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    every = bars(spark, sf_dir)
    cell = lambda x: with_third(x.withColumn("hour", F.pmod(F.floor(F.col("t") / HOUR), F.lit(24)).cast("long")), every)
    events = detected(spark, sf_dir).where("factor = 1.0").select("symbol", "t", "side")
    free = J.away_from(every.select("symbol", "t"), events, "t", "t", 8 * HOUR).select("symbol", "t")
    return cell(events), cell(free)


def matched_controls_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the free bars of an event's hour and third the one with the smallest hash; events without one stay."""
    events, free = episodes_and_free_bars(spark, sf_dir)
    c = free.select("symbol", "hour", "third", F.col("t").alias("control"))
    pick = F.min_by("control", F.sha2(F.concat_ws("|", "symbol", F.col("t").cast("string"), F.col("control").cast("string")), 256))
    out = events.join(c, ["symbol", "hour", "third"], "left").groupBy("symbol", "t").agg(pick.alias("control"))
    return out.select("symbol", "t", F.coalesce("control", F.lit(-1)).alias("control"), F.when(F.col("control").isNull(), "NO_EXACT_STRATUM_SUPPORT").otherwise("MATCHED").alias("status"))


FREE_SQL = f"""{DETECTED_SQL}, ev AS (SELECT symbol, t, side, (t // 3600) % 24 AS hour, {third_sql()} AS third FROM det, {THIRD_SQL} WHERE factor = 1),
free AS (SELECT symbol, t AS control, (t // 3600) % 24 AS hour, {third_sql()} AS third FROM bars, {THIRD_SQL} WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.symbol = bars.symbol AND abs(ev.t - bars.t) <= 28800))"""
STRATIFIED_SQL = f"""{FREE_SQL}, m AS (SELECT ev.symbol, ev.t, arg_min(control, sha256(ev.symbol || '|' || ev.t || '|' || control)) AS control FROM ev LEFT JOIN free USING (symbol, hour, third) GROUP BY ALL)
SELECT symbol, t, coalesce(control, -1) AS control, CASE WHEN control IS NULL THEN 'NO_EXACT_STRATUM_SUPPORT' ELSE 'MATCHED' END AS status FROM m"""


def outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change over the next 3 bars in units of ATR."""
    return prepared(spark, sf_dir).select("symbol", "t", F.try_divide(F.lead("close", 3).over(S.order()) - F.col("close"), "atr").alias("x"))


def contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, x = matched_controls_stratified(spark, sf_dir).where("status = 'MATCHED'"), outcome(spark, sf_dir)
    side = detected(spark, sf_dir).where("factor = 1.0").select("symbol", "t", "side")
    both = m.join(side, ["symbol", "t"]).join(x.withColumnRenamed("x", "event_x"), ["symbol", "t"]).join(x.select("symbol", F.col("t").alias("control"), F.col("x").alias("control_x")), ["symbol", "control"])
    both = both.withColumn("difference", F.col("side") * (F.col("event_x") - F.col("control_x"))).where("difference IS NOT NULL")
    return with_third(both, bars(spark, sf_dir))


CONTRAST_SQL = f"""{FREE_SQL}, m AS (SELECT ev.symbol, ev.t, ev.side, arg_min(control, sha256(ev.symbol || '|' || ev.t || '|' || control)) AS control FROM ev JOIN free USING (symbol, hour, third) GROUP BY ALL),
y AS (SELECT symbol, t, (lead(close, 3) {OVER} - close) / nullif(atr, 0) AS x FROM p),
c AS (SELECT m.symbol, m.t, m.control, m.side, m.side * (a.x - b.x) AS difference, {third_sql("m.t")} AS third FROM {THIRD_SQL} CROSS JOIN m JOIN y a ON a.symbol = m.symbol AND a.t = m.t JOIN y b ON b.symbol = m.symbol AND b.t = m.control WHERE a.x - b.x IS NOT NULL)"""


def paired_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and median paired differences by symbol, and the share above zero."""
    return contrasts(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.avg("difference") + 1e-9, 5).alias("mean"), F.round(F.percentile("difference", 0.5) + 1e-9, 5).alias("median"), F.round(F.avg((F.col("difference") > 0).cast("double")), 6).alias("positive"))


PAIRED_SQL = f"""{CONTRAST_SQL} SELECT symbol, count(*) AS n, round(avg(difference) + 1e-9, 5) AS mean, round(quantile_cont(difference, 0.5) + 1e-9, 5) AS median, round(avg(CAST(difference > 0 AS DOUBLE)), 6) AS positive FROM c GROUP BY symbol"""


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = contrasts(spark, sf_dir).groupBy("symbol", "third").agg(F.sum("difference").alias("s"), F.count("*").alias("n"))
    total = by.groupBy("symbol").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.collect_list("s").alias("thirds"))
    all_ = Window.partitionBy(F.lit(1))  # one row for each symbol
    x = total.withColumns({"pooled": F.sum("s").over(all_), "rest": F.sum("s").over(all_) - F.col("s"), "share": F.try_divide(F.abs("s"), F.sum(F.abs("s")).over(all_))})
    sign = lambda c: F.signum(F.col(c))
    agree = F.size(F.filter("thirds", lambda v: F.signum(v) == sign("pooled")))
    return x.select("symbol", "n", (sign("s") == sign("pooled")).alias("same_sign"), (F.col("share") <= 0.5).alias("not_dominant"), (sign("rest") == sign("pooled")).alias("holds_without"), (agree >= 2).alias("thirds_agree"))


def cell_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each symbol has the pooled sign, isn't dominant, isn't needed for it, and has it in two thirds."""
    return gates(spark, sf_dir)


GATES_SQL = f"""{CONTRAST_SQL}, b AS (SELECT symbol, third, sum(difference) AS s, count(*) AS n FROM c GROUP BY ALL), w AS (SELECT symbol, sum(s) AS s, CAST(sum(n) AS BIGINT) AS n, list(s) AS thirds FROM b GROUP BY symbol),
q AS (SELECT *, sum(s) OVER () AS pooled, sum(abs(s)) OVER () AS total FROM w),
gates AS (SELECT symbol, n, sign(s) = sign(pooled) AS same_sign, abs(s) / total <= 0.5 AS not_dominant, sign(pooled - s) = sign(pooled) AS holds_without, len(list_filter(thirds, lambda v: sign(v) = sign(pooled))) >= 2 AS thirds_agree FROM q)"""


def transfer_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that pass each gate, and the verdict over all."""
    g = gates(spark, sf_dir).agg(F.count("*").alias("symbols"), *[F.count_if(c).alias(c) for c in ("same_sign", "not_dominant", "holds_without", "thirds_agree")])
    good = (F.col("same_sign") >= 3) & (F.col("not_dominant") == F.col("symbols")) & (F.col("holds_without") == F.col("symbols")) & (F.col("thirds_agree") >= 3)
    return g.withColumn("verdict", F.when(F.col("symbols") < 3, "INSUFFICIENT_SUPPORT").when(good, "TRANSFERS").otherwise("DOES_NOT_TRANSFER"))


VERDICT_SQL = f"""{GATES_SQL}, v AS (SELECT count(*) AS symbols, {", ".join(f"count(*) FILTER (WHERE {c}) AS {c}" for c in ("same_sign", "not_dominant", "holds_without", "thirds_agree"))} FROM gates)
SELECT *, CASE WHEN symbols < 3 THEN 'INSUFFICIENT_SUPPORT' WHEN same_sign >= 3 AND not_dominant = symbols AND holds_without = symbols AND thirds_agree >= 3 THEN 'TRANSFERS' ELSE 'DOES_NOT_TRANSFER' END AS verdict FROM v"""


def matched_controls_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The free bar of an event's symbol and third that is nearest in ATR and range."""
    events, free = episodes_and_free_bars(spark, sf_dir)
    x = prepared(spark, sf_dir).select("symbol", "t", "atr", "range")
    e, c = events.join(x, ["symbol", "t"]), free.join(x, ["symbol", "t"]).select("symbol", "third", F.col("t").alias("control"), F.col("atr").alias("atr2"), F.col("range").alias("range2"))
    pairs = e.join(c, ["symbol", "third"]).withColumn("score", F.abs(F.col("atr") - F.col("atr2")) + F.abs(F.col("range") - F.col("range2")))
    return pairs.groupBy("symbol", "t").agg(F.min_by("control", F.struct(F.round("score", 9).alias("s"), "control")).alias("control"), F.round(F.min("score"), 6).alias("score"))


SCORE_SQL = f"""{FREE_SQL}, z AS (SELECT ev.symbol, ev.t, control, abs(a.atr - b.atr) + abs(a.range - b.range) AS score FROM ev JOIN free USING (symbol, third) JOIN p a ON a.symbol = ev.symbol AND a.t = ev.t JOIN p b ON b.symbol = ev.symbol AND b.t = control)
SELECT symbol, t, arg_min(control, (round(score, 9), control)) AS control, round(min(score), 6) AS score FROM z GROUP BY symbol, t"""

QUERIES = {f.__name__: f for f in (state_observations_long, direction_runs, detector_factors, boundary_gates, factor_jaccard, thirds_by_direction, matched_controls_stratified, matched_controls_score, paired_contrast, cell_gates, transfer_verdict)}
ORACLES = {
    "state_observations_long": LONG_SQL, "direction_runs": RUNS_SQL,
    "detector_factors": f"{DETECTED_SQL} SELECT symbol, t, CAST(factor AS DOUBLE) AS factor, CAST(side AS BIGINT) AS side, boundary, intact FROM det",
    "boundary_gates": f"{DETECTED_SQL} SELECT symbol, CAST(factor AS DOUBLE) AS factor, count(*) AS raw, count(*) FILTER (WHERE intact) AS intact FROM det GROUP BY ALL",
    "factor_jaccard": JACCARD_SQL, "thirds_by_direction": THIRDS_SQL, "matched_controls_stratified": STRATIFIED_SQL, "matched_controls_score": SCORE_SQL, "paired_contrast": PAIRED_SQL,
    "cell_gates": f"{GATES_SQL} SELECT * FROM gates", "transfer_verdict": VERDICT_SQL,
}
