"""Bars, averages, ranges and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.sources.bars import HOUR, bars, bars_sql, resample_bars

B = f"WITH bars AS ({bars_sql()})"
OVER = "OVER (PARTITION BY symbol ORDER BY t)"
CORE = f"""{B}, i AS (
  SELECT *, row_number() {OVER} - 1 AS i, lag(close) {OVER} AS pc, lag(high) {OVER} AS ph, lag(low) {OVER} AS pl FROM bars
), tr AS (
  SELECT *, greatest(high - low, abs(high - coalesce(pc, close)), abs(low - coalesce(pc, close))) AS tr, abs(close - pc) AS step,
    least(high - low, ph - pl) AS least_range,
    CASE WHEN least(high - low, ph - pl) > 0 AND ph IS NOT NULL THEN least(1.0, greatest(0.0, (least(high, ph) - greatest(low, pl)) / least(high - low, ph - pl))) END AS o
  FROM i
), atr AS (
  SELECT *, CASE WHEN i >= 13 THEN avg(tr) OVER (PARTITION BY symbol ORDER BY t ROWS 13 PRECEDING) END AS atr,
    avg(tr) OVER (PARTITION BY symbol ORDER BY t ROWS 13 PRECEDING) AS atr_partial,
    list(close) OVER (PARTITION BY symbol ORDER BY t) AS closes, list(tr) OVER (PARTITION BY symbol ORDER BY t) AS trs
  FROM tr
)"""


def rounded(frame: DataFrame, *names: str) -> DataFrame:
    """Six places; a billionth is added so that equal sums in another order round alike at exact halves."""
    return frame.select("symbol", "t", *[F.round(F.col(n) + 1e-9, 6).alias(n) for n in names])


def sql_rounded(*names: str) -> str:
    return ", ".join(f"round({n} + 1e-9, 6) AS {n}" for n in names)


def bars_query(hours: int):  # noqa: ANN201
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return bars(spark, sf_dir, hours).withColumn("turnover", F.round("turnover", 4))

    return run, f"SELECT * REPLACE (round(turnover, 4) AS turnover) FROM ({bars_sql(hours)})"


def bars_complete_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_bars(bars(spark, sf_dir, 1), HOUR, 4 * HOUR).select("symbol", "t", "open", "high", "low", "close", "volume")


BARS_COMPLETE_SQL = f"""WITH b AS ({bars_sql(1)})
SELECT symbol, t // 14400 * 14400 AS t, arg_min(open, t) AS open, max(high) AS high, min(low) AS low, arg_max(close, t) AS close, CAST(sum(volume) AS BIGINT) AS volume
FROM b GROUP BY 1, t // 14400 * 14400 HAVING count(*) = 4"""


def true_range_atr_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.atr(bars(spark, sf_dir)), "tr", "atr")


def atr_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.atr(bars(spark, sf_dir), strict=False), "atr")


def atr_wilder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.ema(S.true_range(bars(spark, sf_dir)), "tr", 1 / 14, "atr"), "atr")


def ema_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.ema(bars(spark, sf_dir), "close", 2 / 28, "ema", seed=26), "ema")


def ema_adjust_false(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.ema(S.ema(bars(spark, sf_dir), "close", 2 / 28, "ema27"), "close", 2 / 201, "ema200"), "ema27", "ema200")


def core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with the causal features of the (3, 12, 6) and (6, 24, 12) scales."""
    x = S.ema(S.atr(bars(spark, sf_dir)), "close", 2 / 28, "ema", seed=26)
    for k, w, pairs in ((3, 12, 6), (6, 24, 12)):
        x = S.with_overlap(S.with_efficiency(x, w, f"efficiency{w}"), pairs, f"overlap{pairs}")
        x = x.withColumns({f"slope{k}": S.slope("ema", "atr", k), f"displacement{w}": S.slope("close", "atr", w)})
    return x


FIELDS = ("slope3", "displacement12", "efficiency12", "overlap6", "slope6", "displacement24", "efficiency24", "overlap12")
EMA_SEEDED = "CASE WHEN i >= 26 THEN list_reduce(list_concat([list_avg(closes[1:27])], closes[28:]), lambda a, b: a * (26.0 / 28) + b * (2.0 / 28)) END"
CORE_FULL = f"""{CORE}, e AS (SELECT *, {EMA_SEEDED} AS ema FROM atr), f AS (
  SELECT symbol, t, i, atr,
    (ema - lag(ema, 3) {OVER}) / nullif(atr, 0) AS slope3, (ema - lag(ema, 6) {OVER}) / nullif(atr, 0) AS slope6,
    (close - lag(close, 12) {OVER}) / nullif(atr, 0) AS displacement12, (close - lag(close, 24) {OVER}) / nullif(atr, 0) AS displacement24,
    abs(close - lag(close, 12) {OVER}) / nullif(sum(step) OVER (PARTITION BY symbol ORDER BY t ROWS 11 PRECEDING), 0) AS efficiency12,
    abs(close - lag(close, 24) {OVER}) / nullif(sum(step) OVER (PARTITION BY symbol ORDER BY t ROWS 23 PRECEDING), 0) AS efficiency24,
    CASE WHEN count(o) OVER (PARTITION BY symbol ORDER BY t ROWS 5 PRECEDING) = 6 THEN avg(o) OVER (PARTITION BY symbol ORDER BY t ROWS 5 PRECEDING) END AS overlap6,
    CASE WHEN count(o) OVER (PARTITION BY symbol ORDER BY t ROWS 11 PRECEDING) = 12 THEN avg(o) OVER (PARTITION BY symbol ORDER BY t ROWS 11 PRECEDING) END AS overlap12
  FROM e)"""


def feature_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(core(spark, sf_dir), *FIELDS)


def efficiency_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(core(spark, sf_dir), "efficiency12", "overlap6")


def frozen_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank thresholds of the features by symbol."""
    x = core(spark, sf_dir)
    cells = []
    for k, w, pairs in ((3, 12, 6), (6, 24, 12)):
        for name, value, ps in (("slope", F.abs(f"slope{k}"), (0.7, 0.5)), ("displacement", F.abs(f"displacement{w}"), (0.7, 0.5)), ("efficiency", F.col(f"efficiency{w}"), (0.3,)), ("overlap", F.col(f"overlap{pairs}"), (0.7,))):
            cells += [(f"{name}_{k}_p{int(p * 100)}", value, p) for p in ps]
    x = x.select("symbol", *[v.alias(f"v{j}") for j, (_, v, _) in enumerate(cells)])
    return x.groupBy("symbol").agg(*[F.round(S.nearest_rank(f"v{j}", p), 6).alias(n) for j, (n, _, p) in enumerate(cells)])


def threshold_sql() -> str:
    cells = []
    for k, w, pairs in ((3, 12, 6), (6, 24, 12)):
        for name, value, ps in (("slope", f"abs(slope{k})", (0.7, 0.5)), ("displacement", f"abs(displacement{w})", (0.7, 0.5)), ("efficiency", f"efficiency{w}", (0.3,)), ("overlap", f"overlap{pairs}", (0.7,))):
            cells += [f"round(quantile_disc({value}, {p}), 6) AS {name}_{k}_p{int(p * 100)}" for p in ps]
    return f"{CORE_FULL} SELECT symbol, {', '.join(cells)} FROM f GROUP BY symbol"


def volatility_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.atr(bars(spark, sf_dir)).withColumn("percentile", S.rank_among_last("atr", 96)), "percentile")


VOLATILITY_SQL = f"""{CORE}, w AS (SELECT symbol, t, atr, array_agg(atr) FILTER (WHERE atr IS NOT NULL) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING) AS past FROM atr)
SELECT symbol, t, round(CASE WHEN atr IS NOT NULL AND len(past) = 96 THEN (len(list_filter(past, lambda x: x < atr)) + 0.5 * len(list_filter(past, lambda x: x = atr))) / 96 END + 1e-9, 6) AS percentile FROM w"""


def rolling_median_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = bars(spark, sf_dir, 1).withColumn("change", F.abs(F.col("close") - F.lag("close").over(S.order())))
    return rounded(x.withColumn("noise", S.rolling_median("change", 120)), "noise")


NOISE_SQL = f"""WITH bars AS ({bars_sql(1)}), c AS (SELECT *, abs(close - lag(close) {OVER}) AS change FROM bars)
SELECT symbol, t, round(CASE WHEN count(change) OVER w = 120 THEN quantile_cont(change, 0.5) OVER w END + 1e-9, 6) AS noise FROM c WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS 119 PRECEDING)"""


def breakout_prev20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes beyond the extremes of the 20 bars before."""
    before = S.order().rowsBetween(-20, -1)
    ready = F.count(F.lit(1)).over(before) == 20
    x = bars(spark, sf_dir).withColumns({"top": F.when(ready, F.max("high").over(before)), "bottom": F.when(ready, F.min("low").over(before))})
    side = F.when(F.col("close") > F.col("top"), "UP").when(F.col("close") < F.col("bottom"), "DOWN").otherwise("NONE")
    return x.select("symbol", "t", "top", "bottom", side.alias("side"))


BREAKOUT_SQL = f"""{B}, x AS (SELECT symbol, t, close, CASE WHEN count(*) OVER w = 20 THEN max(high) OVER w END AS top, CASE WHEN count(*) OVER w = 20 THEN min(low) OVER w END AS bottom
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT symbol, t, top, bottom, CASE WHEN close > top THEN 'UP' WHEN close < bottom THEN 'DOWN' ELSE 'NONE' END AS side FROM x"""


def ema_cross_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the close's side of its average within 50 bars, and bars since the last one."""
    x = S.position(S.ema(bars(spark, sf_dir), "close", 2 / 28, "ema"))
    x = x.withColumn("side", F.when(F.col("close") > F.col("ema"), 1).when(F.col("close") < F.col("ema"), -1).otherwise(0))
    x = x.withColumn("cross", F.coalesce((F.col("side") != F.lag("side").over(S.order())).cast("int"), F.lit(0)))
    since = F.col("i") - F.max(F.when(F.col("cross") == 1, F.col("i"))).over(S.order().rowsBetween(Window.unboundedPreceding, 0))
    return x.select("symbol", "t", F.sum("cross").over(S.last(50)).cast("long").alias("crosses"), F.coalesce(since, F.lit(-1)).alias("bars_since"))


CROSS_SQL = f"""{CORE}, e AS (SELECT symbol, t, i, close, list_reduce(closes, lambda a, b: a * (26.0 / 28) + b * (2.0 / 28)) AS ema FROM atr),
s AS (SELECT *, CASE WHEN close > ema AND abs(close - ema) > 1e-12 THEN 1 WHEN close < ema AND abs(close - ema) > 1e-12 THEN -1 ELSE 0 END AS side FROM e),
c AS (SELECT *, coalesce(CAST(side <> lag(side) {OVER} AS INTEGER), 0) AS hit FROM s)
SELECT symbol, t, CAST(sum(hit) OVER (PARTITION BY symbol ORDER BY t ROWS 49 PRECEDING) AS BIGINT) AS crosses, coalesce(i - max(CASE WHEN hit = 1 THEN i END) {OVER}, -1) AS bars_since FROM c"""


def nearest_rank_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank quantiles of closes by symbol, one row each."""
    x = bars(spark, sf_dir).groupBy("symbol").agg(*[S.nearest_rank("close", p).alias(f"p{int(p * 100)}") for p in (0.05, 0.3, 0.5, 0.7, 0.95)])
    return x.unpivot("symbol", ["p5", "p30", "p50", "p70", "p95"], "quantile", "value")


def floor_quantile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at index floor(p (n - 1)) of the sorted closes, and linear quantiles."""
    ranked = bars(spark, sf_dir).withColumns({"r": F.row_number().over(Window.partitionBy("symbol").orderBy("close", "t")) - 1, "n": F.count("*").over(Window.partitionBy("symbol"))})
    at = lambda p: F.max(F.when(F.col("r") == F.floor(p * (F.col("n") - 1)), F.col("close")))
    return ranked.groupBy("symbol").agg(*[at(p).alias(f"floor{int(p * 100)}") for p in (0.1, 0.5, 0.9)], *[F.round(F.percentile("close", p), 6).alias(f"linear{int(p * 100)}") for p in (0.1, 0.5, 0.9)])


FLOOR_SQL = f"""{B}, r AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY close, t) - 1 AS r, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
SELECT symbol, {", ".join(f"max(CASE WHEN r = floor({p} * (n - 1)) THEN close END) AS floor{int(p * 100)}, round(quantile_cont(close, {p}), 6) AS linear{int(p * 100)}" for p in (0.1, 0.5, 0.9))} FROM r GROUP BY symbol"""

GRID_SQL = f"""{B}, q AS (SELECT symbol, {", ".join(f"quantile_disc(close, {p}) AS p{int(p * 100)}" for p in (0.05, 0.3, 0.5, 0.7, 0.95))} FROM bars GROUP BY symbol)
SELECT symbol, quantile, value FROM (UNPIVOT q ON p5, p30, p50, p70, p95 INTO NAME quantile VALUE value)"""

_bars = {f"bars_{n}": bars_query(h) for n, h in (("4h", 4), ("1h", 1), ("1d", 24))}
QUERIES = {k: v[0] for k, v in _bars.items()} | {
    f.__name__: f
    for f in (bars_complete_only, true_range_atr_strict, atr_partial, atr_wilder, ema_seeded, ema_adjust_false, feature_core, efficiency_overlap, frozen_thresholds, volatility_percentile, rolling_median_noise, breakout_prev20, ema_cross_counts, nearest_rank_grid, floor_quantile_grid)
}
ORACLES = {k: v[1] for k, v in _bars.items()} | {
    "bars_complete_only": BARS_COMPLETE_SQL,
    "true_range_atr_strict": f"{CORE} SELECT symbol, t, {sql_rounded('tr', 'atr')} FROM atr",
    "atr_partial": f"{CORE} SELECT symbol, t, round(atr_partial + 1e-9, 6) AS atr FROM atr",
    "atr_wilder": f"{CORE} SELECT symbol, t, round(list_reduce(trs, lambda a, b: a * (13.0 / 14) + b / 14) + 1e-9, 6) AS atr FROM atr",
    "ema_seeded": f"{CORE} SELECT symbol, t, round({EMA_SEEDED} + 1e-9, 6) AS ema FROM atr",
    "ema_adjust_false": f"{CORE} SELECT symbol, t, round(list_reduce(closes, lambda a, b: a * (26.0 / 28) + b * (2.0 / 28)) + 1e-9, 6) AS ema27, round(list_reduce(closes, lambda a, b: a * (199.0 / 201) + b * (2.0 / 201)) + 1e-9, 6) AS ema200 FROM atr",
    "feature_core": f"{CORE_FULL} SELECT symbol, t, {sql_rounded(*FIELDS)} FROM f",
    "efficiency_overlap": f"{CORE_FULL} SELECT symbol, t, {sql_rounded('efficiency12', 'overlap6')} FROM f",
    "frozen_thresholds": threshold_sql(),
    "volatility_percentile": VOLATILITY_SQL,
    "rolling_median_noise": NOISE_SQL,
    "breakout_prev20": BREAKOUT_SQL,
    "ema_cross_counts": CROSS_SQL,
    "nearest_rank_grid": GRID_SQL,
    "floor_quantile_grid": FLOOR_SQL,
}
