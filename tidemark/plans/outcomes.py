"""What comes before and after detections: wide features, exits, resolutions, and tests of shapes against chance, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.plans.features import CORE, OVER
from tidemark.plans.picks import HITS_SQL, hits
from tidemark.plans.shapes import placed
from tidemark.plans.states import A_SQL, model_a
from tidemark.plans.study import OBSERVED_SQL, observed
from tidemark.sources.bars import bars

BACK, AHEAD = (10, 20, 30, 50), (10, 20, 30)
WIDE = [f"{k}{n}" for n in BACK for k in ("net", "range", "above", "crosses")] + [f"{k}{h}" for h in AHEAD for k in ("best", "worst", "end", "best_at")]


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each detection and field: moves, ranges, shares above the slow average and crossings of it over the bars
    before; best and worst move, end and the bar of the best over those after. Null where bars are missing."""
    x = S.atr(model_a(spark, sf_dir), strict=False).withColumn("side", F.signum(F.round(F.col("close") - F.col("slow"), 9)))
    x = x.withColumn("crossed", F.when(F.col("side") * F.lag("side").over(S.order()) < 0, 1).otherwise(0))
    cells = {}
    for n in BACK:
        cells |= {f"net{n}": F.try_divide(F.col("close") - F.lag("close", n - 1).over(S.order()), "atr"), f"range{n}": S.full(F.try_divide(F.max("high").over(S.last(n)) - F.min("low").over(S.last(n)), "atr"), n), f"above{n}": S.full(F.avg(F.when(F.col("side") > 0, 1.0).otherwise(0.0)).over(S.last(n)), n), f"crosses{n}": S.full(F.sum("crossed").over(S.last(n - 1)), n).cast("double")}
    for h in AHEAD:
        w = S.order().rowsBetween(1, h)
        whole = lambda c, w=w, h=h: F.when(F.count(F.lit(1)).over(w) == h, c)
        cells |= {f"best{h}": whole(F.try_divide(F.max("high").over(w) - F.col("close"), "atr")), f"worst{h}": whole(F.try_divide(F.min("low").over(w) - F.col("close"), "atr")), f"end{h}": F.try_divide(F.lead("close", h).over(S.order()) - F.col("close"), "atr"), f"best_at{h}": whole(F.array_position(F.collect_list("high").over(w), F.max("high").over(w)).cast("double"))}
    long = x.withColumns(cells).join(hits(spark, sf_dir).select("symbol", "t"), ["symbol", "t"]).unpivot(["symbol", "t"], WIDE, "field", "value")
    return long.select("symbol", "t", "field", F.round(F.col("value") + 1e-9, 5).alias("value"))


def wide_sql() -> str:
    cells = []
    for n in BACK:
        w, v = f"(PARTITION BY symbol ORDER BY t ROWS {n - 1} PRECEDING)", f"(PARTITION BY symbol ORDER BY t ROWS {n - 2} PRECEDING)"
        cells += [f"(close - lag(close, {n - 1}) {OVER}) / u AS net{n}", f"CASE WHEN i >= {n - 1} THEN (max(high) OVER {w} - min(low) OVER {w}) / u END AS range{n}", f"CASE WHEN i >= {n - 1} THEN avg(CASE WHEN side > 0 THEN 1.0 ELSE 0.0 END) OVER {w} END AS above{n}", f"CASE WHEN i >= {n - 1} THEN CAST(sum(crossed) OVER {v} AS DOUBLE) END AS crosses{n}"]
    for h in AHEAD:
        w = f"(PARTITION BY symbol ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
        there = f"CASE WHEN count(*) OVER {w} = {h} THEN"
        cells += [f"{there} (max(high) OVER {w} - close) / u END AS best{h}", f"{there} (min(low) OVER {w} - close) / u END AS worst{h}", f"(lead(close, {h}) {OVER} - close) / u AS end{h}", f"{there} CAST(list_position(list(high) OVER {w}, max(high) OVER {w}) AS DOUBLE) END AS best_at{h}"]
    union = " UNION ALL ".join(f"SELECT symbol, t, '{n}' AS field, {n} AS value FROM f" for n in WIDE)
    return f"""{A_SQL}, q AS (SELECT symbol, t, i, atr.close, high, low, nullif(atr_partial, 0) AS u, sign(round(a.close - slow, 9)) AS side FROM a JOIN atr USING (symbol, t)), c AS (SELECT *, CAST(coalesce(side * lag(side) {OVER} < 0, false) AS INT) AS crossed FROM q),
f AS (SELECT symbol, t, {", ".join(cells)} FROM c), l AS ({union}) SELECT l.symbol, l.t, field, round(value + 1e-9, 5) AS value FROM l JOIN ({HITS_SQL} SELECT symbol, t FROM hits) h ON h.symbol = l.symbol AND h.t = l.t"""


RULES = ("HOLD", "STOP", "BREAK_EVEN", "GIVE_BACK", "TARGET")


def shuffled_spans(spark: SparkSession, sf_dir: str, times: int = 20) -> DataFrame:
    """The span of each symbol's price path against the spans of its own steps in `times` shuffled orders: one-sided share, the path itself included."""
    x = placed(spark, sf_dir).where("step IS NOT NULL").select("symbol", "t", "step", F.explode(F.sequence(F.lit(0), F.lit(times))).alias("sim"))
    key = F.when(F.col("sim") == 0, F.lit("")).otherwise(F.md5(F.concat_ws("|", "sim", "symbol", "t")))
    path = F.sum("step").over(Window.partitionBy("symbol", "sim").orderBy("key", "t").rowsBetween(Window.unboundedPreceding, 0))
    spans = x.withColumn("key", key).withColumn("path", path).groupBy("symbol", "sim").agg(F.round(F.max("path") - F.min("path"), 6).alias("span"))
    real = F.max(F.when(F.col("sim") == 0, F.col("span")))
    both = spans.withColumn("real", F.max(F.when(F.col("sim") == 0, F.col("span"))).over(Window.partitionBy("symbol")))  # times + 1 rows for each symbol
    return both.groupBy("symbol").agg(F.round(real + 1e-9, 5).alias("span"), F.round(F.avg(F.when(F.col("sim") > 0, F.col("span"))) + 1e-9, 5).alias("mean_shuffled"), F.round(F.count_if(F.col("span") >= F.col("real")) / (times + 1), 6).alias("p"))


SHUFFLED_SQL = f"""{CORE}, x AS (SELECT symbol, t, close - pc AS step, sim, CASE WHEN sim = 0 THEN '' ELSE md5(sim || '|' || symbol || '|' || t) END AS key FROM atr, (SELECT unnest(range(21)) AS sim) WHERE pc IS NOT NULL),
p AS (SELECT symbol, sim, sum(step) OVER (PARTITION BY symbol, sim ORDER BY key, t ROWS UNBOUNDED PRECEDING) AS path FROM x), s AS (SELECT symbol, sim, round(max(path) - min(path), 6) AS span FROM p GROUP BY ALL), r AS (SELECT symbol, span AS real FROM s WHERE sim = 0)
SELECT symbol, round(any_value(real) + 1e-9, 5) AS span, round(avg(span) FILTER (WHERE sim > 0) + 1e-9, 5) AS mean_shuffled, round(count(*) FILTER (WHERE span >= real) / 21, 6) AS p FROM s JOIN r USING (symbol) GROUP BY symbol"""


def partition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin of bars dealt into LOW, NORMAL and HIGH range, in the plane of efficiency and long range."""
    label = F.when(F.col("range8") < 2, "LOW").when(F.col("range8") < 3, "NORMAL").otherwise("HIGH")
    x = observed(spark, sf_dir).where("efficiency8 IS NOT NULL AND range32 IS NOT NULL AND range8 IS NOT NULL").select(label.alias("g"), F.col("efficiency8").alias("x"), F.col("range32").alias("y"))
    c = x.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))  # three rows
    far = x.join(F.broadcast(c), "g").groupBy("g").agg(F.avg(F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2))).alias("s"), F.sum(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)).alias("w"))
    c = c.join(far, "g")
    d = c.select(*[F.col(k).alias(f"_{k}") for k in ("g", "cx", "cy", "s")])
    worst = c.join(F.broadcast(d), F.col("g") != F.col("_g")).groupBy("g").agg(F.max(F.try_divide(F.col("s") + F.col("_s"), F.sqrt(F.pow(F.col("cx") - F.col("_cx"), 2) + F.pow(F.col("cy") - F.col("_cy"), 2)))).alias("r"))
    every = x.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    t = c.join(worst, "g", "left").join(F.broadcast(every)).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.pow(F.col("cx") - F.col("mx"), 2) + F.pow(F.col("cy") - F.col("my"), 2))).alias("b"), F.sum("w").alias("w"), F.avg("r").alias("r"))
    return t.select("k", "n", F.round(F.try_divide(F.col("b") * (F.col("n") - F.col("k")), F.col("w") * (F.col("k") - 1)) + 1e-9, 5).alias("calinski"), F.round(F.col("r") + 1e-9, 5).alias("davies"))


QUALITY_SQL = f"""{OBSERVED_SQL}, x AS (SELECT CASE WHEN range8 < 2 THEN 'LOW' WHEN range8 < 3 THEN 'NORMAL' ELSE 'HIGH' END AS g, efficiency8 AS x, range32 AS y FROM ob WHERE efficiency8 IS NOT NULL AND range32 IS NOT NULL AND range8 IS NOT NULL), c AS (SELECT g, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM x GROUP BY g),
f AS (SELECT g, avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS s, sum((x - cx) ** 2 + (y - cy) ** 2) AS w FROM x JOIN c USING (g) GROUP BY g), d AS (SELECT * FROM c JOIN f USING (g)), r AS (SELECT p.g, max((p.s + q.s) / nullif(sqrt((p.cx - q.cx) ** 2 + (p.cy - q.cy) ** 2), 0)) AS r FROM d p JOIN d q ON p.g <> q.g GROUP BY p.g),
m AS (SELECT avg(x) AS mx, avg(y) AS my FROM x), t AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * ((cx - mx) ** 2 + (cy - my) ** 2)) AS b, sum(w) AS w, avg(r) AS r FROM d LEFT JOIN r USING (g), m) SELECT k, n, round(b * (n - k) / nullif(w * (k - 1), 0) + 1e-9, 5) AS calinski, round(r + 1e-9, 5) AS davies FROM t"""


def principal_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both axes of range and step by symbol, in closed form from one pass of sums: spread along each, share of the first, its angle in degrees."""
    x = placed(spark, sf_dir).where("step IS NOT NULL").groupBy("symbol").agg(F.var_pop("range").alias("a"), F.covar_pop("range", "step").alias("b"), F.var_pop("step").alias("c"))
    mid, away = (F.col("a") + F.col("c")) / 2, F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, 2) + F.pow("b", 2))
    cells = {"first": mid + away, "second": mid - away, "share": F.try_divide(mid + away, 2 * mid), "angle": F.degrees(F.atan2(2 * F.col("b"), F.col("a") - F.col("c")) / 2)}
    return x.select("symbol", *[F.round(c + 1e-9, 4).alias(k) for k, c in cells.items()])


AXES_SQL = f"""{CORE}, x AS (SELECT symbol, var_pop(high - low) AS a, covar_pop(high - low, close - pc) AS b, var_pop(close - pc) AS c FROM atr WHERE pc IS NOT NULL GROUP BY symbol), m AS (SELECT *, (a + c) / 2 AS mid, sqrt(((a - c) / 2) ** 2 + b ** 2) AS away FROM x)
SELECT symbol, round(mid + away + 1e-9, 4) AS first, round(mid - away + 1e-9, 4) AS second, round((mid + away) / nullif(2 * mid, 0) + 1e-9, 4) AS share, round(degrees(atan2(2 * b, a - c) / 2) + 1e-9, 4) AS angle FROM m"""


def bagged_stumps(spark: SparkSession, sf_dir: str, bags: int = 8) -> DataFrame:
    """In each of several half samples by a hash, the cut of the 8-bar range that best parts later gains from losses: values are summed first, then swept in order."""
    y = F.when(F.lead("close", 3).over(S.order()) > F.col("close"), 1).when(F.lead("close", 3).over(S.order()).isNotNull(), 0)
    x = observed(spark, sf_dir).select("symbol", "t", F.round("range8", 4).alias("v"), y.alias("y")).na.drop().withColumn("bag", F.explode(F.sequence(F.lit(1), F.lit(bags))))
    x = x.where(F.substring(F.md5(F.concat_ws("|", "bag", "symbol", "t")), 1, 1) < "8").groupBy("bag", "v").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    w, every = Window.partitionBy("bag").orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("bag")
    x = x.withColumns({"nl": F.sum("n").over(w), "sl": F.sum("s").over(w), "na": F.sum("n").over(every), "sa": F.sum("s").over(every)}).where("nl < na")
    gain = F.round(F.pow("sl", 2) / F.col("nl") + F.pow(F.col("sa") - F.col("sl"), 2) / (F.col("na") - F.col("nl")) - F.pow("sa", 2) / F.col("na"), 9)
    best = x.withColumn("gain", gain).groupBy("bag").agg(F.max_by(F.struct("v", "gain", "nl", "na", "sl", "sa"), F.struct("gain", -F.col("v"))).alias("b"))
    return best.select(F.col("bag").cast("long").alias("bag"), F.col("b.v").alias("cut"), F.round(F.col("b.gain") + 1e-9, 6).alias("gain"), F.round(F.col("b.sl") / F.col("b.nl") + 1e-9, 6).alias("below"), F.round((F.col("b.sa") - F.col("b.sl")) / (F.col("b.na") - F.col("b.nl")) + 1e-9, 6).alias("above"))


STUMPS_SQL = f"""{OBSERVED_SQL}, y AS (SELECT symbol, t, CAST(lead(close, 3) {OVER} > close AS INT) AS y FROM p), x AS (SELECT bag, round(range8, 4) AS v, count(*) AS n, sum(y) AS s FROM ob JOIN y USING (symbol, t), (SELECT unnest(range(1, 9)) AS bag) WHERE range8 IS NOT NULL AND y IS NOT NULL AND substr(md5(bag || '|' || symbol || '|' || t), 1, 1) < '8' GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY bag ORDER BY v) AS nl, sum(s) OVER (PARTITION BY bag ORDER BY v) AS sl, sum(n) OVER (PARTITION BY bag) AS na, sum(s) OVER (PARTITION BY bag) AS sa FROM x),
split AS (SELECT *, round(sl ** 2 / nl + (sa - sl) ** 2 / (na - nl) - sa ** 2 / na, 9) AS gain FROM w WHERE nl < na), r AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY gain DESC, v) AS r FROM split)
SELECT bag, v AS cut, round(gain + 1e-9, 6) AS gain, round(sl / nl + 1e-9, 6) AS below, round((sa - sl) / (na - nl) + 1e-9, 6) AS above FROM r WHERE r = 1"""


def body_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of each day: the median of its three highest body tops and of its three lowest body bottoms."""
    x = bars(spark, sf_dir).groupBy("symbol", F.floor(F.col("t") / 86400).cast("long").alias("day")).agg(F.collect_list(F.greatest("open", "close")).alias("tops"), F.collect_list(F.least("open", "close")).alias("bottoms"))  # six bars a day
    return x.select("symbol", "day", S.median_of(F.slice(F.sort_array("tops", asc=False), 1, 3)).alias("top"), S.median_of(F.slice(F.sort_array("bottoms"), 1, 3)).alias("bottom"))


BOUNDS_SQL = f"""{CORE} SELECT symbol, t // 86400 AS day, list_median(list_reverse_sort(list(greatest(open, close)))[1:3]) AS top, list_median(list_sort(list(least(open, close)))[1:3]) AS bottom FROM atr GROUP BY symbol, t // 86400"""


def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two series by name beside each other by their place, not their time; the longer one's rest stands alone."""
    x = placed(spark, sf_dir)
    names = [r.symbol for r in x.select("symbol").distinct().orderBy("symbol").limit(2).collect()] + [None, None]
    a, b = (x.where(F.col("symbol").eqNullSafe(F.lit(s))).select("i", F.lit(s).cast("string").alias(f"symbol_{k}"), F.col("t").alias(f"t_{k}"), F.col("close").alias(f"close_{k}")) for k, s in (("a", names[0]), ("b", names[1])))
    return a.join(b, "i", "full")


BESIDE_SQL = f"""{CORE}, r AS (SELECT *, dense_rank() OVER (ORDER BY symbol) AS r FROM atr)
SELECT i, a.symbol AS symbol_a, a.t AS t_a, a.close AS close_a, b.symbol AS symbol_b, b.t AS t_b, b.close AS close_b FROM (SELECT * FROM r WHERE r = 1) a FULL JOIN (SELECT * FROM r WHERE r = 2) b USING (i)"""

QUERIES = {f.__name__: f for f in (event_features, shuffled_spans, partition_quality, principal_axes, bagged_stumps, body_bounds, side_by_side)}
ORACLES = {
    "event_features": wide_sql(), "shuffled_spans": SHUFFLED_SQL, "partition_quality": QUALITY_SQL,
    "principal_axes": AXES_SQL, "bagged_stumps": STUMPS_SQL, "body_bounds": BOUNDS_SQL, "side_by_side": BESIDE_SQL,
}
