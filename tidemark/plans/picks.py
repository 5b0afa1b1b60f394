"""Picks and matches: nearest rows in time and value, latest events with their relation, quotas, ranks and fits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import joins as J
from tidemark.plans.features import CORE, OVER
from tidemark.plans.shapes import PIVOTS_SQL, pivots, placed
from tidemark.plans.study import DETECTED_SQL, OBSERVED_SQL, RUNS_SQL, detected, direction_runs, observed
from tidemark.sources.bars import HOUR, bars, bars_sql, table

STEP = 4 * HOUR


def both_sides(left: DataFrame, right: DataFrame, at: str, mark: str) -> DataFrame:
    """left with _before and _after: the last mark at or before `at` and the first at or after it."""
    marks = right.select("symbol", F.col(mark).alias("_before"), F.col(mark).alias("_t"))
    back = J.asof(left, marks, at, "_t", ["_before"])
    ahead = right.select("symbol", F.col(mark).alias("_after"), (-F.col(mark)).alias("_t"))
    return J.asof(back.withColumn("_neg", -F.col(at)), ahead, "_neg", "_t", ["_after"]).drop("_neg")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(spark, sf_dir).where("factor = 1.0").select("symbol", "t", F.col("side").cast("long").alias("side"))


HITS_SQL = f"{DETECTED_SQL}, hits AS (SELECT symbol, t, CAST(side AS BIGINT) AS side FROM det WHERE factor = 1)"


def label_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds from each bar to its nearest pivot, before or after; null where a symbol has none."""
    x = both_sides(bars(spark, sf_dir).select("symbol", "t"), pivots(spark, sf_dir), "t", "t")
    return x.select("symbol", "t", F.least(F.col("t") - F.col("_before"), F.col("_after") - F.col("t")).alias("distance"))


DISTANCE_SQL = f"SELECT b.symbol, b.t, min(abs(b.t - p.t)) AS distance FROM ({bars_sql()}) b LEFT JOIN ({PIVOTS_SQL}) p ON p.symbol = b.symbol GROUP BY b.symbol, b.t"


def chronological_controls(spark: SparkSession, sf_dir: str, reach: int = 3 * STEP) -> DataFrame:
    """For each detection the nearest bar without one within `reach`, the earlier of two, or the failure."""
    found = hits(spark, sf_dir)
    free = bars(spark, sf_dir).select("symbol", "t").join(found.select("symbol", "t"), ["symbol", "t"], "left_anti").withColumnRenamed("t", "m")
    x = both_sides(found, free, "t", "m")
    near = F.when(F.col("_after") - F.col("t") < F.coalesce(F.col("t") - F.col("_before"), F.lit(reach + 1)), F.col("_after")).otherwise(F.col("_before"))
    kept = F.when(F.abs(near - F.col("t")) <= reach, near)
    return x.select("symbol", "t", kept.alias("control"), F.when(kept.isNotNull(), "MATCHED").when(near.isNull(), "NO_STATE").otherwise("TOO_FAR").alias("status"))


CHRONOLOGICAL_SQL = f"""{HITS_SQL}, free AS (SELECT symbol, t AS m FROM bars ANTI JOIN hits USING (symbol, t)), n AS (SELECT h.symbol, h.t, arg_min(m, (abs(m - h.t), m)) AS m FROM hits h LEFT JOIN free f ON f.symbol = h.symbol GROUP BY h.symbol, h.t)
SELECT symbol, t, CASE WHEN abs(m - t) <= {3 * STEP} THEN m END AS control, CASE WHEN m IS NULL THEN 'NO_STATE' WHEN abs(m - t) <= {3 * STEP} THEN 'MATCHED' ELSE 'TOO_FAR' END AS status FROM n"""


def value_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each detection the free bar whose range is nearest to its own, then the earliest: sought along the sorted
    values from both sides, so no pairs are made."""
    x = bars(spark, sf_dir).select("symbol", "t", F.round(F.col("high") - F.col("low"), 6).alias("v"))
    found = x.join(hits(spark, sf_dir).select("symbol", "t"), ["symbol", "t"])
    free = x.join(hits(spark, sf_dir).select("symbol", "t"), ["symbol", "t"], "left_anti").groupBy("symbol", "v").agg(F.min("t").alias("m"))
    pick = F.struct(F.col("v").alias("v"), F.col("m").alias("m"))
    low = J.asof(found, free.select("symbol", pick.alias("_low"), F.col("v").alias("_v")), "v", "_v", ["_low"])
    two = J.asof(low.withColumn("_neg", -F.col("v")), free.select("symbol", pick.alias("_high"), (-F.col("v")).alias("_v")), "_neg", "_v", ["_high"])
    option = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.round(F.abs(F.col(f"{c}.v") - F.col("v")), 6).alias("d"), F.col(f"{c}.m").alias("m")))
    best = F.array_min(F.filter(F.array(option("_low"), option("_high")), lambda o: o.isNotNull()))
    return two.select("symbol", "t", best["m"].alias("control"), F.round(best["d"] + 1e-9, 5).alias("difference"))


VALUE_SQL = f"""{HITS_SQL}, x AS (SELECT symbol, t, round(high - low, 6) AS v FROM bars), free AS (SELECT * FROM x ANTI JOIN hits USING (symbol, t)), e AS (SELECT x.* FROM x JOIN hits USING (symbol, t)),
r AS (SELECT e.symbol, e.t, f.t AS control, round(abs(f.v - e.v), 6) AS d, row_number() OVER (PARTITION BY e.symbol, e.t ORDER BY round(abs(f.v - e.v), 6), f.t) AS r FROM e LEFT JOIN free f ON f.symbol = e.symbol)
SELECT symbol, t, control, round(d + 1e-9, 5) AS difference FROM r WHERE r = 1"""


def run_spans(rows: DataFrame) -> DataFrame:
    """(symbol, s, e, side): runs of at least two steps one way, from the bars' closes."""
    x = S.position(rows).withColumn("side", F.signum(F.col("close") - F.lag("close").over(S.order())).cast("long")).where("side <> 0")
    x = x.withColumn("_new", F.when(F.col("side") == F.lag("side").over(S.order()), 0).otherwise(1)).withColumn("_n", F.sum("_new").over(S.order()))
    return x.groupBy("symbol", "_n").agg(F.min("t").alias("s"), F.max("t").alias("e"), F.first("side").alias("side"), F.count("*").alias("_c")).where("_c >= 2").drop("_n", "_c")


def spans_sql(source: str) -> str:
    return f"""SELECT symbol, min(t) AS s, max(t) AS e, any_value(side) AS side FROM (SELECT *, sum(new) {OVER} AS n FROM (SELECT *, CASE WHEN side = lag(side) {OVER} THEN 0 ELSE 1 END AS new FROM (
SELECT symbol, t, CAST(sign(close - lag(close) {OVER}) AS BIGINT) AS side FROM ({source})) WHERE side <> 0)) GROUP BY symbol, n HAVING count(*) >= 2"""


def overlapping_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each 4-hour run the 1-hour run of the same direction that meets it and starts nearest to its start; null if none."""
    ref, own = run_spans(bars(spark, sf_dir)), run_spans(bars(spark, sf_dir, 1))
    met = J.overlaps(ref, own.select("symbol", F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("side").alias("side2")), 86400).where("side = side2").withColumn("gap", F.abs(F.col("s2") - F.col("s")))
    best = J.nearest(met, ["symbol", "s"], "gap", ["s2"]).select("symbol", "s", F.col("s2").alias("found"), (F.col("s2") - F.col("s")).alias("delay"))
    return ref.join(best, ["symbol", "s"], "left").select("symbol", F.col("s").alias("start"), "side", "found", "delay")


OVERLAPPING_SQL = f"""WITH a AS ({spans_sql(bars_sql())}), b AS ({spans_sql(bars_sql(1))}), r AS (SELECT a.symbol, a.s AS start, a.side, b.s AS found, b.s - a.s AS delay, row_number() OVER (PARTITION BY a.symbol, a.s ORDER BY abs(b.s - a.s), b.s) AS r
FROM a LEFT JOIN b ON a.symbol = b.symbol AND a.side = b.side AND a.s <= b.e AND b.s <= a.e) SELECT symbol, start, side, found, delay FROM r WHERE r = 1"""


def detector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the 4-hour runs by symbol: how many a 1-hour run found, how many at their start or before, and the mean delay in hours;
    with the 1-hour runs that meet no run of their direction."""
    moves = overlapping_moves(spark, sf_dir)
    ref, own = run_spans(bars(spark, sf_dir)), run_spans(bars(spark, sf_dir, 1)).select("symbol", F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("side").alias("side2"))
    true = J.overlaps(ref, own, 86400).where("side = side2").select("symbol", "s2").distinct()
    false = own.join(true, ["symbol", "s2"], "left_anti").groupBy("symbol").agg(F.count("*").alias("false_moves"))
    out = moves.groupBy("symbol").agg(F.count("*").alias("moves"), F.count("found").alias("found"), F.count_if(F.col("delay") <= 0).alias("early"), F.round(F.avg("delay") / HOUR + 1e-9, 5).alias("mean_delay"))
    return out.join(false, "symbol", "left").na.fill(0, ["false_moves"])


SCORES_SQL = f"""{OVERLAPPING_SQL.rsplit(" SELECT", 1)[0]}, o AS (SELECT * FROM r WHERE r = 1), f AS (SELECT b.symbol, count(*) AS k FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.symbol = b.symbol AND a.side = b.side AND a.s <= b.e AND b.s <= a.e) GROUP BY b.symbol)
SELECT o.symbol, count(*) AS moves, count(found) AS found, count(*) FILTER (WHERE delay <= 0) AS early, round(avg(delay) / {HOUR} + 1e-9, 5) AS mean_delay, coalesce(any_value(k), 0) AS false_moves FROM o LEFT JOIN f USING (symbol) GROUP BY o.symbol"""


def recent_relation(spark: SparkSession, sf_dir: str, fresh: int = 2 * STEP) -> DataFrame:
    """Each detection with the last pivot known by then: FRESH_SAME or FRESH_OPPOSITE within `fresh` seconds, else STALE, NONE if there is none."""
    known = pivots(spark, sf_dir).where("kind <> 'BOTH'").select("symbol", F.col("t").alias("pivot"), "kind", "known", F.col("known").alias("_at"))
    x = J.asof(hits(spark, sf_dir), known, "t", "_at", ["pivot", "kind", "known"])
    same = F.when(F.col("side") > 0, F.col("kind") == "LOW").otherwise(F.col("kind") == "HIGH")
    relation = F.when(F.col("kind").isNull(), "NONE").when(F.col("t") - F.col("known") > fresh, "STALE").when(same, "FRESH_SAME").otherwise("FRESH_OPPOSITE")
    return x.select("symbol", "t", "pivot", (F.col("t") - F.col("known")).alias("age"), relation.alias("relation"))


RELATION_SQL = f"""{HITS_SQL}, k AS (SELECT * FROM ({PIVOTS_SQL}) WHERE kind <> 'BOTH' AND known IS NOT NULL)
SELECT h.symbol, h.t, k.t AS pivot, h.t - known AS age, CASE WHEN kind IS NULL THEN 'NONE' WHEN h.t - known > {2 * STEP} THEN 'STALE' WHEN kind = CASE WHEN h.side > 0 THEN 'LOW' ELSE 'HIGH' END THEN 'FRESH_SAME' ELSE 'FRESH_OPPOSITE' END AS relation
FROM hits h ASOF LEFT JOIN k ON h.symbol = k.symbol AND h.t >= k.known"""


def alternating_extremes(spark: SparkSession, sf_dir: str, order: int = 3) -> DataFrame:
    """Two-sided extremes of `order` bars (labels only: they look ahead); of neighbours of one kind the more extreme stays, the earlier of equals."""
    side = S.order().rowsBetween(-order, order)
    x = S.position(bars(spark, sf_dir)).withColumns({"top": F.max("high").over(side), "bottom": F.min("low").over(side), "_n": F.count("*").over(side)})
    high, low = F.col("high") == F.col("top"), F.col("low") == F.col("bottom")
    x = x.where(F.col("_n") == 2 * order + 1).withColumn("kind", F.when(high & ~low, "HIGH").when(low & ~high, "LOW")).where("kind IS NOT NULL")
    x = x.withColumn("_new", F.when(F.col("kind") == F.lag("kind").over(S.order()), 0).otherwise(1)).withColumn("_g", F.sum("_new").over(S.order()))
    size = F.when(F.col("kind") == "HIGH", F.col("high")).otherwise(-F.col("low"))
    best = F.max_by("t", F.struct(size, -F.col("t")))
    return x.groupBy("symbol", "_g", "kind").agg(best.alias("t"), F.abs(F.max(size)).alias("price"), F.count("*").alias("merged")).drop("_g")


ALTERNATING_SQL = f"""{CORE}, x AS (SELECT symbol, t, high, low, max(high) OVER w AS top, min(low) OVER w AS bottom, count(*) OVER w AS n FROM atr WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
k AS (SELECT *, CASE WHEN high = top THEN 'HIGH' ELSE 'LOW' END AS kind FROM x WHERE n = 7 AND (high = top) <> (low = bottom)), g AS (SELECT *, sum(new) {OVER} AS g FROM (SELECT *, CASE WHEN kind = lag(kind) {OVER} THEN 0 ELSE 1 END AS new FROM k)),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, g ORDER BY CASE WHEN kind = 'HIGH' THEN -high ELSE low END, t) AS r, count(*) OVER (PARTITION BY symbol, g) AS merged FROM g)
SELECT symbol, kind, t, CASE WHEN kind = 'HIGH' THEN high ELSE abs(low) END AS price, merged FROM r WHERE r = 1"""


def last_aligned_run(spark: SparkSession, sf_dir: str, reach: int = 30) -> DataFrame:
    """Each detection with the last run of two or more steps its own way that ended before it, at most `reach` bars back."""
    x = S.position(bars(spark, sf_dir)).select("symbol", "t", "i")
    found = hits(spark, sf_dir).join(x, ["symbol", "t"])
    ends = run_spans(bars(spark, sf_dir)).join(x.withColumnRenamed("t", "e"), ["symbol", "e"]).select(F.concat_ws("|", "symbol", "side").alias("symbol"), F.col("s").alias("run_start"), F.col("e").alias("run_end"), F.col("i").alias("run_i"), F.col("i").alias("_e"))
    keyed = found.withColumns({"name": F.col("symbol"), "symbol": F.concat_ws("|", "symbol", "side")})
    met = J.asof(keyed, ends, "i", "_e", ["run_start", "run_end", "run_i"], strict=True)
    inside = F.col("i") - F.col("run_i") <= reach
    return met.select(F.col("name").alias("symbol"), "t", *[F.when(inside, F.col(c)).alias(c) for c in ("run_start", "run_end")], F.when(inside, F.col("i") - F.col("run_i")).alias("bars_since"))


ALIGNED_SQL = f"""{HITS_SQL}, h AS (SELECT hits.*, i FROM hits JOIN atr USING (symbol, t)), s AS (SELECT s.*, i FROM ({spans_sql(bars_sql())}) s JOIN atr ON atr.symbol = s.symbol AND atr.t = s.e)
SELECT h.symbol, h.t, CASE WHEN h.i - s.i <= 30 THEN s.s END AS run_start, CASE WHEN h.i - s.i <= 30 THEN s.e END AS run_end, CASE WHEN h.i - s.i <= 30 THEN h.i - s.i END AS bars_since FROM h ASOF LEFT JOIN s ON h.symbol = s.symbol AND h.side = s.side AND h.i > s.i"""


def day_quota(spark: SparkSession, sf_dir: str, most: int = 6) -> DataFrame:
    """Of each kind of pivot the first of a day, then the first `most` days: a quota of distinct days."""
    x = pivots(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86400).cast("long"))
    firsts = x.groupBy("kind", "day").agg(F.min(F.struct("t", "symbol")).alias("p"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("day"))  # one row a day
    return firsts.withColumn("r", rank).where(F.col("r") <= most).select("kind", "day", "p.t", "p.symbol")


QUOTA_SQL = f"""WITH x AS (SELECT *, t // 86400 AS day, row_number() OVER (PARTITION BY kind, t // 86400 ORDER BY t, symbol) AS first FROM ({PIVOTS_SQL})), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY day) AS r FROM x WHERE first = 1)
SELECT kind, day, t, symbol FROM r WHERE r <= 6"""


def ranked_symbols(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """Symbols by a weighted score of clipped parts (efficiency, displacement, small range): the k best, named by their place."""
    clip = lambda c, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), c))
    means = observed(spark, sf_dir).groupBy("symbol").agg(F.avg("efficiency8").alias("a"), F.avg(F.abs("displacement8")).alias("b"), F.avg("range8").alias("c"))
    score = 0.5 * clip(F.col("a"), 0.0, 1.0) + 0.3 * clip(F.col("b") / 3, 0.0, 1.0) - 0.2 * clip(F.col("c") / 5, 0.0, 1.0)
    top = means.withColumn("score", F.round(score + 1e-9, 6)).orderBy(F.desc("score"), "symbol").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "symbol")).cast("long")).select("symbol", "rank", "score")  # k rows


RANKED_SQL = f"""{OBSERVED_SQL}, m AS (SELECT symbol, avg(efficiency8) AS a, avg(abs(displacement8)) AS b, avg(range8) AS c FROM ob GROUP BY symbol),
s AS (SELECT symbol, round(0.5 * least(1.0, greatest(0.0, a)) + 0.3 * least(1.0, greatest(0.0, b / 3)) - 0.2 * least(1.0, greatest(0.0, c / 5)) + 1e-9, 6) AS score FROM m), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, symbol) AS rank FROM s) SELECT symbol, rank, score FROM r WHERE rank <= 3"""


def counterexamples(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """The k detections of each direction with the best and with the worst move over the next four bars, by type."""
    x = S.atr(bars(spark, sf_dir), strict=False).select("symbol", "t", F.try_divide(F.lead("close", 4).over(S.order()) - F.col("close"), "atr").alias("m"))
    x = hits(spark, sf_dir).join(x, ["symbol", "t"]).withColumn("move", F.round(F.col("side") * F.col("m") + 1e-9, 6)).where("move IS NOT NULL")
    place = lambda c: F.row_number().over(Window.partitionBy("side").orderBy(c, "symbol", "t"))
    x = x.withColumns({"best": place(F.desc("move")), "worst": place(F.asc("move"))})
    kinds = F.explode(F.array(F.struct(F.lit("SUCCESS").alias("kind"), F.col("best").alias("r")), F.struct(F.lit("FAILURE").alias("kind"), F.col("worst").alias("r"))))
    return x.select("symbol", "t", "side", "move", kinds.alias("x")).where(F.col("x.r") <= k).select("symbol", "t", "side", "move", "x.kind")


COUNTER_SQL = f"""{HITS_SQL}, f AS (SELECT symbol, t, (lead(close, 4) {OVER} - close) / nullif(atr_partial, 0) AS m FROM atr), x AS (SELECT hits.*, round(side * m + 1e-9, 6) AS move FROM hits JOIN f USING (symbol, t) WHERE m IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY move DESC, symbol, t) AS best, row_number() OVER (PARTITION BY side ORDER BY move, symbol, t) AS worst FROM x)
SELECT symbol, t, side, move, 'SUCCESS' AS kind FROM r WHERE best <= 3 UNION ALL SELECT symbol, t, side, move, 'FAILURE' FROM r WHERE worst <= 3"""


def ordinal_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of plain ranks (equal values by time) of range and step size, by symbol."""
    x = placed(spark, sf_dir).where("step IS NOT NULL").withColumns({"a": F.round("range", 6), "b": F.round(F.abs("step"), 6)})
    rank = lambda c: F.row_number().over(Window.partitionBy("symbol").orderBy(c, "t"))
    return x.withColumns({"ra": rank("a"), "rb": rank("b")}).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.corr("ra", "rb") + 1e-9, 6).alias("rho"))


ORDINAL_SQL = f"""{CORE}, r AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY round(high - low, 6), t) AS ra, row_number() OVER (PARTITION BY symbol ORDER BY round(abs(close - pc), 6), t) AS rb FROM atr WHERE pc IS NOT NULL)
SELECT symbol, count(*) AS n, round(corr(ra, rb) + 1e-9, 6) AS rho FROM r GROUP BY symbol"""


def severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of three robust z values (range, step size, ATR): less the symbol's median, over its interquartile range (1 for 0)."""
    x = placed(spark, sf_dir).where("step IS NOT NULL").select("symbol", "t", "range", F.abs("step").alias("size"), "atr")
    names = ("range", "size", "atr")
    fit = x.groupBy("symbol").agg(*[F.percentile(n, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(f"_{n}") for n in names])

    def z(n: str) -> Column:
        q = lambda k: F.get(F.col(f"_{n}"), F.lit(k))
        return (F.col(n) - q(1)) / F.coalesce(F.nullif(q(2) - q(0), F.lit(0.0)), F.lit(1.0))

    return x.join(F.broadcast(fit), "symbol").select("symbol", "t", F.round(sum(map(z, names), F.lit(0.0)) / 3 + 1e-9, 5).alias("severity"))  # fit: one row for each symbol


SEVERITY_SQL = f"""{CORE}, x AS (SELECT symbol, t, high - low AS range, abs(close - pc) AS size, atr_partial AS a FROM atr WHERE pc IS NOT NULL), q AS (SELECT symbol, {", ".join(f"quantile_cont({n}, {p}) AS {n}{k}" for n in ("range", "size", "a") for k, p in ((1, 0.25), (2, 0.5), (3, 0.75)))} FROM x GROUP BY symbol)
SELECT symbol, t, round(({" + ".join(f"({n} - {n}2) / coalesce(nullif({n}3 - {n}1, 0), 1.0)" for n in ("range", "size", "a"))}) / 3 + 1e-9, 5) AS severity FROM x JOIN q USING (symbol)"""


def group_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the features by direction of the run, less the mean of all bars, in their standard deviations."""
    names = ["displacement8", "efficiency8", "range8"]
    x = observed(spark, sf_dir).where(" AND ".join(f"{n} IS NOT NULL" for n in names)).unpivot(["symbol", "sign"], names, "field", "value")
    every = x.groupBy("field").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))  # one row for each field
    groups = x.groupBy(F.col("sign").cast("long").alias("sign"), "field").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    return groups.join(F.broadcast(every), "field").select("sign", "field", "n", F.round(F.try_divide(F.col("m") - F.col("_m"), F.nullif("_s", F.lit(0.0))) + 1e-9, 5).alias("separation"))


SEPARATION_SQL = f"""{OBSERVED_SQL}, w AS (SELECT ob.*, g.sign FROM ob JOIN g USING (symbol, t) WHERE displacement8 IS NOT NULL AND efficiency8 IS NOT NULL AND range8 IS NOT NULL), u AS ({" UNION ALL ".join(f"SELECT sign, '{n}' AS field, {n} AS value FROM w" for n in ("displacement8", "efficiency8", "range8"))}),
e AS (SELECT field, avg(value) AS m, stddev_pop(value) AS s FROM u GROUP BY field) SELECT CAST(sign AS BIGINT) AS sign, field, count(*) AS n, round((avg(value) - any_value(m)) / nullif(any_value(s), 0) + 1e-9, 5) AS separation FROM u JOIN e USING (field) GROUP BY sign, field"""


def environment_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By symbol: crossings of a 20-bar mean, longest and mean run, mean pullback from the running high in units of ATR."""
    x = placed(spark, sf_dir).withColumn("side", F.signum(F.round(F.col("close") - F.avg("close").over(S.last(20)), 9)))
    deep = F.try_divide(F.max("high").over(S.order().rowsBetween(Window.unboundedPreceding, 0)) - F.col("close"), "atr")
    x = x.withColumns({"crossed": F.col("side") * F.lag("side").over(S.order()) < 0, "deep": deep})
    runs = direction_runs(spark, sf_dir).groupBy("symbol", "origin").agg(F.count("*").alias("n")).groupBy("symbol").agg(F.max("n").alias("longest_run"), F.round(F.avg("n") + 1e-9, 5).alias("mean_run"))
    return x.groupBy("symbol").agg(F.count_if("crossed").alias("crossings"), F.round(F.avg("deep") + 1e-9, 5).alias("mean_pullback")).join(runs, "symbol")


PROFILE_SQL = f"""{CORE}, x AS (SELECT symbol, t, sign(round(close - avg(close) OVER (PARTITION BY symbol ORDER BY t ROWS 19 PRECEDING), 9)) AS side, (max(high) {OVER} - close) / nullif(atr_partial, 0) AS deep FROM atr), c AS (SELECT *, side * lag(side) {OVER} < 0 AS crossed FROM x),
n AS (SELECT symbol, origin, count(*) AS n FROM ({RUNS_SQL}) GROUP BY ALL), r AS (SELECT symbol, max(n) AS longest_run, round(avg(n) + 1e-9, 5) AS mean_run FROM n GROUP BY symbol)
SELECT c.symbol, count(*) FILTER (WHERE crossed) AS crossings, round(avg(deep) + 1e-9, 5) AS mean_pullback, any_value(longest_run) AS longest_run, any_value(mean_run) AS mean_run FROM c JOIN r USING (symbol) GROUP BY c.symbol"""


def ridge_fit(spark: SparkSession, sf_dir: str, penalty: float = 1.0) -> DataFrame:
    """Two-feature ridge with a free intercept by symbol: one pass of sums, then the normal equations in closed form."""
    x = observed(spark, sf_dir).select("symbol", F.col("displacement8").alias("a"), F.col("range8").alias("b"), F.try_divide(F.lead("close", 3).over(S.order()) - F.col("close"), "atr").alias("y")).na.drop()
    n = lambda c, d: F.covar_pop(c, d) * F.count("*")
    s = x.groupBy("symbol").agg(F.count("*").alias("n"), (n("a", "a") + penalty).alias("aa"), (n("b", "b") + penalty).alias("bb"), n("a", "b").alias("ab"), n("a", "y").alias("ay"), n("b", "y").alias("by"), *[F.avg(c).alias(f"m{c}") for c in "aby"])
    det = F.nullif(F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab"), F.lit(0.0))
    s = s.withColumns({"wa": (F.col("bb") * F.col("ay") - F.col("ab") * F.col("by")) / det, "wb": (F.col("aa") * F.col("by") - F.col("ab") * F.col("ay")) / det})
    return s.select("symbol", "n", *[F.round(c + 1e-9, 6).alias(k) for k, c in (("slope_a", F.col("wa")), ("slope_b", F.col("wb")), ("intercept", F.col("my") - F.col("wa") * F.col("ma") - F.col("wb") * F.col("mb")))])


RIDGE_SQL = f"""{OBSERVED_SQL}, x AS (SELECT ob.symbol, displacement8 AS a, range8 AS b, (lead(p.close, 3) OVER (PARTITION BY p.symbol ORDER BY p.t) - p.close) / nullif(p.atr, 0) AS y FROM ob JOIN p USING (symbol, t)),
s AS (SELECT symbol, count(*) AS n, regr_sxx(a, a) + 1 AS aa, regr_sxx(b, b) + 1 AS bb, regr_sxy(a, b) AS ab, regr_sxy(a, y) AS ay, regr_sxy(b, y) AS by_, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM x WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL GROUP BY symbol),
w AS (SELECT *, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS wa, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS wb FROM s) SELECT symbol, n, round(wa + 1e-9, 6) AS slope_a, round(wb + 1e-9, 6) AS slope_b, round(my - wa * ma - wb * mb + 1e-9, 6) AS intercept FROM w"""


def payload_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read from the events' JSON text, as JSON and by position, with a label by a map and a pattern test."""
    x = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.expr("CAST(substr(props, instr(props, ':') + 2, length(props) - instr(props, ':') - 2) AS BIGINT)").alias("cut"), F.col("event_type").rlike("^(view|click)$").alias("passive"))
    label = F.create_map(*[F.lit(v) for kv in (("purchase", "MONEY"), ("signup", "USER"), ("error", "FAULT")) for v in kv])
    return x.groupBy(F.coalesce(F.try_element_at(label, "event_type"), F.lit("VISIT")).alias("label"), "passive").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.count_if(F.col("k") == F.col("cut")).alias("agree"))


PAYLOAD_SQL = """SELECT CASE event_type WHEN 'purchase' THEN 'MONEY' WHEN 'signup' THEN 'USER' WHEN 'error' THEN 'FAULT' ELSE 'VISIT' END AS label, regexp_matches(event_type, '^(view|click)$') AS passive, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total,
count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = CAST(substr(props, instr(props, ':') + 2, length(props) - instr(props, ':') - 2) AS BIGINT)) AS agree FROM events GROUP BY ALL"""


def numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known values, smallest and largest of every column of doubles, found by its type."""
    x = table(spark, sf_dir, "lineitem")
    names = [c for c, kind in x.dtypes if kind == "double"]
    return x.select(*names).unpivot([], names, "field", "value").groupBy("field").agg(F.count("value").alias("known"), (F.min("value") + 0.0).alias("least"), (F.max("value") + 0.0).alias("most"))  # + 0.0: no negative zero


NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
NUMERIC_SQL = " UNION ALL ".join(f"SELECT '{n}' AS field, count({n}) AS known, min({n}) + 0.0 AS least, max({n}) + 0.0 AS most FROM lineitem" for n in NUMERIC)

QUERIES = {f.__name__: f for f in (
    label_distance, chronological_controls, value_controls, overlapping_moves, detector_scores, recent_relation, alternating_extremes, last_aligned_run, day_quota, ranked_symbols,
    counterexamples, ordinal_correlation, severity, group_separation, environment_profile, ridge_fit, payload_fields, numeric_profile,
)}
ORACLES = {
    "label_distance": DISTANCE_SQL, "chronological_controls": CHRONOLOGICAL_SQL, "value_controls": VALUE_SQL, "overlapping_moves": OVERLAPPING_SQL, "detector_scores": SCORES_SQL, "recent_relation": RELATION_SQL,
    "alternating_extremes": ALTERNATING_SQL, "last_aligned_run": ALIGNED_SQL, "day_quota": QUOTA_SQL, "ranked_symbols": RANKED_SQL, "counterexamples": COUNTER_SQL, "ordinal_correlation": ORDINAL_SQL,
    "severity": SEVERITY_SQL, "group_separation": SEPARATION_SQL, "environment_profile": PROFILE_SQL, "ridge_fit": RIDGE_SQL, "payload_fields": PAYLOAD_SQL, "numeric_profile": NUMERIC_SQL,
}
