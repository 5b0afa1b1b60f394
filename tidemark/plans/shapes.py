"""Shapes of bars: predicates, pivots, passages, spreads and picks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.plans.features import CORE, OVER
from tidemark.sources.bars import bars, table


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with i from 0, range, step and ATR over up to 14 bars."""
    x = S.position(S.atr(bars(spark, sf_dir), strict=False))
    return x.withColumns({"range": F.col("high") - F.col("low"), "step": F.col("close") - F.lag("close").over(S.order())})


def bar_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of dojis, long bodies, upper and lower wicks, inside and outside bars by symbol."""
    body, before = F.abs(F.col("close") - F.col("open")), lambda c: F.lag(c).over(S.order())
    x = placed(spark, sf_dir).withColumns({
        "doji": body <= 0.1 * F.col("range"), "large": body >= 0.7 * F.col("range"), "upper": F.col("high") - F.greatest("open", "close") >= 0.5 * F.col("range"), "lower": F.least("open", "close") - F.col("low") >= 0.5 * F.col("range"),
        "inside": (F.col("high") <= before("high")) & (F.col("low") >= before("low")), "outside": (F.col("high") > before("high")) & (F.col("low") < before("low")),
    })
    return x.groupBy("symbol").agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in ("doji", "large", "upper", "lower", "inside", "outside")])


PREDICATES_SQL = f"""{CORE}, x AS (SELECT symbol, abs(close - open) <= 0.1 * (high - low) AS doji, abs(close - open) >= 0.7 * (high - low) AS large, high - greatest(open, close) >= 0.5 * (high - low) AS upper,
  least(open, close) - low >= 0.5 * (high - low) AS lower, high <= ph AND low >= pl AS inside, high > ph AND low < pl AS outside FROM atr)
SELECT symbol, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE {c}) AS {c}" for c in ("doji", "large", "upper", "lower", "inside", "outside"))} FROM x GROUP BY symbol"""


def pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-point extrema, known one bar later."""
    near = lambda c, k: F.lag(c, k).over(S.order())
    high = (F.col("high") > near("high", 1)) & (F.col("high") > near("high", -1))
    low = (F.col("low") < near("low", 1)) & (F.col("low") < near("low", -1))
    x = placed(spark, sf_dir).withColumn("kind", F.when(high & low, "BOTH").when(high, "HIGH").when(low, "LOW")).withColumn("known", F.lead("t").over(S.order()))
    return x.where("kind IS NOT NULL").select("symbol", "t", "kind", "known")


PIVOTS_SQL = f"""{CORE}, x AS (SELECT symbol, t, high > ph AND high > lead(high) {OVER} AS h, low < pl AND low < lead(low) {OVER} AS l, lead(t) {OVER} AS known FROM atr)
SELECT symbol, t, CASE WHEN h AND l THEN 'BOTH' WHEN h THEN 'HIGH' ELSE 'LOW' END AS kind, known FROM x WHERE h OR l"""


def rolling_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population standard deviation of the last 20 closes, null where they aren't all there."""
    return placed(spark, sf_dir).select("symbol", "t", F.round(S.full(F.stddev_pop("close").over(S.last(20)), 20) + 1e-9, 5).alias("deviation"))


DEVIATION_SQL = f"""{CORE} SELECT symbol, t, round(CASE WHEN i >= 19 THEN stddev_pop(close) OVER (PARTITION BY symbol ORDER BY t ROWS 19 PRECEDING) END + 1e-9, 5) AS deviation FROM atr"""


def first_passage(spark: SparkSession, sf_dir: str, bars_ahead: int = 12) -> DataFrame:
    """Whether the next bars reach a gain or a loss of one ATR first, and after how many; both in one bar is BOTH."""
    ahead = F.collect_list(F.struct("high", "low")).over(S.order().rowsBetween(1, bars_ahead))
    first = lambda hit: F.array_min(F.filter(F.transform("ahead", lambda b, k: F.when(hit(b), k + 1)), lambda k: k.isNotNull()))
    x = placed(spark, sf_dir).withColumn("ahead", ahead)
    x = x.withColumns({"up": first(lambda b: b["high"] >= F.col("close") + F.col("atr")), "down": first(lambda b: b["low"] <= F.col("close") - F.col("atr"))})
    kind = F.when(F.col("up").isNull() & F.col("down").isNull(), "NONE").when(F.col("up") == F.col("down"), "BOTH").when(F.col("down").isNull() | (F.col("up") < F.col("down")), "UP").otherwise("DOWN")
    return x.select("symbol", "t", kind.alias("kind"), F.least("up", "down").cast("long").alias("bars"))


PASSAGE_SQL = f"""{CORE}, h AS (SELECT a.symbol, a.t, min(CASE WHEN b.high >= a.close + a.atr_partial THEN b.i - a.i END) AS up, min(CASE WHEN b.low <= a.close - a.atr_partial THEN b.i - a.i END) AS down
  FROM atr a LEFT JOIN atr b ON a.symbol = b.symbol AND b.i BETWEEN a.i + 1 AND a.i + 12 GROUP BY a.symbol, a.t)
SELECT symbol, t, CASE WHEN up IS NULL AND down IS NULL THEN 'NONE' WHEN up = down THEN 'BOTH' WHEN down IS NULL OR up < down THEN 'UP' ELSE 'DOWN' END AS kind, least(up, down) AS bars FROM h"""


def three_of_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bar of each symbol and day at which three of the last four steps go the same way."""
    up, down = (F.sum((c).cast("int")).over(S.last(4)) for c in (F.col("step") > 0, F.col("step") < 0))
    x = placed(spark, sf_dir).withColumns({"up": up, "down": down}).where("i >= 4 AND (up >= 3 OR down >= 3)")
    return x.groupBy("symbol", F.floor(F.col("t") / 86400).cast("long").alias("day")).agg(F.min("t").alias("t"), F.min_by(F.when(F.col("up") >= 3, "UP").otherwise("DOWN"), "t").alias("side"))


THREE_SQL = f"""{CORE}, s AS (SELECT symbol, t, i, close - pc AS step FROM atr), x AS (SELECT symbol, t, i, sum(CAST(step > 0 AS INT)) OVER w AS up, sum(CAST(step < 0 AS INT)) OVER w AS down FROM s WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS 3 PRECEDING))
SELECT symbol, t // 86400 AS day, min(t) AS t, arg_min(CASE WHEN up >= 3 THEN 'UP' ELSE 'DOWN' END, t) AS side FROM x WHERE i >= 4 AND (up >= 3 OR down >= 3) GROUP BY symbol, t // 86400"""


def quartile_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars by quartile of the range; cut points are fixed on each symbol's first half and used on all of it."""
    x = placed(spark, sf_dir)
    half = x.groupBy("symbol").agg((F.max("i") / 2).alias("half"))  # one row for each symbol
    early = x.join(F.broadcast(half), "symbol").where("i <= half")
    cuts = early.groupBy("symbol").agg(*[S.nearest_rank("range", p).alias(f"q{k}") for k, p in ((1, 0.25), (2, 0.5), (3, 0.75))])
    met = x.join(F.broadcast(cuts), "symbol")
    quartile = sum(((F.col("range") > F.col(f"q{k}")).cast("long") for k in (1, 2, 3)), F.lit(1).cast("long"))
    return met.groupBy("symbol", quartile.alias("quartile")).agg(F.count("*").alias("n"))


QUARTILE_SQL = f"""{CORE}, h AS (SELECT symbol, max(i) / 2 AS half FROM atr GROUP BY symbol), q AS (SELECT symbol, {", ".join(f"quantile_disc(high - low, {p}) AS q{k}" for k, p in ((1, 0.25), (2, 0.5), (3, 0.75)))} FROM atr JOIN h USING (symbol) WHERE i <= half GROUP BY symbol)
SELECT symbol, CAST(1 + {" + ".join(f"CAST(high - low > q{k} AS BIGINT)" for k in (1, 2, 3))} AS BIGINT) AS quartile, count(*) AS n FROM atr JOIN q USING (symbol) GROUP BY ALL"""


def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges less their median over the interquartile range (1 for 0), both from each symbol's first half alone."""
    x = placed(spark, sf_dir)
    half = x.groupBy("symbol").agg((F.max("i") / 2).alias("half"))
    early = x.join(F.broadcast(half), "symbol").where("i <= half")
    fit = early.groupBy("symbol").agg(*[F.percentile("range", p).alias(f"p{k}") for k, p in ((1, 0.25), (2, 0.5), (3, 0.75))])
    spread = F.coalesce(F.nullif(F.col("p3") - F.col("p1"), F.lit(0.0)), F.lit(1.0))
    return x.join(F.broadcast(fit), "symbol").select("symbol", "t", F.round((F.col("range") - F.col("p2")) / spread + 1e-9, 5).alias("scaled"))


SCALE_SQL = f"""{CORE}, h AS (SELECT symbol, max(i) / 2 AS half FROM atr GROUP BY symbol), q AS (SELECT symbol, {", ".join(f"quantile_cont(high - low, {p}) AS p{k}" for k, p in ((1, 0.25), (2, 0.5), (3, 0.75)))} FROM atr JOIN h USING (symbol) WHERE i <= half GROUP BY symbol)
SELECT symbol, t, round((high - low - p2) / coalesce(nullif(p3 - p1, 0), 1.0) + 1e-9, 5) AS scaled FROM atr JOIN q USING (symbol)"""


def largest_moves(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """The k steps of each symbol that are largest in size, earlier ones first among equals."""
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("size"), "t"))
    x = placed(spark, sf_dir).where("step IS NOT NULL").withColumn("size", F.round(F.abs("step"), 9))
    return x.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("symbol", "rank", "t", F.round(F.col("step") + 1e-9, 6).alias("step"))


MOVES_SQL = f"""{CORE}, x AS (SELECT symbol, t, close - pc AS step, row_number() OVER (PARTITION BY symbol ORDER BY round(abs(close - pc), 9) DESC, t) AS rank FROM atr WHERE pc IS NOT NULL)
SELECT symbol, rank, t, round(step + 1e-9, 6) AS step FROM x WHERE rank <= 5"""


def every_fifth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth bar of each symbol in time order: a sample of equal support over the whole span."""
    return placed(spark, sf_dir).where("i % 5 = 0").select("symbol", "t", "close")


def delta_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base of prices by order under a delta with the orders of the table's last year: the delta's rows replace the base's."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_totalprice").cast("double").alias("price"), F.year(F.col("o_orderdate").cast("date")).alias("y"))
    last = F.lit(orders.agg(F.max("y")).first()[0])
    delta = orders.where(F.col("y") >= last).select("o_orderkey", (F.col("price") * 2).alias("new"))
    both = orders.where(F.col("y") <= last).select("o_orderkey", "price").join(delta, "o_orderkey", "full")
    return both.select("o_orderkey", F.round(F.coalesce("new", "price"), 2).alias("price"), F.when(F.col("new").isNotNull(), "DELTA").otherwise("BASE").alias("origin"))


DELTA_SQL = """WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_totalprice AS DOUBLE) AS price, year(CAST(o_orderdate AS DATE)) AS y FROM orders)
SELECT o_orderkey, round(coalesce(d.price * 2, b.price), 2) AS price, CASE WHEN d.price IS NOT NULL THEN 'DELTA' ELSE 'BASE' END AS origin FROM (SELECT * FROM o WHERE y <= (SELECT max(y) FROM o)) b FULL JOIN (SELECT * FROM o WHERE y >= (SELECT max(y) FROM o)) d USING (o_orderkey)"""


def decimal_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact sums, smallest and largest prices as decimals, shown in cents."""
    cents = lambda c: (c * 100).cast("long")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(cents(F.sum(price)).alias("total"), cents(F.min(price)).alias("least"), cents(F.max(price)).alias("most"))


DECIMAL_SQL = """SELECT l_returnflag, CAST(sum(p) * 100 AS BIGINT) AS total, CAST(min(p) * 100 AS BIGINT) AS least, CAST(max(p) * 100 AS BIGINT) AS most FROM (SELECT l_returnflag, CAST(l_extendedprice AS DECIMAL(18,2)) AS p FROM lineitem) GROUP BY l_returnflag"""

QUERIES = {f.__name__: f for f in (bar_predicates, pivots, rolling_deviation, first_passage, three_of_four, quartile_shares, robust_scale, largest_moves, every_fifth, delta_wins, decimal_totals)}
ORACLES = {
    "bar_predicates": PREDICATES_SQL, "pivots": PIVOTS_SQL, "rolling_deviation": DEVIATION_SQL, "first_passage": PASSAGE_SQL, "three_of_four": THREE_SQL, "quartile_shares": QUARTILE_SQL, "robust_scale": SCALE_SQL,
    "largest_moves": MOVES_SQL, "every_fifth": f"{CORE} SELECT symbol, t, close FROM atr WHERE i % 5 = 0", "delta_wins": DELTA_SQL, "decimal_totals": DECIMAL_SQL,
}
