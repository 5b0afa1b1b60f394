"""Rule-based trades and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import machines as M
from tidemark.plans.study import DETECTED_SQL, detected_in
from tidemark.plans.features import OVER
from tidemark.sources.bars import bars, bars_sql, slot, table

FEE = 0.002
DAY, WEEK = 86400, 604800


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of prices by return flag, from the mean price of a unit on each day of shipment."""
    day = F.unix_seconds(F.col("l_shipdate").cast("date").cast("timestamp"))
    days = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("symbol"), day.cast("long").alias("t")).agg(F.round(F.avg(F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")) + 1e-9, 4).alias("price"), F.count("*").alias("n"))
    return days.groupBy("symbol", slot(F.col("t"), WEEK).alias("w")).agg(
        F.min_by("price", "t").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "t").alias("close"), F.sum("n").alias("volume"), F.sum("price").alias("turnover"),
    ).withColumnRenamed("w", "t")


WEEKLY_SQL = f"""SELECT symbol, d // {WEEK} * {WEEK} AS t, arg_min(price, d) AS open, max(price) AS high, min(price) AS low, arg_max(price, d) AS close, CAST(sum(n) AS BIGINT) AS volume, sum(price) AS turnover
FROM (SELECT l_returnflag AS symbol, CAST(epoch(CAST(l_shipdate AS DATE)) AS BIGINT) AS d, round(avg(CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE)) + 1e-9, 4) AS price, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY symbol, d // {WEEK} * {WEEK}"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detection of factor 1 in the weekly prices: in at the next open, out at the close four bars later."""
    prices = weekly(spark, sf_dir)
    x = prices
    after = S.order().rowsBetween(1, 4)
    x = x.select("symbol", "t", F.lead("open").over(S.order()).alias("entry"), F.lead("close", 4).over(S.order()).alias("exit"), F.max("high").over(after).alias("top"), F.min("low").over(after).alias("bottom"))
    d = detected_in(prices).where("factor = 1.0").select("symbol", "t", "side")
    rows = d.join(x, ["symbol", "t"]).where("exit IS NOT NULL AND entry > 0")
    gross = F.col("side") * (F.col("exit") / F.col("entry") - 1)
    best, worst = F.when(F.col("side") > 0, F.col("top")).otherwise(F.col("bottom")), F.when(F.col("side") > 0, F.col("bottom")).otherwise(F.col("top"))
    plain = lambda c: c + 0.0  # noqa: E731  no negative zero
    return rows.select("symbol", "t", F.col("side").cast("long").alias("side"), "entry", "exit", plain(gross).alias("gross"), (plain(gross) - FEE).alias("net"), plain(F.col("side") * (best / F.col("entry") - 1)).alias("mfe"), plain(F.col("side") * (worst / F.col("entry") - 1)).alias("mae"))


T_SQL = f"""{DETECTED_SQL.replace(bars_sql(), WEEKLY_SQL)}, nx AS (SELECT symbol, t, lead(open) {OVER} AS entry, lead(close, 4) {OVER} AS exit, max(high) OVER w AS top, min(low) OVER w AS bottom FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)),
tr0 AS (SELECT det.symbol, det.t, CAST(side AS BIGINT) AS side, entry, exit, side * (exit / entry - 1) AS g, side * (CASE WHEN side > 0 THEN top ELSE bottom END / entry - 1) AS f, side * (CASE WHEN side > 0 THEN bottom ELSE top END / entry - 1) AS a FROM det JOIN nx ON det.symbol = nx.symbol AND det.t = nx.t WHERE factor = 1 AND exit IS NOT NULL AND entry > 0),
trades AS (SELECT symbol, t, side, entry, exit, g + 0.0 AS gross, g - {FEE} AS net, f + 0.0 AS mfe, a + 0.0 AS mae FROM tr0)"""


def trade_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades(spark, sf_dir).select("symbol", "t", "side", "entry", "exit", *[F.round(c, 6).alias(c) for c in ("gross", "net", "mfe", "mae")])


def factor(net: str = "net"):  # noqa: ANN201
    """Wins over losses; 999 without losses, 0 without either."""
    wins, losses = F.coalesce(F.sum(F.when(F.col(net) > 0, F.col(net))), F.lit(0.0)), F.coalesce(-F.sum(F.when(F.col(net) < 0, F.col(net))), F.lit(0.0))
    return F.when(losses > 0, wins / F.nullif(losses, F.lit(0.0))).when(wins > 0, 999.0).otherwise(0.0)


FACTOR = "CASE WHEN coalesce(-sum(CASE WHEN net < 0 THEN net END), 0) > 0 THEN coalesce(sum(CASE WHEN net > 0 THEN net END), 0) / -sum(CASE WHEN net < 0 THEN net END) WHEN sum(CASE WHEN net > 0 THEN net END) > 0 THEN 999.0 ELSE 0.0 END"


def growth():  # noqa: ANN201
    """Log growth of the capital; a loss of all of it or more leaves nothing."""
    return F.when(F.col("net") > -1, F.ln(1 + F.col("net"))).otherwise(-1000.0)


GROWTH = "CASE WHEN net > -1 THEN ln(1 + CASE WHEN net > -1 THEN net ELSE 0 END) ELSE -1000.0 END"


def trades_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    capture = F.try_divide("net", F.nullif("mfe", F.lit(0.0)))
    return trades(spark, sf_dir).groupBy("symbol").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("net") > 0).cast("double")), 6).alias("win_rate"), F.round(factor(), 5).alias("profit_factor"), F.round(F.sum("net"), 6).alias("total"),
        F.round(F.exp(F.sum(growth())) - 1, 5).alias("compounded"), F.round(F.percentile("net", 0.5), 6).alias("median"), F.round(F.avg(F.when(F.col("mfe") > 0.001, capture)), 4).alias("capture"),
    )


METRICS_SQL = f"""{T_SQL} SELECT symbol, count(*) AS n, round(avg(CAST(net > 0 AS DOUBLE)), 6) AS win_rate, round({FACTOR}, 5) AS profit_factor, round(sum(net), 6) AS total, round(exp(sum({GROWTH})) - 1, 5) AS compounded,
round(quantile_cont(net, 0.5), 6) AS median, round(avg(CASE WHEN mfe > 0.001 THEN net / mfe END), 4) AS capture FROM trades GROUP BY symbol"""


def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest fall of compounded equity below its high, by symbol; equity starts at 1000."""
    order = S.order().rowsBetween(Window.unboundedPreceding, 0)
    x = trades(spark, sf_dir).withColumn("log", F.sum(growth()).over(order))
    x = x.withColumn("peak", F.greatest(F.lit(0.0), F.max("log").over(order)))
    return x.groupBy("symbol").agg(F.round(F.max(1 - F.exp(F.col("log") - F.col("peak"))), 6).alias("drawdown"), F.round(1000 * F.exp(F.max_by("log", "t")), 3).alias("equity"))


DRAWDOWN_SQL = f"""{T_SQL}, lg AS (SELECT symbol, t, sum({GROWTH}) {OVER} AS log FROM trades), k AS (SELECT *, greatest(0, max(log) {OVER}) AS peak FROM lg)
SELECT symbol, round(max(1 - exp(log - peak)), 6) AS drawdown, round(1000 * exp(arg_max(log, t)), 3) AS equity FROM k GROUP BY symbol"""


def profit_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of all wins that the best one, three and five trades make, and the return without them."""
    r = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("net"), "t"))
    x = trades(spark, sf_dir).withColumn("r", r)
    wins = F.sum(F.when(F.col("net") > 0, F.col("net")))
    return x.groupBy("symbol").agg(*[F.round(F.sum(F.when((F.col("r") <= k) & (F.col("net") > 0), F.col("net"))) / wins, 6).alias(f"top{k}") for k in (1, 3, 5)], *[F.round(F.sum(F.when(F.col("r") > k, F.col("net"))), 6).alias(f"without{k}") for k in (1, 3, 5)])


CONCENTRATION_SQL = f"""{T_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY net DESC, t) AS r FROM trades)
SELECT symbol, {", ".join(f"round(sum(CASE WHEN r <= {k} AND net > 0 THEN net END) / sum(CASE WHEN net > 0 THEN net END), 6) AS top{k}, round(sum(CASE WHEN r > {k} THEN net END), 6) AS without{k}" for k in (1, 3, 5))} FROM r GROUP BY symbol"""


def cost_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and profit factors at several costs."""
    x = trades(spark, sf_dir).withColumn("cost", F.explode(F.array(*map(F.lit, (0.0, 0.001, 0.002, 0.004))))).withColumn("net", F.col("gross") - F.col("cost"))
    return x.groupBy("symbol", "cost").agg(F.round(F.sum("net"), 6).alias("total"), F.round(factor(), 5).alias("profit_factor"))


STRESS_SQL = f"""{T_SQL}, x AS (SELECT symbol, CAST(c AS DOUBLE) AS cost, gross - c AS net FROM trades, (VALUES (0.0), (0.001), (0.002), (0.004)) AS v(c)) SELECT symbol, cost, round(sum(net), 6) AS total, round({FACTOR}, 5) AS profit_factor FROM x GROUP BY ALL"""


def block_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three blocks of trades in time order."""
    x = trades(spark, sf_dir).withColumn("block", F.ntile(3).over(S.order()).cast("long"))
    return x.groupBy("symbol", "block").agg(F.count("*").alias("n"), F.round(F.sum("net"), 6).alias("total"), F.round(factor(), 5).alias("profit_factor"))


BLOCK_SQL = f"""{T_SQL}, x AS (SELECT *, ntile(3) {OVER} AS block FROM trades) SELECT symbol, block, count(*) AS n, round(sum(net), 6) AS total, round({FACTOR}, 5) AS profit_factor FROM x GROUP BY ALL"""


def side_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trades(spark, sf_dir).withColumn("d", F.when(F.col("side") > 0, "long").otherwise("short")).groupBy("symbol").pivot("d", ["long", "short"]).agg(F.round(F.avg("net"), 6).alias("mean"), F.count("net").alias("n"))
    return out.na.fill(0, ["long_n", "short_n"])


PIVOT_SQL = f"""{T_SQL} SELECT symbol, round(avg(CASE WHEN side > 0 THEN net END), 6) AS long_mean, count(*) FILTER (WHERE side > 0) AS long_n, round(avg(CASE WHEN side < 0 THEN net END), 6) AS short_mean, count(*) FILTER (WHERE side < 0) AS short_n FROM trades GROUP BY symbol"""


def backtest_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position machine over several stops; every (symbol, stop) is a key of its own."""
    x = S.ema(S.atr(bars(spark, sf_dir, 1), strict=False), "close", 2 / 28, "ema")
    side = F.when(F.col("close") > F.col("ema"), 1).otherwise(-1)
    x = x.withColumn("side", side).withColumn("signal", F.when(F.col("side") != F.lag("side").over(S.order()), F.col("side")).otherwise(0)).withColumn("atr_before", F.lag("atr").over(S.order()))
    out = None
    for stop in (1.0, 1.5, 2.5):
        rows = x.select(F.concat_ws("@", "symbol", F.lit(str(stop))).alias("key"), "t", "open", "high", "low", "close", "side", "signal", "atr_before")
        part = M.run(rows, "key", ["t"], lambda stop=stop: M.Backtest(stop), M.TRADE)
        out = part if out is None else out.unionByName(part)
    return out.select("key", "entry_t", "exit_t", "side", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("entry", "exit")], "reason", "bars", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("gross", "net", "mfe", "mae")])


QUERIES = {f.__name__: f for f in (trade_list, trades_metrics, max_drawdown, profit_concentration, cost_stress, block_metrics, side_pivot, backtest_grid)}
ORACLES = {
    "trade_list": f"{T_SQL} SELECT symbol, t, side, entry, exit, round(gross, 6) AS gross, round(net, 6) AS net, round(mfe, 6) AS mfe, round(mae, 6) AS mae FROM trades",
    "trades_metrics": METRICS_SQL, "max_drawdown": DRAWDOWN_SQL, "profit_concentration": CONCENTRATION_SQL, "cost_stress": STRESS_SQL, "block_metrics": BLOCK_SQL, "side_pivot": PIVOT_SQL,
}
