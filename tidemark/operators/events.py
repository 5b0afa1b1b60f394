"""Events of series, their episodes and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.series import median_of


def before(seconds: int) -> Window:
    """The rows of a key up to `seconds` before, the current time excluded."""
    return Window.partitionBy("symbol").orderBy("t").rangeBetween(-seconds, -1)


def percentile_events(rows: DataFrame, value: str, reach: int, least: int, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(symbol, t, share, side): rows whose value is extreme among the values of the time before."""
    past = F.collect_list(value).over(before(reach))
    seen = rows.withColumn("_past", past)
    share = F.try_divide(F.size(F.filter("_past", lambda x: x <= F.col(value))), F.size("_past"))
    side = F.when(F.size("_past") < least, "INSUFFICIENT_HISTORY").when(share <= low, "LOW").when(share >= high, "HIGH")
    return seen.select("symbol", "t", F.when(F.size("_past") >= least, share).alias("share"), side.alias("side")).where("side IS NOT NULL")


def robust_z_events(rows: DataFrame, value: str, reach: int, least: int, z: float = 4.0) -> DataFrame:
    """(symbol, t, z, side): log changes far from the median of those before, in units of their absolute deviation."""
    previous = F.lag(value).over(Window.partitionBy("symbol").orderBy("t"))
    change = F.when((previous > 0) & (F.col(value) > 0), F.ln(F.col(value)) - F.ln(previous))
    seen = rows.withColumn("_d", change).withColumn("_past", F.collect_list("_d").over(before(reach))).withColumn("_m", median_of(F.col("_past")))
    away = F.sort_array(F.transform("_past", lambda x: F.abs(x - F.col("_m"))))
    seen = seen.withColumn("_mad", F.get(away, F.floor((F.size("_past") - 1) / 2).cast("int")))
    score = F.when((F.size("_past") >= least) & (F.col("_mad") > 0), F.lit(0.67448975) * (F.col("_d") - F.col("_m")) / F.col("_mad"))
    side = F.when(F.size("_past") < least, "INSUFFICIENT_HISTORY").when(F.col("_mad") <= 0, "ZERO_MAD").when(score >= z, "EXPANSION").when(score <= -z, "CONTRACTION")
    return seen.where("_d IS NOT NULL").select("symbol", "t", score.alias("z"), side.alias("side")).where("side IS NOT NULL")


def episodes(events: DataFrame, gap: int, keys: tuple[str, ...] = ("symbol",), id_col: str = "event_id") -> DataFrame:
    """events with episode_start, episode_end, member_count, is_representative: a gap of `gap` or more splits."""
    order = Window.partitionBy(*keys).orderBy("t", id_col)
    new = F.coalesce((F.col("t") - F.lag("t").over(order) >= gap).cast("int"), F.lit(1))
    numbered = events.withColumn("_new", new).withColumn("_n", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*keys, "_n")
    return numbered.withColumns({
        "episode_start": F.min("t").over(own), "episode_end": F.max("t").over(own) + gap, "member_count": F.count("*").over(own), "is_representative": F.col("_new") == 1,
    }).drop("_new", "_n")


def interval_components(spans: DataFrame, key: str = "symbol") -> DataFrame:
    """spans (key, s, e) with component_start: connected unions of intervals that meet."""
    order = Window.partitionBy(key).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("s") > reach).cast("int"), F.lit(1))
    numbered = spans.withColumn("_new", new).withColumn("_n", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn("component_start", F.min("s").over(Window.partitionBy(key, "_n"))).drop("_new", "_n")
