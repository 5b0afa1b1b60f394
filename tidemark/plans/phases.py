"""Local phases of price with recursive SQL, controls from sorted pools and from gaps, and sums at several grains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import clustered as C
from tidemark.operators import machines as M
from tidemark.operators import pools as P
from tidemark.plans.cycles import HOURLY, recursive
from tidemark.plans.features import CORE, OVER
from tidemark.plans.picks import HITS_SQL, hits, run_spans, spans_sql
from tidemark.plans.study import OBSERVED_SQL, observed
from tidemark.sources.bars import bars, bars_sql


def local(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = S.ema(S.ema(bars(spark, sf_dir, 1), "close", 2 / 28, "fast"), "close", 2 / 201, "slow")
    three = S.order().rowsBetween(-3, -1)
    # Rounded where averages are compared, so that sums in another order decide alike.
    x = x.withColumns({"high3": F.max("high").over(three), "low3": F.min("low").over(three), "fast": F.round("fast", 9), "slow": F.round("slow", 9)})
    return M.run(x.select("symbol", "t", "high", "low", "close", "fast", "slow", "high3", "low3"), "symbol", ["t"], M.LocalPhase, M.LOCAL)


def local_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local(spark, sf_dir).where("kind = 'BAR'").select("symbol", "t", "way", "phase", "event", "number")


def local_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = [F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("depth", "near")]
    return local(spark, sf_dir).where("kind = 'CORRECTION'").select("symbol", "number", "way", "start", F.col("t").alias("end"), F.col("event").alias("status"), "bars", "tries", *places)


LOCAL_SQL = f"""{recursive(HOURLY)}, e AS (SELECT *, round(list_reduce(closes, lambda a, b: a * (26.0 / 28) + b * (2.0 / 28)), 9) AS f, round(list_reduce(closes, lambda a, b: a * (199.0 / 201) + b * (2.0 / 201)), 9) AS s FROM atr),
b AS MATERIALIZED (SELECT symbol, t, i, high, low, close, pc, ph, pl, f, s, CASE WHEN f > s THEN 1 ELSE -1 END AS w, max(high) OVER p AS high3, min(low) OVER p AS low3 FROM e WINDOW p AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
m AS (SELECT symbol, t, i, w AS way, 'EXPANSION' AS phase, CAST(NULL AS VARCHAR) AS event, CAST(NULL AS BIGINT) AS number, CAST(0 AS BIGINT) AS count, 0 AS of, false AS open, false AS back, CAST(0 AS DOUBLE) AS extreme FROM b WHERE i = 0
  UNION ALL SELECT symbol, t, i, CASE WHEN turned OR NOT live THEN w ELSE of END,
    CASE WHEN turned THEN 'CONTEXT_LOSS' WHEN NOT live THEN 'EXPANSION' WHEN fails THEN 'PULLBACK' WHEN past > 0 THEN 'RESUMPTION' WHEN rises THEN 'RECOVERY' WHEN back THEN 'RECOVERY' ELSE 'PULLBACK' END,
    CASE WHEN turned THEN 'CONTEXT_LOSS' WHEN NOT live THEN NULL WHEN fails THEN 'RECOVERY_FAILED' WHEN past > 0 THEN 'RESUMPTION' WHEN rises THEN 'RECOVERY' WHEN starts THEN 'CORRECTION_START' END,
    CASE WHEN live THEN count END, count, CASE WHEN live THEN of ELSE 0 END, live AND (fails OR past <= 0), live AND NOT fails AND (back OR rises), extreme
  FROM (SELECT *, live AND back AND move < 0 AND past <= 0 AS fails, live AND move > 0 AND of * (close - CASE WHEN of > 0 THEN ph ELSE pl END) > 0 AS rises
    FROM (SELECT *, of * (close - pc) AS move, of * (close - extreme) AS past FROM (
      SELECT symbol, t, i, high, low, close, pc, ph, pl, w, turned, starts, NOT turned AND (open OR starts) AS live, CASE WHEN starts THEN w ELSE of END AS of, count + CAST(starts AS INT) AS count, NOT starts AND back AS back,
        CASE WHEN starts THEN CASE WHEN w > 0 THEN high3 ELSE low3 END ELSE extreme END AS extreme
      FROM (SELECT *, NOT turned AND NOT open AND w * (close - pc) < 0 AS starts FROM (SELECT b.*, m.of, m.open, m.back, m.count, m.extreme, m.of <> 0 AND m.of * (b.f - b.s) <= 0 AS turned FROM m JOIN b ON b.symbol = m.symbol AND b.i = m.i + 1))))))"""
PHASES_SQL = f"{LOCAL_SQL} SELECT symbol, t, way, phase, event, number FROM m"
#: A correction ends with its RESUMPTION, with the CONTEXT_LOSS on the bar behind its last one, or stays open.
CORRECTIONS_SQL = f"""{LOCAL_SQL}, c AS (SELECT m.symbol, number, any_value(m.way) AS way, min(m.i) AS first, max(m.i) AS last, bool_or(event = 'RESUMPTION') AS resumed, count(*) AS bars, count(*) FILTER (event = 'RECOVERY_FAILED') + count(*) FILTER (begun) AS tries,
    min(abs(b.close - b.f) / b.f * 100) AS near, min(b.low) AS low, max(b.high) AS high
  FROM (SELECT *, phase = 'RECOVERY' AND event = 'RECOVERY' AND coalesce(lag(phase) OVER (PARTITION BY symbol, number ORDER BY i), '') <> 'RECOVERY' AS begun FROM m WHERE number IS NOT NULL) m JOIN b USING (symbol, i) GROUP BY m.symbol, number),
d AS (SELECT c.*, a.t AS start, CASE WHEN a.w > 0 THEN a.high3 ELSE a.low3 END AS extreme, z.t AS last_t, n.t AS next_t FROM c JOIN b a ON a.symbol = c.symbol AND a.i = c.first JOIN b z ON z.symbol = c.symbol AND z.i = c.last LEFT JOIN b n ON n.symbol = c.symbol AND n.i = c.last + 1)
SELECT symbol, number, way, start, CASE WHEN resumed OR next_t IS NULL THEN last_t ELSE next_t END AS "end", CASE WHEN resumed THEN 'RESUMPTION' WHEN next_t IS NULL THEN 'OPEN_END' ELSE 'CONTEXT_LOSS' END AS status, bars, tries,
  round(greatest(0, CASE WHEN way > 0 THEN extreme - low ELSE high - extreme END / extreme * 100) + 1e-9, 5) AS depth, round(near + 1e-9, 5) AS near FROM d"""


def pool_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detection with a bar of its own direction whose step in units comes nearest, from bars with no detection around; a bar's direction is that of the eight bars up to four before it."""
    x = S.position(S.atr(bars(spark, sf_dir), strict=False))
    back = lambda c, n: F.lag(c, n).over(S.order())
    x = x.withColumns({"way": F.when(back("close", 5) >= back("close", 12), 1).when(back("close", 12).isNotNull(), -1).cast("long"), "step": F.col("close") - back("close", 1)}).where("atr > 0")
    found = hits(spark, sf_dir).join(x.select("symbol", "t", "i", "step", "atr"), ["symbol", "t"])
    events = found.select("symbol", "t", "i", F.col("side").alias("way"), F.round(F.col("side") * F.col("step") / F.col("atr"), 9).alias("target"))
    marked = P.blocked(events, x, 12)
    free = F.max(F.col("blocked").cast("int")).over(S.order().rowsBetween(-4, 0)) == 0
    pool = marked.withColumn("free", free).where("free AND way IS NOT NULL AND i >= 12").select("symbol", "way", "i", F.round(F.col("way") * F.col("step") / F.col("atr"), 9).alias("value"))
    return P.nearest_in_pool(events, pool, ["symbol", "way"], "target", "value").select("symbol", "t", "way", "target", "control_i", "control_value")


POOL_SQL = f"""{HITS_SQL}, x AS (SELECT symbol, t, i, close - pc AS step, atr_partial AS u, CASE WHEN lag(close, 5) {OVER} >= lag(close, 12) {OVER} THEN 1 WHEN lag(close, 12) {OVER} IS NOT NULL THEN -1 END AS way FROM atr QUALIFY u > 0),
ev AS (SELECT h.symbol, h.t, i, side AS way, round(side * step / u, 9) AS target FROM hits h JOIN x USING (symbol, t)), f AS (SELECT x.*, EXISTS (SELECT 1 FROM ev WHERE ev.symbol = x.symbol AND ev.i BETWEEN x.i AND x.i + 12) AS blocked FROM x),
pool AS (SELECT symbol, way, i, round(way * step / u, 9) AS value, row_number() OVER (PARTITION BY symbol, way ORDER BY round(way * step / u, 9), i) AS r FROM (SELECT *, max(CAST(blocked AS INT)) OVER (PARTITION BY symbol ORDER BY t ROWS 4 PRECEDING) = 0 AS free FROM f) WHERE free AND way IS NOT NULL AND i >= 12 AND step IS NOT NULL),
pl AS (SELECT ev.*, (SELECT count(*) FROM pool WHERE pool.symbol = ev.symbol AND pool.way = ev.way AND pool.value < ev.target) AS place FROM ev),
c AS (SELECT pl.symbol, pl.t, pl.way, pl.target, pool.i AS control_i, pool.value AS control_value, row_number() OVER (PARTITION BY pl.symbol, pl.t, pl.way ORDER BY CASE WHEN pool.i IS NULL THEN 1 ELSE 0 END, round(abs(pool.value - pl.target), 12), abs(pool.i - pl.i), pool.i) AS n
  FROM pl LEFT JOIN pool ON pool.symbol = pl.symbol AND pool.way = pl.way AND pool.r BETWEEN place - 7 AND place + 9)
SELECT symbol, t, way, target, control_i, control_value FROM c WHERE n = 1"""


def duration_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run of four or more steps one way with the interval of its length that meets no such run."""
    x = S.position(bars(spark, sf_dir)).select("symbol", "t", "i")
    at = lambda t, out: x.select("symbol", F.col("t").alias(t), F.col("i").alias(out))
    runs = run_spans(bars(spark, sf_dir)).join(at("s", "first"), ["symbol", "s"]).join(at("e", "last"), ["symbol", "e"]).select("symbol", "first", "last", (F.col("last") - F.col("first")).alias("bars")).where("bars >= 3")
    return P.matched_in_duration(runs, x.groupBy("symbol").agg(F.count("*").alias("n")), "bars")


DURATION_SQL = f"""{CORE}, sp AS ({spans_sql(bars_sql())}), r AS (SELECT sp.symbol, a.i AS first, z.i AS last, z.i - a.i AS bars FROM sp JOIN atr a ON a.symbol = sp.symbol AND a.t = sp.s JOIN atr z ON z.symbol = sp.symbol AND z.t = sp.e WHERE z.i - a.i >= 3),
free AS (SELECT symbol, i FROM atr WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.symbol = atr.symbol AND atr.i BETWEEN first AND last)), g AS (SELECT symbol, min(i) AS start, max(i) AS "end" FROM (SELECT *, i - row_number() OVER (PARTITION BY symbol ORDER BY i) AS g FROM free) GROUP BY symbol, g),
c AS (SELECT r.*, g.start, g.start + least(greatest(bars, 3), g."end" - g.start) AS "end" FROM r LEFT JOIN g ON g.symbol = r.symbol AND g."end" - g.start >= 3)
SELECT symbol, first, last, bars, start, "end", abs("end" - start - bars) AS mismatch FROM c QUALIFY row_number() OVER (PARTITION BY symbol, first, last ORDER BY abs("end" - start - bars), start) = 1"""

FIELDS = ("displacement4", "displacement8", "efficiency8", "range8", "efficiency32")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode, symbol, side, third, role, field, value, validity): the observations of each detection (EVENT) and of the bar 24 before it (CONTROL), episode by episode."""
    x = S.position(observed(spark, sf_dir))
    found = hits(spark, sf_dir).join(x.select("symbol", "t", "i"), ["symbol", "t"])
    sizes = x.groupBy("symbol").agg(F.count("*").alias("n"))
    e = found.join(sizes, "symbol").select("symbol", "side", "i", F.floor(F.col("i") * 3 / F.col("n")).alias("third"), F.concat_ws("@", "symbol", "t").alias("episode"), F.explode(F.array(F.struct(F.lit("EVENT").alias("role"), F.lit(0).alias("back")), F.struct(F.lit("CONTROL").alias("role"), F.lit(24).alias("back")))).alias("r"))
    e = e.select("episode", "symbol", "side", "third", "r.role", (F.col("i") - F.col("r.back")).alias("i"))
    long = e.join(x.select("symbol", "i", *FIELDS), ["symbol", "i"]).unpivot(["episode", "symbol", "side", "third", "role"], list(FIELDS), "field", "value")
    return long.withColumn("validity", F.when(F.col("value").isNull(), "NO_HISTORY").otherwise("VALID"))


def contrast_of(rows: list[dict]) -> list[tuple]:
    """The fields of an episode: event less control, or the reason why there is none."""
    by = {(r["role"], r["field"]): r for r in rows}
    out = []
    for field in dict.fromkeys(r["field"] for r in rows):
        event, control = by.get(("EVENT", field)), by.get(("CONTROL", field))
        if event is None:
            continue
        odd = next((r for r in (event, control) if r is not None and r["validity"] != "VALID"), None)
        reason = odd["validity"] if odd else "UNMATCHED" if control is None else None
        out.append((event["symbol"], event["side"], event["third"], field, None if reason else event["value"] - control["value"], reason))
    return out


GRAINS = (("symbol",), ("symbol", "side"), ("side",), ("symbol", "third"))


def contrast_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and counts of the contrasts at four grains, and of the reasons for which rows are out, from one pass over observations that stand episode by episode."""
    rows = observations(spark, sf_dir).repartitionByRange("episode").sortWithinPartitions("episode", "role", "field")
    found = C.flushed(rows, "episode", contrast_of, "symbol string, side long, third long, field string, contrast double, reason string")
    # Every grain in one aggregation; all rows are summed by key before anything is shuffled.
    names = ["symbol", "side", "third"]
    each = F.explode(F.array(*[F.struct(F.lit("+".join(g)).alias("grain"), *[F.col(c).alias(c) if c in g else F.lit(None).cast("string" if c == "symbol" else "long").alias(c) for c in names]) for g in GRAINS])).alias("g")
    by = found.select(each, "field", "contrast", "reason").groupBy("g.grain", "g.symbol", "g.side", "g.third", "field")
    return by.agg(F.count("*").alias("rows"), F.count("contrast").alias("n"), F.round(F.sum("contrast") + 1e-9, 5).alias("total"), F.count_if(F.col("reason") == "NO_HISTORY").alias("no_history"), F.count_if(F.col("reason") == "UNMATCHED").alias("unmatched"))


SUMS_SQL = f"""{OBSERVED_SQL}, h AS (SELECT symbol, t, side FROM ({HITS_SQL} SELECT * FROM hits)), n AS (SELECT symbol, count(*) AS n FROM ob GROUP BY symbol),
e AS (SELECT h.symbol, h.side, ob.i, CAST(floor(ob.i * 3 / n) AS BIGINT) AS third FROM h JOIN ob USING (symbol, t) JOIN n USING (symbol)), fld AS (SELECT unnest([{", ".join(f"'{f}'" for f in FIELDS)}]) AS field),
c AS (SELECT e.symbol, e.side, e.third, field, ({" ".join(f"CASE WHEN field = '{f}' THEN a.{f} ELSE" for f in FIELDS)} NULL {"END " * len(FIELDS)}) AS x, ({" ".join(f"CASE WHEN field = '{f}' THEN b.{f} ELSE" for f in FIELDS)} NULL {"END " * len(FIELDS)}) AS y, b.i IS NULL AS lone
  FROM e JOIN ob a ON a.symbol = e.symbol AND a.i = e.i LEFT JOIN ob b ON b.symbol = e.symbol AND b.i = e.i - 24 CROSS JOIN fld),
d AS (SELECT *, x - y AS contrast, CASE WHEN x IS NULL OR (NOT lone AND y IS NULL) THEN 'NO_HISTORY' WHEN lone THEN 'UNMATCHED' END AS reason FROM c)
SELECT CASE WHEN grouping(third) = 0 THEN 'symbol+third' WHEN grouping(symbol) = 1 THEN 'side' WHEN grouping(side) = 0 THEN 'symbol+side' ELSE 'symbol' END AS grain, symbol, side, third, field,
  count(*) AS rows, count(contrast) AS n, round(sum(contrast) + 1e-9, 5) AS total, count(*) FILTER (reason = 'NO_HISTORY') AS no_history, count(*) FILTER (reason = 'UNMATCHED') AS unmatched
FROM d GROUP BY GROUPING SETS ((field, symbol), (field, symbol, side), (field, side), (field, symbol, third))"""

QUERIES = {f.__name__: f for f in (local_phases, local_corrections, pool_controls, duration_controls, contrast_sums)}
ORACLES = {"local_phases": PHASES_SQL, "local_corrections": CORRECTIONS_SQL, "pool_controls": POOL_SQL, "duration_controls": DURATION_SQL, "contrast_sums": SUMS_SQL}
