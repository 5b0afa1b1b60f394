"""Reconciliation of line items with a disturbed copy of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quality as Q
from tidemark.operators import reconcile as R
from tidemark.sources.bars import table
from tidemark.sources.files import canonical_hash


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("double").alias("q"), "l_returnflag", "l_linestatus")


def actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders divisible by 11 are gone, by 7 moved under new keys, by 5 change quantity, by 13 change flag."""
    k = F.col("l_orderkey")
    rows = expected(spark, sf_dir).where(k % 11 != 0)
    return rows.select(F.when(k % 7 == 0, -k).otherwise(k).alias("l_orderkey"), "l_linenumber", F.when(k % 5 == 0, F.col("q") + 1).otherwise(F.col("q")).alias("q"), F.when(k % 13 == 0, "X").otherwise(F.col("l_returnflag")).alias("l_returnflag"), "l_linestatus")


BOTH = """WITH e AS (SELECT CAST(l_orderkey AS BIGINT) AS k, CAST(l_linenumber AS BIGINT) AS n, CAST(l_quantity AS DOUBLE) AS q, l_returnflag AS f, l_linestatus AS s FROM lineitem),
a AS (SELECT CASE WHEN k % 7 = 0 THEN -k ELSE k END AS k, n, CASE WHEN k % 5 = 0 THEN q + 1 ELSE q END AS q, CASE WHEN k % 13 = 0 THEN 'X' ELSE f END AS f, s FROM e WHERE k % 11 <> 0)"""


def reconcile_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.by_identity(expected(spark, sf_dir), actual(spark, sf_dir), ["l_orderkey", "l_linenumber"], ["q"], ["l_returnflag", "l_linestatus"])
    return out.groupBy("status").agg(F.count("*").alias("n"), F.coalesce(F.max("difference"), F.lit(-1.0)).alias("worst"))


JOIN_SQL = f"""{BOTH}, j AS (SELECT e.k AS ek, a.k AS ak, abs(e.q - a.q) AS d, e.f IS DISTINCT FROM a.f OR e.s IS DISTINCT FROM a.s AS t FROM e FULL JOIN a ON e.k = a.k AND e.n = a.n)
SELECT CASE WHEN ak IS NULL THEN 'MISSING' WHEN ek IS NULL THEN 'EXTRA' WHEN t THEN 'NONNUMERIC_DIFFERENCE' WHEN d > 1e-9 THEN 'NUMERIC_DIFFERENCE' ELSE 'MATCH' END AS status, count(*) AS n, coalesce(max(d), -1.0) AS worst FROM j GROUP BY 1"""


def reconcile_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_multiplicity(expected(spark, sf_dir), actual(spark, sf_dir), ["q", "l_returnflag", "l_linestatus"])


MULTISET_SQL = f"""{BOTH}, x AS (SELECT q, f, s, count(*) AS n FROM e GROUP BY ALL), y AS (SELECT q, f, s, count(*) AS n FROM a GROUP BY ALL)
SELECT q, f AS l_returnflag, s AS l_linestatus, least(coalesce(x.n, 0), coalesce(y.n, 0)) AS matched, greatest(0, coalesce(x.n, 0) - coalesce(y.n, 0)) AS missing, greatest(0, coalesce(y.n, 0) - coalesce(x.n, 0)) AS extra FROM x FULL JOIN y USING (q, f, s)"""


def reconcile_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.by_position(expected(spark, sf_dir), actual(spark, sf_dir), ["l_orderkey"], "q", "l_returnflag")
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("difference") <= 1e-9).alias("equal"), F.count_if(F.col("actual").isNull()).alias("missing"), F.count_if(F.col("expected").isNull()).alias("extra"))


PAIRS_SQL = f"""{BOTH}, x AS (SELECT k, q, row_number() OVER (PARTITION BY k ORDER BY q, f) AS r FROM e), y AS (SELECT k, q, row_number() OVER (PARTITION BY k ORDER BY q, f) AS r FROM a)
SELECT count(*) AS n, count(*) FILTER (WHERE abs(x.q - y.q) <= 1e-9) AS equal, count(*) FILTER (WHERE y.q IS NULL) AS missing, count(*) FILTER (WHERE x.q IS NULL) AS extra FROM x FULL JOIN y ON x.k = y.k AND x.r = y.r"""


def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders only on one side."""
    a, b = (f(spark, sf_dir).select("l_orderkey").distinct() for f in (expected, actual))
    return a.join(b, "l_orderkey", "left_anti").withColumn("side", F.lit("EXPECTED")).unionByName(b.join(a, "l_orderkey", "left_anti").withColumn("side", F.lit("ACTUAL")))


KEYS_SQL = f"""{BOTH} SELECT k AS l_orderkey, 'EXPECTED' AS side FROM (SELECT DISTINCT k FROM e) WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT k, 'ACTUAL' FROM (SELECT DISTINCT k FROM a) WHERE k NOT IN (SELECT k FROM e)"""


def invariance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that haven't four lines with four numbers and one flag."""
    return Q.invariance(expected(spark, sf_dir), ["l_orderkey"], "l_linenumber", "l_returnflag", 4)


INVARIANCE_SQL = f"""{BOTH} SELECT k AS l_orderkey, count(*) AS n_rows, count(DISTINCT n) AS n_labels, count(DISTINCT f) AS n_payloads FROM e GROUP BY k HAVING count(*) <> 4 OR count(DISTINCT n) <> 4 OR count(DISTINCT f) <> 1"""


def table_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal digests of a table and of itself in another order."""
    rows = expected(spark, sf_dir)
    a, b = canonical_hash(rows, rows.columns), canonical_hash(rows.repartition(7, "q"), rows.columns)
    return a.withColumnRenamed("digest", "first").join(b.withColumnRenamed("digest", "second"), "rows").select("rows", (F.col("first") == F.col("second")).alias("equal"))


QUERIES = {f.__name__: f for f in (reconcile_join, reconcile_multiset, reconcile_pairs, key_sets, invariance_check, table_hash)}
ORACLES = {"reconcile_join": JOIN_SQL, "reconcile_multiset": MULTISET_SQL, "reconcile_pairs": PAIRS_SQL, "key_sets": KEYS_SQL, "invariance_check": INVARIANCE_SQL, "table_hash": "SELECT count(*) AS rows, true AS equal FROM lineitem"}
