"""Clusters of bars' observations, with SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import density as D
from tidemark.operators import partitions as P
from tidemark.operators.lineage import cut
from tidemark.plans.states import A_SQL, model_a
from tidemark.plans.study import OBSERVED_SQL, observed

COLUMNS = ("displacement8", "efficiency8", "range8")


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, t, x0, x1, x2): observations, centred and in units of their deviation; rounded, so that sums in another order agree."""
    x = observed(spark, sf_dir).select("symbol", "t", *COLUMNS).na.drop()
    # One row of means and deviations stands beside all rows.
    stats = x.agg(*[F.struct(F.avg(c).alias("m"), F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias("s")).alias(f"of{k}") for k, c in enumerate(COLUMNS)])
    return x.join(F.broadcast(stats)).select("symbol", "t", *[F.round((F.col(c) - F.col(f"of{k}.m")) / F.col(f"of{k}.s"), 6).alias(f"x{k}") for k, c in enumerate(COLUMNS)])


SCALED_SQL = f"""{OBSERVED_SQL}, known AS (SELECT symbol, t, {", ".join(COLUMNS)} FROM ob WHERE {" AND ".join(f"{c} IS NOT NULL" for c in COLUMNS)}),
pts AS MATERIALIZED (SELECT symbol, t, {", ".join(f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 6) AS x{k}" for k, c in enumerate(COLUMNS))} FROM known)"""


def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DBSCAN of the observations; eps is the 45 percent point of the distance to the fourth neighbour."""
    x = scaled(spark, sf_dir)
    names = ["x0", "x1", "x2"]
    eps = D.neighbour_distance(D.points_of(x, ["symbol", "t"], names))
    if eps is None:
        return x.select("symbol", "t", F.lit(None).cast("string").alias("cluster_symbol"), F.lit(None).cast("long").alias("cluster_t"), F.lit(False).alias("core"))
    found = D.dbscan(x, ["symbol", "t"], names, eps)
    return found.select("symbol", "t", F.col("cluster.symbol").alias("cluster_symbol"), F.col("cluster.t").alias("cluster_t"), "core")


DENSITY_SQL = f"""{SCALED_SQL.replace("WITH", "WITH RECURSIVE", 1)},
num AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY symbol, t) AS id FROM pts),
far AS MATERIALIZED (SELECT a.id AS a, b.id AS b, (a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2) AS q FROM num a, num b),
fourth AS (SELECT a, sqrt(list_sort(list(q) FILTER (a <> b))[4]) AS r FROM far GROUP BY a), e AS (SELECT quantile_cont(r, 0.45) AS eps FROM fourth),
near AS MATERIALIZED (SELECT a, b FROM far, e WHERE q <= eps * eps), cores AS MATERIALIZED (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 4),
links AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (FROM cores) AND b IN (FROM cores)), reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
core_of AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY a), label AS (SELECT id, c, true AS core FROM core_of UNION ALL SELECT near.a, min(c), false FROM near JOIN core_of ON core_of.id = near.b WHERE near.a NOT IN (FROM cores) GROUP BY near.a)
SELECT num.symbol, num.t, f.symbol AS cluster_symbol, f.t AS cluster_t, coalesce(label.core, false) AS core FROM num LEFT JOIN label ON label.id = num.id LEFT JOIN num f ON f.id = label.c"""

XS = ["x0", "x1", "x2"]
KS, SEEDS = (2, 3, 4, 5, 6), (1, 2, 3, 4, 5)


def kmeans_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each number of clusters: agreement of its seeds, silhouettes, the smallest cluster, how long states last, and whether it is stable; chosen is the best."""
    x = scaled(spark, sf_dir)
    centres = P.kmeans_grid(x, ["symbol", "t"], XS, KS, SEEDS)
    runs = list(centres)
    found = cut(P.labelled(x, XS, centres))
    agree = P.agreement(found, runs).groupBy("k").agg(F.percentile("ari", 0.5).alias("median_ari"), F.percentile("ari", 0.1).alias("p10_ari"))
    each = [F.struct(F.lit(k).alias("k"), F.lit(s).alias("seed"), F.get("labels", F.lit(j)).alias("state")) for j, (k, s) in enumerate(runs)]
    long = found.select("symbol", "t", F.explode(F.array(*each)).alias("r")).select("symbol", "t", "r.*")
    sizes = long.groupBy("k", "seed", "state").agg(F.count("*").alias("n"))
    least = sizes.groupBy("k", "seed").agg((F.min("n") / F.sum("n")).alias("share")).groupBy("k").agg(F.min("share").alias("min_share"), F.count(F.when(F.col("share") < 0.05, 1)).alias("degenerate"))
    order = Window.partitionBy("k", "seed", "symbol").orderBy("t")
    new = (F.col("state") != F.lag("state").over(order)) | F.lag("state").over(order).isNull()
    dwell = long.withColumn("run", F.sum(new.cast("long")).over(order)).groupBy("k", "seed", "symbol", "run", "state").agg(F.count("*").alias("bars"))
    lasting = dwell.groupBy("k", "seed", "state").agg(F.percentile("bars", 0.5).alias("m")).groupBy("k", "state").agg(F.percentile("m", 0.5).alias("m")).groupBy("k").agg(F.count(F.when(F.col("m") >= 3, 1)).alias("lasting"))
    some = P.sample(found, ["symbol", "t"], XS, P.SILHOUETTE_ROWS, more=("labels",))
    points, labels = P.matrix_of(some, XS), np.array([r.labels for r in some])
    shape = spark.createDataFrame([(k, float(P.silhouettes(points, labels[:, j]).mean())) for j, (k, _) in enumerate(runs)], "k int, s double").groupBy("k").agg(F.percentile("s", 0.5).alias("median_silhouette"), F.percentile("s", 0.1).alias("p10_silhouette"))
    out = agree.join(least, "k").join(lasting, "k").join(shape, "k")
    stable = (F.col("median_ari") >= 0.80) & (F.col("p10_ari") >= 0.65) & (F.col("median_silhouette") >= 0.25) & (F.col("min_share") >= 0.05) & (F.col("lasting") >= 2)
    best = Window.partitionBy(F.lit(1)).orderBy(F.col("stable").desc(), *[F.col(c).desc() for c in ("median_ari", "p10_ari", "median_silhouette", "min_share")], "k")  # a row for each number of clusters
    return out.withColumn("stable", stable).withColumn("chosen", F.row_number().over(best) == 1)


def linkage_clusters(spark: SparkSession, sf_dir: str, k: int = 4) -> DataFrame:
    return P.linkage(scaled(spark, sf_dir), ["symbol", "t"], XS, k).select("symbol", "t", "cluster")


def co_clustering(spark: SparkSession, sf_dir: str, k: int = 4) -> DataFrame:
    """How often two rows of a sample of 100 are put together by linkages of four fifths of it."""
    pairs, _ = P.co_clustered(scaled(spark, sf_dir), ["symbol", "t"], XS, k, most=100)
    return pairs.withColumn("share", F.col("together") / F.col("drawn"))


def linkage_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of linkages of four fifths of the sample with that of all of it, by number of clusters."""
    out = None
    for k in (2, 3, 4, 5):
        _, agree = P.co_clustered(scaled(spark, sf_dir), ["symbol", "t"], XS, k, replicates=100, most=100)
        one = agree.agg(F.lit(k).alias("k"), F.avg("ari").alias("mean_ari"), F.percentile("ari", 0.5).alias("median_ari"), F.percentile("ari", 0.1).alias("p10_ari"))
        out = one if out is None else out.unionByName(one)
    return out


def state_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean silhouette of each state of the trend model among the observations, over at most 900 rows."""
    x = scaled(spark, sf_dir).join(model_a(spark, sf_dir).select("symbol", "t", "state"), ["symbol", "t"])
    some = P.sample(x, ["symbol", "t"], XS, P.SILHOUETTE_ROWS, more=("state",))
    values = P.silhouettes(P.matrix_of(some, XS), np.array([r.state for r in some]))
    rows = [(r.state, float(v)) for r, v in zip(some, values, strict=True)]
    return spark.createDataFrame(rows, "state string, s double").groupBy("state").agg(F.count("*").alias("n"), F.round(F.avg("s") + 1e-9, 6).alias("silhouette"))


#: SQL over all rows: equal while there are no more than the sample's 900, as in the smaller tables.
SILHOUETTE_SQL = f"""{A_SQL}, """ + SCALED_SQL[SCALED_SQL.index("p AS (SELECT symbol, t, i, open"):] + """,
st AS MATERIALIZED (SELECT row_number() OVER () AS id, pts.*, a.state FROM pts JOIN a USING (symbol, t)), sizes AS (SELECT state, count(*) AS n FROM st GROUP BY state),
means AS (SELECT a.id, a.state, b.state AS other, sum(sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2))) AS d FROM st a, st b GROUP BY ALL),
ab AS (SELECT means.id, any_value(means.state) AS state, coalesce(max(CASE WHEN other = means.state THEN d / nullif(n - 1, 0) END), 0) AS a, min(CASE WHEN other <> means.state THEN d / n END) AS b FROM means JOIN sizes ON sizes.state = other GROUP BY means.id)
SELECT state, count(*) AS n, round(avg(CASE WHEN b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) + 1e-9, 6) AS silhouette FROM ab GROUP BY state"""

QUERIES = {f.__name__: f for f in (density_clusters, kmeans_stability, linkage_clusters, co_clustering, linkage_stability, state_silhouette)}
ORACLES = {"density_clusters": DENSITY_SQL, "state_silhouette": SILHOUETTE_SQL}
