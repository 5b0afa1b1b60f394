"""Statistics of features and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import stats as X
from tidemark.plans.states import A_SQL, model_a
from tidemark.plans.study import OBSERVED_SQL, observed, outcome, with_third
from tidemark.sources.bars import bars

LABELLED_SQL = f"{OBSERVED_SQL}, y AS (SELECT symbol, t, (lead(close, 3) OVER (PARTITION BY symbol ORDER BY t) - close) / nullif(atr, 0) AS x FROM p), z AS (SELECT ob.symbol, ob.t, displacement8, efficiency8, range32, x, CAST(x > 0 AS BIGINT) AS up FROM ob JOIN y ON ob.symbol = y.symbol AND ob.t = y.t WHERE x IS NOT NULL)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir).join(outcome(spark, sf_dir), ["symbol", "t"]).where("x IS NOT NULL").withColumn("up", (F.col("x") > 0).cast("long"))


def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, out = labelled(spark, sf_dir), None
    for a, b in (("displacement8", "x"), ("efficiency8", "range32"), ("displacement8", "efficiency8")):
        part = X.spearman(x, a, b, "symbol").select("symbol", F.lit(a).alias("a"), F.lit(b).alias("b"), "n", F.round("rho", 6).alias("rho"))
        out = part if out is None else out.unionByName(part)
    return out


def spearman_sql() -> str:
    parts = []
    for a, b in (("displacement8", "x"), ("efficiency8", "range32"), ("displacement8", "efficiency8")):
        parts.append(f"""SELECT symbol, '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY {a}) + (count(*) OVER (PARTITION BY symbol, {a}) - 1) / 2.0 AS ra,
rank() OVER (PARTITION BY symbol ORDER BY {b}) + (count(*) OVER (PARTITION BY symbol, {b}) - 1) / 2.0 AS rb FROM z WHERE {a} IS NOT NULL AND {b} IS NOT NULL) GROUP BY symbol""")
    return f"{LABELLED_SQL} {' UNION ALL '.join(parts)}"


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.roc_auc(labelled(spark, sf_dir), "displacement8", "up", "symbol").withColumn("auc", F.round("auc", 6))


AUC_SQL = f"""{LABELLED_SQL}, r AS (SELECT symbol, up, rank() OVER (PARTITION BY symbol ORDER BY displacement8) + (count(*) OVER (PARTITION BY symbol, displacement8) - 1) / 2.0 AS r FROM z WHERE displacement8 IS NOT NULL),
s AS (SELECT symbol, CAST(sum(up) AS BIGINT) AS positives, CAST(sum(1 - up) AS BIGINT) AS negatives, sum(r * up) AS s FROM r GROUP BY symbol)
SELECT symbol, positives, negatives, round((s - positives * (positives + 1) / 2) / (positives * negatives), 6) AS auc FROM s"""


def two_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    slow = F.when(F.col("ds") > 0, "UP").when(F.col("ds") < 0, "DOWN").otherwise("TRANSITION")
    return model_a(spark, sf_dir).select(F.col("state").alias("a"), slow.alias("b"))


TWO_SQL = f"{A_SQL}, m AS (SELECT state AS a, CASE WHEN ds > 0 THEN 'UP' WHEN ds < 0 THEN 'DOWN' ELSE 'TRANSITION' END AS b FROM a)"


def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.cohen_kappa(two_models(spark, sf_dir), "a", "b").withColumn("kappa", F.round("kappa", 6))


KAPPA_SQL = f"""{TWO_SQL}, nn AS (SELECT count(*) AS n, avg(CAST(a = b AS DOUBLE)) AS o FROM m), ee AS (SELECT sum(x.c * y.c) AS e FROM (SELECT a AS v, count(*) AS c FROM m GROUP BY 1) x JOIN (SELECT b AS v, count(*) AS c FROM m GROUP BY 1) y USING (v))
SELECT n, round((o - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM nn, ee"""


def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.adjusted_rand(two_models(spark, sf_dir), "a", "b").withColumn("ari", F.round("ari", 6))


ARI_SQL = f"""{TWO_SQL}, c AS (SELECT a, b, count(*) AS n FROM m GROUP BY ALL), ii AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(n * (n - 1) / 2) AS i FROM c),
x AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT n, round((i - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)), 6) AS ari FROM ii, x, y"""


def ks_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.ks_distance(labelled(spark, sf_dir).where("range32 IS NOT NULL"), "range32", "up", "symbol").withColumn("ks", F.round("ks", 6))


KS_SQL = f"""{LABELLED_SQL}, d AS (SELECT symbol, abs(sum(1 - up) OVER w / sum(1 - up) OVER (PARTITION BY symbol) - sum(up) OVER w / sum(up) OVER (PARTITION BY symbol)) AS d FROM z WHERE range32 IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY range32 RANGE UNBOUNDED PRECEDING))
SELECT symbol, round(max(d), 6) AS ks FROM d GROUP BY symbol"""


def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.bootstrap_mean(labelled(spark, sf_dir).select("symbol", "t", "x"), "x", "symbol")


def kmeans_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, t, cluster) from standardised observations."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    x = observed(spark, sf_dir).na.drop(subset=["displacement8", "efficiency8", "range8"])
    parts = [VectorAssembler(inputCols=["displacement8", "efficiency8", "range8"], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), KMeans(k=3, seed=1, predictionCol="cluster")]
    fitted = Pipeline(stages=parts).fit(x)
    # Clusters are numbered by their centres, so the numbers don't depend on the order of the rows.
    centres = [list(c) for c in fitted.stages[-1].clusterCenters()]
    number = F.array(*[F.lit(sorted(centres).index(c)) for c in centres])
    return fitted.transform(x).select("symbol", "t", F.get(number, F.col("cluster")).alias("cluster"))


def logistic_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, t, p, up): each third of the time scored by a model of the other two."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = with_third(labelled(spark, sf_dir), bars(spark, sf_dir)).na.drop(subset=["displacement8", "efficiency8", "range32"])
    x, out = VectorAssembler(inputCols=["displacement8", "efficiency8", "range32"], outputCol="features").transform(x).cache(), None
    for k in range(3):
        model = LogisticRegression(labelCol="up", regParam=0.1).fit(x.where(F.col("third") != k))
        part = model.transform(x.where(F.col("third") == k)).select("symbol", "t", F.get(vector_to_array("probability"), F.lit(1)).alias("p"), "up")
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {f.__name__: f for f in (spearman_matrix, roc_auc, cohen_kappa, adjusted_rand, ks_distance, bootstrap_interval, kmeans_states, logistic_out_of_fold)}
ORACLES = {"spearman_matrix": spearman_sql(), "roc_auc": AUC_SQL, "cohen_kappa": KAPPA_SQL, "adjusted_rand": ARI_SQL, "ks_distance": KS_SQL}
