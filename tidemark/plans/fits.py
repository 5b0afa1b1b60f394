"""Fits of later moves on all nine observations of a bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import forest as W
from tidemark.operators import linear as L
from tidemark.plans.study import NAMES, observed


def told(spark: SparkSession, sf_dir: str, ahead: int = 3) -> DataFrame:
    """(symbol, t, nine observations, y): y is the move of the next bars in units of ATR."""
    y = F.try_divide(F.lead("close", ahead).over(S.order()) - F.col("close"), "atr")
    return observed(spark, sf_dir).select("symbol", "t", *NAMES, y.alias("y"))


def linear_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, model, term, weight) of least squares, ridge, lasso and Huber's fit; the term of the intercept is empty."""
    x = told(spark, sf_dir)
    one_pass = L.fitted(L.gram(x, "symbol", NAMES, "y"), "symbol", NAMES, {"ols": L.ridge(0.0), "ridge": L.ridge(1.0), "lasso": L.lasso()})
    found = one_pass.unionByName(L.huber(x, "symbol", NAMES, "y"))
    terms = F.arrays_zip(F.array(F.lit(""), *[F.lit(n) for n in NAMES]).alias("term"), F.col("weights").alias("weight"))
    return found.select("symbol", "model", F.explode(terms).alias("w")).select("symbol", "model", "w.term", F.round(F.col("w.weight") + 1e-9, 6).alias("weight"))


def observation_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal axes of all nine observations by symbol."""
    found = L.axes(L.gram(told(spark, sf_dir), "symbol", NAMES, "y"), "symbol", NAMES)
    return found.select("symbol", "axis", F.round("share", 6).alias("share"), F.transform("weights", lambda w: F.round(w, 5)).alias("weights"))


def stump_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, t, y, predicted) by eighty bagged stumps."""
    x = told(spark, sf_dir)
    forest = W.fit(x, ["symbol", "t"], NAMES, "y")
    return x.na.drop(subset=NAMES).select("symbol", "t", "y", F.round(W.predict(NAMES, forest), 6).alias("predicted"))


QUERIES = {f.__name__: f for f in (linear_models, observation_axes, stump_forest)}
ORACLES: dict[str, str] = {}
