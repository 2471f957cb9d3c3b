"""Models over seasons: walk-forward ridge fits and a logistic calibrator, with Spark's own library."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.functions import windows as W
from tidelag.functions.scalars import fixed
from tidelag.operators import regression as R
from tidelag.plans.inputs import plays, query
from tidelag.plans.market import predictions
from tidelag.sources.sinks import stored

FEATURES = ("roll3", "roll6", "std")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = plays(spark, sf_dir).groupBy("team", "season", "week").agg(F.avg("yards").alias("y"))
    w = W.by(("team", "season"), ("week",))
    return t.select("*", W.lagged_mean("y", w, 3).alias("roll3"), W.lagged_mean("y", w, 6).alias("roll6"), W.lagged_mean("y", w).alias("std"))


def walk_forward(df: DataFrame, features: tuple[str, ...], label: str, seasons: list[int], season: str = "season", penalty: float = 0.1) -> DataFrame:
    """df's rows of each season with `prediction` of a ridge fit on all earlier seasons; gaps get the median."""
    filled = [f"{c}_f" for c in features]
    parts = []
    for s in seasons:
        past = df.where(F.col(season) < s)
        fill = Imputer(inputCols=list(features), outputCols=filled, strategy="median").fit(past)
        rows = VectorAssembler(inputCols=filled, outputCol="__x")
        model = LinearRegression(featuresCol="__x", labelCol=label, regParam=penalty).fit(rows.transform(fill.transform(past)))
        parts.append(model.transform(rows.transform(fill.transform(df.where(F.col(season) == s)))).drop("__x", *filled))
    return reduce(DataFrame.unionByName, parts)


@query()
def ridge_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week's mean from what was before, fitted on earlier seasons alone; every season but the first."""
    f = stored(_features(spark, sf_dir), "features")
    known = sorted(r["season"] for r in f.select("season").distinct().collect() if r["season"] is not None)
    out = walk_forward(f, FEATURES, "y", known[1:])
    return out.select("team", "season", "week", fixed("y", 4).alias("y"), fixed("prediction", 4).alias("prediction"))


@query()
def edge_calibrator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a bet wins by the size of its edge, each season from all earlier ones; the first season has none."""
    p = predictions(spark, sf_dir).withColumn("edge", F.abs(F.col("predicted") - F.col("spread")))
    won = ((F.col("predicted") > F.col("spread")) == (F.col("margin") > F.col("spread"))).cast("double")
    p = stored(VectorAssembler(inputCols=["edge"], outputCol="x").transform(p.withColumn("won", won)), "edges")
    logistic = LogisticRegression(featuresCol="x", labelCol="won", regParam=0.01)
    fits = [(s, logistic.fit(p.where(F.col("season") < s))) for s in R.known_seasons(p)[1:]]
    parts = [m.transform(p.where(F.col("season") == s)) for s, m in fits]
    return reduce(DataFrame.unionByName, parts).select("game", "season", fixed(vector_to_array("probability")[1], 4).alias("confidence"))


@query()
def bayesian_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week's mean with the floor and ceiling that a Bayesian fit on earlier seasons gives it."""
    f = stored(_features(spark, sf_dir), "features")
    out = R.with_intervals(f, R.bayesian_folds(f, FEATURES, "y"), FEATURES)
    return out.select("team", "season", "week", *[fixed(c, 4).alias(c) for c in ("y", "mean", "std", "floor", "ceiling")])


@query()
def quantile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines below which 10, 50 and 90 in 100 weeks are expected, fitted on earlier seasons."""
    f = stored(_features(spark, sf_dir), "features")
    out = R.with_quantiles(f, R.quantile_folds(f, FEATURES, "y"), FEATURES)
    return out.select("team", "season", "week", *[fixed(c, 4).alias(c) for c in ("y", "q10", "q50", "q90")])
