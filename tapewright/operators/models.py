"""Models of patterns: boosted trees and regressions with a split by time, calibrated probabilities, profiles of clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.positions import cumulative, running
from tapewright.functions.rolling import ratio
from tapewright.functions.stored import cut_table


def split_by_time(df: DataFrame, date: str, identity: str, test: float = 0.2) -> DataFrame:
    """``df`` with ``train``: whether a row is among the oldest, all but the last ``test`` of them."""
    df = cut_table(df)  # read three times
    placed = running(df, date, [identity], {})
    total = df.agg(F.count("*").alias("__n"))  # one row
    return placed.join(F.broadcast(total)).withColumn("train", F.col("place") <= F.floor(F.col("__n") * (1 - test))).drop("place", "__n")


def weighted(df: DataFrame, positive: Column) -> DataFrame:
    """``df`` with ``target`` (1.0 or 0.0) and ``weight``: positives of the training rows weigh as much as negatives."""
    df = cut_table(df.withColumn("target", F.coalesce(positive, F.lit(False)).cast("double")))  # fits read it often
    one = df.where("train").agg(ratio(F.sum(1 - F.col("target")), F.sum("target")).alias("__w"))  # one row
    return df.join(F.broadcast(one)).withColumn("weight", F.when(F.col("target") == 1, F.coalesce("__w", F.lit(1.0))).otherwise(1.0)).drop("__w")


def _features(features: list[str]) -> list:
    """Nulls become the training rows' medians, and the columns a vector."""
    return [Imputer(strategy="median", inputCols=features, outputCols=[f"__filled_{c}" for c in features]), VectorAssembler(inputCols=[f"__filled_{c}" for c in features], outputCol="__vector")]


def fit_boosted(df: DataFrame, features: list[str], iterations: int = 100, depth: int = 3, least: int = 50, step: float = 0.1, share: float = 0.8, seed: int = 42):
    """Boosted trees on the training rows of :func:`weighted`; a fitted pipeline."""
    model = GBTClassifier(featuresCol="__vector", labelCol="target", weightCol="weight", maxIter=iterations, maxDepth=depth, minInstancesPerNode=least, stepSize=step, subsamplingRate=share, seed=seed)
    return Pipeline(stages=[*_features(features), model]).fit(df.where("train"))


def fit_logistic(df: DataFrame, features: list[str], ridge: float = 0.0):
    """A weighted logistic regression on the training rows, on standardised columns."""
    model = LogisticRegression(featuresCol="__vector", labelCol="target", weightCol="weight", regParam=ridge, standardization=True)
    return Pipeline(stages=[*_features(features), model]).fit(df.where("train"))


def score(fitted, df: DataFrame, out: str = "p_target") -> DataFrame:
    """``df`` with the probability that a fitted pipeline gives a target."""
    shown = fitted.transform(df).withColumn(out, vector_to_array("probability")[1])
    return shown.select(*df.columns, out)


def classifier_metrics(scored: DataFrame, by: str = "train", p: str = "p_target", top: float = 0.2) -> DataFrame:
    """By ``by``: rows, share of targets, area under the curve (ties count half), log loss, precision of the best ``top``.

    All come from counts of distinct probabilities in order.
    """
    own = [F.col(by).alias(by), F.col(p).alias(p), F.col("target").alias("target")]
    each = scored.select(*own)
    c = cumulative(each, p, [by])
    hits = each.groupBy(by, p).agg(F.sum("target").alias("pos")).select(F.col(by).alias("__by"), F.col(p).alias("__p"), "pos")
    ranked = c.join(hits, (F.col(by).eqNullSafe(F.col("__by"))) & (F.col(p) == F.col("__p")))
    above = F.col("total") - F.col("before") - F.col("count")
    k = F.greatest(F.lit(1), F.floor(F.col("total") * top))
    inside = F.least(F.col("count"), F.greatest(k - above, F.lit(0)))  # of a tie at the edge, its share
    safe = F.least(F.greatest(F.col(p), F.lit(1e-12)), F.lit(1 - 1e-12))
    out = ranked.groupBy(by).agg(
        F.max("total").alias("n"), F.sum("pos").alias("targets"), F.sum(F.col("pos") * (F.col("before") + (F.col("count") + 1) / 2)).alias("__ranks"), F.max(k).alias("__k"),
        F.sum(F.col("pos") * inside / F.col("count")).alias("__hit"), (-F.sum(F.col("pos") * F.ln(safe) + (F.col("count") - F.col("pos")) * F.ln(1 - safe))).alias("__loss"),
    )
    n, pos = F.col("n"), F.col("targets")
    auc = ratio(F.col("__ranks") - pos * (pos + 1) / 2, pos * (n - pos))
    return out.select(by, "n", ratio(pos, n.cast("double")).alias("rate"), auc.alias("auc"), ratio(F.col("__loss"), n.cast("double")).alias("log_loss"), ratio(F.col("__hit"), F.col("__k").cast("double")).alias("precision_top"), ratio(ratio(F.col("__hit"), F.col("__k").cast("double")), ratio(pos, n.cast("double"))).alias("lift"))


def linear_regression(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Least squares of ``target`` on the training rows: a row for each coefficient, the intercept first."""
    rows = df.where("train").select(*[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("double").alias("target")).dropna()
    model = LinearRegression(featuresCol="__vector", labelCol="target", solver="normal", regParam=0.0).fit(VectorAssembler(inputCols=features, outputCol="__vector").transform(rows))
    found = [("intercept", float(model.intercept)), *zip(features, map(float, model.coefficients), strict=True)]
    return df.sparkSession.createDataFrame(found, "name string, coefficient double")


def fit_isotonic(df: DataFrame, probabilities: list[str], label: str, grid: int = 10_000) -> dict[str, IsotonicRegression]:
    """For each class its probability's isotonic regression on whether a row is of that class (0, 1, ... in order).

    Probabilities count to 1 / ``grid``, and rows of one count as one weighted row: whatever the number of rows, a
    regression sees ``grid`` + 1 of them at most. Outside what it saw it stays at its ends.
    """
    each = F.array(*[F.struct(F.lit(k).alias("k"), (F.floor(F.col(p) * grid + 0.5) / grid).alias("p"), (F.col(label) == k).cast("double").alias("y")) for k, p in enumerate(probabilities)])
    rows = df.where(F.col(label).isNotNull()).select(F.explode(each).alias("e")).where("e.p IS NOT NULL")
    rows = rows.groupBy(F.col("e.k").alias("__k"), F.col("e.p").alias("__p")).agg(F.avg("e.y").alias("__y"), F.count("*").cast("double").alias("__w"))
    rows = cut_table(rows)  # one pass over ``df`` for all classes; a regression reads its rows several times
    model = IsotonicRegression(featuresCol="__p", labelCol="__y", weightCol="__w")
    return {p: model.fit(rows.where(F.col("__k") == k)) for k, p in enumerate(probabilities)}


def calibrate(df: DataFrame, fitted: dict, grid: int = 10_000, least: float = 1e-8) -> DataFrame:
    """``df`` with its probabilities calibrated class by class, and made to sum to 1 again; null ones stay null."""
    columns = list(df.columns)
    for p, model in fitted.items():
        at = F.floor(F.coalesce(F.col(p), F.lit(0.0)) * grid + 0.5) / grid
        df = model.setFeaturesCol("__p").setPredictionCol(f"__c_{p}").transform(df.withColumn("__p", at)).drop("__p")
    raised = {p: F.when(F.col(p).isNotNull(), F.greatest(F.col(f"__c_{p}"), F.lit(least))) for p in fitted}
    total = reduce(lambda a, b: a + b, raised.values())
    return df.select(*[(raised[c] / total).alias(c) if c in fitted else F.col(c) for c in columns])


def cluster_profiles(df: DataFrame, features: list[str], most: int = 8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rows with ``profile``, a row for each profile): k-means of standardised columns, nulls as medians.

    The number of clusters from 2 to ``most`` is that of the best silhouette. Profiles are numbered by the size of
    their first column's centre, and named by the column in which their centre stands out most.
    """
    df = cut_table(df)  # each number of clusters reads it several times
    staged = Pipeline(stages=[*_features(features), StandardScaler(inputCol="__vector", outputCol="__scaled", withMean=True, withStd=True)]).fit(df)
    scaled = staged.transform(df)
    judge, best = ClusteringEvaluator(featuresCol="__scaled", predictionCol="__k"), None
    for k in range(2, most + 1):
        model = KMeans(k=k, seed=seed, featuresCol="__scaled", predictionCol="__k").fit(scaled)
        quality = judge.evaluate(model.transform(scaled))
        if best is None or quality > best[0] + 1e-9:
            best = quality, model
    quality, model = best
    centres = [list(map(float, c)) for c in model.clusterCenters()]
    order = sorted(range(len(centres)), key=lambda i: centres[i])
    named = []
    for number, i in enumerate(order):
        column = max(range(len(features)), key=lambda j: (abs(centres[i][j]), -j))
        named.append((i, number, f"{'high' if centres[i][column] > 0 else 'low'} {features[column]}", *centres[i]))
    names = df.sparkSession.createDataFrame(named, "__k int, profile int, name string, " + ", ".join(f"`{c}` double" for c in features))
    rows = model.transform(scaled).select(*df.columns, "__k").join(F.broadcast(names.select("__k", "profile", "name")), "__k").drop("__k")
    sizes = rows.groupBy("profile").agg(F.count("*").alias("n"))
    return rows, names.drop("__k").join(sizes, "profile").withColumn("silhouette", F.lit(float(quality)))
