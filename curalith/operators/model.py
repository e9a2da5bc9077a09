"""A model's life cycle on pyspark.ml: weights, fit, history, scores."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalith.operators.metrics import class_weights


def train(rows: DataFrame, features: str = "features", label: str = "y_true", iterations: int = 20) -> LogisticRegressionModel:
    """Fit on the rows of the train split only; classes weigh n / (2 n_c).  ``features`` is array<float or double>."""
    if "split" in rows.columns and not rows.where(F.lower(F.trim("split")) != "train").isEmpty():
        raise ValueError("training takes rows of the train split only")
    weighted = rows.join(F.broadcast(class_weights(rows, label).select(label, "weight")), label)
    data = weighted.select(F.col(label).cast("double").alias("label"), array_to_vector(F.col(features).cast("array<double>")).alias("features"), "weight")
    return LogisticRegression(maxIter=iterations, regParam=1e-3, weightCol="weight").fit(data)


def history(model: LogisticRegressionModel) -> DataFrame:
    """(epoch, loss) of the optimiser's iterations."""
    from pyspark.sql import SparkSession

    return SparkSession.active().createDataFrame(list(enumerate(float(x) for x in model.summary.objectiveHistory)), "epoch int, loss double")


def score(model: LogisticRegressionModel, rows: DataFrame, features: str = "features") -> DataFrame:
    """The rows with ``score``, the probability of class 1: key and score stay in one row, nothing is zipped by position."""
    out = model.transform(rows.withColumn("features_vector", array_to_vector(F.col(features).cast("array<double>"))).withColumnRenamed("features", "features_array") if features == "features" else rows.withColumn("features_vector", array_to_vector(F.col(features).cast("array<double>"))), {model.featuresCol: "features_vector"})
    scored = out.withColumn("score", F.get(vector_to_array("probability"), 1)).drop("rawPrediction", "probability", "prediction", "features_vector")
    return scored.withColumnRenamed("features_array", "features") if features == "features" else scored
