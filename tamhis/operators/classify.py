"""Supervised models on document vectors; naive Bayes over words is in ``bayes``."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.sql import Column
from pyspark.sql import functions as F

from tamhis.functions import fixed
from tamhis.functions.vectors import as_array
from tamhis.operators.bayes import TextNaiveBayesModel

RAW, PROBABILITY = "__raw_prediction", "probability"


def logistic(vec_col: str = "vec", label_col: str = "label", out: str = "prediction", **options) -> LogisticRegression:
    return LogisticRegression(
        featuresCol=vec_col, labelCol=label_col, predictionCol=out, rawPredictionCol=RAW, probabilityCol=PROBABILITY,
        **{"maxIter": 100, "regParam": 0.01, **options},
    )


def perceptron(
    dims: int, classes: int, nodes: int = 5, layers: int = 2, vec_col: str = "vec", label_col: str = "label",
    out: str = "prediction", iterations: int = 100,
) -> MultilayerPerceptronClassifier:
    """Feed-forward head: ``dims`` inputs, ``layers + 1`` hidden layers of ``nodes``, one output per class."""
    return MultilayerPerceptronClassifier(
        featuresCol=vec_col, labelCol=label_col, predictionCol=out, rawPredictionCol=RAW, probabilityCol=PROBABILITY,
        layers=[dims, *([nodes] * (layers + 1)), classes], maxIter=iterations, seed=fixed.SEED,
    )


def outcome(model: PipelineModel | TextNaiveBayesModel, prediction: str = "prediction") -> tuple[Column, Column]:
    """Predicted class number and probabilities by class number, from the columns that ``model`` adds."""
    if isinstance(model, TextNaiveBayesModel):
        return F.col(prediction), F.col(PROBABILITY)
    return F.col(prediction).cast("int"), as_array(PROBABILITY)
