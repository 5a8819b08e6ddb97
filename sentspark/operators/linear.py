"""Balanced logistic regression on sentence vectors."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from sentspark.operators.counts import balanced_weights, class_counts


def label_codes(df: DataFrame, label: str = "label", output: str = "label_encoded") -> DataFrame:
    """Adds codes by alphabetical order of the labels found."""
    indexer = StringIndexer(inputCol=label, outputCol="_code", stringOrderType="alphabetAsc").fit(df.select(label))
    return indexer.transform(df).withColumn(output, F.col("_code").cast("int")).drop("_code")


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def fit_logistic(train: DataFrame, vector: str = "embedding", label: str = "label", inverse_penalty: float = 1.0,
                 max_iter: int = 200, balanced: bool = True) -> PipelineModel:
    """L2-penalised fit with balanced class weights; the intercept is not penalised.

    The solver sums weighted losses and divides by the sum of weights, so the
    penalty of C is 1 / (C x sum of weights). With balanced weights that sum is
    the number of rows. Per iteration one pass with tree aggregation.
    """
    data = _vectors(train.select(vector, label), vector)
    counts = balanced_weights(class_counts(train, label), label).collect()   # one row per class
    weight = F.lit(1.0)
    if balanced:
        weight = F.when(F.lit(False), F.lit(0.0))
        for row in counts:
            weight = weight.when(F.col(label) == row[label], F.lit(row["weight"]))
    data = data.withColumn("weight", weight).select("features", label, "weight")
    rows = sum(row["n"] for row in counts)
    indexer = StringIndexer(inputCol=label, outputCol="code", stringOrderType="alphabetAsc").fit(data)
    solver = LogisticRegression(
        featuresCol="features", labelCol="code", weightCol="weight", regParam=1.0 / (inverse_penalty * rows),
        elasticNetParam=0.0, standardization=False, fitIntercept=True, maxIter=max_iter, tol=1e-9,
    )
    names = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=indexer.labels)
    return Pipeline(stages=[solver, names]).fit(indexer.transform(data))


def predict_logistic(model: PipelineModel, df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds ``logits`` and ``predicted_label``; ids ride along."""
    out = model.transform(_vectors(df, vector))
    return out.withColumn("logits", vector_to_array("rawPrediction")).drop("features", "rawPrediction", "probability", "prediction")


def coefficients(model: PipelineModel) -> list[float]:
    """Coefficients, then the intercept."""
    fitted = model.stages[0]
    return [*(float(x) for x in fitted.coefficients), float(fitted.intercept)]
