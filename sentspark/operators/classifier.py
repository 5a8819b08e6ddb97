"""One door to both classifiers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from sentspark.operators import head as H, linear as L
from sentspark.operators.history import track
from sentspark.session import remove_path


@dataclass
class LogisticClassifier:
    params: dict[str, Any]
    model: PipelineModel | None = None

    def fit(self, train: DataFrame, val: DataFrame | None = None, **_: Any) -> "LogisticClassifier":
        self.model = L.fit_logistic(train, **self.params)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return L.predict_logistic(self.model, df, self.params.get("vector", "embedding"))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> "LogisticClassifier":
        self.model = PipelineModel.load(path)
        return self


@dataclass
class HeadClassifier:
    params: dict[str, Any]
    model: H.Head | None = None
    best_score: float | None = None

    def fit(self, train: DataFrame, val: DataFrame | None = None, log: Callable[[dict], None] | None = None,
            train_fn: Callable = H.train_head, **options: Any) -> "HeadClassifier":
        settings = H.HeadSettings(**self.params)
        self.model, self.best_score, _ = track(train_fn, log, train, val, settings, **options)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return H.predicted(H.score(df, self.model, "embedding"))

    def save(self, path: str) -> None:
        H.save_head(SparkSession.active(), self.model, path)

    def load(self, path: str) -> "HeadClassifier":
        self.model = H.load_head(SparkSession.active(), path)
        return self


KINDS = {"lr": LogisticClassifier, "mlp": HeadClassifier}


def make_classifier(kind: str, **params: Any):
    if kind not in KINDS:
        raise NotImplementedError(f"no classifier named {kind!r}")
    return KINDS[kind](params)


def load_or_fit(kind: str, path: str, train: DataFrame, val: DataFrame | None = None, force: bool = False,
                train_on: bool = False, fit_options: dict[str, Any] | None = None, **params: Any):
    """A saved model is loaded; with ``train_on`` a head is then fitted further from its
    weights. Without one, fit. What was fitted is saved, and the progress of a fit that
    has come to its end is removed."""
    classifier = make_classifier(kind, **params)
    options = dict(fit_options or {})
    progress = options.get("progress")
    if force and progress:
        remove_path(SparkSession.active(), progress)
    if not force:
        try:
            classifier.load(path)
        except Exception as missing:
            if not (isinstance(missing, AnalysisException) or "does not exist" in str(missing)):
                raise
        else:
            if kind != "mlp" or not train_on:
                return classifier
            options["initial"] = classifier.model
    classifier.fit(train, val, **options)
    classifier.save(path)
    if progress:
        remove_path(SparkSession.active(), progress)
    return classifier
