"""The three end-to-end runs, each a composition of the operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sentspark.functions.labels import TRAIN_CODES
from sentspark.operators import (
    classifier as K, counts as C, embedding as EM, evaluation as E, layout as Y, linear as L, profile as P, tokens as T,
)
from sentspark.operators.encoding import encode_labels
from sentspark.session import list_folders, materialize
from sentspark.sources import readers as R, settings as Z, sinks as W


def _path(settings: Mapping, *parts: str) -> str:
    return "/".join([settings["data"]["dir"].rstrip("/"), *(p.strip("/") for p in parts)])


def train_and_submit(spark: SparkSession, source: Mapping | str, test_has_labels: bool = True, force: bool = False,
                     embed: Callable[[DataFrame], DataFrame] | None = None, vocabulary_size: int = 30_000,
                     metrics: Mapping[str, Callable] | None = None, train_on: bool = True) -> dict[str, Any]:
    """Read three splits, profile their tokens, fit the head on frozen sentence
    vectors, score the test split and write the submission.

    ``embed`` adds the ``embedding`` column; without it the built-in hashed
    encoder, fitted to the train split, is used. A head saved by an earlier run of the
    same name is loaded and trained on, or only loaded without ``train_on``; ``force``
    starts afresh. A run that was stopped goes on behind its last complete epoch.
    """
    settings = Z.load_settings(source)
    data, encoder, train = settings["data"], settings["encoder_model"], settings["train"]
    splits = R.read_splits(
        spark, {name: _path(settings, data[f"{name}_en"]) for name in ("train", "val", "test")},
        unlabelled=() if test_has_labels else ("test",), line_breaks=True,
    )
    for name in ("train", "val", "test") if test_has_labels else ("train", "val"):
        splits[name] = encode_labels(splits[name])
    run = Z.run_id(settings)
    folder = _path(settings, data["fine_tuned_model_path"], run)

    # One vocabulary for all splits; it leaves this run as a table of fixed size.
    steps = T.settings_steps(encoder["r2l"])
    vocab = T.vocabulary(splits["train"], vocabulary_size, steps=steps)
    everything = R.union_splits({name: df.select("sentence_id", "sentence") for name, df in splits.items()})
    token_profile = T.token_stats(T.tokenize(
        everything, vocab, encoder["max_length"], steps=steps, add_special_tokens=encoder["add_special_tokens"],
        padding=encoder["padding"], truncation=encoder["truncation"]), ("split",))

    if embed is None:
        model = EM.hashed_encoder(splits["train"], encoder.get("hidden_dim", 256))
        embed = lambda df: EM.embed_hashed(df, model)
    vectors = {name: embed(df) for name, df in splits.items()}      # the fit stores them itself
    weights = None
    if train["loss"] == "focal":
        rows = C.effective_weights(C.class_counts(splits["train"], "label_encoded"), "label_encoded").collect()
        weights = tuple(r["weight"] for r in sorted(rows, key=lambda r: r["label_encoded"]))
    if not list_folders(spark, f"{folder}/progress"):
        W.forget_run(spark, f"{folder}/history", run)       # a stopped run goes on, any other starts anew
    head = K.load_or_fit(
        "mlp", f"{folder}/model", vectors["train"], vectors["val"], force, train_on,
        {"log": W.metric_logger(spark, f"{folder}/history", run), "metrics": metrics, "progress": f"{folder}/progress"},
        inputs=encoder.get("hidden_dim", 256), hidden=encoder["mlp_dim"], classes=len(TRAIN_CODES), dropout=encoder["dropout_ratio"],
        learning_rate=train["learning_rate"], eps=train["eps"], epochs=train["epochs"], patience=train["early_stopping_patience"],
        batch_size=train["batch_size"], warmup_steps=train["warmup_steps"], step_per=train["step_per"], loss=train["loss"],
        gamma=train["focal_loss_gamma"], class_weights=weights, digits=train["rounding_metrics"], seed=train["seed"],
    )
    predicted = head.predict(vectors["test"]).select(
        "sentence_id", "predicted_label", *(["label"] if test_has_labels else [])
    )
    out = {"run_id": run, "best_score": head.best_score, "token_profile": token_profile, "history": f"{folder}/history"}
    if test_has_labels:
        report = C.class_report(C.confusion(predicted, "label", "predicted_label"), train["rounding_metrics"])
        scores = {r["category"]: r["f1-score"] for r in report.collect()}
        W.log_metrics(spark, f"{folder}/history", run, {f"test/{c}_class_f1": scores.get(c) for c in TRAIN_CODES})
        out["test_report"] = report
    out["submission"] = W.write_submission(predicted, folder, test_has_labels)
    return out


def explore_embeddings(spark: SparkSession, source: Mapping | str, force: bool = False, bins: int = 200,
                       embed: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Length profile, cached vectors, 2-D layout, and the binned counts and legend a
    plot needs."""
    settings = Z.load_settings(source)
    data, encoder, reducer = settings["data"], settings["encoder_model"], dict(settings["dim_red_model"])
    train = R.read_delimited(spark, _path(settings, data["train_en"]), separator="\t", line_breaks=True)
    coded = L.label_codes(train)

    def compute() -> DataFrame:
        texts = train.select("sentence_id", "sentence")
        vectors = embed(texts) if embed else EM.embed_hashed(texts, EM.hashed_encoder(texts))
        return vectors.select("sentence_id", "embedding")

    cache = W.cache_path(_path(settings, data["train_en_embedding"]), encoder["name"], encoder["max_length"], data["train_en"])
    vectors = W.load_or_compute(spark, cache, compute, force)
    layout = Y.layout_table(coded, Y.reduce_vectors(vectors, reducer.pop("name"), reducer))
    return {
        "lengths": P.describe_lengths(train), "layout": layout,
        "bins": Y.density_bins(layout, "Component 1", "Component 2", bins, "label"),
        "legend": E.legend(coded, "label_encoded", "label"),
    }


def baseline(spark: SparkSession, train_path: str, test_path: str, folder: str,
             embed: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, Any]:
    """Logistic regression on sentence vectors, predictions as a table, and its
    scores against the labels of the test file."""
    train, test = (R.read_unquoted(spark, p) for p in (train_path, test_path))
    if embed is None:
        model = EM.hashed_encoder(train.where("sentence is not null"))
        embed = lambda df: EM.embed_hashed(df.na.fill("", ["sentence"]), model)
    # The solver reads its rows many times: they are encoded once.
    fitted = L.fit_logistic(materialize(embed(train).drop("sentence"), "train"))
    path = f"{folder.rstrip('/')}/{W.BASELINE_PREDICTIONS_NAME}"
    W.write_delimited(W.submission(L.predict_logistic(fitted, embed(test.select("sentence_id", "sentence")))), path)
    return {"predictions": path, **evaluate_files(spark, path, test_path)}


def evaluate_files(spark: SparkSession, pred_path: str, gold_path: str) -> dict[str, DataFrame]:
    """Check a prediction file against a gold file, then score it."""
    pred = R.read_unquoted(spark, pred_path, R.PREDICTIONS)
    gold = R.read_unquoted(spark, gold_path)
    merged = E.validated_merge(pred, gold)
    scores = E.evaluate_cells(C.confusion(merged))
    return {"scores": scores, "line": E.score_line(scores)}
