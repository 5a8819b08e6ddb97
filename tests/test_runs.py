import pytest
from pyspark.sql import functions as F

from sentspark.operators.sampling import train_val_split
from sentspark.plans import binding as B, runs
from sentspark.session import scratch_path
from sentspark.sources import readers as R, sinks as W


@pytest.fixture(scope="module")
def folder(spark, tables):
    """Three delimited splits of the labelled sentences."""
    root = scratch_path(spark, "run")
    rows = B.sentences(spark, tables).select(F.col("sentence_id").cast("string").alias("sentence_id"), "sentence", "label")
    train, rest = train_val_split(rows, 0.6, 1)
    val, test = train_val_split(rest, 0.5, 1)
    for name, df in {"train": train, "val": val, "test": test}.items():
        W.write_delimited(df, f"{root}/raw/{name}.tsv")
        flat = df.withColumn("sentence", F.regexp_replace("sentence", "\\s+", " "))
        W.write_unquoted(flat, f"{root}/flat/{name}.tsv")
    return root


def settings(folder, **train):
    return {
        "data": {"dir": folder, "train_en": "raw/train.tsv", "val_en": "raw/val.tsv", "test_en": "raw/test.tsv",
                 "fine_tuned_model_path": "models", "train_en_embedding": "embeddings"},
        "train": {"epochs": 2, "batch_size": 30, "learning_rate": 0.01, **train},
        "encoder_model": {"name": "hashed/words", "max_length": 32, "hidden_dim": 32, "mlp_dim": 8},
        "dim_red_model": {"name": "pca", "n_components": 2},
    }


def test_train_and_submit(spark, folder):
    first = runs.train_and_submit(spark, settings(folder, loss="focal"))
    assert first["submission"].endswith("task1_dev_mono_english.tsv") and 0 <= first["best_score"] <= 1
    written = R.read_delimited(spark, first["submission"], R.PREDICTIONS, "\t")
    test = R.read_delimited(spark, f"{folder}/raw/test.tsv", separator="\t", line_breaks=True)
    assert written.count() == test.count() == written.join(test, "sentence_id").count()
    logged = W.read_history(spark, first["history"])
    assert logged.where("epoch is null and metric = 'val/macro_f1'").first()["value"] == first["best_score"]
    assert {"val/macro_f1", "test/OBJ_class_f1"} <= {r["metric"] for r in logged.collect()}
    assert {r["split"] for r in first["token_profile"].collect()} == {"train", "val", "test"}
    again = runs.train_and_submit(spark, settings(folder, loss="focal"), test_has_labels=False, train_on=False)
    assert again["best_score"] is None and again["submission"].endswith("task1_test_mono_english.tsv")
    on = runs.train_and_submit(spark, settings(folder, loss="focal"))
    assert 0 <= on["best_score"] <= 1


def test_explore(spark, folder):
    got = runs.explore_embeddings(spark, settings(folder), bins=5)
    n = R.read_delimited(spark, f"{folder}/raw/train.tsv", separator="\t", line_breaks=True).count()
    assert got["layout"].columns == ["sentence_id", "Component 1", "Component 2", "label_encoded", "label"]
    assert got["layout"].count() == n == got["bins"].agg(F.sum("n")).first()[0]
    assert {(r[0], r[1]) for r in got["legend"].collect()} == {(0, "OBJ"), (1, "SUBJ")}


def test_baseline(spark, folder):
    got = runs.baseline(spark, f"{folder}/flat/train.tsv", f"{folder}/flat/test.tsv", f"{folder}/out")
    scores = got["scores"].first()
    assert 0 <= scores["macro_F1"] <= 1 and got["line"].first()[0].startswith("macro_F1:\t")
