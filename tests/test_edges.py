"""Inputs that earlier versions got wrong."""

import numpy as np
import pytest

from sentspark.operators import counts as C, evaluation as E, forest as A, neighbours as N, sampling as S
from sentspark.plans import binding as B
from sentspark.sources import sinks


def labelled(spark, rows):
    return spark.createDataFrame(rows, "sentence_id string, label string")


def test_split_keeps_null_ids(spark):
    df = spark.createDataFrame([(None if i % 10 == 0 else str(i), i) for i in range(100)], "sentence_id string, x int")
    train, val = S.train_val_split(df, 0.8, 42)
    assert (train.count(), val.count()) == (80, 20)
    assert train.unionByName(val).agg({"x": "sum"}).first()[0] == 4950


def test_score_line_tabs_and_ties(spark):
    scores = spark.createDataFrame([(0.625, 0.125, 0.375, 0.155, 0.145, 1.0, 0.0)], list(E.SCORES))
    line = E.score_line(scores).first()[0]
    assert line == ("macro_F1:\t0.62\t\tmacro_P:\t\t0.12\t\tmacro_R:\t\t0.38\t\tSUBJ_F1:\t%.2f\t\tSUBJ_P:\t\t%.2f\t\tSUBJ_R:\t\t1.00\t\t"
                    "accuracy:\t0.00") % (0.155, 0.145)


def test_third_gold_label(spark):
    pred = labelled(spark, [("1", "SUBJ"), ("2", "OBJ"), ("3", "OBJ")])
    gold = labelled(spark, [("1", "SUBJ"), ("2", "OBJ"), ("3", "OTHER")])
    row = E.evaluate(pred, gold).first()
    assert abs(row["accuracy"] - 2 / 3) < 1e-12
    assert abs(row["macro_F1"] - (1 + 2 / 3 + 0) / 3) < 1e-12


def test_null_ids_match(spark):
    pred, gold = labelled(spark, [(None, "SUBJ"), ("2", "OBJ")]), labelled(spark, [(None, "SUBJ"), ("2", "OBJ")])
    assert all(r["ok"] for r in E.validate(pred, gold).collect())
    assert E.merge(pred, gold).count() == 2
    assert E.id_mismatch(pred, gold.where("sentence_id IS NOT NULL")).collect() == [(None, "pred only")]


def test_num_classes_of_nothing(spark):
    assert C.num_classes(labelled(spark, []), "label").first()[0] == 0


def test_half_to_even(spark):
    cells = spark.createDataFrame([("a", "a", 9), ("a", "b", 23)], "gold string, pred string, n long")
    assert C.score_all(cells, {"accuracy": C.accuracy}).first()["value"] == 0.2812


def test_neighbours_of_vectors_with_a_large_common_part(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(scale=1e-3, size=(400, 8)).astype(np.float32)
    x[:, 0] = 1e5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r["i"], r["rank"]): r["j"] for r in N.knn_graph(df, 5, pivots=7).collect()}
    exact = ((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(-1)
    for i in range(400):
        order = sorted((exact[i, j], j) for j in range(400) if j != i)[:5]
        assert [got[i, r + 1] for r in range(5)] == [j for _, j in order]


@pytest.mark.parametrize("group", [50_000, 500, 125, 32])
def test_approximate_neighbours_find_most(spark, group):
    """Recall against brute force on all vectors with the default passes and rounds, for
    one cell and for 4, 16 and 64."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    norm = (x * x).sum(axis=1)
    gaps = norm[:, None] + norm[None] - 2 * x @ x.T
    np.fill_diagonal(gaps, np.inf)
    limit = dict(zip(ids.tolist(), np.sqrt(np.sort(gaps, axis=1)[:, 9])))
    got = A.knn_approx(df, 10, group=group).collect()
    assert len(got) == 10 * len(x)
    hits = sum(r["distance"] <= limit[r["i"]] + 1e-6 for r in got)
    assert hits >= (1.0 if group == 50_000 else 0.9) * len(got)


def test_approximate_neighbours_of_copies(spark):
    rows = [(i, [float(i // 50), 0.0]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = A.knn_approx(df, 5).collect()
    assert len(got) == 750 and all(r["distance"] == 0 and r["i"] // 50 == r["j"] // 50 for r in got)
    assert A.knn_approx(df.where("false"), 5).count() == 0


def test_half_written_cache_is_computed_again(spark, tmp_path):
    path = str(tmp_path / "cache")
    spark.range(3).write.parquet(path)
    (tmp_path / "cache" / "_SUCCESS").unlink()
    assert sinks.load_or_compute(spark, path, lambda: spark.range(10)).count() == 10
    assert sinks.load_or_compute(spark, path, lambda: spark.range(20)).count() == 10
