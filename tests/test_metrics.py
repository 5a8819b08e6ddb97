import math

import pytest
from pyspark.sql import functions as F

from sentspark.operators import counts as C, evaluation as E


def pairs(spark, rows):
    return spark.createDataFrame(rows, "gold_label string, pred_label string")


def by_category(df):
    return {r["category"]: r for r in df.collect()}


def test_zero_rules_for_class_never_predicted(spark):
    cells = C.confusion(pairs(spark, [("A", "B"), ("B", "B"), ("B", "B")]))
    scored = C.precision_recall_f1(C.cell_totals(cells))
    got = by_category(scored)
    assert got["A"]["precision"] is None and got["A"]["recall"] == 0 and got["A"]["f1"] == 0
    zero, nan = ({r["average"]: r for r in C.averages(scored, rule).collect()} for rule in (C.ZERO, C.NAN))
    assert zero["macro avg"]["precision"] == pytest.approx(1 / 3)
    assert nan["macro avg"]["precision"] == pytest.approx(2 / 3)
    assert nan["weighted avg"]["precision"] == pytest.approx(2 / 3)


def test_report_of_class_only_predicted(spark):
    got = by_category(C.class_report(C.confusion(pairs(spark, [("A", "A"), ("A", "C"), ("B", "B")]))))
    assert math.isnan(got["C"]["recall"]) and got["C"]["count-labels"] is None
    assert got["accuracy"]["precision"] == got["accuracy"]["support"] == 0.6667
    assert got["macro avg"]["recall"] == 0.75
    assert "Total obs" not in got and got["A"]["count-predictions"] == 1


def test_report_by_code_names(spark):
    cells = spark.createDataFrame([(0, 1, 2), (1, 1, 2)], "gold int, pred int, n bigint")
    got = by_category(C.class_report(cells, zero_rule=C.ZERO, names={0: "OBJ", 1: "SUBJ"}))
    assert got["OBJ"]["precision"] == 0 and got["SUBJ"]["recall"] == 1 and got["macro avg"]["precision"] == 0.25


def test_micro_f1_is_accuracy(spark):
    cells = C.confusion(pairs(spark, [("A", "B"), ("B", "B"), ("C", "A"), ("C", "C")]))
    totals = C.cell_totals(cells).agg(F.sum("tp"), F.sum("support"), F.sum("predicted")).first()
    assert 2 * totals[0] / (totals[1] + totals[2]) == C.accuracy(cells).first()[0]


def test_weights(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 10000)], "k string, n bigint")
    rows = {r["k"]: r["weight"] for r in C.effective_weights(counts, "k").collect()}
    assert sum(rows.values()) == pytest.approx(2) and rows["a"] > 1.9
    one = spark.createDataFrame([("a", 7)], "k string, n bigint")
    assert C.effective_weights(one, "k").first()["weight"] == pytest.approx(1)
    assert C.balanced_weights(counts, "k").where("k = 'a'").first()["weight"] == pytest.approx(10001 / 2)


def tsv(spark, rows):
    return spark.createDataFrame(rows, "sentence_id string, label string")


@pytest.mark.parametrize("pred, gold, check", [
    ([("1", "OBJ")], [("1", "OBJ"), ("2", "OBJ")], "row counts"),
    ([("1", "BAD")], [("1", "OBJ")], "label values"),
    ([("1", None)], [("1", "OBJ")], "label values"),
    ([("1", "OBJ")], [("2", "OBJ")], "ids"),
    ([("1", "OBJ"), ("1", "SUBJ")], [("1", "OBJ"), ("1", "OBJ")], "ids"),
    ([], [], "label values"),
])
def test_validator_names_first_failure(spark, pred, gold, check):
    with pytest.raises(ValueError, match=check):
        E.validated_merge(tsv(spark, pred), tsv(spark, gold))


def test_validator_columns_and_success(spark):
    good = tsv(spark, [("1", "OBJ"), ("2", "OBJ")])
    with pytest.raises(ValueError, match="columns"):
        E.validated_merge(good.drop("label"), good)
    with pytest.raises(ValueError, match="gold labels"):
        E.validated_merge(good, good.drop("label"))
    merged = E.validated_merge(good.withColumn("x", F.lit(1)), good.withColumn("x", F.lit(2)))
    assert merged.columns == ["sentence_id", "pred_label", "x_x", "gold_label", "x_y"] and merged.count() == 2


def test_hot_ids_are_multiplied_not_joined(spark):
    """A third of both sides under one id: the cells are those of the full join."""
    ids = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
    p = spark.range(3000).select(ids.alias("sentence_id"), F.when(F.col("id") % 2 == 0, "SUBJ").otherwise("OBJ").alias("label"))
    g = spark.range(3000).select(ids.alias("sentence_id"), F.when(F.col("id") % 5 == 0, "SUBJ").otherwise("OBJ").alias("label"))
    full = {(r["gold"], r["pred"]): r["n"] for r in C.confusion(E.merge(p, g)).collect()}
    for classes in (("OBJ", "SUBJ"), None):
        assert {(r["gold"], r["pred"]): r["n"] for r in E.matched_cells(p, g, classes).collect()} == full


def test_user_metric(spark):
    cells = C.confusion(pairs(spark, [("A", "A"), ("A", "B")]))

    def rows(cells, by=()):
        return cells.groupBy(*by).agg(F.sum("n").cast("double").alias("rows"))

    assert C.score_all(cells, rows).collect()[0]["name"] == "metric"
    got = {r["name"]: r["value"] for r in C.score_all(cells, {**C.METRICS, "rows": rows}).collect()}
    assert got == {"accuracy": 0.5, "macro_f1": 0.3333, "rows": 2.0}


def test_empty_input(spark):
    cells = C.confusion(pairs(spark, []))
    assert C.accuracy(cells).first()[0] is None and C.macro_f1(cells).first()[0] is None


def test_rank_auc_with_ties_groups_and_gaps(spark):
    import random

    from sentspark.operators import row_metrics as RM

    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), None if rng.random() < 0.05 else float(rng.randrange(40)), rng.random() < 0.3) for _ in range(3000)]
    rows += [("only", 1.0, True), ("only", 2.0, True)]
    df = spark.createDataFrame(rows, "g string, s double, p boolean").repartition(7)
    got = {r["g"]: (r["positives"], r["negatives"], r["auc"]) for r in RM.rank_auc(df, F.col("s"), F.col("p"), ["g"]).collect()}
    for g in ("a", "b", None):
        pos, neg = ([s for h, s, p in rows if h == g and s is not None and p == want] for want in (True, False))
        auc = sum((x > y) + 0.5 * (x == y) for x in pos for y in neg) / (len(pos) * len(neg))
        assert got[g][:2] == (len(pos), len(neg)) and abs(got[g][2] - auc) < 1e-9
    assert got["only"] == (2, 0, None)
    whole = RM.rank_auc(df, F.col("s"), F.col("p")).first()
    assert 0.4 < whole["auc"] < 0.6
    assert RM.rank_auc(df.where("false"), F.col("s"), F.col("p")).first()["auc"] is None


def test_one_shuffle_for_the_checks(spark):
    """Exchanges in the plans: one for the id counts, two for the cells."""
    pred = spark.range(50).select(F.col("id").cast("string").alias("sentence_id"), F.lit("OBJ").alias("label"))

    def shuffles(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    assert shuffles(E.id_mismatch(pred, pred)) == 1
    assert shuffles(E.validation_counts(pred, pred)) == 1
    assert shuffles(E.matched_cells(pred, pred)) == 3       # two of rows, one of the few cells
