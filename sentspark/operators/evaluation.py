"""Checks and scores of a prediction table against a gold table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sentspark.functions.labels import LABELS, SUBJECTIVE
from sentspark.operators import counts as C
from sentspark.operators.skew import skew_join

# The score names in output order.
SCORES = ("macro_F1", "macro_P", "macro_R", "SUBJ_F1", "SUBJ_P", "SUBJ_R", "accuracy")
# The names followed by two tabs.
WIDE = ("macro_P", "macro_R", "SUBJ_P", "SUBJ_R")
# The checks, in the order they are made.
CHECKS = ("row counts", "columns", "label values", "ids", "gold labels")


def _both_sides(pred: DataFrame, gold: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The rows of both tables below each other: sentence_id, label, the group columns
    of ``gold``, and whether a row is a prediction. Grouping by id then takes the place
    of a join: NULL is an id like any other, and rows are counted before they move."""
    types = {f.name: f.dataType for f in gold.schema}
    p = pred.select("sentence_id", "label", *[F.lit(None).cast(types[c]).alias(c) for c in by], F.lit(True).alias("predicted"))
    return p.unionByName(gold.select(F.col("sentence_id"), "label", *by, F.lit(False).alias("predicted")))


def matched_cells(pred: DataFrame, gold: DataFrame, classes: Sequence[str] | None = LABELS, by: Sequence[str] = ()) -> DataFrame:
    """Confusion cells, per group of ``gold`` if asked, of the inner join on
    ``sentence_id`` without building it.

    Both sides are counted per id and label, so a repeated id, however hot, is one row
    per label before anything is shuffled, and the cell of a many-to-many match is the
    product of the two counts. What then meets at an id is bounded by the number of
    labels and groups. NULL ids match each other. With ``classes`` given, a predicted
    label outside the list fails the query; gold labels may be others.
    """
    p = pred if classes is None else pred.withColumn("label", _known(classes))
    counted = _both_sides(p, gold, by).groupBy("sentence_id", "predicted", *by, "label").agg(F.count(F.lit(1)).alias("n"))
    predicted = F.struct(F.col("label").alias("pred"), F.col("n").alias("np"))
    real = F.struct(*by, F.col("label").alias("gold"), F.col("n").alias("ng"))
    met = counted.groupBy("sentence_id").agg(
        F.collect_list(F.when(F.col("predicted"), predicted)).alias("p"), F.collect_list(F.when(~F.col("predicted"), real)).alias("g"))
    pairs = met.where((F.size("p") > 0) & (F.size("g") > 0)).select(F.explode("p").alias("p"), "g").select("p.*", F.explode("g").alias("g"))
    return pairs.select("g.*", "pred", "np").groupBy(*by, "gold", "pred").agg(F.sum(F.col("np") * F.col("ng")).alias("n"))


def _known(classes: Sequence[str]) -> Column:
    known = F.coalesce(F.col("label").isin(*classes), F.lit(False))
    return F.when(known, F.col("label")).otherwise(F.raise_error(F.lit("label outside the class list")))


def evaluate_cells(cells: DataFrame, by: Sequence[str] = (), positive: str = SUBJECTIVE) -> DataFrame:
    """The seven scores, undefined ones 0."""
    scored = C.precision_recall_f1(C.cell_totals(cells, by))
    zero = F.lit(0.0)
    macro = {
        f"macro_{short}": F.avg(F.coalesce(F.col(name), zero))
        for short, name in (("F1", "f1"), ("P", "precision"), ("R", "recall"))
    }
    single = {
        f"{positive}_{short}": F.coalesce(F.max(F.when(F.col("category") == positive, F.col(name))), zero)
        for short, name in (("F1", "f1"), ("P", "precision"), ("R", "recall"))
    }
    hits = {"accuracy": F.try_divide(F.sum("tp"), F.sum("support"))}
    grouped = scored.groupBy(*by) if by else scored.groupBy()
    return grouped.agg(*[expr.alias(name) for name, expr in {**macro, **single, **hits}.items()])


def evaluate(pred: DataFrame, gold: DataFrame, classes: Sequence[str] | None = LABELS) -> DataFrame:
    return evaluate_cells(matched_cells(pred, gold, classes))


def evaluate_by(pred: DataFrame, gold: DataFrame, by: Sequence[str]) -> DataFrame:
    """The seven scores per group, the group columns coming from ``gold``."""
    return evaluate_cells(matched_cells(pred, gold, None, by), by)


def score_line(scores: DataFrame) -> DataFrame:
    """The scores as one line, two decimals each; ties are decided by the exact binary
    value and then half to even, as ``format_number`` does."""
    shown = [F.concat(F.lit(f"{name}:" + "\t" * (1 + (name in WIDE))), F.coalesce(F.format_number(F.col(name), 2), F.lit("nan"))) for name in SCORES]
    return scores.select(F.concat_ws("\t\t", *shown).alias("line"))


def validation_counts(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """One row with all numbers the checks need, from both sides counted per id in one
    shuffle."""
    label = F.col("label") if "label" in pred.columns else F.lit(None).cast("string")
    rows = _both_sides(pred.select("sentence_id", label.cast("string").alias("label")), gold.select("sentence_id", F.lit(None).cast("string").alias("label")))
    at = rows.groupBy("sentence_id").agg(
        F.count_if("predicted").alias("np"), F.count_if(~F.col("predicted")).alias("ng"),
        *[F.count_if(F.col("predicted") & (F.col("label") == c)).alias(f"n_{c}") for c in LABELS])
    return at.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(name)
          for c, name in (("np", "n_pred"), ("ng", "n_gold"), *[(f"n_{c}", f"n_{c}") for c in LABELS])],
        F.coalesce(F.sum(F.col("np") * F.col("ng")), F.lit(0)).alias("n_joined"),
        F.count_if(F.col("ng") == 0).alias("ids_only_pred"),
        F.count_if(F.col("np") == 0).alias("ids_only_gold"),
    )


def validate(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(step, check, ok, detail, first_failure): the five checks in order. Table
    columns are checked on the schemas; a check that cannot be made for lack of a
    column counts as failed."""
    has_pred = {"label", "sentence_id"} <= set(pred.columns)
    has_gold = "sentence_id" in gold.columns
    if not (has_pred and has_gold):
        one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
        numbers = (
            pred.select(one.alias("p"), none.alias("g")).union(gold.select(none, one))
            .agg(*[F.coalesce(F.sum(c), none).alias(name) for c, name in (("p", "n_pred"), ("g", "n_gold"))])
        )
        no = F.lit(False)
        verdicts = [
            (F.col("n_pred") == F.col("n_gold"), _pair("n_pred", "n_gold")),
            (no, F.lit("sentence_id or label is missing")), (no, F.lit("not checked")), (no, F.lit("not checked")),
            (F.lit("label" in gold.columns), F.lit("not checked")),
        ]
    else:
        numbers = validation_counts(pred, gold)
        known = sum((F.col(f"n_{c}") for c in LABELS), F.lit(0))
        verdicts = [
            (F.col("n_pred") == F.col("n_gold"), _pair("n_pred", "n_gold")),
            (F.lit(True), F.lit("sentence_id, label")),
            ((known > 0) & (known == F.col("n_pred")), _pair(*[f"n_{c}" for c in LABELS])),
            (F.col("n_joined") == F.col("n_pred"), _pair("n_joined", "ids_only_pred", "ids_only_gold")),
            (F.lit("label" in gold.columns), F.lit("label in gold")),
        ]
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("check"), ok.alias("ok"), detail.alias("detail"))
        for i, (name, (ok, detail)) in enumerate(zip(CHECKS, verdicts))
    ])
    failed = F.get(F.filter("rows", lambda r: ~r["ok"]), F.lit(0))["step"]
    return (
        numbers.select(rows.alias("rows"))
        .select(failed.alias("failed"), F.inline("rows"))
        .select("step", "check", "ok", "detail", F.coalesce(F.col("step") == F.col("failed"), F.lit(False)).alias("first_failure"))
    )


def _pair(*names: str):
    return F.concat_ws(", ", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in names])


def merge(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Inner join on ``sentence_id`` with both labels renamed; other columns the two
    share get the suffixes _x and _y. NULL ids match each other."""
    shared = (set(pred.columns) & set(gold.columns)) - {"sentence_id", "label"}

    def renamed(df: DataFrame, label: str, suffix: str) -> DataFrame:
        names = {"label": label, **{c: c + suffix for c in shared}}
        id_text = F.col("sentence_id").cast("string")
        key = F.coalesce(F.concat(F.lit("="), id_text), F.lit(""))
        return df.select(key.alias("_id"), *[F.col(c).alias(names.get(c, c)) for c in df.columns])

    left, right = renamed(pred, "pred_label", "_x"), renamed(gold, "gold_label", "_y").drop("sentence_id")
    return skew_join(left, right, "_id").drop("_id")


def validated_merge(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Run the checks now and return the joined table, or fail naming the check."""
    failed = validate(pred, gold).where("first_failure").collect()
    if failed:
        raise ValueError(f"{failed[0]['check']}: {failed[0]['detail']}")
    return merge(pred, gold)


def id_mismatch(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(sentence_id, side): the ids that occur on one side only; one shuffle."""
    none = F.lit(None).cast("string").alias("label")
    at = _both_sides(pred.select("sentence_id", none), gold.select("sentence_id", none)).groupBy("sentence_id").agg(
        F.bool_or("predicted").alias("in_pred"), F.bool_and("predicted").alias("only_pred"))
    return at.where(F.col("only_pred") | ~F.col("in_pred")).select("sentence_id", F.when(F.col("only_pred"), "pred only").otherwise("gold only").alias("side"))


def join_scores(df: DataFrame, scores: DataFrame) -> DataFrame:
    """Attach scores by id, never by row position."""
    return skew_join(df, scores, "sentence_id")


def legend(df: DataFrame, code: str, name: str) -> DataFrame:
    """Distinct (code, name) pairs."""
    return df.select(code, name).distinct()
