"""Confusion counts and every score derived from them.

One grouped scan of the rows, ``confusion``, feeds all scores; what follows it
works on a table of (classes x classes) rows. Scores that are undefined (a zero
denominator) are NULL until the very end, where ``zero_rule`` says what they are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sentspark.functions.labels import decode

ZERO, NAN = "zero", "nan"


def confusion(df: DataFrame, gold: str = "gold_label", pred: str = "pred_label",
              by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by..., gold, pred, n)."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(*by, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(n.alias("n"))


def class_counts(df: DataFrame, column: str) -> DataFrame:
    """(column, n): rows per class, keyed rather than positional."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def num_classes(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, NULL counting as one."""
    missing = F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))
    return df.agg((F.count_distinct(column) + missing).cast("bigint").alias("num_classes"))


def cell_totals(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., category, tp, support, predicted), a row for each class that occurs
    in gold or predictions."""
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("gold").eqNullSafe(F.col("pred")), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("gold").alias("category"), hit.alias("tp"), F.col("n").alias("support"), zero.alias("predicted")),
        F.struct(F.col("pred").alias("category"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")),
    )
    return (
        cells.select(*by, F.inline(sides))
        .groupBy(*by, "category")
        .agg(*[F.sum(c).cast("bigint").alias(c) for c in ("tp", "support", "predicted")])
    )


def fixed_classes(totals: DataFrame, classes: Sequence) -> DataFrame:
    """Exactly the given classes, absent ones with zero counts."""
    kind = totals.schema["category"].dataType
    listed = F.array(*[F.lit(c).cast(kind) for c in classes])
    wanted = totals.sparkSession.range(0, 1, 1, 1).select(F.explode(listed).alias("category"))
    joined = F.broadcast(wanted).join(totals, "category", "left")
    return joined.select("category", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "support", "predicted")])


def precision_recall_f1(totals: DataFrame) -> DataFrame:
    """Adds precision, recall and f1, NULL where undefined."""
    tp = F.col("tp")
    return totals.withColumns({
        "precision": F.try_divide(tp, F.col("predicted")),
        "recall": F.try_divide(tp, F.col("support")),
        "f1": F.try_divide(2 * tp, F.col("support") + F.col("predicted")),
    })


def settle(value: Column, zero_rule: str) -> Column:
    """Give an undefined score its final value."""
    if zero_rule not in (ZERO, NAN):
        raise ValueError("zero_rule must be 'zero' or 'nan'")
    return F.coalesce(value, F.lit(0.0 if zero_rule == ZERO else float("nan")))


def averages(scored: DataFrame, zero_rule: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., average, precision, recall, f1, support) with a macro and a weighted
    row. Under the zero rule an undefined score counts as 0, under the NaN rule it
    is left out, together with its weight."""
    def pick(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0)) if zero_rule == ZERO else F.col(name)

    def weighted(name: str) -> Column:
        present = F.when(pick(name).isNotNull(), F.col("support"))
        return F.try_divide(F.sum(pick(name) * F.col("support")), F.sum(present))

    names = ("precision", "recall", "f1")
    grouped = scored.groupBy(*by) if by else scored.groupBy()
    both = grouped.agg(
        F.array(
            F.struct(F.lit("macro avg").alias("average"), *[settle(F.avg(pick(n)), zero_rule).alias(n) for n in names]),
            F.struct(F.lit("weighted avg").alias("average"), *[settle(weighted(n), zero_rule).alias(n) for n in names]),
        ).alias("rows"),
        F.sum("support").alias("support"),
    )
    return both.select(*by, "support", F.inline("rows")).select(*by, "average", *names, "support")


def accuracy(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    hit = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    grouped = cells.groupBy(*by) if by else cells.groupBy()
    return grouped.agg(F.try_divide(F.sum(hit), F.sum("n")).alias("accuracy"))


def macro_f1(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean F1 over the classes that occur in gold or predictions."""
    scored = precision_recall_f1(cell_totals(cells, by))
    grouped = scored.groupBy(*by) if by else scored.groupBy()
    return grouped.agg(F.avg(F.coalesce("f1", F.lit(0.0))).alias("macro_f1"))


def f1_classwise(cells: DataFrame, num_classes: int) -> DataFrame:
    """F1 of the class codes 0..num_classes-1."""
    scored = precision_recall_f1(fixed_classes(cell_totals(cells), range(num_classes)))
    return scored.select("category", F.coalesce("f1", F.lit(0.0)).alias("f1"))


def f1_macro(cells: DataFrame, num_classes: int) -> DataFrame:
    """Mean over the fixed class codes, also those that never occur."""
    return f1_classwise(cells, num_classes).agg(F.avg("f1").alias("f1_macro"))


def class_count_table(cells: DataFrame) -> DataFrame:
    """Labels and predictions per gold class, with a ``Total obs`` row. A class seen
    only in the predictions has no row."""
    per_class = cell_totals(cells).where("support > 0").select(
        F.col("category").cast("string").alias("category"),
        F.col("support").alias("count-labels"), F.col("predicted").alias("count-predictions"),
    )
    everything = F.coalesce(F.sum("n"), F.lit(0)).cast("bigint")
    total = cells.agg(
        F.lit("Total obs").alias("category"),
        everything.alias("count-labels"), everything.alias("count-predictions"),
    )
    return per_class.unionByName(total)


def transposed_counts(cells: DataFrame, classes: Sequence[str]) -> DataFrame:
    """The same counts as two rows with one column per class. The class list is
    given, so the pivot costs no extra pass."""
    wide = class_count_table(cells).unpivot("category", ["count-labels", "count-predictions"], "side", "n")
    return wide.groupBy("side").pivot("category", [*classes, "Total obs"]).agg(F.sum("n"))


def class_report(cells: DataFrame, digits: int = 4, swap: bool = False, zero_rule: str = NAN,
                 names: Mapping[int, str] | None = None) -> DataFrame:
    """One row per class, then accuracy (repeated in all four score columns), macro
    and weighted averages, with the class counts joined on.

    ``swap`` exchanges gold and predictions; ``names`` gives class codes the names to
    be shown.
    """
    if swap:
        cells = cells.select(F.col("gold").alias("pred"), F.col("pred").alias("gold"), "n")
    if names:
        cells = cells.select(*[decode(F.col(c), names).alias(c) for c in ("gold", "pred")], "n")
    scored = precision_recall_f1(cell_totals(cells))
    scores = ("precision", "recall", "f1")
    per_class = scored.select(
        F.col("category").cast("string").alias("category"),
        *[settle(F.col(n), zero_rule).alias(n) for n in scores], F.col("support").cast("double").alias("support"),
    )
    hits = accuracy(cells).select(
        F.lit("accuracy").alias("category"), *[F.col("accuracy").alias(n) for n in (*scores, "support")]
    )
    means = averages(scored, zero_rule).select(
        F.col("average").alias("category"), *scores, F.col("support").cast("double").alias("support")
    )
    rows = reduce(DataFrame.unionByName, [per_class, hits, means])
    rounded = rows.select(
        "category",
        *[F.bround(F.col(n), digits).alias("f1-score" if n == "f1" else n) for n in (*scores, "support")],
    )
    # One row per class.
    return rounded.join(F.broadcast(class_count_table(cells)), "category", "left")


def report_cell(report: DataFrame, category: str, score: str = "f1-score") -> DataFrame:
    """One value of the report."""
    return report.where(F.col("category") == category).select(F.col(score))


def effective_weights(counts: DataFrame, key: str, beta: float = 0.9999) -> DataFrame:
    """(key, n, weight): weights inverse to the effective number of rows
    (1-beta^n)/(1-beta), scaled to sum to the number of classes."""
    raw = F.lit(1.0 - beta) / (1.0 - F.pow(F.lit(beta), F.col("n").cast("double")))
    everything = Window.partitionBy(F.lit(0))
    return counts.withColumn("raw", raw).select(
        key, "n", (F.col("raw") / F.sum("raw").over(everything) * F.count("raw").over(everything)).alias("weight")
    )


def balanced_weights(counts: DataFrame, key: str) -> DataFrame:
    """(key, n, weight): rows / (classes x rows of the class)."""
    everything = Window.partitionBy(F.lit(0))
    return counts.select(
        key, "n", (F.sum("n").over(everything) / (F.count("n").over(everything) * F.col("n"))).alias("weight")
    )


# Scores by name. Each is a function of the confusion cells and the group columns
# and gives (group columns..., score). Callers may pass their own.
METRICS: dict[str, Callable[[DataFrame, Sequence[str]], DataFrame]] = {"accuracy": accuracy, "macro_f1": macro_f1}


def class_f1(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., category, f1), 0 where undefined."""
    scored = precision_recall_f1(cell_totals(cells, by))
    return scored.select(*by, "category", F.coalesce("f1", F.lit(0.0)).alias("f1"))


def score_all(cells: DataFrame, metrics: dict[str, Callable] | Callable, by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """(by..., name, value) for every metric, rounded half to even. A bare function counts as
    ``{"metric": function}``."""
    named = metrics if isinstance(metrics, dict) else {"metric": metrics}
    parts = []
    for name, fn in named.items():
        value = fn(cells, by)
        parts.append(value.select(*by, F.lit(name).alias("name"), F.bround(F.col(value.columns[-1]), digits).alias("value")))
    return reduce(DataFrame.unionByName, parts)
