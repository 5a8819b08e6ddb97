"""Scores that confusion counts can't give, as states that Spark merges.

A metric is a set of aggregates (update and merge, done by Spark in partial sums) and an
expression over them (finish). Any number of metrics share one pass over the rows, with
or without groups. Rank scores need the order of all rows and take one range shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from sentspark.scratch import scratch
from sentspark.session import materialize


@dataclass(frozen=True)
class RowMetric:
    """``state`` names the aggregates over the rows, ``finish`` gives the score from
    their columns."""

    state: Mapping[str, Column]
    finish: Callable[[Mapping[str, Column]], Column]


def mean_of(value: Column) -> RowMetric:
    """Mean over the rows; NULL without rows."""
    return RowMetric({"sum": F.sum(value), "rows": F.count(value)}, lambda s: F.try_divide(s["sum"], s["rows"]))


def log_loss(p: Column, code: Column) -> RowMetric:
    """Mean negative log probability of the true class."""
    return mean_of(-F.log(F.get(p, code)))


def brier(p: Column, code: Column) -> RowMetric:
    """Mean squared distance of the probabilities from the true class."""
    miss = F.aggregate(F.transform(p, lambda x, i: (x - (i == code).cast("double")) * (x - (i == code).cast("double"))), F.lit(0.0), lambda a, x: a + x)
    return mean_of(miss)


def correlation(x: Column, y: Column) -> RowMetric:
    """Correlation of two columns from five sums."""
    def finish(s: Mapping[str, Column]) -> Column:
        return F.try_divide(s["n"] * s["xy"] - s["x"] * s["y"],
                            F.sqrt(s["n"] * s["xx"] - s["x"] * s["x"]) * F.sqrt(s["n"] * s["yy"] - s["y"] * s["y"]))

    return RowMetric({"n": F.count(x + y), "x": F.sum(x), "y": F.sum(y), "xx": F.sum(x * x), "yy": F.sum(y * y), "xy": F.sum(x * y)}, finish)


def states(metrics: Mapping[str, RowMetric]) -> list[Column]:
    """The aggregates of all metrics under names of their own."""
    return [value.alias(f"{name}__{part}") for name, metric in metrics.items() for part, value in metric.state.items()]


def finished(metrics: Mapping[str, RowMetric]) -> list[Column]:
    return [metric.finish({part: F.col(f"{name}__{part}") for part in metric.state}).alias(name) for name, metric in metrics.items()]


def score_rows(df: DataFrame, metrics: Mapping[str, RowMetric], by: Sequence[str] = ()) -> DataFrame:
    """One row per group with all scores, from one pass."""
    grouped = df.groupBy(*by) if by else df.groupBy()
    return grouped.agg(*states(metrics)).select(*by, *finished(metrics))


def rank_auc(df: DataFrame, score: Column, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, positives, negatives, auc) per group: the chance that a positive row scores
    above a negative one, ties counting half; NULL if there is none of either. Rows with
    a NULL score are passed over.

    Equal scores are one row before anything is sorted. The different ones are sorted by
    ranges; what lies below a range comes from one row per range and group, so no window
    spans more than a range of a group.
    """
    told = df.select(*by, score.cast("double").alias("_score"), positive.cast("long").alias("_positive")).where("_score IS NOT NULL")
    counts = told.groupBy(*by, "_score").agg(F.sum("_positive").alias("_p"), F.sum(1 - F.col("_positive")).alias("_n"))
    with scratch(df.sparkSession, "auc") as tmp:
        order = [F.col(c) for c in by] + [F.col("_score")]
        ranged = tmp.table(counts.repartitionByRange(*order).select("*", F.spark_partition_id().alias("_range")))
        below_range = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranged.groupBy(*by, "_range").agg(F.sum("_n").alias("_in_range"))
        ranges = ranges.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_of"), F.coalesce(F.sum("_in_range").over(below_range), F.lit(0)).alias("_before"))
        same = F.col("_range") == F.col("_of")
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        within = Window.partitionBy(*by, "_range").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
        placed = ranged.join(ranges, same).withColumn("_below", F.col("_before") + F.coalesce(F.sum("_n").over(within), F.lit(0)))
        won = F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2))
        grouped = placed.groupBy(*by) if by else placed.groupBy()
        out = grouped.agg(F.coalesce(F.sum("_p"), F.lit(0)).alias("positives"), F.coalesce(F.sum("_n"), F.lit(0)).alias("negatives"), won.alias("_won"))
        return materialize(out.select(*by, "positives", "negatives", F.try_divide("_won", F.col("positives") * F.col("negatives")).alias("auc")), "auc")
