"""Exact summary statistics of counts: text lengths and token counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

# The statistics in output order and the quantiles among them.
STATISTICS = ("count", "null_count", "mean", "std", "min", "25%", "50%", "75%", "max")
QUANTILES = {"25%": 0.25, "50%": 0.5, "75%": 0.75}


def describe_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., statistic, value) for an integer column; quantiles are the value of
    nearest rank, std is the sample deviation.

    The rows are first reduced to a histogram with map-side combining, so what is
    sorted afterwards has one row per distinct value: its size depends on the
    longest text, not on the number of rows.
    """
    histogram = df.groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    known = F.when(F.col("v").isNotNull(), F.col("n"))
    ranked = histogram.select(
        *by, "v", "n",
        F.sum(known).over(group.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum(known).over(group).alias("total"),
        (F.sum(F.col("v").cast("double") * F.col("n")).over(group) / F.sum(known).over(group)).alias("mean"),
    )
    n, total, gap = F.col("n"), F.col("total"), F.col("v") - F.col("mean")

    def at_rank(q: float):
        index = F.floor((total - 1) * F.lit(q) + 0.5)
        inside = (F.col("upto") > index) & (F.col("upto") - n <= index) & F.col("v").isNotNull()
        return F.max(F.when(inside, F.col("v")))

    count = F.coalesce(F.max("total"), F.lit(0))
    columns = {
        "count": count,
        "null_count": F.coalesce(F.sum(F.when(F.col("v").isNull(), n)), F.lit(0)),
        "mean": F.max("mean"),
        "std": F.sqrt(F.try_divide(F.sum(n * gap * gap), F.nullif(count - 1, F.lit(0)))),
        "min": F.min("v"),
        **{name: at_rank(q) for name, q in QUANTILES.items()},
        "max": F.max("v"),
    }
    grouped = ranked.groupBy(*by) if by else ranked.groupBy()
    wide = grouped.agg(*[columns[s].cast("double").alias(s) for s in STATISTICS])
    return wide.unpivot([*by], list(STATISTICS), "statistic", "value")


def describe_lengths(df: DataFrame, text: str = "sentence", by: Sequence[str] = ()) -> DataFrame:
    """Profile of the text lengths in characters (code points)."""
    return describe_counts(df.select(*by, F.length(text).alias("length")), "length", by)
