"""Joins that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A key is hot when it owns more than one row in HOT_SHARE, so there are never
# more than HOT_SHARE hot keys: tables of them have a fixed size bound.
HOT_SHARE = 1000


def hot_keys(df: DataFrame, key: str, shares: int = HOT_SHARE) -> DataFrame:
    """(key, splits): the hot keys and into how many parts to cut each. One narrow
    scan with map-side combining; at most ``shares`` rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    return (
        counts.where(F.col("rows") * shares > total)
        .select(key, F.ceil(F.col("rows") * shares / total).cast("int").alias("splits"))
    )


def skew_join(left: DataFrame, right: DataFrame, key: str, salted_on: str | None = None) -> DataFrame:
    """Inner equi-join whose left side may hold hot keys. Their left rows are spread
    over ``splits`` salts and the matching right rows are repeated once per salt.

    ``salted_on`` is the column whose hash picks the salt; without it, all left
    columns are used.
    """
    hot = F.broadcast(hot_keys(left, key))
    spread = F.xxhash64(salted_on) if salted_on else F.xxhash64(*left.columns)
    split = F.coalesce("splits", F.lit(1))
    many = (
        left.join(hot, key, "left")
        .withColumn("salt", F.pmod(spread, split).cast("int")).drop("splits")
    )
    few = (
        right.join(hot, key, "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), split - 1))).drop("splits")
    )
    return many.join(few, [key, "salt"]).drop("salt")
