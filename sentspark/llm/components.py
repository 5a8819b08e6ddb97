"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sentspark.llm.scratch import Scratch


def _towards_least(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b), a < b. Large: every greater neighbour of a node
    is tied to the least of its neighbourhood; small: the node and its lesser ones. Both
    sides of the joins are dealt by the node already, so nothing is broadcast: over many
    steps that would pile up on the executors."""
    seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    back = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        ties = seen.unionByName(back)
        least = ties.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        new = ties.join(least.hint("merge"), "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        least = back.groupBy("u").agg(F.min("v").alias("m"))
        new = back.join(least.hint("merge"), "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(
            least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return new.where("a < b").distinct()


def connected_components(links: DataFrame, tmp: Scratch) -> DataFrame:
    """doc_id and component_id (least node of the component) of every node that has a
    link. ``links`` has columns a and b; order and repetition don't matter. The number
    of steps grows with the logarithm of the longest chain; minima are combined before
    the shuffle, so a hub doesn't gather its neighbours in one row."""
    edges = tmp.table(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    before = None
    while True:
        edges = tmp.table(_towards_least(_towards_least(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("doc_id"), F.col("a").alias("component_id")).unionByName(
                edges.select(F.col("a").alias("doc_id"), F.col("a").alias("component_id")).distinct())
        before = now
