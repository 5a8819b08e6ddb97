"""Weighted graph and pair sets that the 2-D layouts are fitted to.

Rows are addressed by a dense index 0..n-1 in seeded order (``index_rows``), so a
random partner is an index drawn by hash, found again by an equi-join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sentspark.operators.neighbours import _matrix
from sentspark.operators.sampling import rank_rows, shuffle_key
from sentspark.operators.skew import skew_join
from sentspark.session import materialize

# Extra neighbours searched before rescaling, neighbour ranks that
# set a row's scale, candidates per mid-near pick, and the rank picked of them.
EXTRA_NEIGHBOURS = 50
SCALE_RANKS = (4, 6)
MID_NEAR_CANDIDATES = 6
MID_NEAR_PICK = 2
STRETCH, AT_ONCE = 4096, 256    # indices whose rows are compared in one task, and rows at a time


def index_rows(df: DataFrame, id_column: str, vector: str, seed: int) -> DataFrame:
    """(idx, id, vec), written once because every later step reads it."""
    narrow = df.select(F.col(id_column).alias("id"), F.col(vector).cast("array<float>").alias("vec"))
    return materialize(rank_rows(narrow, shuffle_key("id", seed), F.col("id"), name="idx"), "indexed")


@F.pandas_udf(T.StructType([T.StructField("rho", T.DoubleType()), T.StructField("sigma", T.DoubleType())]))
def _local_scale(distances: pd.Series) -> pd.DataFrame:
    """Nearest positive distance rho, and the sigma at which the memberships
    exp(-(d-rho)/sigma) sum to log2 of the neighbour count."""
    counts = distances.map(len).to_numpy()
    table = np.full((len(counts), counts.max(initial=1)), np.inf)
    for row, values in enumerate(distances):
        table[row, :counts[row]] = values
    positive = np.where(table > 0, table, np.inf).min(axis=1)
    rho = np.where(np.isfinite(positive), positive, 0.0)
    beyond = np.maximum(table - rho[:, None], 0.0)
    target = np.log2(np.maximum(counts, 2))
    low, high = np.zeros(len(counts)), np.full(len(counts), np.inf)
    sigma = np.ones(len(counts))
    for _ in range(64):
        over = np.exp(-beyond / sigma[:, None]).sum(axis=1) > target
        high, low = np.where(over, sigma, high), np.where(over, low, sigma)
        sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
    known = np.where(np.isfinite(table), table, 0.0).sum(axis=1) / np.maximum(counts, 1)
    return pd.DataFrame({"rho": rho, "sigma": np.maximum(sigma, 1e-3 * known)})


def membership_edges(knn: DataFrame) -> DataFrame:
    """(i, j, weight): directed membership strengths of the neighbours."""
    near = F.sort_array(F.collect_list(F.struct("distance", "j")))   # k entries per row
    scaled = knn.groupBy("i").agg(near.alias("near")).withColumn("scale", _local_scale(F.col("near.distance")))
    gap = F.greatest(F.col("edge.distance") - F.col("scale.rho"), F.lit(0.0))
    return scaled.select("i", "scale", F.explode("near").alias("edge")).select(
        "i", F.col("edge.j").alias("j"), F.exp(-gap / F.col("scale.sigma")).alias("weight")
    )


def fuzzy_union(edges: DataFrame) -> DataFrame:
    """(i, j, weight), both directions, with the weights a and b of the two directed
    edges united as a + b - ab. One shuffle on the unordered pair, no self-join."""
    def side(forward: bool) -> Column:
        chosen = F.col("i") < F.col("j") if forward else F.col("i") > F.col("j")
        return F.coalesce(F.max(F.when(chosen, F.col("weight"))), F.lit(0.0))

    pairs = edges.groupBy(F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).agg(
        side(True).alias("a"), side(False).alias("b")
    )
    weight = (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("weight")
    both = F.array(
        F.struct(F.col("lo").alias("i"), F.col("hi").alias("j")), F.struct(F.col("hi").alias("i"), F.col("lo").alias("j"))
    )
    return pairs.select(F.inline(both), weight)


def umap_graph(knn: DataFrame) -> DataFrame:
    return fuzzy_union(membership_edges(knn))


def near_pairs(knn: DataFrame, k: int) -> DataFrame:
    """(i, j): of the given neighbours the k with the smallest distance after
    dividing its square by the local scales of both ends."""
    low, high = SCALE_RANKS
    knn = materialize(knn, "knn")       # read three times, searched once
    local = F.coalesce(F.avg(F.when(F.col("rank").between(low, high), F.col("distance"))), F.avg("distance"))
    scales = knn.groupBy(F.col("i").alias("j")).agg(F.greatest(local, F.lit(1e-10)).alias("scale"))
    both = skew_join(knn.select("i", "j", "distance"), scales, "j", salted_on="i")
    # The scale of i is the same for all its pairs and so does not change their order.
    order = Window.partitionBy("i").orderBy(F.col("distance") * F.col("distance") / F.col("scale"), "j")
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("i", "j")


def _window_start(n: int, seed: int, purpose: str) -> Column:
    """Where a row's run of consecutive indices begins, by hash. The index order is itself
    random, so the run is a sample."""
    return F.pmod(F.xxhash64("idx", F.lit(seed), F.lit(purpose)), F.lit(n))


def mid_near_pairs(indexed: DataFrame, n: int, picks: int, seed: int) -> DataFrame:
    """(i, j): ``picks`` times per row, six other rows are drawn and the second
    nearest of them kept. Rows go to the stretch of indices in which their run begins,
    instead of vectors to each draw."""
    width = MID_NEAR_CANDIDATES + 1   # one to spare, in case the row draws itself
    length = min(picks * width, n)
    if length == 0:
        return indexed.select(F.col("idx").alias("i"), F.col("idx").alias("j")).where("false")
    start = _window_start(n, seed, "mid-near")
    guests = indexed.select((start / STRETCH).cast("bigint").alias("stretch"), "idx", start.alias("start"), "vec")
    # A stretch has all rows that a run beginning in it reaches, also beyond the last index.
    reached = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda s: (F.pmod(F.col("idx") - s, F.lit(n)) / STRETCH).cast("bigint"))
    # Fresh aliases: both sides stem from the same table.
    members = indexed.select(F.explode(F.array_distinct(reached)).alias("stretch"), F.col("idx").alias("j"), F.col("vec").alias("other"))

    def pick(guests: pa.Table, members: pa.Table) -> pa.Table:
        members = members.sort_by("j")
        known, vectors = members["j"].to_numpy(), _matrix(members["other"]).T
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for at in range(0, guests.num_rows, AT_ONCE):
            these = guests.slice(at, AT_ONCE)
            i, own = these["idx"].to_numpy(), _matrix(these["vec"]).T
            for first in range(0, length, width):
                j = (these["start"].to_numpy()[:, None] + np.arange(first, min(first + width, length))) % n
                gap = vectors[:, np.searchsorted(known, j)] - own[:, :, None]
                distance = np.sqrt((gap * gap).sum(axis=0))
                other = j != i[:, None]
                other &= np.cumsum(other, axis=1) <= MID_NEAR_CANDIDATES
                order = np.lexsort((j, distance, ~other))
                drawn = other.sum(axis=1)
                some = np.flatnonzero(drawn)
                out.append((i[some], j[some, order[some, np.minimum(MID_NEAR_PICK, drawn[some]) - 1]]))
        return pa.table({name: np.concatenate(c) for name, c in zip(("i", "j"), zip(*out))})

    return guests.groupBy("stretch").cogroup(members.groupBy("stretch")).applyInArrow(pick, "i bigint, j bigint")


def far_pairs(indexed: DataFrame, near: DataFrame, n: int, k: int, picks: int, seed: int) -> DataFrame:
    """(i, j): ``picks`` rows drawn at random that are neither the row itself nor one
    of its near pairs. The run drawn is longer by all it could lose, so the count
    is exact whenever enough other rows exist."""
    steps = F.sequence(F.lit(0), F.lit(max(1, min(picks + k + 1, n)) - 1))
    drawn = F.transform(steps, lambda s: F.pmod(F.col("start") + s, F.lit(n)).cast("bigint"))
    taken = near.groupBy(F.col("i").alias("idx")).agg(F.collect_list("j").alias("taken"))   # k entries per row
    rows = indexed.select("idx", _window_start(n, seed, "far").alias("start")).join(taken, "idx", "left")
    free = F.filter(drawn, lambda j: (j != F.col("idx")) & ~F.array_contains(F.coalesce("taken", F.array().cast("array<bigint>")), j))
    return rows.select(F.col("idx").alias("i"), F.explode(F.slice(free, 1, picks)).alias("j"))


def pacmap_pairs(indexed: DataFrame, knn: DataFrame, n: int, k: int = 10, mn_ratio: float = 0.5,
                 fp_ratio: float = 2.0, seed: int = 42) -> DataFrame:
    """(i, j, kind) with kind near, mid or far."""
    near = materialize(near_pairs(knn, k), "near")
    mid = mid_near_pairs(indexed, n, int(k * mn_ratio), seed)
    far = far_pairs(indexed, near, n, k, int(k * fp_ratio), seed)
    parts = [(near, "near"), (mid, "mid"), (far, "far")]
    tagged = [df.withColumn("kind", F.lit(kind)) for df, kind in parts]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
