"""Exact k-nearest-neighbour graph without comparing all pairs.

1. Equal vectors are grouped first. Only distinct vectors are searched; a group
   of copies, however large, is one point, and its members get their
   neighbours by looking up the group.
2. Points are put into the cell of their nearest pivot, and cells that lie together
   into regions of at most REGION entries (a crowded cell is cut). The k nearest points
   of the own region bound how far the true neighbours can be.
3. A point visits another region only if the triangle inequality, applied to the
   pivot distances, allows something nearer than that bound in one of its cells; it
   goes there once. Within a region the same bounds leave out cells.
4. A region's visitors are cut into parts of at most VISITORS entries. A part gives back
   k rows per visitor at most, and only those within the visitor's bound.

How many cells are compared depends on how clustered the data are; the result
does not. What moves is each point once a region it visits, and each region once a part
of its visitors; both are large, so that even vectors without clusters move few times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sentspark.operators.skew import skew_join
from sentspark.session import materialize

REGION = 1 << 23    # entries of the vectors one task holds as members (32 MB)
VISITORS = 1 << 21  # entries of the vectors compared with them in one task
LEAST_VISITORS = 512
PARTS = 32          # parts of visitors that all rows are cut into, if none gets too large
CELL_ROWS = 1000
MAX_PIVOTS = 2048
TILE, STRETCH = 256, 4096   # visitors and members of one product of matrices
MOST_TASKS = 4000
PENDING = 1 << 20   # candidates kept before they are compared exactly

_FOUND = "i bigint, j bigint, distance double"


def knn_graph(df: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding",
              pivots: int | None = None, block: int | None = None) -> DataFrame:
    """(i, j, rank, distance): the k nearest other rows of each row in Euclidean
    distance, equal distances in id order; all of them if there are fewer than k.
    ``block`` limits the rows of a region and of a part of its visitors."""
    points = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("vec"))
    distinct = materialize(
        points.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "distinct"
    )
    facts = distinct.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max("copies"), F.lit(0)).alias("copies"), F.max(F.size("vec")).alias("width")
    ).first()
    found = _search(distinct, facts["n"], k, pivots, block, max(1, facts["width"] or 1))
    if facts["copies"] <= 1:
        return _ranked(found, k)
    return _expand_copies(points, distinct, found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """Keep the k nearest per row; Spark limits each group before the shuffle too."""
    order = Window.partitionBy("i").orderBy("distance", "j")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("i", "j", "rank", "distance")


class _Pivots:
    """Pivots, and the rings their members lie in."""

    def __init__(self, centres: np.ndarray) -> None:
        self.centres, self.between = centres, np.sqrt(_squared(centres, centres)[0])
        self.ring = np.full((len(centres), 2), np.nan)

    def bounds(self, rows: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower bounds on the distance to any member of a cell, and their slack: it lies
        in a ring around its pivot, and on its pivot's side of the bisecting plane.
        Pivots too close for their distance to be sure have no such side."""
        squared, error = _squared(rows, self.centres)
        gaps = np.sqrt(squared)
        at_own = gaps[np.arange(len(own)), own][:, None]
        sure = self.between[own] ** 2 > 1e6 * error
        plane = np.divide(squared - at_own ** 2, 2 * self.between[own], out=np.zeros_like(gaps), where=sure)
        nearest = np.maximum(np.maximum(gaps - self.ring[:, 1], self.ring[:, 0] - gaps), plane)
        return nearest, 4 * np.sqrt(error) + 1e-5 * np.abs(nearest)

    def open_cells(self, rows: np.ndarray, own: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether a row (by its own cell and limit) must look into a cell."""
        nearest, slack = self.bounds(rows, own)
        return (nearest <= limit[:, None] + slack) & ~np.isnan(self.ring[:, 0])


def _together(centres: np.ndarray, cells: np.ndarray) -> list[int]:
    """``cells`` in an order in which those that lie together follow each other: halves
    along the direction their pivots are spread in most, again and again."""
    if len(cells) <= 2:
        return [int(c) for c in cells]
    spread = centres[cells] - centres[cells].mean(axis=0)
    order = np.argsort(spread @ np.linalg.svd(spread, full_matrices=False)[2][0], kind="stable")
    half = len(cells) // 2
    return _together(centres, cells[order[:half]]) + _together(centres, cells[order[half:]])


def _regions(order: list[int], sizes: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """(cell, region, splits): a cell's members are in region, or in one of the
    ``splits`` regions from there on if they are more than one can hold."""
    plan, region, held = [], 0, 0
    for cell in order:
        splits = -(-sizes[cell] // most)
        if held and held + sizes[cell] > most:
            region, held = region + 1, 0
        plan.append((cell, region, splits))
        if splits > 1:
            region, held = region + splits, 0
        else:
            held += sizes[cell]
    return plan


def _search(distinct: DataFrame, n: int, k: int, pivots: int | None, block: int | None, width: int) -> DataFrame:
    """k nearest among distinct vectors."""
    spark = distinct.sparkSession
    wanted = pivots or min(MAX_PIVOTS, -(-n // CELL_ROWS))
    chosen = distinct.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(max(1, wanted)).collect()
    if not chosen:
        return spark.createDataFrame([], _FOUND)
    centres = np.asarray([row["vec"] for row in chosen], dtype="float64")
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            gaps = np.sqrt(_squared(_matrix(batch["vec"]), shared.value)[0])
            cell = gaps.argmin(axis=1)
            radius = gaps[np.arange(len(cell)), cell]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["vec"], pa.array(cell, pa.int64()), pa.array(radius)], ["id", "vec", "cell", "radius"]
            )

    located = materialize(
        distinct.select("id", "vec").mapInArrow(assign, "id bigint, vec array<float>, cell bigint, radius double"), "cells"
    )
    cells = located.groupBy("cell").agg(
        F.count(F.lit(1)).alias("members"), F.min("radius").alias("inner"), F.max("radius").alias("outer")
    ).collect()
    table = _Pivots(centres)
    for row in cells:
        table.ring[row["cell"]] = row["inner"], row["outer"]
    limits = spark.sparkContext.broadcast(table)
    sizes = {row["cell"]: row["members"] for row in cells}
    most = block or max(1, REGION // width)
    part = block or max(1, min(VISITORS // width, max(LEAST_VISITORS, -(-n // PARTS))))
    plan = _regions(_together(centres, np.array(sorted(sizes))), sizes, most)
    # One row per cell, at most MAX_PIVOTS of them.
    where = F.broadcast(spark.createDataFrame(plan, "cell bigint, region bigint, splits bigint"))
    members = located.select("id", "vec", "cell").join(where, "cell").select(
        "id", "vec", "cell", (F.col("region") + F.pmod(F.xxhash64("id", F.lit(0)), "splits")).alias("region"))
    n_members = {}
    for row in members.groupBy("region").agg(F.count(F.lit(1)).alias("n")).collect():
        n_members[row["region"]] = row["n"]
    open_limit = F.lit(float("inf")).alias("bound")
    home = _nearest_in_regions(members.select("*", open_limit), members, n_members, k, part, limits)
    if len(n_members) == 1:
        return home
    home = materialize(home, "home")

    bounds = home.groupBy("i").agg(
        F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("bound")
    ).withColumnRenamed("i", "id")
    # The bound of a point with fewer than k neighbours in its region stays open.
    bounded = materialize(
        members.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))), "bounded"
    )
    first = np.zeros((len(centres), max(n_members) + 1), bool)      # cell by region
    for cell, region, splits in plan:
        first[cell, region:region + splits] = True
    belongs = spark.sparkContext.broadcast(first.astype("float32"))

    def reachable(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        cells = limits.value.open_cells(_matrix(batch["vec"]), batch["cell"].to_numpy(), batch["bound"].to_numpy())
        regions = cells.astype("float32") @ belongs.value > 0
        regions[np.arange(len(regions)), batch["region"].to_numpy()] = False
        return np.nonzero(regions)

    def count_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                region, n_visits = np.unique(reachable(batch)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(region, pa.int64()), pa.array(n_visits, pa.int64())], ["region", "n"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):   # keeps the fan-out of one output batch small
                piece = batch.slice(start, 256)
                row, region = reachable(piece)
                taken = piece.select(["id", "vec", "cell", "bound"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(region, pa.int64())], ["id", "vec", "cell", "bound", "region"])

    totals = bounded.mapInArrow(count_visits, "region bigint, n bigint").groupBy("region").agg(F.sum("n").alias("n")).collect()
    if not totals:
        return home
    visitors = bounded.mapInArrow(visit, "id bigint, vec array<float>, cell bigint, bound double, region bigint")
    away = _nearest_in_regions(visitors, members, {r["region"]: r["n"] for r in totals}, k, part, limits)
    return home.unionByName(away)


def _nearest_in_regions(visitors: DataFrame, members: DataFrame, n_visitors: dict, k: int, part: int, limits) -> DataFrame:
    """k nearest members within their bound per visitor of a region, parts of the
    visitors apart."""
    spark = visitors.sparkSession
    plan = [(region, -(-n // part)) for region, n in n_visitors.items()]
    # One row per region, of which there are no more than cells and blocks of crowded ones.
    parts = F.broadcast(spark.createDataFrame(plan, "region bigint, parts bigint"))
    tasks = min(4 * sum(count for _, count in plan), MOST_TASKS)    # few parts meet in a task
    keys = ("region", "part")

    def dealt(df: DataFrame, part: Column, columns: list[str]) -> DataFrame:
        # Fresh aliases: both sides may stem from the same table.
        placed = df.join(parts, "region").withColumn("part", part)
        return placed.select([F.col(c).alias(c) for c in (*keys, *columns)]).repartition(tasks, *keys)

    left = dealt(visitors, F.pmod(F.xxhash64("id"), "parts"), ["id", "vec", "cell", "bound"])
    right = dealt(members, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)), ["id", "vec", "cell"])

    def compare(these: pa.Table, those: pa.Table) -> pa.Table:
        return _block_nearest(these, those, k, limits.value)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, _FOUND)


def _matrix(column: pa.Array | pa.ChunkedArray, kind: str = "float64") -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(kind)


def _squared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by a product of matrices, and a bound on their rounding error.
    The mean is taken off first, so that what all vectors share costs no digits; the
    bound grows with what is left of the norms and with the digits lost before."""
    centre = b.mean(axis=0)
    lost = np.abs(centre).max(initial=0.0)
    a, b = a - centre, b - centre
    na, nb = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)[None, :]
    unit = np.finfo(float).eps * max(1, a.shape[1])
    error = 8 * unit * (na + nb) + (4 * unit * lost) ** 2
    return np.maximum(na + nb - 2.0 * (a @ b.T), 0.0), error


def _block_nearest(these: pa.Table, those: pa.Table, k: int, pivots: _Pivots | None = None) -> pa.Table:
    """(i, j, distance): of ``those`` the k nearest to each of ``these``, within its
    ``bound`` if there is one. With pivots both have cells, and cells are left out."""
    empty = pa.table({"i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
    if these.num_rows == 0 or those.num_rows == 0:
        return empty
    if pivots is not None:
        these, those = these.sort_by("cell"), those.sort_by("cell")
    a, b = _matrix(these["vec"], "float32"), _matrix(those["vec"], "float32")
    a_ids, b_ids = these["id"].to_numpy(), those["id"].to_numpy()
    bound = these["bound"].to_numpy() if "bound" in these.column_names else np.full(len(a), np.inf)
    a_cells, b_cells = (t["cell"].to_numpy() if pivots is not None else None for t in (these, those))
    fast, sure, out = _Members(b, "float32"), None, []
    for start in range(0, len(a), TILE):
        tile = slice(start, start + TILE)
        where = None if pivots is None else (pivots, a_cells[tile], b_cells)
        found = fast.nearest(a[tile], a_ids[tile], b_ids, k, bound[tile], where) if fast.fits(a[tile]) else None
        if found is None:       # too coarse to tell the vectors apart
            sure = sure or _Members(b, "float64")
            found = sure.nearest(a[tile], a_ids[tile], b_ids, k, bound[tile], where)
        row, col, distance = found
        out.append(pa.table({"i": a_ids[tile][row], "j": b_ids[col], "distance": distance}))
    return pa.concat_tables(out) if out else empty


class _Members:
    """Vectors that others are compared with, by products of matrices of one kind of
    number. These distances carry rounding errors: what might be among the first k is
    kept, and that is ordered by the exact differences."""

    def __init__(self, rows: np.ndarray, kind: str) -> None:
        self.rows, self.kind = rows, kind
        # What all vectors share is taken off first, so that it costs no digits.
        self.centre = rows.mean(axis=0, dtype="float64")
        self.lost = np.abs(self.centre).max(initial=0.0)
        self.moved = self._moved(rows)
        self.norms = np.einsum("ij,ij->i", self.moved, self.moved, dtype="float64")
        self.far = self.norms.max(initial=0.0)

    def _moved(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(rows.shape, self.kind)
        for start in range(0, len(rows), STRETCH):
            out[start:start + STRETCH] = rows[start:start + STRETCH].astype("float64") - self.centre
        return out

    def fits(self, rows: np.ndarray) -> bool:
        """Whether squares stay far from the largest number of this kind."""
        return bool(max(self.far, float((np.abs(rows.astype("float64")) ** 2).sum(axis=1).max(initial=0.0))) < 1e30)

    def nearest(self, rows: np.ndarray, ids: np.ndarray, member_ids: np.ndarray, k: int, bound: np.ndarray,
                where: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(row, member, distance) in order; None if single precision leaves too many."""
        part, width = self._moved(rows), rows.shape[1]
        own = np.einsum("ij,ij->i", part, part, dtype="float64")
        unit = np.finfo("float64").eps * max(1, width)
        error = 8 * unit * (own + self.far) + (4 * unit * self.lost) ** 2
        if self.kind == "float32":
            error += (width + 16) * np.finfo("float32").eps * (own + self.far)
        # A row's own norm is left out of its distances and taken off the cut instead.
        cut = bound ** 2 * (1 + 1e-9) + 2 * error - own
        twice, norms = -2 * part, self.norms.astype(self.kind)
        wanted = k + 1                      # the row itself may be among the members
        best = np.full((len(rows), wanted), np.inf)
        pending = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        held = seen = 0
        for members in self._in_turn(where, rows, lambda: np.sqrt(np.maximum(cut + own, 0.0))):
            near = twice @ self.moved[members].T
            near += norms[members]
            fresh = np.isinf(cut).any()
            if fresh:                       # nothing is known yet: the least of this stretch
                best = _least(best, near, wanted)
                cut = np.minimum(cut, best[:, -1] + 2 * error)
            edge = np.nextafter(cut.astype(self.kind), np.inf, dtype=self.kind)
            flat = np.flatnonzero(near <= edge[:, None])
            if len(flat) == 0:
                continue
            r, c = np.divmod(flat, near.shape[1])
            found = near.ravel()[flat].astype("float64")
            if not fresh:
                count = np.bincount(r, minlength=len(rows))
                more = np.full((len(rows), count.max()), np.inf)
                more[r, np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)] = found
                best = _least(best, more, wanted)
                cut = np.minimum(cut, best[:, -1] + 2 * error)
            pending.append((r, members[c], found))
            held, seen = held + len(r), seen + len(r)
            if self.kind == "float32" and seen > len(rows) * (64 * wanted + 1024):
                return None
            if held > PENDING:
                pending = [self._exact(pending, cut, rows, ids, member_ids, k)[:3]]
                held = len(pending[0][0])
        row, col, _, distance = self._exact(pending, cut, rows, ids, member_ids, k)
        inside = distance <= bound[row]
        return row[inside], col[inside], distance[inside]

    def _in_turn(self, where: tuple | None, rows: np.ndarray, limit: Callable) -> Iterator[np.ndarray]:
        """Stretches of members. With cells those of the rows' own cells first, then what
        can be nearer than the limits known by then."""
        def cut_up(members: np.ndarray) -> Iterator[np.ndarray]:
            for start in range(0, len(members), STRETCH):
                yield members[start:start + STRETCH]

        if where is None:
            yield from cut_up(np.arange(len(self.rows)))
            return
        pivots, cells, member_cells = where
        own = np.isin(member_cells, cells)
        yield from cut_up(np.flatnonzero(own))
        wanted = pivots.open_cells(rows.astype("float64"), cells, limit()).any(axis=0)
        yield from cut_up(np.flatnonzero(wanted[member_cells] & ~own))

    def _exact(self, pending: list, cut: np.ndarray, rows: np.ndarray, ids: np.ndarray, member_ids: np.ndarray,
               k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, member, product's value, distance) of the k nearest of the candidates."""
        row, col, value = (np.concatenate(c) for c in zip(*pending))
        real = (value <= cut[row]) & (ids[row] != member_ids[col])
        row, col, value = row[real], col[real], value[real]
        exact = np.concatenate([
            np.sqrt(((rows[row[s:s + 65536]].astype("float64") - self.rows[col[s:s + 65536]]) ** 2).sum(axis=1))
            for s in range(0, len(row), 65536)
        ] or [np.empty(0)])
        order = np.lexsort((member_ids[col], exact, row))
        row, col, value, exact = row[order], col[order], value[order], exact[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[kept], col[kept], value[kept], exact[kept]


def _least(best: np.ndarray, more: np.ndarray, wanted: int) -> np.ndarray:
    """The ``wanted`` least of a row of both, the largest of them last."""
    if more.shape[1] > wanted:
        more = np.partition(more, wanted - 1, axis=1)[:, :wanted]
    return np.partition(np.hstack([best, more]), wanted - 1, axis=1)[:, :wanted]


def _expand_copies(points: DataFrame, distinct: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """From neighbours among distinct vectors to neighbours among all rows. A row
    needs at most k+1 ids of any group of copies, the smallest ones."""
    several = distinct.where("copies > 1").select("vec", F.col("id").alias("group"))
    members = materialize(skew_join(points, several, "vec", salted_on="id").select("id", "group"), "copies")
    order = Window.partitionBy("group").orderBy("id")
    first = members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    heads = first.groupBy("group").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    own = heads.select("group", F.explode("ids").alias("id"), F.lit(0.0).alias("distance"))
    others = found.select(F.col("i").alias("owner"), F.col("j").alias("group"), "distance").join(heads, "group", "left").select(
        F.col("owner").alias("group"), F.explode(F.coalesce("ids", F.array("group"))).alias("id"), "distance"
    )
    nearest = Window.partitionBy("group").orderBy("distance", "id")
    lists = (
        own.unionByName(others)
        .withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k + 1)
        .groupBy("group").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("nearest"))
    )
    single = distinct.where("copies = 1").select("id", F.col("id").alias("group"))
    everyone = members.unionByName(single)
    mine = F.slice(F.filter("nearest", lambda x: x["id"] != F.col("id")), 1, k)
    return (
        skew_join(everyone, lists, "group", salted_on="id")
        .select(F.col("id").alias("i"), F.posexplode(mine).alias("place", "near"))
        .select("i", F.col("near")["id"].alias("j"), (F.col("place") + 1).alias("rank"), F.col("near")["distance"].alias("distance"))
    )
