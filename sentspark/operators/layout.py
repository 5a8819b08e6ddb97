"""2-D layouts of vectors: PCA, and two graph layouts fitted by descent.

The rows are dealt to blocks by where their vectors lie, so that most near pairs stay
within one. A block has its own rows, all pairs they take part in, and
copies of the rows at the other ends. A round is one job: it brings the copies up to
date, then every block makes INNER steps of the descent on its own, moving the copies
along by the pairs it sees, so that the two ends of a pair keep meeting halfway. Pairs are
stored by block and don't move; copies travel packed, in single precision. At the
end of a round the copies are dropped: a row's position comes from its own block. Rows
that take part in a large share of all pairs are dealt to several blocks by the other
end, and their position is the mean of those. Positions are never collected, and the
state of a round is a table in the shared folder.

In the pair layout the same rows go the same ways in every round. So a block keeps its
pairs by place and in order, and for each other block the places of the rows it sends there
and gets from there; a round writes letters from block to block, of values only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, partial
from math import ceil, log2
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sentspark.operators.embedding import pca_layout
from sentspark.operators.forest import SEED, dealt_to_cells, knn_approx
from sentspark.operators.graphs import EXTRA_NEIGHBOURS, index_rows, pacmap_pairs, umap_graph
from sentspark.operators.neighbours import knn_graph
from sentspark.operators.skew import HOT_SHARE, hot_keys
from sentspark.scratch import Scratch, scratch
from sentspark.session import materialize

# The clip and the repulsion count of the membership layout; the phase
# lengths (shares of 450 steps), pair constants and optimiser constants of the pair
# layout; the dimensions its vectors are brought down to first.
CLIP, NEGATIVES = 4.0, 5
PHASES = (100 / 450, 200 / 450)
NEAR_C, MID_C, FAR_C = 10.0, 10000.0, 1.0
ADAM_RATE, BETA_1, BETA_2, ADAM_EPS = 1.0, 0.9, 0.999, 1e-7
FIRST_DIMENSIONS = 100

INNER = 5                   # steps between two exchanges
PAIRS_PER_BLOCK = 4_000_000
MOST_BUCKETS = 1024
CELL = 1 << 20              # numbers in one cell of a table
TILE = 1 << 15              # pairs or rows whose numbers stay near the processor
KINDS = ("near", "mid", "far")
SEGMENTS = ("near", "far", "mid")   # mid pairs have no weight at the end
CONSTANTS = {"near": NEAR_C, "mid": MID_C, "far": FAR_C}
_STATE = ("y0", "y1", "m0", "m1", "v0", "v1")


def curve_parameters(min_dist: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) for which 1 / (1 + a * d ** (2 * b)) comes nearest, by least squares over
    300 distances up to three times ``spread``, to 1 below ``min_dist`` and to
    exp(-(d - min_dist) / spread) beyond. Damped Gauss-Newton steps."""
    if not 0 <= min_dist <= spread:
        raise ValueError("min_dist must lie between 0 and spread")
    d = np.linspace(0, 3 * spread, 300)
    wanted = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    log_d = np.log(np.maximum(d, 1e-300))

    def parts(a: float, b: float) -> tuple[np.ndarray, np.ndarray]:
        power = np.where(d > 0, np.exp(2 * b * log_d), 0.0)
        value = 1 / (1 + a * power)
        slope = -value ** 2
        return value - wanted, np.stack([slope * power, slope * a * power * np.where(d > 0, 2 * log_d, 0.0)], axis=1)

    now, damping = np.array([1.0, 1.0]), 1e-3
    miss, slopes = parts(*now)
    for _ in range(500):
        square = slopes.T @ slopes
        step = np.linalg.solve(square + damping * np.diag(np.diag(square)), -slopes.T @ miss)
        trial = now + step
        if (trial > 0).all():
            new, new_slopes = parts(*trial)
            if new @ new <= miss @ miss:
                now, miss, slopes, damping = trial, new, new_slopes, damping / 3
                if np.abs(step).max() < 1e-12:
                    break
                continue
        damping *= 4
        if damping > 1e12:
            break
    return float(now[0]), float(now[1])


class _Blocks:
    """Pairs (i, j, ...) dealt to blocks by their first end, both directions given, and
    which rows each block holds. ``hot`` has the rows that take part in more than a
    thousandth of all pair ends (at most a thousand), with their number of blocks."""

    def __init__(self, pairs: DataFrame, indexed: DataFrame, per_block: int, tmp: Scratch) -> None:
        rows, depth = indexed.select("idx"), max(0, ceil(log2(max(1, pairs.count()) / per_block)))
        self.blocks, self.tmp = 1 << depth, tmp
        self.buckets = min(self.blocks, MOST_BUCKETS)
        names = F.lit(_names(indexed.sparkSession, self.blocks, self.buckets)).cast("array<bigint>")
        home = tmp.table(dealt_to_cells(indexed.select(F.col("idx").alias("id"), "vec"), depth, SEED)[0].select(
            F.col("id").alias("i"), F.get(names, F.col("cell").cast("int")).alias("home")))
        self.hot = tmp.table(hot_keys(pairs.select(F.col("i").alias("idx")), "idx").where("splits > 1"))
        # A row of average degree is far below the limit only if there are many rows.
        self.salted = bool(self.hot.take(1)) and HOT_SHARE * 10 < rows.count()
        if self.salted:
            splits = F.broadcast(self.hot.select(F.col("idx").alias("i"), "splits"))
            spread = F.get(names, F.pmod(F.xxhash64("i", F.pmod(F.xxhash64("j"), F.col("splits"))), F.lit(self.blocks)).cast("int"))
            dealt = pairs.join(splits, "i", "left").join(home, "i").withColumn("block", F.when(F.col("splits").isNull(), F.col("home")).otherwise(spread))
        else:
            dealt = pairs.join(home, "i").withColumn("block", F.col("home"))
        self.pairs = tmp.dealt(dealt.select("block", *pairs.columns), "block", self.buckets)
        ends = self.pairs.select("block", F.col("i").alias("idx"), F.lit(True).alias("own")).unionByName(
            self.pairs.select("block", F.col("j").alias("idx"), F.lit(False).alias("own")))
        alone = home.join(self.pairs.select("i"), "i", "left_anti").select(F.col("home").alias("block"), F.col("i").alias("idx"), F.lit(True).alias("own"))
        self.places = tmp.table(ends.unionByName(alone).groupBy("block", "idx").agg(F.max("own").alias("own")))

    @cached_property
    def routes(self) -> DataFrame:
        return self.tmp.table(_routes(self.places))

    def round(self, state: DataFrame, work: Callable, more: DataFrame | None = None) -> DataFrame:
        """The state after ``work`` on every block. ``more`` names further rows
        (block, idx, own) that blocks need."""
        routes = self.routes if more is None else self.routes.unionByName(_routes(more))
        columns = [c for c in state.columns if c != "idx"]

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield _packed(batch, columns)

        def step(pairs: pa.Table, points: pa.Table) -> pa.Table:
            return work(pairs, _unpacked(points, columns))

        sent = routes.join(state, "idx").mapInArrow(pack, "block bigint, own boolean, idx binary, state binary")
        points = sent.repartition(self.buckets, "block").groupBy("block")
        moved = self.pairs.groupBy("block").cogroup(points).applyInArrow(step, state.schema)
        if not self.salted:
            return moved
        return moved.groupBy("idx").agg(*[F.avg(c).alias(c) for c in state.columns if c != "idx"])


def _names(spark: SparkSession, blocks: int, buckets: int) -> list[int]:
    """A number for each block. Spark's hash deals equally many of them to each bucket, so
    that no task has more blocks than others."""
    bucket = F.pmod(F.hash("id"), F.lit(buckets))
    found = spark.range(64 * blocks).groupBy(bucket.alias("bucket")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    each = blocks // buckets
    return sorted(n for r in found.select(F.slice("ids", 1, each).alias("ids")).collect() for n in r["ids"])


def _routes(places: DataFrame) -> DataFrame:
    """(idx, to): the blocks each row goes to, and whether it is their own."""
    return places.groupBy("idx").agg(F.collect_list(F.struct("block", "own")).alias("to"))


def _packed(batch: pa.RecordBatch, columns: list[str]) -> pa.RecordBatch:
    """One row per block and ``own`` with the rows that go there: own ones as they are,
    copies and drawn ones in single precision."""
    idx, state = batch["idx"].to_numpy(), np.stack([batch[c].to_numpy() for c in columns], axis=1)
    to = batch["to"]
    row = np.repeat(np.arange(len(idx)), to.value_lengths().to_numpy())
    block, own = to.flatten().flatten()
    kind = pc.fill_null(pc.cast(own, pa.int8()), 2).to_numpy()
    order = np.lexsort((kind, block.to_numpy()))
    row, block, kind = row[order], block.to_numpy()[order], kind[order]
    out = []
    for part in np.split(np.arange(len(row)), np.flatnonzero(np.diff(block) | np.diff(kind)) + 1):
        mine, what = row[part], int(kind[part[0]])
        values = state[mine] if what == 1 else state[mine].astype("float32")
        out.append((int(block[part[0]]), (False, True, None)[what], idx[mine].tobytes(), values.tobytes()))
    types = {"block": pa.int64(), "own": pa.bool_(), "idx": pa.binary(), "state": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types.values())], list(types))


def _unpacked(sent: pa.Table, columns: list[str]) -> pa.Table:
    """(idx, own, ...) of the packed rows."""
    idx, own, state = [np.empty(0, np.int64)], [], [np.empty((0, len(columns)))]
    for r in sent.to_pylist():
        idx.append(np.frombuffer(r["idx"], np.int64))
        own += [r["own"]] * len(idx[-1])
        state.append(np.frombuffer(r["state"], "float64" if r["own"] else "float32").reshape(-1, len(columns)).astype("float64"))
    values = np.concatenate(state)
    return pa.table({"idx": np.concatenate(idx), "own": pa.array(own, pa.bool_()), **{c: values[:, n].copy() for n, c in enumerate(columns)}})


def _start(indexed: DataFrame, scale: float) -> DataFrame:
    placed = pca_layout(indexed, "vec", 2, scale)
    return placed.select("idx", F.col("position")[0].alias("y0"), F.col("position")[1].alias("y1"), *[F.lit(0.0).alias(c) for c in _STATE[2:]])


class _Local:
    """One block in memory: its points in order of their index, and its pairs by place."""

    def __init__(self, pairs: pa.Table, points: pa.Table, columns: list[str]) -> None:
        points = points.sort_by([("idx", "ascending"), ("own", "descending")])
        idx = points["idx"].to_numpy()
        first = np.r_[True, idx[1:] != idx[:-1]] if len(idx) else np.zeros(0, bool)
        self.idx, self.own = idx[first], points["own"].to_numpy(zero_copy_only=False)[first]
        self.state = {c: points[c].to_numpy()[first].copy() for c in columns}
        self.a, self.b = (np.searchsorted(self.idx, pairs[end].to_numpy()) for end in ("i", "j"))
        # A pair of two own rows is there in both directions.
        self.back = ~self.own[self.b] if len(self.b) else np.zeros(0, bool)

    @property
    def y(self) -> np.ndarray:
        return np.stack([self.state["y0"], self.state["y1"]], axis=1)

    def total(self, force: np.ndarray, a: np.ndarray, b: np.ndarray | None = None, back: np.ndarray | None = None) -> np.ndarray:
        """Sums of ``force`` at the first ends, and of its opposite at those second ends
        that are copies."""
        n, out = len(self.idx), []
        for axis in (0, 1):
            sums = np.bincount(a, force[:, axis], n)
            if b is not None:
                sums -= np.bincount(b[back], force[back, axis], n)
            out.append(sums)
        return np.stack(out, axis=1)

    def table(self) -> pa.Table:
        return pa.table({"idx": self.idx[self.own], **{c: v[self.own] for c, v in self.state.items()}})


class _Letters:
    """Blocks whose rows go the same ways in every round. What a block needs is packed and
    stored once (``_keep``); a round's table has for each block the letters it gets: its own
    state, and values of the copies in the order both ends know."""

    def __init__(self, blocks: _Blocks) -> None:
        self.buckets, self.salted, self.own = blocks.buckets, blocks.salted, blocks.places.where("own").select("block", "idx")
        owners = self.own.groupBy("idx").agg(F.collect_list("block").alias("owners"))
        held = blocks.places.join(owners, "idx").select(
            "block", "idx", "own", F.explode("owners").alias("other"), (F.size("owners") > 1).alias("shared"))
        got = held.select("block", "idx", "own", "other", "shared", F.lit(True).alias("got"))
        away = held.where("block <> other").select(
            F.col("other").alias("block"), "idx", F.lit(True).alias("own"), F.col("block").alias("other"), "shared", F.lit(False).alias("got"))
        # At most HOT_SHARE rows.
        hot = [r["idx"] for r in blocks.hot.collect()] if self.salted else []
        links = got.unionByName(away).repartition(self.buckets, "block").groupBy("block")
        kept = blocks.pairs.groupBy("block").cogroup(links).applyInArrow(partial(_keep, hot=np.array(hot, np.int64)), _KEPT)
        self.kept = blocks.tmp.dealt(kept, "block", self.buckets)

    def _by_block(self, df: DataFrame, work: Callable) -> DataFrame:
        return self.kept.groupBy("block").cogroup(df.repartition(self.buckets, "block").groupBy("block")).applyInArrow(work, _LETTER)

    def first(self, state: DataFrame) -> DataFrame:
        """The letters of a state by row."""
        return self._by_block(self.own.join(state, "idx"), _write_first)

    def round(self, letters: DataFrame, work: Callable) -> DataFrame:
        """The letters after ``work`` on the pairs and rows of every block."""
        return self._by_block(letters, partial(_answer, work=work))

    def positions(self, letters: DataFrame) -> DataFrame:
        """(idx, y0, y1)"""
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for idx, data in zip(batch["idx"].to_pylist(), batch["data"].to_pylist()):
                    y = np.frombuffer(data, "float64").reshape(-1, len(_STATE))
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(idx, np.int64)), pa.array(y[:, 0].copy()), pa.array(y[:, 1].copy())], ["idx", "y0", "y1"])

        read_back = letters.where("idx IS NOT NULL").select("idx", "data").mapInArrow(read, "idx bigint, y0 double, y1 double")
        return read_back.groupBy("idx").agg(F.avg("y0").alias("y0"), F.avg("y1").alias("y1")) if self.salted else read_back


_KEPT = "block bigint, name string, part int, data binary"
_LETTER = "block bigint, source bigint, shared boolean, idx binary, data binary"


def _keep(key: tuple, pairs: pa.Table, links: pa.Table, hot: np.ndarray) -> pa.Table:
    """What a block keeps: its own rows (``idx``, in order; their places come first, then
    those of the copies), its pairs by place, and for the letters it gets and sends the
    other block, whether they are about rows that have several blocks, and the places.

    Pairs are in order of segment and second end. A segment is one kind; those of a second
    round of SEGMENTS only move their first end, as the other one's share is counted elsewhere."""
    links = links.sort_by([("got", "descending"), ("other", "ascending"), ("shared", "ascending"), ("idx", "ascending")])
    got, other, shared, own, idx = (links[c].to_numpy(zero_copy_only=False) for c in ("got", "other", "shared", "own", "idx"))
    mine = np.unique(idx[got & own])
    copies = np.unique(idx[got & ~own])
    known = np.r_[mine, copies]
    by_idx = np.argsort(known, kind="stable")

    def place(of: np.ndarray) -> np.ndarray:
        return by_idx[np.searchsorted(known, of, sorter=by_idx)] if len(of) else np.empty(0, np.int64)

    out = {"idx": mine, "size": np.array([len(known)])}
    for name, which in (("got", got & (other != key[0].as_py())), ("sent", ~got)):
        to, about, at = other[which], shared[which], place(idx[which])
        first = np.flatnonzero(np.r_[True, (to[1:] != to[:-1]) | (about[1:] != about[:-1])]) if len(to) else np.empty(0, np.int64)
        out |= {f"{name}_other": to[first], f"{name}_shared": about[first].astype(np.int64), f"{name}_first": first, f"{name}_place": at.astype(np.int32)}
    a, b, kind = place(pairs["i"].to_numpy()), place(pairs["j"].to_numpy()), pairs["kind"].to_numpy().astype(np.int64)
    is_hot = np.isin(known, hot)
    both_own = b < len(mine)
    twice = both_own & ~is_hot[a] & ~is_hot[b]      # there in both directions: one of them moves both ends
    segment = _segment(kind, both_own & ~twice)
    kept = ~twice | (a < b)
    a, b, segment = a[kept], b[kept], segment[kept]
    order = np.argsort(segment * max(1, len(known)) + b, kind="stable")
    out |= {"segments": np.bincount(segment, minlength=2 * len(SEGMENTS)), "a": a[order].astype(np.int32), "b": b[order].astype(np.int32)}
    rows = [(key[0].as_py(), name, part, values[start:start + CELL].tobytes())
            for name, values in out.items() for part, start in enumerate(range(0, max(1, len(values)), CELL))]
    types = {"block": pa.int64(), "name": pa.string(), "part": pa.int32(), "data": pa.binary()}
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], list(types))


def _segment(kind: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """The segment of each pair, by its kind (a place in KINDS, from 1) and whether it moves
    its first end alone."""
    order = np.array([SEGMENTS.index(k) for k in KINDS])
    return order[kind.astype(np.int64) - 1] + len(SEGMENTS) * alone


def _kept(table: pa.Table) -> dict[str, np.ndarray]:
    cells: dict[str, list] = {}
    for name, data in zip(*(table.sort_by("part")[c].to_pylist() for c in ("name", "data"))):
        cells.setdefault(name, []).append(data)
    # A place is used as an index again and again: int64 is what that takes.
    return {name: np.frombuffer(b"".join(data), np.int32 if name in ("a", "b", "got_place", "sent_place") else np.int64).astype(np.int64)
            for name, data in cells.items()}


def _write(block: int, kept: dict[str, np.ndarray], state: np.ndarray) -> pa.Table:
    """The letters of a block with the state of its own rows."""
    out = [(block, block, False, kept["idx"].tobytes(), state.tobytes())]
    parts = np.split(kept["sent_place"], kept["sent_first"][1:]) if len(kept["sent_first"]) else []
    for other, shared, at in zip(kept["sent_other"].tolist(), kept["sent_shared"].tolist(), parts):
        values = state[at]
        out.append((other, block, bool(shared), None, (values if shared else values.astype("float32")).tobytes()))
    types = {"block": pa.int64(), "source": pa.int64(), "shared": pa.bool_(), "idx": pa.binary(), "data": pa.binary()}
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types.values())], list(types))


def _write_first(key: tuple, kept: pa.Table, points: pa.Table) -> pa.Table:
    points = points.sort_by("idx")
    return _write(key[0].as_py(), _kept(kept), np.stack([points[c].to_numpy() for c in _STATE], axis=1))


def _answer(key: tuple, kept: pa.Table, letters: pa.Table, work: Callable) -> pa.Table:
    block, kept = key[0].as_py(), _kept(kept)
    sent = {(r["source"], r["shared"]): r["data"] for r in letters.select(["source", "shared", "data"]).to_pylist()}
    n, width = len(kept["idx"]), len(_STATE)
    state, seen = np.zeros((int(kept["size"][0]), width)), np.zeros(int(kept["size"][0]))
    state[:n], seen[:n] = np.frombuffer(sent[block, False], "float64").reshape(-1, width), 1
    parts = np.split(kept["got_place"], kept["got_first"][1:]) if len(kept["got_first"]) else []
    for other, shared, at in zip(kept["got_other"].tolist(), kept["got_shared"].tolist(), parts):
        values = np.frombuffer(sent[other, bool(shared)], "float64" if shared else "float32").reshape(-1, width)
        if shared:      # of several blocks: the mean of theirs
            state[at] += values
            seen[at] += 1
        else:
            state[at] = values
    if kept["got_shared"].any():
        several = seen > 1
        state[several] /= seen[several, None]
    work(kept, state)
    return _write(block, kept, state[:n])


def pair_layout(indexed: DataFrame, pairs: DataFrame, n_iter: int = 450, inner: int = INNER, per_block: int = PAIRS_PER_BLOCK) -> DataFrame:
    """(idx, y0, y1) from near, mid and far pairs, by Adam."""
    with scratch(indexed.sparkSession, "pairs") as tmp, scratch(indexed.sparkSession, "state") as states:
        kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int").alias("kind")
        once = tmp.table(pairs.select("i", "j", kind))
        blocks = _Blocks(once.unionByName(once.select(F.col("j").alias("i"), F.col("i").alias("j"), "kind")), indexed, per_block, tmp)
        post = _Letters(blocks)
        letters = states.table(post.first(_start(indexed, 0.01)))
        inner = inner if blocks.blocks > 1 else n_iter      # one block has no copies
        for first in range(0, n_iter, max(1, inner)):
            work = partial(_descend, first=first, last=min(n_iter, first + inner), n_iter=n_iter)
            letters = states.table(post.round(letters, work))
            states.keep_last(1)
        return materialize(post.positions(letters), "layout")


def pair_weights(step: int, n_iter: int) -> tuple[float, float, float]:
    """Weights of near, mid and far pairs in a step."""
    first, second = (int(share * n_iter) for share in PHASES)
    if step < first:
        return 2.0, 1000.0 * (1 - step / first) + 3.0 * step / first, 1.0
    return (3.0, 3.0, 1.0) if step < second else (1.0, 0.0, 1.0)


def _strengths(step: int, n_iter: int) -> dict[str, float]:
    near, mid, far = pair_weights(step, n_iter)
    return {"near": 2.0 * near * NEAR_C, "mid": 2.0 * mid * MID_C, "far": -2.0 * far}


def _descend(kept: dict[str, np.ndarray], state: np.ndarray, first: int, last: int, n_iter: int) -> None:
    """Steps ``first`` to ``last`` of Adam on the rows of ``state``, which is changed. Numbers
    are gone through by TILE, and ends of pairs as complex numbers, so that a place is looked
    up once."""
    a, b, n_own = kept["a"], kept["b"], len(kept["idx"])
    y, m, v = (np.ascontiguousarray(state[:, c:c + 2]) for c in (0, 2, 4))
    bounds = np.r_[0, np.cumsum(kept["segments"])].tolist()
    force, pull = np.empty_like(y), np.empty((2, len(a)))
    here, there, reach, square = np.empty(TILE, complex), np.empty(TILE, complex), np.empty(TILE), np.empty(TILE)
    z = y.view(complex).ravel()
    for step in range(first, last):
        strengths = _strengths(step, n_iter)
        force[:] = 0.0
        for moves in (2, 1):
            start = end = bounds[0 if moves == 2 else len(SEGMENTS)]
            for n, kind in enumerate(SEGMENTS):
                segment = n + (0 if moves == 2 else len(SEGMENTS))
                if strengths[kind]:     # only the last segment's may be 0
                    end = bounds[segment + 1]
                    for s in range(bounds[segment], end, TILE):
                        at = slice(s, min(end, s + TILE))
                        size = at.stop - s
                        gap, other, r, q = here[:size], there[:size], reach[:size], square[:size]
                        np.take(z, a[at], out=gap, mode="clip")
                        np.take(z, b[at], out=other, mode="clip")
                        gap -= other
                        np.multiply(gap.real, gap.real, out=r)
                        r += np.multiply(gap.imag, gap.imag, out=q)
                        r += CONSTANTS[kind] + 1.0
                        r *= r
                        np.divide(strengths[kind], r, out=r)
                        np.multiply(gap.real, r, out=pull[0, at])
                        np.multiply(gap.imag, r, out=pull[1, at])
            for axis in (0, 1) if end > start else ():
                force[:n_own, axis] += np.bincount(a[start:end], pull[axis, start:end], n_own)
                if moves == 2:
                    force[:, axis] -= np.bincount(b[start:end], pull[axis, start:end], len(y))
        rate = ADAM_RATE * (1 - BETA_2 ** (step + 1)) ** 0.5 / (1 - BETA_1 ** (step + 1))
        for s in range(0, len(y), TILE // 8):
            at = slice(s, s + TILE // 8)
            f, g = force[at], (1 - BETA_1) * force[at]
            m[at] *= BETA_1
            m[at] += g
            np.multiply(1 - BETA_2, f, out=g)
            g *= f
            v[at] *= BETA_2
            v[at] += g
            np.sqrt(v[at], out=g)
            g += ADAM_EPS
            np.multiply(rate, m[at], out=f)
            f /= g
            y[at] -= f
    state[:, 0:2], state[:, 2:4], state[:, 4:6] = y, m, v


def _pair_steps(pairs: pa.Table, points: pa.Table, first: int, last: int, n_iter: int) -> pa.Table:
    """The same steps as the work of ``_Blocks.round``."""
    local = _Local(pairs, points, list(_STATE))
    places = np.argsort(~local.own, kind="stable")      # own rows first
    at = np.empty_like(places)
    at[places] = np.arange(len(places))
    a, b = at[local.a], at[local.b]
    segment = _segment(pairs["kind"].to_numpy(), ~local.back)
    order = np.lexsort((b, segment))
    kept = {"idx": local.idx[local.own], "a": a[order], "b": b[order], "segments": np.bincount(segment, minlength=2 * len(SEGMENTS))}
    state = np.stack([local.state[c] for c in _STATE], axis=1)[places]
    _descend(kept, state, first, last, n_iter)
    local.state = {c: state[at, n] for n, c in enumerate(_STATE)}
    return local.table()


def membership_layout(indexed: DataFrame, graph: DataFrame, n: int, n_iter: int = 200, seed: int = 42,
                      min_dist: float = 0.1, spread: float = 1.0, inner: int = INNER, per_block: int = PAIRS_PER_BLOCK) -> DataFrame:
    """(idx, y0, y1) from a symmetric weighted graph: edges attract by weight, and every
    row is repelled by a few others. Each round draws NEGATIVES rows per own row from the
    whole table into a block, and each of its steps draws anew among those."""
    a, b = curve_parameters(min_dist, spread)
    with scratch(indexed.sparkSession, "edges") as tmp, scratch(indexed.sparkSession, "state") as states:
        edges = tmp.table(graph.select("i", "j", "weight"))
        blocks = _Blocks(edges, indexed, per_block, tmp)
        strength = edges.groupBy(F.col("i").alias("idx")).agg(F.sum("weight").alias("strength"))
        start = _start(indexed, 10.0).select("idx", "y0", "y1").join(strength, "idx", "left").withColumn("strength", F.coalesce("strength", F.lit(0.0)))
        state = states.table(start)
        inner = inner if blocks.blocks > 1 else n_iter      # one block has all rows to draw from
        for first in range(0, n_iter, max(1, inner)):
            drawn = blocks.places.where("own").select(
                "block", F.explode(F.transform(F.sequence(F.lit(1), F.lit(NEGATIVES)), lambda s: F.pmod(
                    F.xxhash64("idx", F.lit(seed), F.lit(first), s), F.lit(n)))).alias("idx"), F.lit(None).cast("boolean").alias("own"))
            work = partial(_edge_steps, first=first, last=min(n_iter, first + inner), n_iter=n_iter, seed=seed, a=a, b=b)
            state = states.table(blocks.round(state, work, drawn))
            states.keep_last(1)
        return materialize(state.select("idx", "y0", "y1"), "layout")


def _edge_steps(edges: pa.Table, points: pa.Table, first: int, last: int, n_iter: int, seed: int, a: float, b: float) -> pa.Table:
    drawn = points.filter(pc.is_null(points["own"]))["idx"].to_numpy()
    points = points.set_column(points.column_names.index("own"), "own", pc.fill_null(points["own"], False))
    local = _Local(edges, points, ["y0", "y1", "strength"])
    weight, y, strength = edges["weight"].to_numpy(), local.y, local.state["strength"]
    others, every = np.searchsorted(local.idx, np.sort(drawn)), np.arange(len(local.idx))
    rng = np.random.default_rng([seed, first, int(local.idx[0]) if len(local.idx) else 0])
    for step in range(first, last):
        gap = y[local.a] - y[local.b]
        d2 = (gap * gap).sum(axis=1)
        near = np.where(d2 > 0, d2, 1.0)
        pull = np.where(d2 > 0, 2.0 * a * b * near ** (b - 1.0) / (1.0 + a * near ** b), 0.0) * weight
        force = local.total(np.clip(pull[:, None] * gap, -CLIP, CLIP), local.a, local.b, local.back)
        for _ in range(NEGATIVES if len(others) else 0):
            partner = others[rng.integers(0, len(others), len(every))]
            gap = y - y[partner]
            d2 = (gap * gap).sum(axis=1)
            push = np.where(partner == every, 0.0, -2.0 * b / ((0.001 + d2) * (1.0 + a * d2 ** b))) * strength
            force += np.clip(push[:, None] * gap, -CLIP, CLIP)
        y = y - (1.0 - step / n_iter) * force
    local.state |= {"y0": y[:, 0], "y1": y[:, 1]}
    return local.table()


def _by_pca(df: DataFrame, id_column: str, vector: str, **params: Any) -> DataFrame:
    placed = pca_layout(df.select(id_column, vector), vector)
    return placed.select(id_column, F.col("position")[0].alias("Component 1"), F.col("position")[1].alias("Component 2"))


def _named(positions: DataFrame, indexed: DataFrame, id_column: str) -> DataFrame:
    return positions.join(indexed.select("idx", "id"), "idx").select(
        F.col("id").alias(id_column), F.col("y0").alias("Component 1"), F.col("y1").alias("Component 2")
    )


# How neighbours are found, by name; the caller chooses, not the size of the table.
SEARCHES: dict[str, Callable[..., DataFrame]] = {"approximate": knn_approx, "exact": knn_graph}


def _by_pacmap(df: DataFrame, id_column: str, vector: str, n_neighbors: int = 10, MN_ratio: float = 0.5,
               FP_ratio: float = 2.0, random_state: int = 42, n_iter: int = 450, neighbours: str = "approximate",
               apply_pca: bool = True) -> DataFrame:
    """Vectors of more than FIRST_DIMENSIONS entries are brought down to their leading
    principal components first, unless ``apply_pca`` is off."""
    width = df.select(F.max(F.size(vector))).first()[0] or 0
    if apply_pca and width > FIRST_DIMENSIONS:
        reduced = pca_layout(df.select(id_column, vector), vector, FIRST_DIMENSIONS)
        df, vector = reduced.select(id_column, "position"), "position"
    indexed = index_rows(df, id_column, vector, random_state)
    n = indexed.count()
    knn = SEARCHES[neighbours](indexed, n_neighbors + EXTRA_NEIGHBOURS, "idx", "vec")
    pairs = pacmap_pairs(indexed, knn, n, n_neighbors, MN_ratio, FP_ratio, random_state)
    return _named(pair_layout(indexed, pairs, n_iter), indexed, id_column)


def _by_umap(df: DataFrame, id_column: str, vector: str, n_neighbors: int = 15, random_state: int = 42,
             n_iter: int = 200, neighbours: str = "approximate", min_dist: float = 0.1, spread: float = 1.0) -> DataFrame:
    indexed = index_rows(df, id_column, vector, random_state)
    n = indexed.count()
    graph = umap_graph(SEARCHES[neighbours](indexed, n_neighbors, "idx", "vec"))
    return _named(membership_layout(indexed, graph, n, n_iter, random_state, min_dist, spread), indexed, id_column)


REDUCERS: dict[str, Callable[..., DataFrame]] = {"pca": _by_pca, "pacmap": _by_pacmap, "umap": _by_umap}


def reduce_vectors(df: DataFrame, model: str = "pacmap", params: dict[str, Any] | None = None,
                   id_column: str = "sentence_id", vector: str = "embedding") -> DataFrame:
    """(id, Component 1, Component 2) by the named method."""
    params = dict(params or {})
    if model not in REDUCERS:
        raise NotImplementedError(f"no layout method named {model!r}")
    if params.pop("n_components", 2) != 2 or params.pop("metric", "euclidean") != "euclidean":
        raise NotImplementedError("layouts have two components and use the Euclidean metric")
    return REDUCERS[model](df, id_column, vector, **params)


def layout_table(df: DataFrame, layout: DataFrame, id_column: str = "sentence_id") -> DataFrame:
    """The layout with label code and label attached by id."""
    return layout.join(df.select(id_column, "label_encoded", "label"), id_column)


def density_bins(points: DataFrame, x: str, y: str, bins: int, by: str) -> DataFrame:
    """(bx, by, label, n): counts on a bins x bins grid over the range of the points,
    which is what a scatter plot of any size needs."""
    span = points.agg(
        F.struct(*[f(c).cast("double").alias(f"{name}_{axis}") for axis, c in (("x", x), ("y", y)) for name, f in (("min", F.min), ("max", F.max))])
    ).scalar()

    def cell(value: str, axis: str) -> Column:
        low, high = span.getField(f"min_{axis}"), span.getField(f"max_{axis}")
        place = F.floor(F.try_divide((F.col(value).cast("double") - low) * bins, high - low)).cast("int")
        return F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1))

    placed = points.select(cell(x, "x").alias("bx"), cell(y, "y").alias("by"), F.col(by).alias("label"))
    return placed.groupBy("bx", "by", "label").agg(F.count(F.lit(1)).alias("n"))
