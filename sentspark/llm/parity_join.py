"""Similarity self-join of word-shingle sets by parity sketches.

Method. A shingle set is XOR-hashed into blocks: each shingle flips one place of one
block. Two sketches differ in at most as many blocks as the sets differ in elements, so
with sizes a <= b and Jaccard >= t they differ in at most D(a) = floor(a * (1 - t) / t).
Sizes are cut into bands, one number of blocks per band; a document also takes part in
each higher band that holds a possible partner. Of any D(a) + 1 blocks one agrees
(pigeonhole), so one key per block finds every linked pair. A block is very wide and
kept as a linear 64-bit hash of its places, so only blocks with the same shingles share
a key; empty blocks have none (see ``_keys`` for why the search stays complete).

Equal sets are one class from the start and only its smallest doc_id goes on. The first
few keys of each band go first: they tie near-identical documents, and the many keys
those share are then dropped where they are read, since only members of different
components matter. Documents under one key are compared by a second sketch (a lower
bound again) in chunks of bounded size; the pairs it admits are cut down to some that
span them, and those are verified on the real sets. Where one fails, all admitted pairs
of the key between different components are verified. Sets to verify are brought
together by one of the two documents, in groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import ceil, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sentspark.llm.components import connected_components
from sentspark.llm.kernels import mix, shingle_sets, small_batches
from sentspark.llm.scratch import Scratch, keep, scratch, small_arrow_batches

CHECK_BITS = (128, 1 << 16)     # bounds of the second sketch's width: 16 bits per allowed difference
LEAD = 8                # keys of a band that go first
BLOCK = 1 << 14         # members of a key compared at a time
COMPARED = 1 << 19      # words of sketches in memory at a time
VERIFIED = 1 << 21      # shingles of one group of pairs to verify

_U = np.uint64


class Geometry:
    """Size bands and block numbers for Jaccard >= num / den."""

    def __init__(self, num: int, den: int) -> None:
        if not 0 < num < den:
            raise ValueError("the threshold must lie between 0 and 1")
        self.num, self.den = num, den
        self.ratio = max(2.0, den / num)
        self.least = -(-num // (den - num))      # smaller sets link only with equal ones

    def most(self, n: int) -> int:
        """Largest symmetric difference of a set of ``n`` and a linked larger one."""
        return n * (self.den - self.num) // self.num

    def blocks(self, band: int) -> int:
        """Blocks of a band: enough for its largest sets, of which few are empty."""
        top = self.edge(band + 1) - 1
        return self.most(top) + 2 + ceil(1.5 * exp(-0.9 * self.num / (self.den - self.num)) * self.most(top))

    def reach(self, n: int, blocks: int) -> int:
        """Blocks looked at by a set of ``n``; doesn't fall as ``n`` grows. More than
        most(n), to make up for the empty ones to be expected."""
        part = n * (self.den - self.num) / self.num
        return min(blocks, max(self.most(n) + 1, ceil(1 + part * (1 + 1.5 * exp(-n / blocks)))))

    def edge(self, band: int) -> int:
        return ceil(self.least * self.ratio ** band)

    def bands(self, n: int) -> Iterator[int]:
        """Bands in which a set of ``n`` may meet an equal or larger partner."""
        if n < self.least:
            return
        band = 0
        while self.edge(band + 1) <= n:
            band += 1
        largest = n * self.den // self.num
        while self.edge(band) <= max(n, largest):
            yield band
            band += 1


def _keys(geometry: Geometry, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of one sorted set: the first LEAD of each band, and the others.

    In a band a set looks at its first reach(n) blocks. If more than D(n) of them aren't
    empty it is rich and emits those; else it is poor and emits every block of the band
    that isn't empty. If at most D(n) in the whole band aren't, it is bare and emits each
    of its shingles as well. Let a <= b be linked, so that at most D(a) <= D(b) blocks
    differ. If a is rich, one of its blocks agrees; b has it within its own, longer reach
    and emits it. If a is poor and b rich, one of b's blocks agrees, and a emits it. If
    both are poor and one isn't bare, that one has more than D(a) blocks, one of them
    agrees, and both emit it. If both are bare, they share a shingle.
    """
    n, lead, rest = len(tokens), [], []
    place, spot = tokens >> _U(32), mix(tokens)
    for band in geometry.bands(n):
        blocks, most = geometry.blocks(band), geometry.most(n)
        at = ((place * _U(blocks)) >> _U(32)).astype(np.int64)         # grows with the token
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        values, used = np.bitwise_xor.reduceat(spot, first), at[first]
        near = used < geometry.reach(n, blocks)
        if int(near.sum()) > most:
            values, used = values[near], used[near]
        found = mix(values + mix(used.astype(np.uint64) * _U(4096) + _U(band)))
        if len(used) <= most:
            found = np.r_[found, mix(spot + mix(np.array([band], np.uint64) + _U(1 << 40)))]
        lead.append(found[:LEAD])
        rest.append(found[LEAD:])
    none = tokens[:0]
    return np.concatenate([none, *lead]), np.concatenate([none, *rest])


def _check_sketch(geometry: Geometry, tokens: np.ndarray) -> bytes:
    """Parity sketch over token bits that the blocks don't use. Widths are powers of
    two, so a wide one folds into a narrower one."""
    width = CHECK_BITS[0]
    while width < CHECK_BITS[1] and width < 16 * geometry.most(len(tokens)):
        width *= 2
    bit = (tokens & _U(width - 1)).astype(np.int64)
    odd = (np.bincount(bit, minlength=width) & 1).astype(np.uint8)
    return np.packbits(odd).tobytes()


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _lists(parts: list[np.ndarray], kind=np.int64) -> pa.Array:
    bounds = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(parts) if parts else np.zeros(0, kind)))


def _describe(batches, shingle: int, geometry: Geometry):
    """doc_id, set size, 128-bit set digest, keys and check sketch of each document, few
    at a time: a worker keeps the room it once took, and later stages use it again."""
    for batch in small_batches(batches):
        sizes, first, second, lead, rest, sketches = [], [], [], [], [], []
        for tokens in shingle_sets(batch.column("text"), shingle):
            sizes.append(len(tokens))
            first.append(tokens.sum(dtype=np.uint64))
            second.append(mix(tokens ^ _U(0xA24BAED4963EE407)).sum(dtype=np.uint64))
            early, late = _keys(geometry, tokens)
            lead.append(_signed(early))
            rest.append(_signed(late))
            sketches.append(_check_sketch(geometry, tokens))
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(sizes, pa.int64()),
            pa.array(_signed(np.array(first, np.uint64))), pa.array(_signed(np.array(second, np.uint64))),
            _lists(lead), _lists(rest), pa.array(sketches, pa.binary()),
        ], names=["doc_id", "n_shingles", "d1", "d2", "lead", "rest", "sketch"])


def _buckets(batches):
    """From rows (key, doc_id, back: doc_id less its component) sorted by (key, doc_id):
    the distinct members of each key with two or more, in rows of at most BLOCK members,
    and their component if it is the same for all. Keys within one component are left
    out. Holds one block at a time."""
    def rows(found):
        return pa.RecordBatch.from_arrays([
            pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int64()),
            pa.array([f[3] for f in found], pa.bool_()), pa.array([f[4] for f in found], pa.list_(pa.int64())),
        ], names=["key", "chunk", "component", "only", "members"])

    key, held, groups, chunk = None, [], set(), 0

    def row(only):
        return key, chunk, next(iter(groups)) if len(groups) == 1 else None, only, held

    def close():
        return [row(chunk == 0)] if chunk or len(groups) > 1 else []

    for batch in batches:
        keys, ids, back = (batch.column(c).to_numpy() for c in ("key", "doc_id", "back"))
        if len(keys) == 0:
            continue
        of = ids - back
        found = []
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        stops = np.r_[starts[1:], len(keys)]
        # Keys within one component that lie inside the batch are skipped at once.
        wanted = np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts)
        wanted[[0, -1]] = True
        for a, b in zip(starts[wanted].tolist(), stops[wanted].tolist()):
            if key != keys[a]:
                found += close()
                key, held, groups, chunk = keys[a], [], set(), 0
            for doc, group in zip(ids[a:b].tolist(), of[a:b].tolist()):
                if held and held[-1] == doc:
                    continue
                if len(held) == BLOCK:
                    found.append(row(False))
                    held, groups, chunk = [], set(), chunk + 1
                held.append(doc)
                groups.add(group)
        if found:
            yield rows(found)
    if key is not None and (found := close()):
        yield rows(found)


def _fold(sketch: bytes, width: int) -> bytes:
    while len(sketch) > width:
        half = len(sketch) // 2
        sketch = (int.from_bytes(sketch[:half]) ^ int.from_bytes(sketch[half:])).to_bytes(half)
    return sketch


class _Parts:
    """Which rows hang together already."""

    def __init__(self, names: np.ndarray) -> None:
        _, self.of = np.unique(names, return_inverse=True)

    def join(self, i: np.ndarray, j: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Positions of the pairs, closest first, that tie parts not tied before."""
        order = np.lexsort((j, i, gap))
        ends = np.sort(np.stack([self.of[i[order]], self.of[j[order]]], axis=1), axis=1)
        _, at = np.unique(ends, axis=0, return_index=True)      # the first is the closest
        root, used = {}, []

        def find(x):
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        for k in np.sort(at).tolist():
            x, y = find(int(ends[k, 0])), find(int(ends[k, 1]))
            if x != y:
                root[max(x, y)] = min(x, y)
                used.append(k)
        if root:
            moved = np.arange(int(self.of.max()) + 1)
            moved[list(root)] = [find(x) for x in root]
            self.of = moved[self.of]
        return order[used]


def _admissible(rows: dict[str, np.ndarray], first: np.ndarray, last: np.ndarray, geometry: Geometry, spanning: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) and their tasks, of row i and rows first[i] .. last[i] - 1, that sizes
    and sketches admit and that lie in different components. ``spanning``: only as many
    as tie what all of them would. All sketches have one width."""
    ids, sizes, task = rows["doc_id"], rows["n_shingles"], rows["task"]
    bits = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(ids), -1)
    names = np.stack([task, rows["component"]], axis=1)
    parts = _Parts(np.ascontiguousarray(names).view([("t", np.int64), ("c", np.int64)])[:, 0])
    first = np.maximum(first, np.arange(len(ids)) + 1)
    counts = np.maximum(last - first, 0)
    cost = counts * bits.shape[1]
    step = np.searchsorted(np.cumsum(cost), np.arange(1, 1 + int(cost.sum()) // COMPARED) * COMPARED)
    pairs, tasks = [], []
    for part in np.split(np.arange(len(ids)), np.unique(step)):
        n = counts[part]
        i = np.repeat(part, n)
        j = np.repeat(first[part], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        ok = (parts.of[i] != parts.of[j]) & (ids[i] != ids[j]) & (large * geometry.num <= small * geometry.den)
        i, j, both = i[ok], j[ok], (small + large)[ok]
        gap = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        ok = gap <= both * (geometry.den - geometry.num) // (geometry.den + geometry.num)
        i, j, gap = i[ok], j[ok], gap[ok]
        if spanning and len(i):
            at = parts.join(i, j, gap)
            i, j = i[at], j[at]
        pairs.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], axis=1))
        tasks.append(task[i])
    return np.concatenate(pairs), np.concatenate(tasks)


def _compare(batches, geometry: Geometry, spanning: bool):
    """From members sorted by (task, side): rows (a, b, task) for admissible pairs. Holds
    the tasks of one batch."""
    names = ["task", "side", "doc_id", "n_shingles", "component"]

    def work(held):
        rows = {c: np.concatenate([h[c] for h in held]) for c in names}
        sketches = [x for h in held for x in h["sketch"]]
        begin = np.flatnonzero(np.r_[True, rows["task"][1:] != rows["task"][:-1]])
        sizes = np.diff(np.r_[begin, len(sketches)])
        owner = np.repeat(np.arange(len(begin)), sizes)
        width = np.array([len(x) for x in sketches])
        narrow = np.minimum.reduceat(width, begin)[owner]
        right = np.add.reduceat(rows["side"], begin)[owner]     # rows on side 1 of the task
        stop = (begin + sizes)[owner]
        first = np.where(right > 0, stop - right, begin[owner])
        last = np.where(rows["side"] > 0, first, stop)
        pairs, tasks = [], []
        for w in np.unique(narrow):
            at = np.flatnonzero(narrow == w)        # whole tasks, so ranges stay ranges
            moved = np.cumsum(narrow == w) - 1
            part = {c: rows[c][at] for c in names}
            part["sketch"] = [_fold(sketches[i], w) for i in at]
            low = moved[first[at]]
            found, of = _admissible(part, low, low + last[at] - first[at], geometry, spanning)
            pairs.append(found)
            tasks.append(of)
        pairs, tasks = np.concatenate(pairs), np.concatenate(tasks)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(tasks)], names=["a", "b", "task"])

    held = []
    for batch in batches:
        now = {c: batch.column(c).to_numpy() for c in names} | {"sketch": batch.column("sketch").to_pylist()}
        count = batch.num_rows
        if count == 0:
            continue
        # The last task may go on in the next batch.
        cut = int(np.searchsorted(now["task"], now["task"][-1]))
        if cut or (held and held[-1]["task"][-1] != now["task"][0]):
            yield work(held + ([{c: v[:cut] for c, v in now.items()}] if cut else []))
            held = []
        held.append({c: v[cut:] for c, v in now.items()})
    if held:
        yield work(held)


def _verified(batches, shingle: int, geometry: Geometry):
    """From texts sorted by group: the pairs that link, of those named by their first
    document. Holds the sets of one group."""
    group, sets, asked = None, {}, []

    def links():
        found = []
        for a, others in asked:
            for b in others:
                if b not in sets:
                    continue
                shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if shared * geometry.den >= (len(sets[a]) + len(sets[b]) - shared) * geometry.num:
                    found.append((a, b))
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        groups, ids, partners = (batch.column(c).to_pylist() for c in ("group", "doc_id", "partners"))
        for of, doc, others, tokens in zip(groups, ids, partners, shingle_sets(batch.column("text"), shingle)):
            if of != group:
                if asked:
                    yield links()
                group, sets, asked = of, {}, []
            if others:
                asked.append((doc, others))
            sets.setdefault(doc, tokens)        # a repeated id: the first of its texts
    if asked:
        yield links()


def _verify(pairs: DataFrame, texts: DataFrame, sizes: DataFrame, shingle: int, geometry: Geometry, tmp: Scratch) -> DataFrame:
    """The linked ones of distinct ``pairs`` (a, b). A group is a document with its
    partners, so each text moves about once per pair; if they are many, the group is cut
    by a hash of the partner into groups of about VERIFIED shingles."""
    size = sizes.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n"))
    # Linked sets are of about the same size.
    parts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("others")).join(size, "a").select(
        "a", F.ceil(F.col("others") * F.col("n") / VERIFIED).alias("parts"))
    named = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    asked = named.groupBy("a", "part").agg(F.collect_list("b").alias("partners"))
    wanted = asked.select(F.struct("a", "part").alias("group"), F.col("a").alias("doc_id"), "partners").unionByName(
        named.select(F.struct("a", "part").alias("group"), F.col("b").alias("doc_id"), F.array().cast("array<long>").alias("partners")))
    wanted = tmp.table(wanted.select(F.xxhash64("group").alias("group"), "doc_id", "partners"))
    return tmp.table(
        texts.join(wanted, "doc_id").select("group", "doc_id", "partners", "text")
        .repartition("group").sortWithinPartitions("group", "doc_id")
        .mapInArrow(partial(_verified, shingle=shingle, geometry=geometry), "a long, b long"))


def parity_join(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are ignored, so their
    names can't clash. A set holds the distinct runs of ``shingle`` words (A-Z
    lower-cased; words are split at ASCII white space); with fewer words the whole
    sequence is its one element. Two documents link if den * |A & B| >= num * |A | B|.
    component_id is the smallest doc_id reachable by links.

    NULL, empty or blank text: n_shingles 0, component_id is the own doc_id. NULL
    doc_id: the row keeps its size, component_id is NULL and it links nothing.
    Repeated rows come out as often as they went in. No rows in, no rows out. Texts
    are read whole; sets are compared by 64-bit shingle hashes.
    """
    spark, geometry = docs.sparkSession, Geometry(num, den)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(spark, "parity") as tmp, small_arrow_batches(spark):
        whole = tmp.table(texts.mapInArrow(
            partial(_describe, shingle=shingle, geometry=geometry),
            "doc_id long, n_shingles long, d1 long, d2 long, lead array<long>, rest array<long>, sketch binary"))
        described = whole.select("doc_id", "n_shingles", "d1", "d2")
        classes = tmp.table(
            described.where("n_shingles > 0 AND doc_id IS NOT NULL")
            .groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")))
        able = classes.where(F.col("n_shingles") >= geometry.least).select(F.col("rep").alias("doc_id")).distinct()
        reps = tmp.table(whole.join(able, "doc_id", "left_semi").select("doc_id", "n_shingles", "sketch").dropDuplicates(["doc_id"]))
        state = tmp.table(able.withColumn("component", F.col("doc_id")))
        links = tested = None

        def candidates(tasks: DataFrame, spanning: bool) -> DataFrame:
            """Pairs of the tasks' members in different components, with their task."""
            members = tasks.select("task", F.explode(F.concat(
                F.transform("m0", lambda d: F.struct(F.lit(0).alias("side"), d.alias("doc_id"))),
                F.transform(F.coalesce("m1", F.array().cast("array<long>")), lambda d: F.struct(F.lit(1).alias("side"), d.alias("doc_id"))),
            )).alias("m")).select("task", "m.side", "m.doc_id")
            return tmp.table(
                members.join(state, "doc_id").join(reps, "doc_id")
                .select("task", "side", "doc_id", "n_shingles", "component", "sketch")
                .repartition("task").sortWithinPartitions("task", "side", "doc_id")
                .mapInArrow(partial(_compare, geometry=geometry, spanning=spanning), "a long, b long, task long"))

        def test(found: DataFrame) -> None:
            """Verifies the pairs not seen before and moves the components on."""
            nonlocal links, tested, state
            new = found.select("a", "b").distinct()
            new = tmp.table(new if tested is None else new.join(tested, ["a", "b"], "left_anti"))
            if new.isEmpty():
                return
            more = _verify(new, texts, reps, shingle, geometry, tmp)
            links = more if links is None else links.unionByName(more)
            tested = new if tested is None else tested.unionByName(new)
            labels = connected_components(links, tmp)
            state = tmp.table(able.join(labels, "doc_id", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component")))

        failed = []
        for column in ("lead", "rest"):
            rows = (
                whole.where(F.size(column) > 0).select("doc_id", column).join(state, "doc_id")
                # Most are a component of their own: a zero takes no room in the shuffle.
                .select(F.explode(column).alias("key"), "doc_id", (F.col("doc_id") - F.col("component")).alias("back"))
                .repartition("key").sortWithinPartitions("key", "doc_id")
                .mapInArrow(_buckets, "key long, chunk int, component long, only boolean, members array<long>"))
            buckets = tmp.table(rows)
            # Keys with the same few members need one comparison only.
            blank = F.lit(None).cast("array<long>").alias("m1")
            single = buckets.where("only").select("members").distinct().select(
                F.xxhash64("members", F.lit(0)).alias("task"), F.col("members").alias("m0"), blank)
            large = buckets.where("NOT only")
            other = large.select("key", F.col("chunk").alias("chunk1"), F.col("component").alias("component1"), F.col("members").alias("m1"))
            within = large.where("component IS NULL").select(F.xxhash64("key", "chunk", F.lit(1)).alias("task"), F.col("members").alias("m0"), blank)
            across = large.join(other, "key").where("chunk < chunk1 AND (component = component1) IS NOT TRUE").select(
                F.xxhash64("key", "chunk", "chunk1").alias("task"), F.col("members").alias("m0"), "m1")
            tasks = single.unionByName(within).unionByName(across)
            named = candidates(tasks, True)
            test(named)
            if links is not None:
                # Where a spanning pair doesn't link, others may tie its ends.
                open_ = named.join(links, ["a", "b"], "left_anti").select("task").distinct()
                failed.append(tasks.join(open_, "task", "left_semi"))
        if failed:
            again = failed[0]
            for more in failed[1:]:
                again = again.unionByName(more)
            test(candidates(again, False))
        of_class = classes.join(state, F.col("rep") == F.col("doc_id"), "left").select(
            "d1", "d2", F.col("n_shingles").alias("size"), F.coalesce("component", "rep").alias("component_id"))
        result = (
            described.join(of_class.withColumnsRenamed({"d1": "e1", "d2": "e2"}),
                  (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n_shingles") == F.col("size"))
                  & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        )
        return keep(result)
