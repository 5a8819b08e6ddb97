"""Near duplicates by SimHash with a hierarchical index in Gray order.

The distinct fingerprints are sorted by their rank in the binary-reflected Gray code, so
that neighbours share most of their bits. Bits that all fingerprints below a node share
are factored into the node as a masked pattern; a node keeps only those its parent
doesn't have. A search goes down from the root, adds up the differences in the patterns
it passes, and leaves out a whole group once they exceed the allowed number.

Over executors the top level of the index are masked patterns of bit blocks: two
fingerprints that differ in at most 3 bits agree in one of 4 blocks, so each goes below 4
such patterns. A pattern with too many fingerprints is split by 4 blocks of the bits it
leaves open, and so on; after LEVELS rounds at most GROUP different ones can be left.
Below a pattern only links between parts not yet tied are looked for, and one link
between two parts is enough, so a dense group never yields all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sentspark.llm.components import connected_components
from sentspark.llm.scratch import Scratch, keep, scratch

BITS = 64
DISTANCE = 3
SHINGLE = 3
SEED = 42

LEVELS = 5              # 16, 12, 9, 7 and 5 bits are fixed: 15 stay open
GROUP = 1 << 15         # fingerprints below one pattern
FAN = 8                 # children of a node
FRONTIER = 1 << 21      # (query, node) pairs in memory at a time
PIECE = 1 << 16         # shingles hashed at a time

_U = np.uint64
_ALL = _U(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes) -> int:
    """SimHash of UTF-8 text: a bit is 1 if set in over half of the XXH64 hashes of its
    word shingles (A-Z lower-cased, repeats counted; fewer words: one shingle of all).
    0 without words."""
    words = text.lower().split()        # bytes: A-Z and the ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(SHINGLE, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest, total = xxhash.xxh64_intdigest, len(words) - k + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, total, PIECE):
        stop = min(total, at + PIECE)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:stop].tolist(), ends[at + k - 1:stop + k - 1].tolist())], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in batch.column("text").cast(pa.binary())),
                             np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "bits"])


def _masks(level: int) -> list[int]:
    """The bits fixed by each of the 4 ** level patterns, most significant blocks first."""
    if level == 0:
        return [0]
    found = []
    for mask in _masks(level - 1):
        free = [b for b in reversed(range(BITS)) if not mask >> b & 1]
        for part in np.array_split(np.array(free), DISTANCE + 1):
            found.append(mask | sum(1 << int(b) for b in part))
    return found


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def gray_rank(bits: Column) -> Column:
    """Rank in the binary-reflected Gray code, as a long that sorts like the unsigned one."""
    for shift in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, shift))
    return bits.bitwiseXOR(F.lit(-(1 << 63)))


def _below_patterns(rows: DataFrame, level: int) -> DataFrame:
    """Each row of ``rows`` (path, rep, bits) below the 4 patterns that refine its own."""
    masks = F.array(*[F.lit(_signed(m)) for m in _masks(level)])
    spread = rows.select(F.explode(F.transform(F.array(*[F.lit(i) for i in range(DISTANCE + 1)]), lambda c: F.col("path") * 4 + c)).alias("path"), "rep", "bits")
    return spread.withColumn("pattern", F.col("bits").bitwiseAND(F.get(masks, F.col("path"))))


class Forest:
    """Index of groups of fingerprints: one tree per group, in Gray order."""

    def __init__(self, bits: np.ndarray, group: np.ndarray) -> None:
        """``bits`` sorted by group, then by Gray rank; ``group`` numbers from 0."""
        self.bits = bits
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(bits) else np.zeros(0, np.int64)
        place = np.arange(len(bits)) - starts[group]
        shared, pattern, first = [np.full(len(bits), _ALL)], [bits], [np.arange(len(bits))]
        children, span = [], 1
        while len(first[-1]) > len(starts):
            span *= FAN
            heads = np.flatnonzero(place % span == 0)                   # first leaf of each node
            at = np.searchsorted(first[-1], heads)
            both, either = np.bitwise_and.reduceat(bits, heads), np.bitwise_or.reduceat(bits, heads)
            children.append((at, np.r_[at[1:], len(first[-1])]))
            shared.append(~(both ^ either))
            pattern.append(both & shared[-1])
            first.append(heads)
        # Top down: what a parent shares isn't kept below it.
        self.own = list(shared)
        for level, (begin, end) in enumerate(children):
            self.own[level] = shared[level] & ~np.repeat(shared[level + 1], end - begin)
        self.pattern, self.children, self.first = pattern, children, first
        self.last = [np.r_[f[1:], len(bits)] - 1 for f in first]
        self.root = group

    def near(self, queries: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves (i, j), i one of ``queries`` and j > i of its tree, with at most
        DISTANCE differences and in different parts. Groups that lie wholly in the
        query's own part are left out as well."""
        level = len(self.children)
        node, asked = self.root[queries], queries
        far = np.bitwise_count((self.bits[asked] ^ self.pattern[level][node]) & self.own[level][node]).astype(np.int64)
        while True:
            whole = part[self.first[level]]
            mixed = np.maximum.reduceat(part, self.first[level]) != np.minimum.reduceat(part, self.first[level])
            go = (far <= DISTANCE) & (self.last[level][node] > asked) & (mixed[node] | (whole[node] != part[asked]))
            node, asked, far = node[go], asked[go], far[go]
            if level == 0:
                return asked, node
            begin, end = self.children[level - 1]
            counts = (end - begin)[node]
            asked, far = np.repeat(asked, counts), np.repeat(far, counts)
            node = np.repeat(begin[node], counts) + np.arange(len(asked)) - np.repeat(np.cumsum(counts) - counts, counts)
            level -= 1
            far = far + np.bitwise_count((self.bits[asked] ^ self.pattern[level][node]) & self.own[level][node])


def spanning_links(bits: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """Links that tie what is within DISTANCE in the same group, one less than parts."""
    if len(bits) == 0:
        return []
    forest, part, links = Forest(bits, group), np.arange(len(bits)), []
    sizes = np.bincount(group)[group]
    steps = np.searchsorted(np.cumsum(sizes), np.arange(1, 2 + int(sizes.sum()) // FRONTIER) * FRONTIER, "right")
    for queries in np.split(np.arange(len(bits)), np.unique(steps)):
        if len(queries) == 0:
            continue
        a, b = forest.near(queries, part)
        ties, at = np.unique(np.stack([part[a], part[b]], axis=1), axis=0, return_index=True)
        root = {}

        def find(x):
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        for (x, y), i in zip(ties.tolist(), at.tolist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
                links.append((int(a[i]), int(b[i])))
        if root:
            moved = np.arange(len(bits))
            moved[list(root)] = [find(x) for x in root]
            part = moved[part]
    return links


def _links(batches) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (path, pattern, rank): links between representatives. Holds
    about GROUP rows, always whole groups."""
    names = ["path", "pattern", "rep", "bits"]

    def work(rows):
        change = (rows["path"][1:] != rows["path"][:-1]) | (rows["pattern"][1:] != rows["pattern"][:-1])
        group = np.cumsum(np.r_[False, change])
        alone = np.bincount(group)[group] == 1
        keep_ = ~alone
        if not keep_.any():
            return None
        _, dense = np.unique(group[keep_], return_inverse=True)
        rep = rows["rep"][keep_]
        found = np.array(spanning_links(rows["bits"][keep_].view(np.uint64), dense), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(rep[found[:, 0]]), pa.array(rep[found[:, 1]])], names=["a", "b"])

    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        now = {c: batch.column(c).to_numpy() for c in names}
        held = now if held is None else {c: np.concatenate([held[c], now[c]]) for c in names}
        if len(held["bits"]) >= GROUP:
            cut = len(held["bits"]) - 1         # start of the last group, which may go on
            same = (held["path"] == held["path"][-1]) & (held["pattern"] == held["pattern"][-1])
            cut = int(np.argmax(same))
            if cut:
                if (out := work({c: v[:cut] for c, v in held.items()})) is not None:
                    yield out
                held = {c: v[cut:].copy() for c, v in held.items()}
    if held is not None and (out := work(held)) is not None:
        yield out


def near_links(classes: DataFrame, tmp: Scratch, group: int = GROUP) -> DataFrame:
    """Links (a, b) between the ``rep`` of distinct fingerprints (rep, bits) that tie all
    that differ in at most DISTANCE bits."""
    rows, links = classes.select(F.lit(0).alias("path"), "rep", "bits"), []
    for level in range(1, LEVELS + 1):
        rows = tmp.table(_below_patterns(rows, level))
        crowded = None
        if level < LEVELS:
            crowded = tmp.table(rows.groupBy("path", "pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group).drop("n"))
            crowded = None if crowded.isEmpty() else crowded
        here = rows if crowded is None else rows.join(crowded, ["path", "pattern"], "left_anti")
        links.append(
            here.select("path", "pattern", "rep", "bits", gray_rank(F.col("bits")).alias("rank"))
            .repartition("path", "pattern").sortWithinPartitions("path", "pattern", "rank")
            .select("path", "pattern", "rep", "bits").mapInArrow(_links, "a long, b long"))
        if crowded is None:
            break
        rows = rows.join(crowded, ["path", "pattern"], "left_semi").select("path", "rep", "bits")
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    return tmp.table(found)


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable by
    links) of every row of ``docs`` (doc_id, text; other columns are ignored, so their
    names can't clash).

    Fingerprints link if they differ in at most DISTANCE bits, those of texts without
    words (NULL, empty, blank: zero) like any other. Texts are read whole and hashed in
    pieces. A NULL doc_id keeps its fingerprint, links nothing and has component_id NULL.
    Repeated rows come out as often as they went in; no rows in, no rows out.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(docs.sparkSession, "simhash") as tmp:
        told = tmp.table(texts.mapInArrow(_fingerprints, "doc_id long, bits long"))
        classes = tmp.table(told.where("doc_id IS NOT NULL").groupBy("bits").agg(F.min("doc_id").alias("rep")))
        labels = connected_components(near_links(classes, tmp), tmp)
        of_class = classes.join(labels, F.col("rep") == F.col("doc_id"), "left").select(
            F.col("bits").alias("of_bits"), F.coalesce("component_id", "rep").alias("component_id"))
        result = told.join(of_class, (F.col("bits") == F.col("of_bits")) & F.col("doc_id").isNotNull(), "left")
        return keep(result.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"))
