"""SimHash groups and their index against comparing all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sentspark.llm import gray_simhash as G
from sentspark.llm.catalog import QUERIES
from sentspark.llm.components import connected_components
from sentspark.llm.scratch import scratch


def slow_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) if x]
    hashes = [xxhash.xxh64(" ".join(w[i:i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def least_reachable(bits, ids):
    """Smallest id reachable by links between fingerprints, for each row."""
    values = np.array(bits, np.uint64)
    group = list(range(len(ids)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(ids)):
        if ids[i] is None:
            continue
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 3).tolist():
            if ids[j] is not None:
                group[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)] = min(x, least.get(root(i), x))
    return [None if x is None else least[root(i)] for i, x in enumerate(ids)]


def brute(rows):
    bits = [slow_fingerprint(t) for _, t in rows]
    ids = [d for d, _ in rows]
    return Counter((d, f"{b:016x}", c) for d, b, c in zip(ids, bits, least_reachable(bits, ids)))


def test_hard_rows(hard, hard_texts, none):
    assert Counter(map(tuple, G.simhash_groups(hard).collect())) == brute(hard_texts)
    assert G.simhash_groups(none).collect() == []


def test_query(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, QUERIES["op12_gray_simhash"](spark, tables).collect())) == brute(rows)


def test_pieces_of_long_texts(monkeypatch):
    text = " ".join(str(random.Random(1).randrange(50)) for _ in range(500))
    whole = G.fingerprint(text.encode())
    monkeypatch.setattr(G, "PIECE", 7)
    assert G.fingerprint(text.encode()) == whole == slow_fingerprint(text)


def near_fingerprints(rng, n, centres):
    base = rng.integers(0, 1 << 64, centres, dtype=np.uint64)
    bits = base[rng.integers(0, centres, n)]
    for _ in range(4):
        flips = np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        bits = bits ^ np.where(rng.random(n) < 0.6, flips, np.uint64(0))
    return np.unique(bits)


@pytest.mark.parametrize("frontier", [40, 1000, 1 << 21])
def test_index_prunes_nothing_it_needs(frontier, monkeypatch):
    monkeypatch.setattr(G, "FRONTIER", frontier)
    rng = np.random.default_rng(frontier)
    for _ in range(6):
        bits = near_fingerprints(rng, 300, 25)
        _, group = np.unique(np.sort(rng.integers(0, 4, len(bits))), return_inverse=True)
        rank = bits.copy()
        for s in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(s)
        bits = bits[np.lexsort((rank, group))]
        every = np.arange(len(bits))
        i, j = G.Forest(bits, group).near(every, every)
        assert set(zip(i.tolist(), j.tolist())) == {
            (a, b) for a in range(len(bits)) for b in range(a + 1, len(bits)) if group[a] == group[b] and (int(bits[a]) ^ int(bits[b])).bit_count() <= 3}
        links = G.spanning_links(bits, group)
        assert all(group[a] == group[b] and (int(bits[a]) ^ int(bits[b])).bit_count() <= 3 for a, b in links)


def test_gray_ranks_of_neighbours_differ_in_one_bit(spark):
    ranks = [r[0] for r in spark.range(64).select((F.col("id").bitwiseXOR(F.shiftrightunsigned("id", 1))).alias("g")).select(G.gray_rank(F.col("g"))).collect()]
    assert [r + (1 << 63) for r in ranks] == list(range(64))


def test_patterns():
    for level in range(1, 4):
        masks = G._masks(level)
        assert len(masks) == 4 ** level and all(a & ~b == 0 for i, b in enumerate(masks) for a in [G._masks(level - 1)[i // 4]])
    assert 64 - min(m.bit_count() for m in G._masks(G.LEVELS)) <= 16


@pytest.mark.parametrize("group", [1 << 15, 30, 3])
def test_crowded_patterns_are_split(spark, group):
    """Far more fingerprints below a pattern than one task may hold: none is lost."""
    rng = np.random.default_rng(3)
    bits = np.unique(np.r_[near_fingerprints(rng, 250, 12), rng.integers(0, 1 << 16, 150, dtype=np.uint64), np.uint64(0)])
    rows = [(i, int(b)) for i, b in enumerate(bits.view(np.int64))]
    df = spark.createDataFrame(rows, "rep long, bits long")
    with scratch(spark, "test") as tmp:
        labels = {r[0]: r[1] for r in connected_components(G.near_links(df, tmp, group), tmp).collect()}
    assert [labels.get(i, i) for i in range(len(bits))] == least_reachable(bits, list(range(len(bits))))
