"""Parity-sketch join and components against brute force."""

import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from sentspark.llm import kernels, parity_join as P
from sentspark.llm.kernels import shingle_sets
from sentspark.llm.parity_join import Geometry, _check_sketch, _describe, _fold, _keys, parity_join
from sentspark.llm.scratch import ARROW_BYTES, ARROW_CONF, small_arrow_batches

import pyarrow as pa
import re


def brute(rows, k, num, den):
    """{row number: (set size, component)} by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) if x]
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    least = {}
    ids = [d for d, _ in rows]
    todo = [i for i, d in enumerate(ids) if d is not None]
    group = {i: i for i in todo}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for x in todo:
        for y in todo:
            if x < y and sets[x] and sets[y]:
                shared = len(sets[x] & sets[y])
                if den * shared >= num * (len(sets[x]) + len(sets[y]) - shared):
                    group[root(x)] = root(y)
    for i in todo:
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return Counter((ids[i], len(sets[i]), least[root(i)] if i in group else None) for i in range(len(rows)))


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_hard_rows(hard, hard_texts, k, num):
    got = Counter(tuple(r) for r in parity_join(hard, k, num, 100).collect())
    assert got == brute(hard_texts, k, num, 100)


def test_no_rows(none):
    assert parity_join(none, 3, 90, 100).collect() == []


def test_chains_of_near_copies(spark):
    rng = random.Random(3)
    rows, base = [], [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(120)]
    for i in range(160):
        if i % 40 == 0:
            base = [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.choice([30, 120, 400]))]
        else:
            base = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                base[rng.randrange(len(base))] = "x" + str(rng.randrange(1000))
        rows.append((i, " ".join(base)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for k, num in ((3, 90), (5, 80)):
        assert Counter(tuple(r) for r in parity_join(df, k, num, 100).collect()) == brute(rows, k, num, 100)


def all_keys(geometry, tokens):
    return np.concatenate(_keys(geometry, tokens))


def test_linked_sets_share_a_key_and_sketches_bound_differences():
    rng = np.random.default_rng(1)
    for num in (80, 90):
        geometry = Geometry(num, 100)
        for n in [*range(geometry.least, geometry.least + 40), 77, 150, 333, 1000, 5000]:
            for _ in range(6):
                whole = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
                # As different as the threshold allows: tokens exchanged on either side.
                drop = int(rng.integers(0, n * (100 - num) // (100 + num) + 1))
                add = (n - drop) * 100 // num - n
                add = int(rng.integers(0, max(0, add) + 1))
                other = np.unique(np.r_[rng.choice(whole, n - drop, replace=False), rng.integers(0, 1 << 64, add, dtype=np.uint64)])
                shared = len(np.intersect1d(whole, other))
                if 100 * shared < num * (len(whole) + len(other) - shared) or len(np.setxor1d(whole, other)) == 0:
                    continue
                assert len(np.intersect1d(all_keys(geometry, whole), all_keys(geometry, other))) > 0
                a, b = _check_sketch(geometry, whole), _check_sketch(geometry, other)
                size = min(len(a), len(b))
                a, b = (np.frombuffer(_fold(x, size), np.uint8) for x in (a, b))
                assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(whole, other))


def test_poor_and_bare_sets_share_a_key():
    """Shingles crowded into few blocks: the look-up that random sets never need."""
    rng = np.random.default_rng(2)
    for num in (80, 90):
        geometry = Geometry(num, 100)
        for _ in range(400):
            n = int(rng.integers(geometry.least, 60))
            spots = rng.integers(0, 1 << 32, int(rng.integers(1, 4)), dtype=np.uint64) << np.uint64(32)
            pool = np.unique(spots[rng.integers(0, len(spots), 2 * n)] | rng.integers(0, 1 << 32, 2 * n, dtype=np.uint64))[:n + 9]
            pool = rng.permutation(pool)
            drop = n * (100 - num) // (100 + num)
            a, b = np.sort(pool[:n]), np.sort(pool[drop:n + drop])
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= num * (len(a) + len(b) - shared):
                assert len(np.intersect1d(all_keys(geometry, a), all_keys(geometry, b))) > 0


def test_unrelated_sets_share_no_key():
    """Empty blocks aren't keys, so what unrelated sets share doesn't grow with the table."""
    rng, seen = np.random.default_rng(3), Counter()
    geometry = Geometry(80, 100)
    for _ in range(1500):
        seen.update(np.unique(all_keys(geometry, np.unique(rng.integers(0, 1 << 64, int(rng.integers(100, 400)), dtype=np.uint64)))).tolist())
    assert max(seen.values()) == 1


def test_keys_are_few():
    rng, geometry = np.random.default_rng(4), Geometry(80, 100)
    for n in (130, 200, 300, 1000):
        counts = [len(all_keys(geometry, np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)))) for _ in range(100)]
        bands = len(list(geometry.bands(n)))
        assert np.mean(counts) <= bands * (1.2 * geometry.most(n) + 4)


@pytest.mark.parametrize("block,compared", [(1 << 14, 1 << 19), (8, 64)])
def test_large_groups_in_chunks(spark, monkeypatch, block, compared):
    """A passage that most documents share, near-identical ones and chains, compared in
    chunks of few members."""
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "COMPARED", compared)
    rng = random.Random(block)
    passage, rows = [f"p{i}" for i in range(60)], []
    for i in range(90):
        if i % 3 == 0:
            own = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([5, 15, 40]))]
        words = own + passage
        if i % 3 == 2:
            words[rng.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in parity_join(df, 5, 80, 100).collect()) == brute(rows, 5, 80, 100)


def test_shingle_hashes_are_those_of_the_words():
    texts = ["A b  c\td", "a b c d", "", None, "c d", "a b c", "x\x1cy é", "a"]
    sets = list(shingle_sets(pa.array(texts, pa.string()), 3))
    assert [len(s) for s in sets] == [2, 2, 0, 0, 1, 1, 1, 1]
    assert sets[0].tolist() == sets[1].tolist() and sets[5][0] in sets[0]
    by_hash = defaultdict(set)
    for s, t in zip(sets, texts):
        by_hash[tuple(s.tolist())].add(t)
    assert len(by_hash) == 6


def test_describing_a_large_batch_takes_little_memory(monkeypatch):
    rng = random.Random(8)
    words = [rng.choice("abcdefghij") + str(i) for i in range(5000)]
    texts = [" ".join(rng.choices(words, k=150)) if i % 50 else None for i in range(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    monkeypatch.setattr(kernels, "_powers", {})
    tracemalloc.start()
    rows, most = [], 0
    for out in _describe([batch], 5, Geometry(80, 100)):
        most = max(most, out.num_rows)
        if len(rows) < 60:
            rows += out.slice(0, 60).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most <= 1024 and peak < 24 << 20      # the texts are 4 MB
    alone = [r for i in range(60) for out in _describe([batch.slice(i, 1)], 5, Geometry(80, 100)) for r in out.to_pylist()]
    assert rows[:60] == alone


def test_long_texts_come_in_small_arrow_batches(spark, monkeypatch):
    before, seen = spark.conf.get(ARROW_CONF, None), []
    star = P.connected_components

    def spied(links, tmp):
        seen.append(spark.conf.get(ARROW_CONF, None))
        return star(links, tmp)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    monkeypatch.setattr(P, "connected_components", spied)
    parity_join(spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j k")], "doc_id long, text string")).collect()
    assert seen and set(seen) == {str(ARROW_BYTES)}
    long = spark.range(0, 4000, 1, 1).selectExpr("repeat(concat('word', id, ' '), 500) AS text")
    with small_arrow_batches(spark):
        assert max(r.n for r in long.mapInArrow(sizes, "n long").collect()) < ARROW_BYTES + (1 << 16)
    assert spark.conf.get(ARROW_CONF, None) == before
