"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sentspark.llm import crc_resampling as C
from sentspark.llm.catalog import QUERIES


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return len(w), Counter(zlib.crc32(" ".join(w[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1))


def brute(docs, benchmark):
    told = [(d, *features(t)) for d, t in docs]
    s, t = sum((x for _, _, x in told), Counter()), sum((features(x)[1] for x in benchmark), Counter())
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in s}
    rows = []
    for d, words, x in told:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in x.items())
        rows.append([d, sum(x.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words >= 20])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[:5 * len(able) // 100]):
        r[4] = i + 1
    return Counter(tuple(r[:5]) for r in rows)


def test_query(spark, tables):
    docs = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    benchmark = [r[0] for r in spark.read.parquet(f"{tables}/benchmark.parquet").select("text").collect()]
    got = QUERIES["op13_crc_resampling"](spark, tables)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert Counter(map(tuple, got.collect())) == brute(docs, benchmark)


def test_hard_rows(spark, hard, hard_texts, none):
    target = spark.createDataFrame([("The cat is of THE mat", 1), (None, 2), ("", 3)], "text string, doc_id int")
    assert Counter(map(tuple, C.resample(hard, target).collect())) == brute(hard_texts, ["The cat is of THE mat"])
    more = C.resample(hard, target.where("false"), percent=50).collect()
    assert sorted(r["rank"] for r in more if r["rank"] is not None) == list(range(1, 1 + sum(features(t)[0] >= 20 for _, t in hard_texts) // 2))
    assert C.resample(none, target).collect() == []


def test_shifts_cancel_prefixes():
    rng = random.Random(5)
    for _ in range(300):
        a, b = (bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 200, 255, 256, 257, 3000]))) for _ in range(2))
        moved = C.shift(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))
        assert int(moved[0]) ^ zlib.crc32(a + b) == zlib.crc32(b)
        value = np.array([zlib.crc32(a)], np.uint32)
        assert C._take_back(C._move(value)) == value


@pytest.mark.parametrize("piece,at_once", [(1, 1), (40, 9), (1 << 20, 1 << 17)])
def test_pieces_and_batches(piece, at_once, monkeypatch):
    monkeypatch.setattr(C, "PIECE_BYTES", piece)
    monkeypatch.setattr(C, "WORDS_AT_ONCE", at_once)
    rng = random.Random(piece)
    texts = ["", None, "a", "A b C d", "x" * 700 + " y " + "é" * 300, "Hello, World! 12 3.4 é漢\x00\x7f", " ".join(str(rng.randrange(99)) for _ in range(400))]
    got, words = [Counter() for _ in texts], None
    for docs, buckets, words in C._scans(pa.array(texts, pa.string()).cast(pa.binary())):
        for d, b in zip(docs.tolist(), buckets.tolist()):
            got[d][b] += 1
    assert [(int(n), c) for n, c in zip(words, got)] == [features(t) for t in texts]
