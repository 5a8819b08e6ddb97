"""Document fingerprints by winnowing.

Every run of K code points is hashed with a rolling polynomial; of each window of
WINDOW consecutive hashes the least is chosen, the rightmost where several tie, and
its position is kept. Two texts that share a run of K + WINDOW - 1 code points share
at least one chosen hash (the match guarantee).
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sentspark.llm.kernels import mix

K = 24
WINDOW = 17
BUCKETS_PER_PARTITION = 4

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_FIRST = -(1 << 63)     # stands for a NULL doc_id in the order


def gram_hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    """Polynomial hash of every run of ``k`` code points, built by doubling; one hash
    of the whole text if it is shorter."""
    k = min(k, len(codes))
    if k == 0:
        return np.zeros(0, np.uint64)
    level = mix(codes.astype(np.uint64) + _U(1))
    done, total, span = 0, None, 1
    rest = k
    while rest:
        if rest & 1:
            part = level[done:]
            if total is None:
                total = part
            else:
                size = len(codes) - done - span + 1
                total = total[:size] * _U(pow(_BASE, span, 1 << 64)) + part[:size]
            done += span
        rest >>= 1
        if rest:
            level = level[:-span] * _U(pow(_BASE, span, 1 << 64)) + level[span:]
            span *= 2
    return mix(total[:len(codes) - k + 1] + _U(k))


def winnow(codes: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions, in order of position."""
    values = gram_hashes(codes, k)
    hashes, count = values, len(values)
    if count == 0:
        return values, np.zeros(0, np.int64)
    window = min(window, count)
    places, span = np.arange(count), 1

    def join(shift):
        left, right = values[:-shift], values[shift:]
        later = right <= left
        return np.where(later, right, left), np.where(later, places[shift:], places[:-shift])

    while 2 * span <= window:
        values, places = join(span)
        span *= 2
    if window > span:
        values, places = join(window - span)
    chosen = places[np.flatnonzero(np.r_[True, places[1:] != places[:-1]])]
    return hashes[chosen], chosen


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def digest(hashes: np.ndarray, places: np.ndarray) -> str:
    """Short name of a fingerprint: equal exactly if hashes and positions are equal,
    but for chance collisions of 128 bits."""
    return hashlib.blake2b(hashes.tobytes() + places.astype("<i8").tobytes(), digest_size=16).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two sorted sets of distinct hashes; 1 if both are empty."""
    if len(a) == 0 and len(b) == 0:
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, hashes and positions of each row of ``docs`` (doc_id, text). A NULL or
    empty text has none; a text shorter than ``k`` has one hash, at position 0."""
    def each(batches):
        for batch in batches:
            found = [winnow(codes_of(t or ""), k, window) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())),
                pa.array([p for _, p in found], pa.list_(pa.int64())),
            ], names=["doc_id", "hashes", "positions"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, hashes array<long>, positions array<long>")


def _against_next(batches, k: int, window: int):
    """From rows sorted by (bucket, copy, doc_id): each row beside the row after it. Of
    the rows only the last one is held."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "n_selected", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64()]
    held = None

    def row(this, following):
        _, doc, text, codes, (hashes, places), known = this
        half = len(codes) // 2
        edited = text[:len(text) - half] + following[2][:half]
        other, spots = winnow(codes_of(edited), k, window)
        return (doc, len(codes), hashlib.sha256(edited.encode()).hexdigest(), digest(hashes, places), digest(other, spots),
                len(hashes), likeness(known, np.unique(other)), likeness(known, following[5]))

    for batch in batches:
        out = []
        for bucket, copy, doc, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "copy", "doc_id", "text"))):
            if copy and held is None:    # a further row with the id of the next bucket's first
                continue
            codes = codes_of(text)
            found = winnow(codes, k, window)
            now = (bucket, doc, text, codes, found, np.unique(found[0]))
            if held is not None:
                out.append(row(held, now))
            held = None if copy else now
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def fingerprint_edits(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of its edited form, and how like they are.

    The edited form ends with the start of the next document by ascending doc_id (the
    first one after the last): the last floor(n/2) code points give way to as many
    from there, or to all it has. Rows are dealt to buckets by doc_id and sorted there;
    the first rows of a bucket are also copied to the end of the one before it, so each
    row finds its successor in its own task. One shuffle; no window spans the table.

    NULL text counts as empty; NULL doc_id comes first; rows with one id are ordered by
    text; identical rows follow each other. A single row is its own successor. Empty
    against empty is 1 alike. No rows in, no rows out. Texts are read whole, however
    long. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = F.coalesce("doc_id", F.lit(_FIRST))
    count = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.stat.approxQuantile("doc_id", [i / count for i in range(1, count)], 0.1 / count))) if count > 1 else []
    bounds = np.array([int(c) for c in cuts], np.int64)

    @F.pandas_udf("int")
    def bucket_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), "right").astype(np.int32))

    # One row per bucket: their number is fixed by the number of partitions.
    heads = (
        docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("key")).withColumn("bucket", bucket_of("key"))
        .groupBy("bucket").agg(F.min("key").alias("key")).orderBy("bucket").collect()
    )
    before = {h["key"]: heads[i - 1]["bucket"] for i, h in enumerate(heads)}

    @F.pandas_udf("array<struct<bucket:int,copy:boolean>>")
    def places(key: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, key.to_numpy(), "right").tolist()
        return pd.Series([
            [{"bucket": b, "copy": False}] + ([{"bucket": before[x], "copy": True}] if x in before else [])
            for b, x in zip(own, key.tolist())
        ])

    return (
        rows.withColumn("place", F.explode(places(order))).select("place.bucket", "place.copy", "doc_id", "text")
        .repartition("bucket").sortWithinPartitions("bucket", "copy", F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(partial(_against_next, k=k, window=window),
                    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
                    " n_selected long, near_edited double, near_next double")
    )
