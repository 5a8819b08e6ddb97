"""Target-distribution importance resampling over hashed word n-grams.

Every run of 1 to 3 words is a feature; its bucket is the CRC-32 of its bytes modulo
BUCKETS. A document, brought to words with one separator after each, is scanned once and
the CRC so far is kept behind every separator. CRC is linear over GF(2):
crc(AB) = crc(A) shifted by the length of B, plus crc(B). So the CRC of any run of words
follows from the two prefixes around it: the shifted one cancels out what lies before.
The separator at the end of a run is taken back by the inverse shift of one byte.

Documents are weighted by the log ratio of the bucket frequencies in the target and in
all documents; adding Gumbel noise and taking the highest scores draws without
replacement in proportion to the weights' exponentials.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sentspark.llm.scratch import Scratch, keep, scratch

BUCKETS = 10_000
LONGEST = 3             # words in a feature
LEAST_WORDS = 20
DRAWN_PERCENT = 5
SEED = 42

WORDS_AT_ONCE = 1 << 17
PIECE_BYTES = 1 << 20   # text split into words at a time

_POLYNOMIAL = 0xEDB88320
_SPAN = 256             # shifts of less bytes than this have a table each

#: Bytes that aren't part of a word become separators, A-Z become small letters.
_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def _byte_table() -> np.ndarray:
    """What the CRC of one byte adds; also how a register moves on by one zero byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    return table


_BYTE = _byte_table()
_BEFORE = np.argsort(_BYTE >> np.uint32(24)).astype(np.uint32)     # the byte whose entry has this top byte


def _move(values: np.ndarray) -> np.ndarray:
    """One zero byte further."""
    return (values >> np.uint32(8)) ^ _BYTE[values & np.uint32(255)]


def _take_back(values: np.ndarray) -> np.ndarray:
    """One zero byte back."""
    low = _BEFORE[values >> np.uint32(24)]
    return ((values ^ _BYTE[low]) << np.uint32(8)) | low


def _apply(tables: np.ndarray, which: np.ndarray | int, values: np.ndarray) -> np.ndarray:
    """The linear map number ``which`` by its values on the four bytes."""
    base = np.asarray(which, np.int64) * 1024
    found = tables[base + (values & np.uint32(255))]
    for i in range(1, 4):
        found ^= tables[base + 256 * i + ((values >> np.uint32(8 * i)) & np.uint32(255))]
    return found


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """Tables of the shifts by 0.._SPAN - 1 bytes, and by _SPAN * 2 ** k bytes."""
    now = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
    small = []
    for _ in range(_SPAN):
        small.append(now)
        now = _move(now)
    large = []
    for _ in range(32):
        large.append(now)
        now = _apply(now, 0, now)
    return np.concatenate(small), np.concatenate(large)


_SMALL, _LARGE = _shift_tables()


def shift(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs moved on by as many zero bytes as ``lengths`` says."""
    moved = _apply(_SMALL, lengths % _SPAN, values)
    rest, k = lengths // _SPAN, 0
    while rest.any():
        at = np.flatnonzero(rest & 1)
        moved[at] = _apply(_LARGE, k, moved[at])
        rest, k = rest >> 1, k + 1
    return moved


_SEPARATOR = np.uint32(zlib.crc32(b" "))


def _feed(crc: int, word: bytes) -> int:
    return zlib.crc32(b" ", zlib.crc32(word, crc))


class _Scan:
    """Prefix CRCs of several documents, or pieces of a long one."""

    def __init__(self) -> None:
        self.crcs, self.places, self.docs, self.held, self.words = [], [], [], [], 0

    def add(self, doc: int, words: list[bytes], before: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
        """Words that follow those behind ``before``, the CRCs and lengths of the last
        prefixes. Returns the last prefixes up to here."""
        crcs = before[0][:-1] + list(accumulate(words, _feed, initial=before[0][-1]))
        at = before[1][:-1] + list(accumulate(map(len, words), lambda a, n: a + n + 1, initial=before[1][-1]))
        self.crcs.append(crcs)
        self.places.append(at)
        self.docs.append(doc)
        self.held.append(len(before[0]) - 1)
        self.words += len(words)
        return crcs[-LONGEST:], at[-LONGEST:]

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Document and bucket of every feature that ends in a word added here."""
        sizes = np.array([len(c) for c in self.crcs])
        crcs = np.fromiter((x for c in self.crcs for x in c), np.uint32, sizes.sum())
        places = np.fromiter((x for p in self.places for x in p), np.int64, sizes.sum())
        inside = np.arange(len(crcs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        new = inside > np.repeat(np.array(self.held), sizes)
        docs = np.repeat(np.array(self.docs), sizes)
        owners, buckets = [], []
        for k in range(1, LONGEST + 1):
            end = np.flatnonzero(new & (inside >= k))
            run = crcs[end] ^ shift(crcs[end - k], places[end] - places[end - k])
            owners.append(docs[end])
            buckets.append(_take_back(run ^ _SEPARATOR) % np.uint32(BUCKETS))
        return np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of ``text``, cut between words into pieces of bounded size."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        stop = folded.find(b" ", at + PIECE_BYTES) if at + PIECE_BYTES < len(folded) else -1
        stop = len(folded) if stop < 0 else stop
        if words := folded[at:stop].split():
            yield words
        at = stop


def _scans(texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, bucket) of all features and words per document, WORDS_AT_ONCE at a time."""
    count = len(texts)
    scan, words_of = _Scan(), np.zeros(count, np.int64)
    for doc, value in enumerate(texts):
        if not value.is_valid:
            continue
        before = ([0], [0])
        for words in _pieces(value.as_buffer().to_pybytes()):
            before = scan.add(doc, words, before)
            words_of[doc] += len(words)
            if scan.words >= WORDS_AT_ONCE:
                yield *scan.features(), words_of
                scan = _Scan()
    if scan.words:
        yield *scan.features(), words_of
    else:
        yield np.zeros(0, np.int64), np.zeros(0, np.int64), words_of


def _bucket_counts(batches) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, buckets, _ in _scans(batch.column("text").cast(pa.binary())):
            total += np.bincount(buckets, minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features per bucket over a whole table; BUCKETS numbers reach the driver."""
    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_bucket_counts, "bucket long, n long")
    total = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        total[bucket] = n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket, with one feature added to every bucket."""
    everything, wanted = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1.0) * everything / ((s + 1.0) * wanted)))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _weighted(batches, gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        features, weights = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        words = features
        for docs, buckets, words in _scans(batch.column("text").cast(pa.binary())):
            features += np.bincount(docs, minlength=batch.num_rows)
            # Sums of whole numbers below 2 ** 53 are exact in doubles.
            weights += np.bincount(docs, gain[buckets], batch.num_rows).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(features), pa.array(weights)],
                                         names=["doc_id", "n_words", "n_features", "weight"])


def weigh_documents(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (sum of the features' gains) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _weighted(batches, gain), "doc_id long, n_words long, n_features long, weight long")


def draw(weighed: DataFrame, percent: int, tmp: Scratch, seed: int = SEED, least: int = LEAST_WORDS) -> DataFrame:
    """``weighed`` with score and rank. Of the N rows with at least ``least`` words the
    floor(percent * N / 100) highest scores get ranks 1, 2, 3..., ties by doc_id (NULL
    last). One range shuffle of the numbers; no window spans the table."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = tmp.table(weighed.withColumn("score", F.col("weight") + noise).withColumn("open", F.col("n_words") >= least))
    drawn = percent * scored.where("open").count() // 100
    order = [F.col("open").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = tmp.table(scored.repartitionByRange(*order).sortWithinPartitions(*order)
                       .select("*", F.spark_partition_id().alias("part"), place.alias("place")))
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("size"))     # one row per partition
    ahead = sizes.select("part", (F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("size")).alias("ahead"))
    rank = F.col("ahead") + F.col("place") + 1
    return (ranged.join(F.broadcast(ahead), "part")
            .withColumn("rank", F.when(F.col("open") & (rank <= drawn), rank)).drop("part", "place", "ahead", "open"))


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank (NULL if not drawn) of every row of
    ``docs`` (doc_id, text), drawn towards the texts of ``target`` (text). Other columns
    are ignored, so their names can't clash.

    Words are runs of a-z, 0-9 and anything outside ASCII, A-Z lower-cased. NULL, empty
    and wordless texts have no features and weight 0. Repeated rows count and are drawn
    on their own; a NULL doc_id takes part with an empty id. Texts are read whole, in
    pieces. No rows in, no rows out; an empty target leaves gains by frequency alone.
    """
    with scratch(docs.sparkSession, "resample") as tmp:
        gain = gains(bucket_counts(docs), bucket_counts(target))
        result = draw(weigh_documents(docs, gain), percent, tmp)
        return keep(result.select("doc_id", "n_features", "weight", "score", "rank"))
