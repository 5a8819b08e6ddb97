"""Vectorised text kernels for Arrow batches: word bounds, 64-bit word hashes and
word shingles of many documents at once, straight from the Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20   # text handled at a time; one longer document is handled alone
SHINGLE_BYTES = 1 << 17 # the same for shingles, which take some 50 bytes for each of text

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_PLACE = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) | _U(1)
_powers: dict[str, np.ndarray] = {}


def powers(base: int, count: int, name: str) -> np.ndarray:
    """base**i modulo 2**64 for i below ``count``."""
    have = _powers.get(name)
    if have is None or len(have) < count:
        size = max(2 * SHINGLE_BYTES, 1 << (count - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:count]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in the bytes) for runs of
    rows of about ``limit`` bytes. NULL counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    if len(texts) == 0:
        return
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    bounds = np.frombuffer(places, wide)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        yield first, last, raw[bounds[first]:bounds[last]], bounds[first:last + 1] - bounds[first]
        first = last


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what is made of a batch of
    long texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes other than 0x20 and 0x09-0x0D) and
    the number of words per row."""
    inside = ~_SPACE[data]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.empty_like(inside)
    if len(inside):
        before[1:] = inside[:-1]
        before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    if len(inside):
        after[:-1] = inside[1:]
        after[-1] = False
        after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """64-bit hash of the bytes of each span, after the byte map ``fold``."""
    size = len(data)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTE[fold[data]] * powers(_BASE, size, "base"), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(_UNBASE, size + 1, "unbase")[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words of one row; of all its words if it has fewer."""
    k = min(k, len(words))
    if k == 0:
        return words[:0]
    count = len(words) - k + 1
    total = np.full(count, k, np.uint64)
    for i in range(k):
        total = total + words[i:i + count] * _PLACE[i]
        total ^= total >> _U(29)
    return mix(total)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row; words are lower-cased A-Z."""
    for _, _, data, offsets in slices(texts, SHINGLE_BYTES):
        starts, ends, counts = word_bounds(data, offsets)
        hashes = span_hashes(data, starts, ends, LOWER)
        at = 0
        for n in counts.tolist():
            yield np.unique(windows(hashes[at:at + n], k))
            at += n
