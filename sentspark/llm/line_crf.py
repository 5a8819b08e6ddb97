"""Line sequence labelling by a linear-chain conditional random field.

Each line of a text is content or boilerplate. A line's evidence is a set of binary
features; neighbouring lines are tied by transition weights. Viterbi decoding finds
the most probable labelling of the whole text, and the share of words in content
lines decides whether it is kept.

The field is trained here, on a bounded sample of documents labelled for quality. Lines
are labelled on their own: content are the lines of good documents but for notices,
lines of symbols and copies of an earlier line, which are boilerplate in good documents
as well; the lines of bad documents are boilerplate.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sentspark.llm.kernels import LOWER, mix, slices, span_hashes, windows, word_bounds

SAMPLE_DOCS = 2000      # labelled documents for training, half of each kind
SAMPLE_LINES = 400      # lines in a row of one of them that training reads, from anywhere in it
STEPS = 150
RIDGE = 1.0
CONTENT_SHARE = 0.5
FEATURES = 24

_U = np.uint64
_BOILERPLATE = np.uint32(1 << 2 | 1 << 12 | 1 << 13)    # features: symbols, copy, notice
_NOTICE = ("rights reserved", "copyright", "licensed under", "license", "cookies", "terms of use", "privacy policy")


def _table(characters: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[[ord(c) for c in characters]] = True
    return found


_SYMBOL = _table("#*$%&|<>")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _table("abcdefghijklmnopqrstuvwxyz")
_LETTER[0xC3:0xC6] = True       # lead bytes of most accented Latin letters
_DIGIT = _table("0123456789")
_BANG = _table("!?")
_STOP = _table(".!?:;\"')")


@dataclass
class Field:
    """unary[label, feature], move[from, to], begin[label]; label 1 is content."""

    unary: np.ndarray
    move: np.ndarray
    begin: np.ndarray


@dataclass
class Measured:
    """One run of rows: counts per row, and per line its row, words and features."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_row: np.ndarray
    line_words: np.ndarray
    bits: np.ndarray        # uint32 per line: feature i is bit i


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of set flags between consecutive bounds."""
    running = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=running[1:])
    return running[bounds[1:]] - running[bounds[:-1]]


def measure(data: np.ndarray, offsets: np.ndarray) -> Measured:
    """Counts and line features of a run of rows given as bytes and offsets."""
    rows = len(offsets) - 1
    starts, ends, counts = word_bounds(data, offsets)
    words = span_hashes(data, starts, ends)
    owner = np.repeat(np.arange(rows), counts)

    # Repeated windows of three words, within a row.
    repeated = np.zeros(len(words), bool)
    if len(words) > 2:
        grams = mix(windows(words, 3) + mix(owner[:-2].astype(np.uint64)))
        valid = owner[:-2] == owner[2:]
        _, back, times = np.unique(grams[valid], return_inverse=True, return_counts=True)
        at = np.flatnonzero(valid)[times[back] > 1]
        for i in range(3):
            repeated[at + i] = True

    # Lines: cut at \n and at row ends.
    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.r_[offsets[:-1], breaks + 1, offsets[-1:]])
    line_row = np.searchsorted(offsets, line_starts[:-1], "right") - 1
    first_word = np.searchsorted(starts, line_starts)
    line_words = np.diff(first_word)
    # Only lines with a word count; the others carry no label.
    keep = np.flatnonzero(line_words > 0)
    bounds_a, bounds_b = line_starts[keep], line_starts[keep + 1]
    line_row, word_a, line_words = line_row[keep], first_word[keep], line_words[keep]
    line_ends = bounds_b - ((bounds_b > bounds_a) & (data[np.maximum(bounds_b - 1, 0)] == 10) if len(data) else 0)
    hashes = mix(span_hashes(data, bounds_a, line_ends) + mix(line_row.astype(np.uint64)))
    _, first = np.unique(hashes, return_index=True)
    copy = np.ones(len(hashes), bool)
    copy[first] = False

    inside = (data & 0xC0) != 0x80
    space = np.isin(data, (9, 10, 11, 12, 13, 32))

    def per_line(flags):
        running = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=running[1:])
        return running[bounds_b] - running[bounds_a]

    chars = np.maximum(1, per_line(inside & ~space))
    symbols, upper, letter = per_line(_SYMBOL[data]), per_line(_UPPER[data]), np.maximum(1, per_line(_LETTER[data]))
    digits, bangs = per_line(_DIGIT[data]), per_line(_BANG[data])
    same = np.zeros(len(words) + 1, bool)
    if len(words) > 1:
        same[1:-1] = words[1:] == words[:-1]
    stutter = _sums(same[:-1], np.r_[word_a, len(words)]) if len(keep) else word_a
    again = _sums(repeated, np.r_[word_a, len(words)]) if len(keep) else word_a
    last = data[np.maximum(ends[word_a + line_words - 1] - 1, 0)] if len(keep) else data[:0]
    opening = data[starts[word_a]] if len(keep) else data[:0]
    notice = np.zeros(len(keep), bool)
    lowered = LOWER[data].tobytes()
    for cue in _NOTICE:
        at = lowered.find(cue.encode())
        while at >= 0:
            where = np.searchsorted(bounds_a, at, "right") - 1
            if where >= 0 and at < bounds_b[where]:
                notice[where] = True
            at = lowered.find(cue.encode(), at + 1)
    mean = chars / np.maximum(1, line_words)
    change = np.r_[True, line_row[1:] != line_row[:-1]] if len(keep) else np.zeros(0, bool)
    features = [
        np.ones(len(keep), bool),
        symbols * 20 > line_words, symbols * 5 > line_words, symbols > line_words,
        upper * 4 > letter, upper * 2 > letter,
        bangs * 5 > line_words, bangs > line_words,
        stutter * 10 > line_words, stutter * 2 > line_words,
        again * 4 > line_words, again * 2 > line_words,
        copy, notice,
        digits * 5 > chars, digits * 2 > chars,
        line_words < 4, line_words < 10, line_words >= 40,
        _STOP[last], _UPPER[opening] | (opening > 0xC2),
        mean < 3, mean > 10,
        change,
    ]
    bits = np.zeros(len(keep), np.uint32)
    for i, flag in enumerate(features):
        bits |= flag.astype(np.uint32) << np.uint32(i)
    return Measured(
        n_words=counts, word_chars=_sums(inside & ~space, offsets), n_symbols=_sums(_SYMBOL[data], offsets),
        n_dup_lines=np.bincount(line_row[copy], minlength=rows),
        n_repeat_words=np.bincount(owner[repeated], minlength=rows),
        line_row=line_row, line_words=line_words, bits=bits,
    )


def _vectors(bits: np.ndarray) -> np.ndarray:
    return ((bits[:, None] >> np.arange(FEATURES, dtype=np.uint32)) & 1).astype(float)


def _by_step(line_row: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sequences in order of falling length: the first line of each, and for every step
    how many of them are that long."""
    firsts = np.flatnonzero(np.r_[True, line_row[1:] != line_row[:-1]])
    sizes = np.diff(np.r_[firsts, len(line_row)])
    order = np.argsort(-sizes, kind="stable")
    firsts, sizes = firsts[order], sizes[order]
    return firsts, [firsts[:n] + t for t, n in enumerate(np.searchsorted(-sizes, -np.arange(sizes[0]), "left"))] if len(sizes) else []


def decode(field: Field, line_row: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Viterbi labels of the lines, True for content; all sequences step together."""
    if len(bits) == 0:
        return np.zeros(0, bool)
    score = _vectors(bits) @ field.unary.T
    _, steps = _by_step(line_row)
    best = np.zeros((len(bits), 2))
    came = np.zeros((len(bits), 2), np.int8)
    best[steps[0]] = score[steps[0]] + field.begin
    for lines in steps[1:]:
        ways = best[lines - 1][:, :, None] + field.move      # (sequence, from, to)
        came[lines] = ways.argmax(axis=1)
        best[lines] = ways.max(axis=1) + score[lines]
    labels = np.zeros(len(bits), np.int8)
    final = np.r_[line_row[1:] != line_row[:-1], True]
    labels[final] = best[final].argmax(axis=1)
    for lines in reversed(steps[1:]):
        labels[lines - 1] = np.where(final[lines - 1], labels[lines - 1], came[lines, labels[lines]])
    return labels.astype(bool)


def train(line_row: np.ndarray, bits: np.ndarray, labels: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> Field:
    """Maximum likelihood with a ridge penalty: forward-backward gradients, Adam steps
    from zero. Without lines all weights stay zero and every tie is boilerplate."""
    x = _vectors(bits)
    size = 2 * FEATURES + 4 + 2
    weights, mean, square = np.zeros(size), np.zeros(size), np.zeros(size)

    def split(w):
        return Field(w[:2 * FEATURES].reshape(2, -1), w[2 * FEATURES:2 * FEATURES + 4].reshape(2, 2), w[-2:])

    if len(bits) == 0:
        return split(weights)
    firsts, order = _by_step(line_row)
    truth = np.eye(2)[labels.astype(int)]
    inner = np.flatnonzero(line_row[1:] == line_row[:-1])
    wanted = np.concatenate([
        (truth.T @ x).ravel(), (truth[inner].T @ truth[inner + 1]).ravel(), truth[firsts].sum(axis=0)])
    for t in range(1, steps + 1):
        field = split(weights)
        score = x @ field.unary.T
        ahead, back = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        ahead[order[0]] = score[order[0]] + field.begin
        for lines in order[1:]:
            ahead[lines] = np.logaddexp.reduce(ahead[lines - 1][:, :, None] + field.move, axis=1) + score[lines]
        for lines in reversed(order[1:]):
            back[lines - 1] = np.logaddexp.reduce(field.move + (back[lines] + score[lines])[:, None, :], axis=2)
        total = np.logaddexp.reduce(ahead + back, axis=1, keepdims=True)
        share = np.exp(ahead + back - total)
        pair = np.exp(ahead[inner][:, :, None] + field.move + (back[inner + 1] + score[inner + 1])[:, None, :] - total[inner][:, :, None])
        expected = np.concatenate([(share.T @ x).ravel(), pair.sum(axis=0).ravel(), share[firsts].sum(axis=0)])
        gradient = (expected - wanted + ridge * weights) / len(x)
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient ** 2
        weights = weights - 0.1 * (mean / (1 - 0.9 ** t)) / (np.sqrt(square / (1 - 0.999 ** t)) + 1e-8)
    return split(weights)


def _some_lines(bits: np.ndarray, doc: int) -> np.ndarray:
    """SAMPLE_LINES lines in a row, from a place that a hash of the document tells."""
    places = max(1, len(bits) - SAMPLE_LINES + 1)
    at = int(mix(np.array([doc], np.int64).view(np.uint64))[0] % _U(places))
    return bits[at:at + SAMPLE_LINES].astype(np.int64)


def _line_features(batches):
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        good = batch.column("good").to_numpy(zero_copy_only=False)
        for first, last, data, offsets in slices(batch.column("text")):
            found = measure(data, offsets)
            lines = [_some_lines(found.bits[found.line_row == r], ids[first + r]) for r in range(last - first)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[first:last], pa.array(good[first:last]), pa.array(lines, pa.list_(pa.int64()))],
                names=["doc_id", "good", "bits"])


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """Trains on at most ``sample_docs`` labelled documents: of each quality the
    ``sample_docs / 2`` that come first by a hash of doc_id. ``labels`` has doc_id and
    quality (1 good, 0 bad). Line features of the sample go to the driver, one integer
    a line and at most SAMPLE_LINES lines a document, whose place in the document a hash
    tells. Of rows that repeat a doc_id one counts."""
    known = labels.where("quality IN (0, 1)").select("doc_id", (F.col("quality") == 1).alias("good"))
    chosen = None
    for good in (True, False):
        part = known.where(F.col("good") == good).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen.dropDuplicates(["doc_id"])), "doc_id")
        .mapInArrow(_line_features, "doc_id long, good boolean, bits array<long>")
        .groupBy("doc_id", "good").agg(F.min("bits").alias("bits")).orderBy("doc_id").toPandas()
    )
    rows = rows[rows["bits"].map(len) > 0]
    if len(rows) == 0:
        return train(np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, bool))
    sizes = rows["bits"].map(len).to_numpy()
    bits = np.concatenate(rows["bits"].tolist()).astype(np.uint32)
    content = np.repeat(rows["good"].to_numpy().astype(bool), sizes) & (bits & _BOILERPLATE == 0)
    return train(np.repeat(np.arange(len(rows)), sizes), bits, content)


def _judge(batches, field: Field, share: float):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words"]
    for batch in batches:
        for first, last, data, offsets in slices(batch.column("text")):
            m = measure(data, offsets)
            content = decode(field, m.line_row, m.bits)
            words = np.bincount(m.line_row, m.line_words * content, minlength=last - first).astype(np.int64)
            failed = (m.n_words < 50) | (100 * m.n_repeat_words > 50 * m.n_words)
            kept = ~failed & (words >= share * m.n_words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[first:last]] + [pa.array(np.asarray(c, np.int64)) for c in
                 (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)]
                + [pa.array(failed), pa.array(kept), pa.array(words)], names=names)


def judge_lines(docs: DataFrame, field: Field, share: float = CONTENT_SHARE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): word and line counts, base_failed,
    kept, and content_words, the words in lines labelled content.

    Words are runs of bytes other than 0x20 and 0x09-0x0D; lines are cut at \\n and
    those without a word carry no label. kept: not base_failed, and at least ``share``
    of the words in content lines. NULL or empty text: all counts 0, base_failed, not
    kept. NULL doc_id is handed on; repeated rows come out as often as they went in.
    Texts are read whole, nothing is shuffled; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        partial(_judge, field=field, share=share),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
        " base_failed boolean, kept boolean, content_words long")
