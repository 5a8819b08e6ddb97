"""Language identification, words first.

A known word scores by its log frequency in each language. An unseen word falls back
to its character n-grams (word edges included), the longest first: the first length
with any known n-gram decides, by the mean over its known ones. Scores are summed over
the words of the whole text and decide the language; its posterior by the evidence of
EVIDENCE average words, however long the text is, is the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from sentspark.llm.kernels import mix
from sentspark.llm.scratch import scratch

SAMPLE_ROWS = 1500      # labelled documents of each language the tables are counted on
KEPT_WORDS = 10_000     # most frequent words of each language
KEPT_GRAMS = {5: 10_000, 4: 8_000, 3: 4_000, 2: 1_000, 1: 150}     # and n-grams
SMOOTHING = 0.5
EVIDENCE = 8            # words whose evidence makes a posterior
SLICE_CHARS = 1 << 17
ROWS_AT_ONCE = 512      # rows scored at a time
UNDECIDED = "und"

_U = np.uint64
_EDGE = 0x20
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


@dataclass
class Model:
    languages: list[str]
    keys: dict[int, np.ndarray]      # by kind (0: words, n: n-grams): sorted hashes
    scores: dict[int, np.ndarray]    # log frequency of each key in each language


def _gram_hash(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the run of ``n`` codes from each position; short at the end."""
    size = max(0, len(codes) - n + 1)
    total = np.full(size, n, np.uint64)
    for i in range(n):
        total = mix(total * _U(0x9E3779B97F4A7C15) + codes[i:i + size].astype(np.uint64))
    return total


def _texts(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows as (first row, codes, word starts, word ends, row of each word).
    Codes are lower-cased and all but letters are edges."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size < SLICE_CHARS):
            size += len(texts[stop])
            stop += 1
        lowered = [t.lower() for t in texts[at:stop]]
        codes = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le"), np.uint32).copy()
        inside = letters()[codes]
        codes[~inside] = _EDGE
        change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = change[::2], change[1::2]
        bounds = np.cumsum([1] + [len(t) + 1 for t in lowered])
        yield at, codes, starts, ends, np.searchsorted(bounds, starts, "right") - 1
        at = stop


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 1): owners (0, 0, 1) and positions (0, 1, 0)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _word_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order-aware hash of each word: the sum of hashes of (letter, place)."""
    owner, place = _spread(ends - starts)
    each = mix(codes[starts[owner] + place].astype(np.uint64) * _U(0x100000001B3) + place.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))
    total = np.add.reduceat(each, np.cumsum(ends - starts) - (ends - starts)) if len(starts) else np.zeros(0, np.uint64)
    return mix(total + (ends - starts).astype(np.uint64))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in ``keys``, and which are there."""
    if len(keys) == 0:
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _count(batches):
    """Counts of hashed words and n-grams by language, summed per batch."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        names, code = np.unique(langs.astype(str), return_inverse=True)
        for first, codes, starts, ends, rows in _texts([t or "" for t in batch.column("text").to_pylist()]):
            lang = code[first + rows]
            kinds = [(0, _word_hash(codes, starts, ends), lang)]
            for n in KEPT_GRAMS:
                grams = _gram_hash(codes, n)
                owner, place = _spread(np.maximum(0, ends - starts + 2 - n + 1))
                kinds.append((n, grams[starts[owner] - 1 + place], lang[owner]))
            for kind, hashes, owner in kinds:
                if len(hashes) == 0:
                    continue
                order = np.lexsort((hashes, owner))
                h, o = hashes[order], owner[order]
                cut = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(cut), kind, np.int32)), pa.array(h[cut].view(np.int64)), pa.array(names[o[cut]].tolist(), pa.string()),
                    pa.array(np.diff(np.r_[cut, len(h)]).astype(np.int64)),
                ], names=["kind", "hash", "lang", "n"])


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Word and n-gram tables from ``rows`` (doc_id, text, lang; NULL text or lang is
    passed over): counted on those ``sample_rows`` rows of each language that come first
    by a hash of doc_id, or on all if there are fewer, and cut to the most frequent
    entries of each language. Those bounds, per language, fix the size of the model,
    which goes to every task; a language is learned from its own rows, however few of
    all they are."""
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    # Spark keeps the first of each language before the shuffle as well.
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("doc_id", "lang").withColumn("place", F.row_number().over(first)).where(F.col("place") <= sample_rows)
    counts = (
        rows.join(F.broadcast(chosen.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi").select("text", "lang")
        .mapInArrow(_count, "kind int, hash long, lang string, n long").groupBy("kind", "hash", "lang").agg(F.sum("n").alias("n"))
    )
    limit = F.lit(KEPT_WORDS)
    for kind, most in KEPT_GRAMS.items():
        limit = F.when(F.col("kind") == kind, most).otherwise(limit)
    most_frequent = Window.partitionBy("kind", "lang").orderBy(F.desc("n"), "hash")
    with scratch(rows.sparkSession, "languages") as tmp:
        counts = tmp.table(counts)
        kept = counts.withColumn("place", F.row_number().over(most_frequent)).where(F.col("place") <= limit).select("kind", "hash").distinct()
        entries = counts.join(F.broadcast(kept), ["kind", "hash"], "left_semi").toPandas()
    languages = sorted(entries["lang"].unique().tolist())
    keys, scores = {}, {}
    for kind in (0, *KEPT_GRAMS):
        part = entries[entries["kind"] == kind]
        table = part.pivot_table(index="hash", columns="lang", values="n", aggfunc="sum", fill_value=0).reindex(columns=languages, fill_value=0)
        hashes = table.index.to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(hashes)
        amount = table.to_numpy(float)[order] + SMOOTHING
        keys[kind], scores[kind] = hashes[order], np.log(amount / amount.sum(axis=0, keepdims=True)) if len(order) else amount
    return Model(languages, keys, scores)


def score_texts(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text; ``und`` and 0 where it has no letter."""
    total = np.zeros((len(texts), len(model.languages)))
    count = np.zeros(len(texts), np.int64)
    for first, codes, starts, ends, rows in _texts(texts):
        words = _word_hash(codes, starts, ends)
        _, place, back = np.unique(words, return_index=True, return_inverse=True)
        s, e, words = starts[place], ends[place], words[place]
        value = np.zeros((len(words), len(model.languages)))
        at, known = _find(model.keys[0], words)
        value[known] = model.scores[0][at[known]]
        left = np.flatnonzero(~known)
        for n in sorted(KEPT_GRAMS, reverse=True):
            if len(left) == 0:
                break
            owner, spot = _spread(np.maximum(0, e[left] - s[left] + 2 - n + 1))
            start = s[left][owner] - 1 + spot
            grams = np.full(len(start), n, np.uint64)
            for i in range(n):
                grams = mix(grams * _U(0x9E3779B97F4A7C15) + codes[start + i].astype(np.uint64))
            at, found = _find(model.keys[n], grams)
            hits = np.bincount(owner[found], minlength=len(left))
            for k in range(len(model.languages)):
                value[left, k] = np.bincount(owner[found], model.scores[n][at[found], k], minlength=len(left)) / np.maximum(hits, 1)
            left = left[hits == 0]
        for k in range(len(model.languages)):
            total[:, k] += np.bincount(first + rows, value[back, k], minlength=len(texts))
        count += np.bincount(first + rows, minlength=len(texts))
    if not model.languages:
        return [UNDECIDED] * len(texts), np.zeros(len(texts))
    best = total.argmax(axis=1)
    tempered = total * np.minimum(1.0, EVIDENCE / np.maximum(count, 1))[:, None]
    share = 1 / np.exp(tempered - tempered.max(axis=1, keepdims=True)).sum(axis=1)
    return [model.languages[b] if ok else UNDECIDED for b, ok in zip(best, count > 0)], np.where(count > 0, share, 0.0)


def _predict(batches, model: Model):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            langs, scores = score_texts([t or "" for t in part.column("text").to_pylist()], model)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row of ``docs`` (doc_id, text).

    NULL, empty or letterless text: ``und``, 0. Ties go to the language first by name.
    Without any language learned all are ``und``. NULL doc_id is handed on; repeated
    rows come out as often as they went in; no rows in, no rows out. Texts are read
    whole, however long, nothing is shuffled;
    other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_predict, model=model), "doc_id long, lang_pred string, score double")


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` as struct ``row`` beside lang_pred and score, in one pass."""
    def each(batches):
        for batch in batches:
            row = batch.column("row")
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = row.slice(at, ROWS_AT_ONCE)
                langs, scores = score_texts([str(t) if t is not None else "" for t in pc.struct_field(part, "text").to_pylist()], model)
                yield pa.RecordBatch.from_arrays([part, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                                 names=["row", "lang_pred", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(each, f"row {kind}, lang_pred string, score double")


def held_out() -> Column:
    """Whether the document is kept from learning: crc32 of its doc_id, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
