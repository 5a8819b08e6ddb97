"""Vocabulary and fixed-length token arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sentspark.functions.text import (
    CLS_ID, PAD_ID, SEP_ID, SPECIAL_TOKENS, UNK_ID, attention_mask, count_non_pad, digit_pieces, pad_ids, words,
)
from sentspark.operators.profile import describe_counts
from sentspark.scratch import scratch
from sentspark.session import materialize

MAX_VOCABULARY = 1 << 20   # the vocabulary travels to every Python worker


# Splitting steps by name; each takes a text and gives its pieces in order.
STEPS: dict[str, Callable[[Column], Column]] = {"digits": digit_pieces, "words": words}


def split_by(text: Column, steps: Sequence[str] = ("words",)) -> Column:
    """The pieces of a text after one splitting step on the pieces of the other."""
    pieces = STEPS[steps[0]](text)
    for step in steps[1:]:
        pieces = F.flatten(F.transform(pieces, STEPS[step]))
    return pieces


def settings_steps(r2l: bool) -> tuple[str, ...]:
    """The splitting steps of a run: digits from the right go first if asked for."""
    return ("digits", "words") if r2l else ("words",)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _find_in_order(text: pa.Array, pieces: pa.Array) -> pa.Array:
    found = []
    for whole, parts in zip(text.to_pylist(), pieces.to_pylist()):
        if whole is None or parts is None:
            found.append(None)
            continue
        at, starts = 0, []
        for part in parts:
            at = whole.find(part, at)
            starts.append(at)
            at += len(part)
        found.append(starts)
    return pa.array(found, pa.list_(pa.int32()))


def piece_offsets(text: Column, steps: Sequence[str] = ("words",)) -> Column:
    """Where each piece starts in the lower-cased text, in code points from 0."""
    lowered = F.lower(text)
    return _find_in_order(lowered, split_by(lowered, steps))


def vocabulary(df: DataFrame, size: int, text: str = "sentence", steps: Sequence[str] = ("words",)) -> DataFrame:
    """(token, id, n): the ``size`` most frequent words, equal counts in word order;
    ids follow the special tokens.

    No sort spans all words: a histogram of the counts, one row per different count,
    tells the least count that gets in. Words above it are taken as they are, and of
    those at it, however many, each task keeps its first in word order. The last
    ranking has ``size`` rows.
    """
    if size > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary holds at most {MAX_VOCABULARY} words")
    counts = df.select(F.explode(split_by(F.col(text), steps)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    with scratch(df.sparkSession, "words") as tmp:
        counts = tmp.table(counts)
        per_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
        up_to = F.sum("words").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n")))
        edge = per_count.select("n", "words", up_to.alias("up_to")).where(F.col("up_to") >= size).orderBy(F.desc("n")).first()
        if edge is None:
            chosen = counts
        else:
            tied = counts.where(F.col("n") == edge["n"]).orderBy("token").limit(size - (edge["up_to"] - edge["words"]))
            chosen = counts.where(F.col("n") > edge["n"]).unionByName(tied)
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "token"))
        return materialize(chosen.select("token", (place + (len(SPECIAL_TOKENS) - 1)).alias("id"), "n"), "vocabulary")


class _Known:
    """The vocabulary on a worker; its look-up table is made once, not for every batch."""

    def __init__(self, tokens: list[str], ids: list[int]) -> None:
        self.tokens, self.ids, self._places = tokens, ids, None

    def __getstate__(self) -> dict:
        return {"tokens": self.tokens, "ids": self.ids, "_places": None}

    def find(self, tokens: pa.Array) -> pa.Array:
        if self._places is None:
            self._places = dict(zip(self.tokens, self.ids))
        distinct = tokens.dictionary_encode()
        ids = pa.array([self._places.get(t, UNK_ID) for t in distinct.dictionary.to_pylist()], pa.int32())
        return pc.fill_null(pc.take(ids, distinct.indices), UNK_ID)


def _lookup_udf(vocab: DataFrame):
    """Word arrays to id arrays: the distinct words of an Arrow batch are looked up."""
    rows = vocab.select("token", "id").collect()
    if len(rows) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary holds at most {MAX_VOCABULARY} words")
    shared = vocab.sparkSession.sparkContext.broadcast(_Known([r["token"] for r in rows], [r["id"] for r in rows]))

    @F.arrow_udf("array<int>")
    def lookup(tokens: pa.Array) -> pa.Array:
        found = shared.value.find(tokens.flatten())
        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("int32")
        return pa.ListArray.from_arrays(pa.array(offsets), found, mask=pc.is_null(tokens) if tokens.null_count else None)

    return lookup


def tokenize(df: DataFrame, vocab: DataFrame, max_length: int, text: str = "sentence", keep: str = "head",
             add_special_tokens: bool = True, token_types: bool = False, steps: Sequence[str] = ("words",),
             padding: str | bool = "max_length", truncation: bool = True) -> DataFrame:
    """Adds ``input_ids`` and ``attention_mask`` (and ``token_type_ids``).

    ``keep='head'`` cuts the words so that both special tokens fit; ``keep='tail'``
    adds the special tokens first and keeps the end of the sequence. Words that
    the cut drops are not looked up. Without ``truncation`` nothing is cut. ``padding``
    fills up to ``max_length``, up to the longest row ("longest" or True), or not at all
    (False or "do_not_pad").
    """
    listed = split_by(F.col(text), steps)
    extra = 2 if add_special_tokens else 0
    if keep not in ("head", "tail"):
        raise ValueError("keep must be 'head' or 'tail'")
    if not truncation:
        cut, cls_fits = F.col("_words"), F.lit(True)
    elif keep == "head":
        cut = F.slice(F.col("_words"), 1, max(max_length - extra, 0))
        cls_fits = F.lit(True)
    else:
        room = max_length - (1 if add_special_tokens else 0)
        cut = F.slice(F.col("_words"), F.greatest(F.size("_words") - room + 1, F.lit(1)), room)
        cls_fits = F.size("_words") + extra <= max_length
    ids = F.col("_ids")
    if add_special_tokens:
        front = F.when(cls_fits, F.array(F.lit(CLS_ID))).otherwise(F.array().cast("array<int>"))
        ids = F.concat(front, ids, F.array(F.lit(SEP_ID)))
    out = (
        df.withColumn("_words", listed)
        .withColumn("_ids", _lookup_udf(vocab)(cut))
        .withColumn("_ids", ids)
    )
    length = _padded_length(out, max_length, padding)
    # What isn't cut may be longer than what is filled up.
    whole = F.greatest(F.size("_ids"), length)
    out = out.withColumns({
        "input_ids": F.concat(F.col("_ids"), F.array_repeat(F.lit(PAD_ID), whole - F.size("_ids"))),
        "attention_mask": F.concat(F.array_repeat(F.lit(1), F.size("_ids")), F.array_repeat(F.lit(0), whole - F.size("_ids"))),
    })
    if token_types:
        out = out.withColumn("token_type_ids", F.array_repeat(F.lit(0), whole))
    return out.drop("_words", "_ids")


def _padded_length(df: DataFrame, max_length: int, padding: str | bool) -> Column:
    if padding == "max_length":
        return F.lit(max_length)
    if padding in (False, "do_not_pad"):
        return F.size("_ids")
    if padding in (True, "longest"):
        return df.agg(F.coalesce(F.max(F.size("_ids")), F.lit(0)).alias("longest")).scalar()
    raise ValueError(f"unknown padding {padding!r}")


def tokenize_with(df: DataFrame, tokenizer_factory: Callable, max_length: int, text: str = "sentence") -> DataFrame:
    """The same with an outside tokenizer: ``tokenizer_factory()`` is called once per
    Python worker and returns ``f(list[str]) -> list[list[int]]``, special tokens
    included."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = tokenizer_factory()
        for batch in batches:
            yield pd.Series([np.asarray(ids, dtype="int32") for ids in tokenizer(batch.tolist())])

    return (
        df.withColumn("_ids", encode(F.col(text)))
        .withColumn("input_ids", pad_ids(F.col("_ids"), max_length))
        .withColumn("attention_mask", attention_mask(F.size("_ids"), max_length))
        .drop("_ids")
    )


def token_stats(tokens: DataFrame, by: tuple[str, ...] = (), pad_id: int = PAD_ID) -> DataFrame:
    """Profile of the number of real tokens per row."""
    counted = tokens.select(*by, count_non_pad(F.col("input_ids"), pad_id).alias("n_tokens"))
    return describe_counts(counted, "n_tokens", by)


def split_digits(df: DataFrame, text: str = "sentence") -> DataFrame:
    """Adds ``pieces``: the text cut by the digits-from-the-right rule."""
    return df.withColumn("pieces", digit_pieces(F.col(text)))
