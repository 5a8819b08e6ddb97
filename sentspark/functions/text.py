"""Text splitting and fixed-length token arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Special tokens and their ids, the word pattern, the digit pattern.
SPECIAL_TOKENS = {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3}
PAD_ID, UNK_ID, CLS_ID, SEP_ID = 0, 1, 2, 3
WORD_PATTERN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
DIGITS_FROM_RIGHT = r"\d{1,3}(?=(\d{3})*\b)"

# Piece separator, and the escapes for texts that hold the separator themselves.
_MARK, _ESCAPE = "\u0001", "\u0002"


def words(text: Column) -> Column:
    """Lower-cased words and single punctuation marks, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def _cut_at_marks(text: Column) -> Column:
    marked = F.regexp_replace(text, "(?U)" + DIGITS_FROM_RIGHT, _MARK + "$0" + _MARK)
    return F.filter(F.split(marked, _MARK), lambda piece: piece != "")


def digit_pieces(text: Column) -> Column:
    """Cut digit runs into groups of three counted from the right; the pieces put
    together give the input back. ``(?U)`` makes ``\\d`` and ``\\b`` Unicode-aware.
    """
    def swap(value, old, new):
        return F.replace(value, F.lit(old), F.lit(new))

    escaped = swap(swap(text, _ESCAPE, _ESCAPE + "b"), _MARK, _ESCAPE + "a")
    restored = F.transform(
        _cut_at_marks(escaped),
        lambda piece: swap(swap(piece, _ESCAPE + "a", _MARK), _ESCAPE + "b", _ESCAPE),
    )
    clash = F.contains(text, F.lit(_MARK)) | F.contains(text, F.lit(_ESCAPE))
    return F.when(clash, restored).otherwise(_cut_at_marks(text))


def pad_ids(ids: Column, max_length: int, keep: str = "head", pad_id: int = PAD_ID) -> Column:
    """Cut to ``max_length`` keeping the head or the tail, then pad at the end."""
    if keep not in ("head", "tail"):
        raise ValueError("keep must be 'head' or 'tail'")
    start = F.lit(1) if keep == "head" else F.greatest(F.size(ids) - max_length + 1, F.lit(1))
    kept = F.slice(ids, start, max_length)
    return F.concat(kept, F.array_repeat(F.lit(pad_id), max_length - F.size(kept)))


def attention_mask(length: Column, max_length: int) -> Column:
    """1 for real tokens, 0 for padding."""
    real = F.least(length, F.lit(max_length))
    return F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), max_length - real))


def count_non_pad(ids: Column, pad_id: int = PAD_ID) -> Column:
    return F.size(F.filter(ids, lambda t: t != pad_id))
