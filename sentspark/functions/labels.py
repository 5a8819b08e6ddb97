"""Label vocabularies and class-code expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# The label words and the three code tables in use.
SUBJECTIVE = "SUBJ"
OBJECTIVE = "OBJ"
LABELS = ("OBJ", "SUBJ")
TRAIN_CODES = {"SUBJ": 0, "OBJ": 1}
HOLDOUT_CODES = {"OBJ": 0, "SUBJ": 1}
BASELINE_TARGETS = {"SUBJ": 1.0, "OBJ": 0.0}


def inverse(mapping: Mapping) -> dict:
    return {code: name for name, code in mapping.items()}


def _lookup(value: Column, mapping: Mapping) -> Column:
    items = list(mapping.items())
    out = F.when(value == F.lit(items[0][0]), F.lit(items[0][1]))
    for key, target in items[1:]:
        out = out.when(value == F.lit(key), F.lit(target))
    return out


def is_mapped(value: Column, mapping: Mapping) -> Column:
    """False for unknown values and for NULL."""
    return F.coalesce(value.isin(list(mapping)), F.lit(False))


def encode(label: Column, mapping: Mapping = TRAIN_CODES) -> Column:
    """Label word to code; a word outside ``mapping`` fails the query."""
    unknown = F.raise_error(
        F.concat(F.lit("label outside the mapping: "), F.coalesce(label.cast("string"), F.lit("NULL")))
    )
    return F.when(is_mapped(label, mapping), _lookup(label, mapping)).otherwise(unknown)


def decode(code: Column, mapping: Mapping) -> Column:
    """Code to label word (``mapping`` is code -> word); unknown codes give NULL."""
    return _lookup(code, mapping)


def threshold_label(score: Column, threshold: float = 0.5) -> Column:
    """Score at or above the threshold is subjective. NaN compares as larger than
    every number in Spark, so it is ruled out first; NULL and NaN are objective."""
    return F.when(~F.isnan(score) & (score >= F.lit(threshold)), SUBJECTIVE).otherwise(OBJECTIVE)


def argmax_index(logits: Column) -> Column:
    """Zero-based index of the largest element, first one on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def softmax(logits: Column) -> Column:
    peak = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp((x - peak).cast("double")))
    total = F.aggregate(raised, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(raised, lambda x: x / total)
