"""Label columns to codes and back, on whole tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from sentspark.functions.labels import TRAIN_CODES, decode, encode, inverse, is_mapped


def encode_labels(df: DataFrame, mapping: Mapping[str, int | float] = TRAIN_CODES, label: str = "label",
                  output: str = "label_encoded", strict: bool = True) -> DataFrame:
    """Adds the codes. The column itself fails on an unmapped label, but only where it
    is read: a count prunes it. ``strict`` therefore looks for one offender now."""
    if strict:
        found = df.where(~is_mapped(F.col(label), mapping)).select(label).take(1)
        if found:
            raise ValueError(f"label outside the mapping: {found[0][0]!r}")
    return df.withColumn(output, encode(F.col(label), mapping))


def decode_labels(df: DataFrame, mapping: Mapping[str, int] = TRAIN_CODES, code: str = "label_encoded",
                  output: str = "label") -> DataFrame:
    return df.withColumn(output, decode(F.col(code), inverse(mapping)))
