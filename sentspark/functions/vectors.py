"""Expressions over array-of-number columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def euclidean(a: Column, b: Column) -> Column:
    def squared(x, y):
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return F.sqrt(total(F.zip_with(a, b, squared)))


def pool_first(token_vectors: Column) -> Column:
    """The vector of the first token."""
    return F.element_at(token_vectors, 1)


def pool_mean(token_vectors: Column, mask: Column) -> Column:
    """Mean over the tokens whose mask is 1; NULL if the mask is empty."""
    kept = F.filter(
        F.arrays_zip(token_vectors.alias("vec"), mask.alias("keep")), lambda t: t["keep"] == 1
    )
    width = F.size(F.element_at(token_vectors, 1))
    zeros = F.array_repeat(F.lit(0.0), width)
    summed = F.aggregate(
        kept, zeros,
        lambda acc, t: F.zip_with(acc, t["vec"], lambda x, y: x + y.cast("double")),
    )
    count = F.size(kept)
    return F.when(count > 0, F.transform(summed, lambda x: x / count))
