"""Per-row losses and the learning-rate factor."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def cross_entropy(probabilities: Column, code: Column) -> Column:
    """-log of the probability given to the true class."""
    return -F.log(F.get(probabilities, code))


def focal(probabilities: Column, code: Column, weight: Column, gamma: float = 2.0) -> Column:
    """Focal loss -w (1-p)^gamma log p of the true class."""
    if gamma < 0:
        raise ValueError("gamma must not be negative")
    p = F.get(probabilities, code)
    return -weight * F.pow(1 - p, F.lit(float(gamma))) * F.log(p)


def linear_warmup(step: Column, warmup_steps: int, total_steps: int) -> Column:
    """Rises from 0 to 1 over the warm-up, then falls linearly to 0."""
    rising = step.cast("double") / float(max(1, warmup_steps))
    falling = (F.lit(float(total_steps)) - step) / float(max(1, total_steps - warmup_steps))
    return F.when(step < warmup_steps, rising).otherwise(F.greatest(F.lit(0.0), falling))
