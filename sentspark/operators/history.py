"""Best epoch and early stopping over a table of epoch scores."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sentspark.functions.losses import linear_warmup


def learning_rate_schedule(spark: SparkSession, total_steps: int, warmup_steps: int = 0,
                           learning_rate: float = 1.0) -> DataFrame:
    """(step, factor, learning_rate) for the steps 0..total_steps."""
    factor = linear_warmup(F.col("step"), warmup_steps, total_steps)
    return (
        spark.range(total_steps + 1).select(F.col("id").alias("step"))
        .select("step", factor.alias("factor"), (factor * learning_rate).alias("learning_rate"))
    )


def total_steps(epochs: int, batches: int, warmup_steps: int) -> int:
    return epochs * batches + warmup_steps


def best_epoch(history: DataFrame, run: str = "run_id", epoch: str = "epoch", score: str = "score") -> DataFrame:
    """(run, best_epoch, best_score); the first of equal scores wins."""
    best = F.max_by(F.struct(epoch, score), F.struct(F.col(score), -F.col(epoch)))
    return history.groupBy(run).agg(best.alias("best")).select(
        run, F.col("best")[epoch].alias("best_epoch"), F.col("best")[score].alias("best_score")
    )


def early_stopping(history: DataFrame, patience: int, run: str = "run_id", epoch: str = "epoch",
                   score: str = "score", floor: float = -1.0) -> DataFrame:
    """(run, epoch, score, improved, waited, status) with status ``logged``,
    ``stopped`` or ``not run``.

    An epoch improves if it beats everything before it. Training stops at the
    first epoch at which ``patience`` epochs in a row brought no improvement; that
    epoch is not logged. Windows run over the epochs of one run only.
    """
    by_run = Window.partitionBy(run).orderBy(epoch)
    so_far = F.max(score).over(by_run.rowsBetween(Window.unboundedPreceding, -1))
    improved = F.coalesce(F.col(score) > F.greatest(F.coalesce(so_far, F.lit(floor)), F.lit(floor)), F.lit(False))
    marked = history.select(run, epoch, score, improved.alias("improved"))
    marked = marked.withColumn("best_no", F.sum(F.col("improved").cast("int")).over(by_run))
    since = F.row_number().over(Window.partitionBy(run, "best_no").orderBy(epoch))
    waited = since - F.when(F.col("best_no") > 0, 1).otherwise(0)
    marked = marked.withColumn("waited", waited)
    stop = F.min(F.when((F.col("waited") >= patience) & ~F.col("improved"), F.col(epoch))).over(Window.partitionBy(run))
    status = (
        F.when(F.col("stop").isNull() | (F.col(epoch) < F.col("stop")), "logged")
        .when(F.col(epoch) == F.col("stop"), "stopped").otherwise("not run")
    )
    return marked.withColumn("stop", stop).select(run, epoch, score, "improved", "waited", status.alias("status"))


def track(train_fn: Callable[..., tuple[Any, float, list]], log: Callable[[dict], None] | None, *args: Any, **options: Any):
    """Run a training function with a logging callback and log its best score last.
    The function takes ``log`` and returns (model, best score, logged epochs)."""
    model, best, logged = train_fn(*args, log=log, **options)
    if log:
        log({"val/macro_f1": best})
    return model, best, logged
