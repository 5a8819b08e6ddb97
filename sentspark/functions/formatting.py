"""Text renderings of durations, numbers, lists and run names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T


def format_time(seconds: Column) -> Column:
    """Seconds to ``h:mm:ss`` after rounding half-even to whole seconds; whole
    days go in front as ``N day(s), ``."""
    whole = F.bround(seconds.cast("double"), 0).cast("bigint")
    days = F.floor(whole / 86400).cast("bigint")
    rest = whole - days * 86400
    clock = F.format_string(
        "%d:%02d:%02d",
        F.floor(rest / 3600).cast("bigint"),
        F.floor((rest % 3600) / 60).cast("bigint"),
        rest % 60,
    )
    unit = F.when(F.abs(days) == 1, F.lit("day")).otherwise(F.lit("days"))
    return F.when(whole.isNull(), None).when(
        days != 0, F.format_string("%d %s, %s", days, unit, clock)
    ).otherwise(clock)


def _short(value: float) -> str:
    if value != value:
        return ""
    text = f"{value:.0f}" if value >= 1000 else f"{value:.4g}"
    text = text.removeprefix("0") if text.startswith("0.") else text.replace("-0.", "-.")
    return text.ljust(5, "0") if text.startswith(".") else text


def _short_all(values: pa.Array) -> pa.Array:
    """Each different value of a batch is rendered once."""
    numbers = values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype("float64")
    different, place = np.unique(numbers, return_inverse=True)
    return pa.array([_short(v) for v in different.tolist()], pa.string()).take(pa.array(place))


# C-style %.4g rounds on the binary value of the double. The JVM formatter rounds
# on its shortest decimal form and so differs on ties, hence the Arrow batches.
@F.arrow_udf(T.StringType())
def _short_udf(values: pa.Array) -> pa.Array:
    return _short_all(values)


@F.arrow_udf(T.StringType())
def _short_list_udf(lists: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("int32"))
    shown = pc.binary_join(pa.ListArray.from_arrays(bounds, _short_all(lists.flatten())), ",")
    return pc.if_else(pc.is_null(lists), None, pc.binary_join_element_wise("[", shown, "]", ""))


def short_float(value: Column) -> Column:
    """Four significant digits without the leading zero (``.3200``), whole numbers
    from 1000 up, blank for NaN or NULL."""
    return F.coalesce(_short_udf(value.cast("double")), F.lit(""))


def short_int(value: Column) -> Column:
    """Integers are shown as they are, blank for NULL."""
    return F.coalesce(value.cast("string"), F.lit(""))


def short_list(values: Column) -> Column:
    """``[a,b,...]`` with every element shown by the rule of ``short_float``."""
    return _short_list_udf(values.cast("array<double>"))


def run_name(model: Column, train_path: Column, max_length: Column, batch_size: Column,
             learning_rate: Column, loss: Column, digits_from_right: Column) -> Column:
    """Name of a run, built from the settings that tell two runs apart."""
    return F.concat(
        F.replace(model, F.lit("/"), F.lit("-")), F.lit("_"),
        F.when(F.contains(train_path, F.lit("2024")), F.lit("2024")).otherwise(F.lit("")),
        F.lit("_max_length"), max_length.cast("string"),
        F.lit("_bs"), batch_size.cast("string"),
        F.lit("_lr"), learning_rate.cast("string"),
        F.when(digits_from_right, F.lit("_r2l")).otherwise(F.lit("")),
        F.lit("_loss"), loss,
    )
