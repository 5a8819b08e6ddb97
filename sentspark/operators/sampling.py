"""Seeded splits and mini-batches with exact sizes.

Order comes from a hash of id and seed, so it does not depend on partitioning,
and a rerun after a lost executor gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sentspark.session import materialize

_HEX_STEP = 4          # hex digits looked at per pass: at most 16**4 histogram rows
_COPIES_STEP = 1 << 20


def shuffle_key(id_column: str, seed: int, epoch: Column | None = None) -> Column:
    """32 hex digits, uniform over distinct ids. NULL is an id of its own: no other
    id's text ends like that."""
    parts = [F.lit(f":{seed}")]
    if epoch is not None:
        parts += [F.lit(":"), epoch.cast("string")]
    named = F.concat(F.col(id_column).cast("string"), *parts)
    return F.md5(F.coalesce(named, F.concat(*parts, F.lit(":null"))).cast("binary"))


def train_val_split(df: DataFrame, ratio: float, seed: int, id_column: str = "sentence_id") -> tuple[DataFrame, DataFrame]:
    """Train gets exactly int(ratio * rows) rows, validation the rest.

    Finds the key at which to cut by narrowing down its leading digits, a narrow
    scan and a small histogram per pass (two or three passes for 10^12 rows).
    Both results are plain filters on that key: no row is shuffled. If the cut
    falls among rows that share one id, the row content decides, and among
    identical rows the copies are counted out.
    """
    key = F.concat(
        shuffle_key(id_column, seed),
        F.md5(F.to_json(F.struct(*df.columns)).cast("binary")),
    )
    need = int(ratio * df.count())
    prefix, width, rows = "", 0, None
    while need > 0 and width < 64 and rows != 1:
        # The id digits alone while they suffice: no other column is read then.
        source = shuffle_key(id_column, seed) if width < 32 else key
        bucket = F.substring(source, 1, width + _HEX_STEP)
        inside = df if not prefix else df.where(F.startswith(source, F.lit(prefix)))
        counts = inside.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
        order = Window.partitionBy(F.lit(0)).orderBy("bucket")
        before = F.sum("rows").over(order) - F.col("rows")
        found = (
            counts.select("bucket", "rows", before.alias("before"))
            .where((F.col("before") <= need) & (F.col("before") + F.col("rows") > need)).take(1)
        )
        if not found:  # the cut lies behind the last row
            return df, df.where(F.lit(False))
        prefix, rows, need = found[0]["bucket"], found[0]["rows"], need - found[0]["before"]
        width += _HEX_STEP
    if width == 0:
        return df.where(F.lit(False)), df
    digits = F.substring(shuffle_key(id_column, seed) if width <= 32 else key, 1, width)
    train, rest = df.where(digits < prefix), df.where(digits >= prefix)
    if need == 0:
        return train, rest
    # ``rows`` identical rows straddle the cut: ``need`` of them go to train.
    twin = df.where(digits == prefix).limit(1)
    return (
        train.unionByName(_copies(twin, need)),
        df.where(digits > prefix).unionByName(_copies(twin, rows - need)),
    )


def _copies(one_row: DataFrame, times: int) -> DataFrame:
    """``times`` copies of a row, made in blocks that spread over the tasks."""
    blocks = -(-times // _COPIES_STEP)
    size = F.least(F.lit(_COPIES_STEP), F.lit(times) - F.col("block") * _COPIES_STEP)
    spread = one_row.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    if blocks > 1:
        spread = spread.repartition("block")
    return (
        spread.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), size.cast("bigint"))))
        .drop("block", "copy")
    )


def rank_rows(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Adds the zero-based position of each row in the given order.

    One range shuffle: rows are sorted within ranges and written to the shared
    folder together with (range, position); the sizes of the ranges, one row per
    partition, then give each range its offset. No window spans the table. The
    row hash at the end of the order splits up rows that tie on everything else.
    """
    ordering = [*order, F.xxhash64(*df.columns)]
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = (
        df.repartitionByRange(*ordering).sortWithinPartitions(*ordering)
        .select("*", F.spark_partition_id().alias("_range"), position.alias("_position"))
    )
    stored = materialize(ranged, "ranked")
    sizes = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("_range")) - F.col("size")
    offsets = sizes.select("_range", before.alias("_offset"))
    return (
        stored.join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_offset") + F.col("_position"))
        .drop("_range", "_position", "_offset")
    )


def assign_batches(df: DataFrame, batch_size: int, seed: int | None = None,
                   id_column: str = "sentence_id") -> DataFrame:
    """Adds ``batch_id``: rows in seeded order, or in id order without a seed, cut
    into batches of ``batch_size``; only the last one may be short."""
    order = [F.col(id_column)] if seed is None else [shuffle_key(id_column, seed), F.col(id_column)]
    ranked = rank_rows(df, *order)
    return ranked.withColumn("batch_id", F.floor(F.col("rank") / batch_size).cast("bigint"))


def batch_sizes(batches: DataFrame) -> DataFrame:
    return batches.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


def epoch_batches(df: DataFrame, batch_size: int, seed: int, epochs: int,
                  id_column: str = "sentence_id") -> DataFrame:
    """Adds ``epoch`` and ``batch_id``, with a new seeded order for each epoch."""
    if epochs < 1:
        raise ValueError("epochs must be at least 1")
    rows = df.count()
    spread = df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    ranked = rank_rows(spread, F.col("epoch"), shuffle_key(id_column, seed, F.col("epoch")), F.col(id_column))
    within = F.col("rank") - (F.col("epoch") - 1) * F.lit(rows)
    return ranked.withColumns({"rank": within, "batch_id": F.floor(within / batch_size).cast("bigint")})


def num_batches(rows: int, batch_size: int) -> int:
    return -(-rows // batch_size)


def progress_steps(steps: DataFrame, step: str = "step", every: int = 40) -> DataFrame:
    """The steps at which progress is reported: every 40th, never the first."""
    return steps.where((F.col(step) % every == 0) & (F.col(step) > 0))


def mean_of_batch_means(df: DataFrame, batch: str, loss: str) -> DataFrame:
    """Mean of the per-batch means: a short batch counts as much as a full one."""
    per_batch = df.groupBy(batch).agg(F.avg(loss).alias("batch_mean"))
    return per_batch.agg(F.avg("batch_mean").alias("mean_loss"))


def first_predictions(df: DataFrame, n: int = 10, order: str = "sentence_id") -> DataFrame:
    """The first ``n`` predictions in id order."""
    return df.orderBy(order).limit(n)
