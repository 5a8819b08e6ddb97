"""Sinks: submissions, run metrics, embedding cache and saved models."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator, Mapping
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sentspark.session import is_complete, list_folders, remove_path

# Submission file names for a test split with and without labels.
SUBMISSION_NAMES = {True: "task1_dev_mono_english.tsv", False: "task1_test_mono_english.tsv"}
BASELINE_PREDICTIONS_NAME = "base_pred_lan.tsv"

HISTORY = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
])


def submission(df: DataFrame, label: str = "predicted_label") -> DataFrame:
    """The two submission columns."""
    return df.select("sentence_id", F.col(label).alias("label"))


def write_delimited(df: DataFrame, path: str, separator: str = "\t", mode: str = "overwrite") -> None:
    """Quoted where needed, quotes doubled, white space kept."""
    df.write.mode(mode).csv(
        path, sep=separator, header=True, quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def write_unquoted(df: DataFrame, path: str, separator: str = "\t", mode: str = "overwrite") -> None:
    """No quoting at all, so no field may hold the separator or a line break."""
    broken = [
        F.when(F.col(f.name).rlike("[\r\n" + separator + "]"),
               F.raise_error(F.lit(f"{f.name} holds a separator or a line break")))
        .otherwise(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(broken).write.mode(mode).csv(
        path, sep=separator, header=True, quote="", emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def _json_arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            yield pd.DataFrame({"value": ["[" + ",".join(batch["record"]) + "]"]})


def write_json_arrays(df: DataFrame, path: str) -> None:
    """Text files with one JSON array of records per line, at most one Arrow batch of
    records each. Needs no shuffle, no task holds more than a batch, and readers can
    split the files (``read_json_records`` with ``whole_documents=False``)."""
    records = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))
    records.mapInPandas(_json_arrays, "value string").write.text(path)


def write_submission(df: DataFrame, folder: str, has_labels: bool) -> str:
    path = f"{folder}/{SUBMISSION_NAMES[has_labels]}"
    write_delimited(submission(df), path)
    return path


def log_metrics(spark: SparkSession, path: str, run_id: str, record: Mapping[str, float | int | None],
                epoch: int | None = None) -> None:
    """Write one record to the history table as (run_id, epoch, metric, value).

    A record is known by its run, its epoch and the names of its metrics and replaces an
    earlier one with the same: a step that is made again leaves one row per metric.
    """
    epoch = record.get("epoch", epoch)
    names = sorted(name for name in record if name != "epoch")
    rows = [(run_id, epoch, zlib.crc32("\n".join(names).encode()), name, None if record[name] is None else float(record[name])) for name in names]
    keyed = T.StructType([*HISTORY.fields[:2], T.StructField("record", T.LongType()), *HISTORY.fields[2:]])
    (spark.createDataFrame(rows, keyed).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id", "epoch", "record").parquet(path))


def forget_run(spark: SparkSession, path: str, run_id: str) -> None:
    """Removes what the history has of a run, before it starts anew."""
    for folder in list_folders(spark, path):
        if unquote(folder.rsplit("/", 1)[-1]) == f"run_id={run_id}":
            remove_path(spark, folder)


def metric_logger(spark: SparkSession, path: str, run_id: str) -> Callable[[Mapping], None]:
    """The default logging callback of a training run."""
    return lambda record: log_metrics(spark, path, run_id, record)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).parquet(path).select(*HISTORY.names)


def load_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame],
                    force: bool = False) -> DataFrame:
    """Parquet cache. The caller puts everything the result depends on (model,
    length, input) into ``path``. Only a folder with the marker of a finished write
    counts; whatever else is there is written anew."""
    if not force and is_complete(spark, path):
        return spark.read.parquet(path)
    compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cached_embeddings(spark: SparkSession, df: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame],
                      text: str = "sentence", output: str = "embedding") -> DataFrame:
    """``df`` with vectors, of which only those of texts not seen before are made.

    The cache is keyed by the SHA-256 of the text. What a call adds is a folder of its
    own, and only folders with the marker of a finished write are read, so that a call
    that failed half-way leaves nothing behind that counts. ``embed`` adds ``output`` to
    a table with the column ``text``; each different text is embedded once.
    """
    keyed = df.withColumn("_key", F.sha2(F.col(text), 256))
    known = _cached(spark, path, output)
    wanted = keyed.where(F.col(text).isNotNull()).groupBy("_key").agg(F.first(text).alias(text))
    missing = wanted if known is None else wanted.join(known.select("_key"), "_key", "left_anti")
    added = f"{path.rstrip('/')}/added-{uuid.uuid4().hex}"
    embed(missing).select("_key", output).write.parquet(added)
    return keyed.join(_cached(spark, path, output), "_key", "left").drop("_key")


def _cached(spark: SparkSession, path: str, output: str) -> DataFrame | None:
    parts = [p for p in list_folders(spark, path) if is_complete(spark, p)]
    if not parts:
        return None
    # A text that two calls embedded at the same time is there twice.
    return spark.read.parquet(*parts).groupBy("_key").agg(F.first(output).alias(output))


def cache_path(folder: str, model: str, max_length: int, source: str) -> str:
    parts = (model, f"len{max_length}", source)
    return folder.rstrip("/") + "/" + "_".join(p.strip("/").replace("/", "-") for p in parts)
