"""File readers. All take an explicit schema, so no pass is spent on inference
and a missing path fails at once instead of giving an empty table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sentspark.sources.quoted import read_quoted

SENTENCES = T.StructType([
    T.StructField("sentence_id", T.StringType()),
    T.StructField("sentence", T.StringType()),
    T.StructField("label", T.StringType()),
])
UNLABELLED = T.StructType(SENTENCES.fields[:2])
PREDICTIONS = T.StructType([SENTENCES.fields[0], SENTENCES.fields[2]])

# The words a raw table may use for a missing entry.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_json_records(spark: SparkSession, path: str, schema: T.StructType,
                      whole_documents: bool = True) -> DataFrame:
    """JSON files holding arrays of records.

    ``whole_documents`` parses each file as one document, which one task must do
    per file. Set it to False for files with one record or one array per line:
    those are split like any text.
    """
    return spark.read.schema(schema).json(path, multiLine=whole_documents)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType = SENTENCES,
                   separator: str = ",", line_breaks: bool = False) -> DataFrame:
    """Quoted fields, a doubled quote inside them stands for one quote. Fields that may
    hold line breaks need ``line_breaks``, which scans the files more than once but
    splits them all the same (see ``quoted.read_quoted``)."""
    if line_breaks:
        return read_quoted(spark, path, schema, separator)
    return spark.read.schema(schema).csv(path, sep=separator, header=True, quote='"', escape='"')


def read_unquoted(spark: SparkSession, path: str, schema: T.StructType = SENTENCES,
                  separator: str = "\t", missing_words: bool = True) -> DataFrame:
    """Quotes are plain text. Empty entries become NULL, and so do the usual words
    for a missing value unless ``missing_words`` is off."""
    df = spark.read.schema(schema).csv(path, sep=separator, header=True, quote="")
    if not missing_words:
        return df
    return df.select([
        F.when(~F.col(f.name).isin(*MISSING_WORDS), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in schema.fields
    ])


def union_splits(splits: Mapping[str, DataFrame]) -> DataFrame:
    """Stack the splits with a ``split`` column; a split may lack the label."""
    tagged = [df.withColumn("split", F.lit(name)) for name, df in splits.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def read_splits(spark: SparkSession, paths: Mapping[str, str], separator: str = "\t",
                unlabelled: tuple[str, ...] = (), line_breaks: bool = False) -> dict[str, DataFrame]:
    """One table per split (train, val, test)."""
    return {
        name: read_delimited(spark, path, UNLABELLED if name in unlabelled else SENTENCES,
                             separator, line_breaks)
        for name, path in paths.items()
    }
