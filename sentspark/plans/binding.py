"""How the given tables play the parts of sentences, gold labels and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sentspark.functions.labels import TRAIN_CODES, encode
from sentspark.functions.vectors import dot
from sentspark.session import even_out


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def gold(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("quality") == 0, "SUBJ").otherwise("OBJ")
    return table(spark, folder, "labels").select(F.col("doc_id").alias("sentence_id"), label.alias("label"))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("toxic") == 1, "SUBJ").otherwise("OBJ")
    return table(spark, folder, "labels").select(F.col("doc_id").alias("sentence_id"), label.alias("label"))


def texts(spark: SparkSession, folder: str, even: bool = False) -> DataFrame:
    """All texts; ``even`` for queries that split or encode them."""
    scan = table(spark, folder, "documents")
    return (even_out(scan) if even else scan).withColumnsRenamed({"doc_id": "sentence_id", "text": "sentence"})


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled sentences."""
    return texts(spark, folder).join(gold(spark, folder), "sentence_id")


def unlabelled(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder).join(gold(spark, folder), "sentence_id", "left_anti")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Gold and predicted label per labelled sentence; both come from one table, so
    no join is needed."""
    return table(spark, folder, "labels").select(
        F.col("doc_id").alias("sentence_id"),
        F.when(F.col("quality") == 0, "SUBJ").otherwise("OBJ").alias("gold_label"),
        F.when(F.col("toxic") == 1, "SUBJ").otherwise("OBJ").alias("pred_label"),
    )


def line_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """A larger gold/prediction table with one epoch per shipping year."""
    return table(spark, folder, "lineitem").select(
        F.year("l_shipdate").alias("epoch"),
        F.when(F.col("l_returnflag") == "N", "OBJ").otherwise("SUBJ").alias("gold_label"),
        F.when(F.col("l_linestatus") == "O", "OBJ").otherwise("SUBJ").alias("pred_label"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with ten classes."""
    return table(spark, folder, "embeddings").select("vec_id", "embedding", F.col("label").alias("class_id"))


def with_logits(spark: SparkSession, folder: str) -> DataFrame:
    """The same with logits: that of a class is the product with its mean vector. The
    means are part of the same plan, as one value of a number per class and entry."""
    rows = vectors(spark, folder)
    entries = rows.select("class_id", F.posexplode("embedding").alias("i", "x")).groupBy("class_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = entries.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("mean"))
    every = means.agg(F.array_sort(F.collect_list(F.struct("class_id", F.col("mean.m").alias("mean")))).alias("means")).scalar()
    logits = F.transform("means", lambda m: dot(F.col("embedding"), m["mean"]))
    return rows.withColumn("means", every).withColumn("logits", logits.cast("array<double>")).drop("means")


def labelled_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a two-class task."""
    label = F.when(F.col("label") == 0, "SUBJ").otherwise("OBJ")
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("sentence_id"), "embedding", label.alias("label"), encode(label, TRAIN_CODES).alias("label_encoded")
    )


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Daily means as the score of an epoch, one run per event type."""
    return (
        table(spark, folder, "events")
        .groupBy(F.col("event_type").alias("run_id"), F.dayofmonth("ts").alias("epoch"))
        .agg(F.round(F.avg("value"), 6).alias("score"))
    )
