"""The operators as steps over a table of documents.

Each step takes (spark, docs, sf_dir); ``docs`` has the columns of documents. All but
the last return those columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sentspark.llm import language_id, soft_mixing
from sentspark.llm.bfd_packing import pack_documents
from sentspark.llm.language_id import UNDECIDED, held_out
from sentspark.llm.parity_join import parity_join
from sentspark.llm.surrogates import replace_entities
from sentspark.llm.table_queries import MIX, label_domains

LEAST_SCORE = 0.5       # posterior below which a document's language counts as unknown


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a posterior of LEAST_SCORE or more; lang
    becomes the predicted one. NULL, empty and letterless texts go. One pass: no join
    brings the prediction back."""
    model = language_id.fit(docs.where(~held_out()))
    told = language_id.tag(docs, model)
    return told.where((F.col("lang_pred") != UNDECIDED) & (F.col("score") >= LEAST_SCORE)).select(
        *[F.col("lang_pred").alias("lang") if c == "lang" else F.col("row").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents tied by a Jaccard of 0.8 or more over runs of five
    words, the one with the smallest doc_id stays; rows without words or id stay. Rows
    that repeat an id stay or go together."""
    found = parity_join(docs, shingle=5, num=80, den=100)
    copies = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; n_chars follows the new text."""
    changed = replace_entities(docs)
    return changed.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say: rare domains are thinned out, clean text
    keeps its tokens."""
    model = soft_mixing.fit(docs, label_domains(spark, sf_dir))
    drawn = soft_mixing.mix_documents(docs, model, MIX, anchor="clean")
    # No filter on copies: pushed into the scan, it would repeat the classifier there
    # once per mention of a posterior.
    turns = F.explode_outer(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies")))).alias("turn")
    return drawn.select("row", turns).where("turn IS NOT NULL").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
