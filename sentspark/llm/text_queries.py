"""Queries of the operators that read one text at a time."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sentspark.llm.bfd_packing import pack_documents
from sentspark.llm.crc_resampling import resample
from sentspark.llm.language_id import fit, held_out, identify
from sentspark.llm.line_blocks import extract_pages
from sentspark.llm.line_crf import fit as fit_field, judge_lines
from sentspark.llm.registry import query, table
from sentspark.llm.winnowing import fingerprint_edits


@query("op3_winnowing")
def op3_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_edits(table(spark, folder, "documents"))


@query("op6_language_id")
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit(docs.where(~held_out()))
    return identify(docs, model).withColumn("held_out", held_out())


@query("op8_line_blocks")
def op8_line_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pages(table(spark, folder, "pages"))


@query("op10_bfd_packing")
def op10_bfd_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_line_crf")
def op2_line_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return judge_lines(docs, fit_field(docs, table(spark, folder, "labels")))


@query("op13_crc_resampling")
def op13_crc_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
