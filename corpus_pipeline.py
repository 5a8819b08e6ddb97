"""From raw documents to packed training sequences: the stages in order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet in the shared folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentspark.llm import stages
from sentspark.llm.scratch import Scratch

STAGES = [
    ("language", stages.with_language),
    ("near_duplicates", stages.near_duplicates),
    ("personal_data", stages.without_personal_data),
    ("mixing", stages.mixed),
    ("packing", stages.packed),
]

# Language scores and soft posteriors are fitted models: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        now = Scratch(spark, name)
        docs = now.table(stage(spark, docs, sf_dir))
        if before is not None:      # nobody reads it any more
            before.drop()
        before = now
    return docs
