"""Intermediate tables in the shared folder, removed by whoever made them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from sentspark.session import remove_path, scratch_path


class Scratch:
    """Writes tables below one folder of the shared directory."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.count, self.oldest = spark, scratch_path(spark, name), 0, 1
        self.names: list[str] = []

    def table(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read back: lineage and size estimates start
        anew, and later passes read only the columns they need."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def dealt(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """``df`` written in buckets by ``key``: who groups it by the key again and again
        doesn't move it again."""
        self.count += 1
        path, name = f"{self.root}/{self.count}", f"dealt_{uuid.uuid4().hex}"
        self.names.append(name)
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name, format="parquet")
        return self.spark.table(name)

    def keep_last(self, tables: int) -> None:
        """Removes all but the last few tables; nobody may read the others any more."""
        while self.oldest <= self.count - tables:
            remove_path(self.spark, f"{self.root}/{self.oldest}")
            self.oldest += 1

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_path(self.spark, self.root)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Scratch]:
    """Tables live inside the block; what leaves it must have been stored elsewhere."""
    held = Scratch(spark, name)
    try:
        yield held
    finally:
        held.drop()
