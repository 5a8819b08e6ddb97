"""Intermediate tables in the shared folder, removed when their user is done."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from sentspark.session import cut_lineage, scratch_path

ARROW_BYTES = 4 << 20   # of the rows that go to Python at once
ARROW_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


class Scratch:
    """Writes tables below one folder of the shared directory."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.count = spark, scratch_path(spark, name), 0

    def table(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read back: lineage ends here, and columns
        that a later pass doesn't need aren't read."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, table: int) -> None:
        """Removes the table written as number ``table``; nobody may read it any more."""
        self._delete(f"{self.root}/{table}")

    def drop(self) -> None:
        self._delete(self.root)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Scratch]:
    """Tables live inside the block; what leaves it must go through ``keep``."""
    held = Scratch(spark, name)
    try:
        yield held
    finally:
        held.drop()


@contextmanager
def small_arrow_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside the block hands rows to Python in batches of about ARROW_BYTES,
    unless the session has a limit of its own. By rows alone, a batch of 10,000 long
    texts lies in the executor and in its worker at once. Results stay the same."""
    if spark.conf.get(ARROW_CONF, None) is not None:
        yield
        return
    spark.conf.set(ARROW_CONF, str(ARROW_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(ARROW_CONF)


def keep(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, so that the scratch tables behind ``df`` can go. Spark's
    cleaner removes the files once nobody refers to the result."""
    return cut_lineage(df)
