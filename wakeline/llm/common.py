"""Plumbing shared by the corpus operators."""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators.graph import Scratch, components

__all__ = ["UPPER", "Scratch", "components", "crc_fold", "small_batches", "table"]

#: Rows that go to Python at a time where texts or sets are long; both sides hold a batch.
BATCH = 500

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(id_col: str, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``.  A null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % k, F.lit(0))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans that are run inside send ``BATCH`` rows at a time to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)
