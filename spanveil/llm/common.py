"""Tables, shared folders and small column helpers of the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What separates words: space and the characters 0x09 to 0x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table of a data directory."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder, by name only, that the driver and all executors share.

    It lies in the folder that the cluster names in spark.checkpoint.dir, else in the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{root}"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def settle(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame, written to a shared folder and read back: its lineage ends here."""
    spark = frame.sparkSession
    path = shared_folder(spark, purpose)
    frame.write.parquet(path)
    schema = StructType.fromJson(frame.schema.jsonValue())
    return spark.read.schema(schema).parquet(path)


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hand Python workers batches of so many rows while tables are written inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
