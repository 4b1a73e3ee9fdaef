"""Reading corpora and tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.functions.fixed_values import BINARY_FILE_TYPES
from spanveil.functions.texts import extract_text, file_type_of

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


#: Rows of a narrow table from which texts are made that a task gets at most, more or less.
ROWS_PER_TASK = 2500


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def read_spread(
    spark: SparkSession, directory: str, name: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """A table of short rows that much work is done on, dealt to tasks by its number of rows.

    Splits are by bytes, and a row group is one split: millions of keys may come as a single task.
    The rows are dealt out one by one, so neither repeated nor null keys matter, and before
    anything is made from them, so that only what is read moves.
    """
    table = read_table(spark, directory, name)
    # Read from the footers.
    tasks = math.ceil(table.count() / rows_per_task)
    return table.repartition(tasks) if tasks > 1 else table


def read_files(spark: SparkSession, path: str, *, recursive: bool = True) -> DataFrame:
    """Files as rows: filename, file_type, file_size, content."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
        .select(
            F.col("path"),
            F.regexp_extract("path", r"([^/]+)\z", 1).alias("filename"),
            F.col("length").alias("file_size"),
            F.col("modificationTime").alias("created_at"),
            "content",
        )
        .withColumn("file_type", file_type_of(F.col("filename")))
    )


def with_text(files: DataFrame, content: str = "content", out: str = "text") -> DataFrame:
    """Decode the content of text-like files; null for kinds that hold no plain text.

    A file with null text comes out of processing as failed, with the reason.
    """
    kind = F.col("file_type")
    text = F.when(~kind.isin(BINARY_FILE_TYPES), extract_text(F.col(content), kind))
    return files.withColumn(out, text)
