"""Where results go: sanitized copies, encrypted originals, catalog, audit log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.functions.texts import content_hash
from spanveil.sources.crypto import encrypt


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one the cluster names, else the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def settle(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame, written to a new shared folder and read back: its rows and their ids stay as they are."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def write_vault(files: DataFrame, path: str, key: bytes, *, mode: str = "errorifexists") -> None:
    """Encrypted originals with the hash of the plain content."""
    files.select(
        "file_id",
        content_hash(F.col("content")).alias("original_hash"),
        encrypt(F.col("content"), key).alias("encrypted"),
    ).write.mode(mode).parquet(path)


def write_sanitized(processed: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Sanitized copies of the files that went through."""
    processed.filter(F.col("status") == "completed").select(
        "file_id", "sanitized_text", "sanitized_hash"
    ).write.mode(mode).parquet(path)


def write_audit(rows: DataFrame, path: str, batch: str) -> None:
    """Add a batch to the audit log, by day; a batch that is written again replaces itself."""
    rows.withColumns({"event_date": F.to_date("timestamp"), "batch": F.lit(batch)}).write.mode(
        "overwrite"
    ).option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "batch").parquet(path)
