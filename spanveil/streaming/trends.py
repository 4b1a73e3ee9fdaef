"""Figures by day that follow a stream of files and equal those of a batch.

What a batch of the stream adds is a small table of sums by day and type, in a folder of its own
that is overwritten if the batch runs again. Sums of these tables are the figures of all
files so far, late ones included, so the stream keeps no state. How late files come is
counted against a watermark: the latest moment of the batches before, less what is allowed.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanveil.operators.stats import day_type_counts, trend_of


def _sums(files: DataFrame, watermark: datetime | None) -> DataFrame:
    late = F.lit(False) if watermark is None else F.col("created_at") < F.lit(watermark)
    return day_type_counts(
        files.filter(F.col("status") == "completed"),
        late=F.count_if(F.col("first") & late),
        latest=F.max("created_at"),
    )


def _watermark(spark: SparkSession, folder: str, before: int, late_by: str) -> datetime | None:
    seen = spark.read.parquet(f"{folder}/sums").filter(F.col("batch") < before)
    return seen.agg((F.max("latest") - F.expr(f"INTERVAL '{late_by}'")).alias("mark")).first()["mark"]


def start_trend(
    files: DataFrame, folder: str, *, late_by: str = "1 day", once: bool = False
) -> StreamingQuery:
    """Follow a stream of files (created_at, status, entity_counts) in a shared folder.

    ``late_by`` is an interval as in SQL. Files that come later are counted as late, and
    in the figures of their day like all others.
    """
    spark = files.sparkSession
    # Readers find a table in any case.
    empty = _sums(spark.createDataFrame([], files.schema), None)
    empty.write.mode("overwrite").parquet(f"{folder}/sums/batch=-1")

    def handle(batch: DataFrame, batch_id: int) -> None:
        mark = _watermark(batch.sparkSession, folder, batch_id, late_by)
        _sums(batch, mark).write.mode("overwrite").parquet(f"{folder}/sums/batch={batch_id}")

    writer = files.writeStream.foreachBatch(handle).option(
        "checkpointLocation", f"{folder}/progress"
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def trend_so_far(
    spark: SparkSession, folder: str, as_of: str | datetime | Column | None = None, days: int = 30
) -> DataFrame:
    """``daily_trend`` of what the stream has had; the first day counts as a whole."""
    moment = F.current_timestamp() if as_of is None else as_of if isinstance(as_of, Column) else F.lit(as_of)
    since = F.to_date(moment.cast("timestamp") - F.make_dt_interval(F.lit(days)))
    sums = spark.read.parquet(f"{folder}/sums").filter(F.col("date") >= since)
    by_type = sums.groupBy("date", "entity_type").agg(F.sum("files").alias("files"), F.sum("n").alias("n"))
    return trend_of(by_type)


def late_files(spark: SparkSession, folder: str) -> DataFrame:
    """Late files by batch, of batches that had some."""
    sums = spark.read.parquet(f"{folder}/sums")
    return sums.groupBy("batch").agg(F.sum("late").alias("late_files")).filter("late_files > 0")
