"""Labelled rows that a model may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a model is fitted on: those with the smallest hash of their id.
LABELLED_ROWS = 20_000


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning; null ids are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def labelled_ids(labels: DataFrame, label: str, rows: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, label) of at most `rows` labelled documents outside the held-out third.

    Labels other than 0 and 1 are left out; of an id with several labels the largest counts.
    """
    return (
        labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int = LABELLED_ROWS
) -> DataFrame:
    """(doc_id, text, label) of `labelled_ids`.

    The ids are chosen first, so that texts of other documents are read but never moved.
    """
    # At most `rows` of 12 bytes, so safe to send to every executor.
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.join(F.broadcast(labelled_ids(labels, label, rows)), "doc_id")
