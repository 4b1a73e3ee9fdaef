"""The file catalog: what came in, what was found, what became of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions import fixed_values as V
from spanveil.functions.masks import check_mode
from spanveil.functions.rules import STRUCTURED_RULES, Rule
from spanveil.functions.spans import DETECTION, empty_of
from spanveil.functions.texts import content_hash, file_type_of, reject_reason
from spanveil.operators.detect import detect_with_counts
from spanveil.operators.sanitize import sanitize

CATALOG_COLUMNS = [
    "file_id",
    "filename",
    "file_type",
    "file_size",
    "original_path",
    "sanitized_path",
    "encryption_key_id",
    "original_hash",
    "sanitized_hash",
    "anonymization_mode",
    "status",
    "error_message",
    "entity_counts",
    "total_entities",
    "uploaded_by",
    "created_at",
    "processed_at",
]
STORED_COLUMNS = {"original_path", "sanitized_path", "encryption_key_id"}


def admit(
    files: DataFrame, filename: str = "filename", size: str = "file_size", limit: int = V.MAX_FILE_SIZE
) -> tuple[DataFrame, DataFrame]:
    """(admitted files, refused files with ``reject_reason``)."""
    judged = files.withColumn("reject_reason", reject_reason(F.col(filename), F.col(size), limit))
    return (
        judged.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        judged.filter(F.col("reject_reason").isNotNull()),
    )


def process_files(
    files: DataFrame,
    *,
    mode: str = "mask",
    key: str | None = None,
    rules: Sequence[Rule] = STRUCTURED_RULES,
    processed_at: Column | None = None,
) -> DataFrame:
    """Detect and sanitize admitted files; one row per file with its outcome.

    Needs file_id, filename, text, uploaded_by, created_at and takes size and
    hash from ``content`` if there is one, else from the text.  A null text is
    a file that could not be read and comes out as ``failed``.
    """
    check_mode(mode, key)
    found = detect_with_counts(files, rules=rules)
    done = sanitize(found, mode=mode, key=key, rules=rules)
    failed = F.col("text").isNull()
    original = F.col("content" if "content" in files.columns else "text")
    outcome = {
        "file_type": file_type_of(F.col("filename")),
        "file_size": F.octet_length(original),
        "original_hash": content_hash(original),
        "sanitized_hash": F.when(~failed, content_hash(F.col("sanitized_text"))),
        "anonymization_mode": F.lit(mode),
        "status": F.when(failed, "failed").otherwise("completed"),
        "error_message": F.when(failed, "no text could be read"),
        "detections": F.col("detections"),
        "entity_counts": F.col("entity_counts"),
        "total_entities": F.col("total_entities"),
        "sanitized_text": F.col("sanitized_text"),
        "processed_at": F.current_timestamp() if processed_at is None else processed_at,
    }
    kept = [c for c in files.columns if c not in outcome and c != "content"]
    return done.select(*kept, *[column.alias(name) for name, column in outcome.items()])


def catalog_rows(processed: DataFrame) -> DataFrame:
    """Catalog records: no text, counts and detections as JSON.

    Where a file was stored and which key encrypts it is null if nothing was stored.
    """

    def column(name: str) -> Column:
        if name == "entity_counts":
            return F.to_json(name).alias(name)
        if name in STORED_COLUMNS and name not in processed.columns:
            return F.lit(None).cast("string").alias(name)
        return F.col(name)

    return processed.select(
        *[column(c) for c in CATALOG_COLUMNS], F.to_json("detections").alias("pii_detected")
    )


def refused_rows(refused: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """Files that were not admitted, in the form of processed ones: failed, with the reason."""
    original = F.col("content" if "content" in refused.columns else "text")
    outcome = {
        "file_type": file_type_of(F.col("filename")),
        "file_size": F.octet_length(original),
        "original_hash": content_hash(original),
        "sanitized_hash": F.lit(None).cast("string"),
        "anonymization_mode": F.lit(None).cast("string"),
        "status": F.lit("failed"),
        "error_message": F.col("reject_reason"),
        "detections": empty_of(DETECTION),
        "entity_counts": F.create_map().cast("map<string,bigint>"),
        "total_entities": F.lit(0),
        "sanitized_text": F.lit(None).cast("string"),
        "processed_at": F.current_timestamp() if processed_at is None else processed_at,
    }
    dropped = {*outcome, "content", "reject_reason"}
    kept = [c for c in refused.columns if c not in dropped]
    return refused.select(*kept, *[column.alias(name) for name, column in outcome.items()])


def parsed_counts(files: DataFrame, counts: str = "entity_counts") -> Column:
    """Counts as a map, from a map or from JSON text."""
    if files.schema[counts].dataType.typeName() == "map":
        return F.col(counts)
    return F.from_json(F.col(counts), "map<string,bigint>")


def list_files(files: DataFrame) -> DataFrame:
    """All catalog columns, counts parsed."""
    return files.withColumn("entity_counts", parsed_counts(files))


def search_files(files: DataFrame, query: str, filename: str = "filename") -> DataFrame:
    """Files whose name contains the query, in any case."""
    return files.filter(F.lower(F.col(filename)).contains(F.lower(F.lit(query))))
