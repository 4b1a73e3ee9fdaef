"""The audit log: who did what to which file, with counts and never with values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.operators.detect import detect, explode_detections
from spanveil.operators.entities import with_listed_entities

# column -> type and default of what an action may leave out
_OPTIONAL = {
    "file_id": ("long", None),
    "filename": ("string", None),
    "entity_counts": ("map<string,bigint>", None),
    "total_entities": ("int", None),
    "anonymization_mode": ("string", None),
    "success": ("boolean", True),
    "error_message": ("string", None),
    "file_hash": ("string", None),
    "ip_address": ("string", None),
    "user_agent": ("string", None),
}
AUDIT_COLUMNS = [
    "id",
    "event_type",
    "user_id",
    "username",
    "user_role",
    "file_id",
    "filename",
    "entity_counts",
    "total_entities",
    "anonymization_mode",
    "success",
    "error_message",
    "file_hash",
    "ip_address",
    "user_agent",
    "timestamp",
]
LIFECYCLE = ["FILE_UPLOAD", "PII_DETECTED", "SANITIZATION_COMPLETED"]


def log_events(actions: DataFrame, users: DataFrame) -> DataFrame:
    """Audit rows from actions (id, event_type, user_id, timestamp and more).

    Name and role of the user are stored with the row.  How to join is left to
    the optimizer, which knows the size of the user table; one very active user
    is split by the adaptive skew join if the tables are shuffled.
    """
    for name, (kind, default) in _OPTIONAL.items():
        if name not in actions.columns:
            actions = actions.withColumn(name, F.lit(default).cast(kind))
    who = users.select(
        F.col("id").alias("user_id"), "username", F.col("role").alias("user_role")
    )
    counts = F.col("entity_counts")
    return (
        actions.join(who, "user_id", "left")
        .withColumn("entity_counts", F.when(F.size(counts) > 0, F.to_json(counts)))
        .withColumn("success", F.when(F.col("success"), 1).otherwise(0))
        .select(AUDIT_COLUMNS)
    )


def _with_file(actions: DataFrame, files: DataFrame) -> DataFrame:
    about = files.select(
        "file_id", F.col("filename"), "original_hash", "sanitized_hash"
    )
    return actions.join(about, "file_id", "left")


def _log(
    actions: DataFrame, users: DataFrame, event_type: str | Column, file_hash: Column | None = None
) -> DataFrame:
    kind = F.lit(event_type) if isinstance(event_type, str) else event_type
    typed = actions.withColumn("event_type", kind)
    if file_hash is not None:
        typed = typed.withColumn("file_hash", file_hash)
    return log_events(typed, users)


def log_uploads(actions: DataFrame, users: DataFrame, files: DataFrame) -> DataFrame:
    return _log(_with_file(actions, files), users, "FILE_UPLOAD", F.col("original_hash"))


def log_downloads(
    actions: DataFrame, users: DataFrame, files: DataFrame, is_sanitized: str = "is_sanitized"
) -> DataFrame:
    """Downloads of the sanitized copy or, where the flag is false, of the original."""
    flag = F.col(is_sanitized)
    kind = F.when(flag, "FILE_DOWNLOAD_SANITIZED").otherwise("FILE_DOWNLOAD_ORIGINAL")
    hashed = F.when(flag, F.col("sanitized_hash")).otherwise(F.col("original_hash"))
    return _log(_with_file(actions, files), users, kind, hashed)


def log_views_of_original(actions: DataFrame, users: DataFrame, files: DataFrame) -> DataFrame:
    return _log(_with_file(actions, files), users, "FILE_VIEW_ORIGINAL", F.col("original_hash"))


def log_logins(actions: DataFrame, users: DataFrame) -> DataFrame:
    return _log(actions, users, "USER_LOGIN")


def log_user_creation(actions: DataFrame, users: DataFrame) -> DataFrame:
    """Credited to the one who created the user (``user_id``), not to the new user."""
    return _log(actions, users, "USER_CREATED")


def _file_event(processed: DataFrame, step: int, **columns: Column) -> list[Column]:
    """The columns of one event of a file's life, taken from its processed row."""
    given = {
        "id": F.col("file_id") * len(LIFECYCLE) + step,
        "event_type": F.lit(LIFECYCLE[step]),
        "user_id": F.col("uploaded_by"),
        "file_id": F.col("file_id"),
        "filename": F.col("filename"),
        "timestamp": F.col("created_at") if step == 0 else F.col("processed_at"),
        **columns,
    }
    for name, (kind, default) in _OPTIONAL.items():
        if name not in given:
            passed_on = name in ("ip_address", "user_agent") and name in processed.columns
            given[name] = F.col(name) if passed_on else F.lit(default)
        given[name] = given[name].cast(kind)
    # One order of columns, so that the events of a file fit into one array.
    return [given[name].alias(name) for name in sorted(given)]


def _upload(processed: DataFrame) -> list[Column]:
    return _file_event(processed, 0, file_hash=F.col("original_hash"))


def _detection(processed: DataFrame) -> list[Column]:
    return _file_event(
        processed,
        1,
        entity_counts=F.col("entity_counts"),
        total_entities=F.col("total_entities"),
    )


def _sanitization(processed: DataFrame) -> list[Column]:
    done = F.col("status") == "completed"
    return _file_event(
        processed,
        2,
        entity_counts=F.when(done, F.col("entity_counts")),
        total_entities=F.when(done, F.col("total_entities")).otherwise(0),
        anonymization_mode=F.col("anonymization_mode"),
        success=done,
        error_message=F.when(~done, F.col("error_message")),
        file_hash=F.when(done, F.col("sanitized_hash")),
    )


def log_detections(processed: DataFrame, users: DataFrame) -> DataFrame:
    return log_events(processed.select(_detection(processed)), users)


def log_sanitizations(processed: DataFrame, users: DataFrame) -> DataFrame:
    return log_events(processed.select(_sanitization(processed)), users)


def log_lifecycle(processed: DataFrame, users: DataFrame) -> DataFrame:
    """Upload, detection and completion of every processed file.

    A file that failed has no detection event.  The three events come out of
    the one processed row, so the texts are looked at once.
    """
    read = F.col("status") != "failed"
    events = F.array(
        F.struct(_upload(processed)),
        F.when(read, F.struct(_detection(processed))),
        F.struct(_sanitization(processed)),
    )
    actions = (
        processed.select(F.explode_outer(events).alias("event"))
        .filter(F.col("event").isNotNull())
        .select("event.*")
    )
    return log_events(actions, users)


_FREE_TEXT = ("filename", "entity_counts", "error_message", "user_agent")


def _cells(audit: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(id, column, text) of the free text of the log."""
    texts = [F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in columns]
    return audit.select("id", F.explode(F.array(*texts)).alias("cell")).select("id", "cell.*")


def find_leaks(
    audit: DataFrame,
    columns: Sequence[str] = _FREE_TEXT,
    values: DataFrame | None = None,
) -> DataFrame:
    """Entities in the free text of the log; it should be empty.

    ``values`` (entity_type, text) narrows the result to values that were
    really detected in the files.
    """
    cells = _cells(audit, columns)
    leaks = explode_detections(detect(cells), ["id", "column"])
    if values is None:
        return leaks
    return leaks.join(values.select("entity_type", "text").distinct(), ["entity_type", "text"], "left_semi")


def find_value_leaks(
    audit: DataFrame, values: DataFrame, columns: Sequence[str] = _FREE_TEXT
) -> DataFrame:
    """Where the free text of the log holds detected values, also those no pattern finds.

    ``values`` (entity_type, text) are what was detected, listed names among them. Word runs of
    the log are first looked up in a set of hashed prefixes of the values, then joined with
    those that are left; a value counts if its words stand in the log in their order. The
    result (id, column, entity_type, start, end) says where and never what.
    """
    cell = F.struct("id", "column")
    cells = _cells(audit, columns).filter(F.col("text").isNotNull()).select(cell.alias("cell"), "text")
    names = values.select(F.col("text").alias("name"), "entity_type").distinct()
    found = with_listed_entities(cells, names, "cell", out="__spans")
    return found.select("cell.*", F.explode("__spans").alias("s")).select(
        "id", "column", "s.entity_type", "s.start", "s.end"
    )
