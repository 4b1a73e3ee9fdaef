"""What a role may see and do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.functions.fixed_values import ROLES

# The events a role may cause.
ALLOWED = {
    "admin": [
        "FILE_UPLOAD",
        "FILE_DOWNLOAD_SANITIZED",
        "FILE_DOWNLOAD_ORIGINAL",
        "FILE_VIEW_ORIGINAL",
        "PII_DETECTED",
        "SANITIZATION_COMPLETED",
        "USER_LOGIN",
        "USER_CREATED",
    ],
    "standard": ["FILE_DOWNLOAD_SANITIZED", "USER_LOGIN"],
}


def _check(role: str) -> None:
    if role not in ROLES:
        raise ValueError(f"unknown role {role!r}")


def files_for(files: DataFrame, role: str) -> DataFrame:
    """All files for an admin, completed ones for anybody else."""
    _check(role)
    return files if role == "admin" else files.filter(F.col("status") == "completed")


def content_for(processed: DataFrame, role: str, *, original: bool = False) -> DataFrame:
    """The original for an admin who asks for it, else the sanitized copy of completed files."""
    _check(role)
    if original:
        if role != "admin":
            raise PermissionError("only an admin may see the original")
        return processed.select("file_id", "filename", F.col("text").alias("content"))
    return processed.filter(F.col("status") == "completed").select(
        "file_id", "filename", F.col("sanitized_text").alias("content")
    )


def actions_of_active_users(actions: DataFrame, users: DataFrame) -> DataFrame:
    """Actions whose user exists and is active."""
    active = users.filter(F.col("is_active") == 1).select(F.col("id").alias("user_id"))
    return actions.join(active, "user_id", "left_semi")


def role_violations(audit: DataFrame) -> DataFrame:
    """Audit rows of events that the role of the user does not allow."""
    spark = audit.sparkSession
    rows = [(role, event) for role, events in ALLOWED.items() for event in events]
    allowed = spark.createDataFrame(rows, "user_role string, event_type string")
    # The matrix is a constant of this module, so it always fits.
    return audit.join(F.broadcast(allowed), ["user_role", "event_type"], "left_anti")
