"""Figures over users, files and the audit log.

Each figure is an aggregate with partial sums before its shuffle, whose keys
are few (statuses, types, days), so no group grows with the data.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions import fixed_values as V
from spanveil.operators.catalog import parsed_counts


def _moment(as_of: str | datetime | Column | None) -> Column:
    if as_of is None:
        return F.current_timestamp()
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def user_stats(users: DataFrame) -> DataFrame:
    counts = users.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("role") == "admin").alias("admins"),
        F.count_if(F.col("role") == "standard").alias("standard"),
        F.count_if(F.col("is_active") == 1).alias("active"),
    )
    return counts.withColumn("inactive", F.col("total") - F.col("active"))


def file_stats(files: DataFrame) -> DataFrame:
    """Files per status and the share of completed ones in percent."""
    counts = files.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == status).alias(status) for status in V.STATUSES],
    )
    rate = F.try_divide(F.col("completed") * 100.0, F.col("total"))
    return counts.withColumn("completion_rate", F.coalesce(rate, F.lit(0.0)))


def entity_totals(files: DataFrame) -> DataFrame:
    """Entities per type over the counts of all files."""
    return (
        files.select(F.explode_outer(parsed_counts(files)).alias("entity_type", "n"))
        .filter(F.col("entity_type").isNotNull())
        .groupBy("entity_type")
        .agg(F.sum("n").alias("total"))
    )


def pii_total(files: DataFrame) -> DataFrame:
    """Entities over all files in one figure."""
    per_file = F.aggregate(
        F.map_values(parsed_counts(files)), F.lit(0).cast("long"), lambda acc, n: acc + n
    )
    return files.agg(F.coalesce(F.sum(per_file), F.lit(0)).alias("total_entities_detected"))


def top_entity_types(files: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent types; ties in order of name."""
    return entity_totals(files).orderBy(F.desc("total"), "entity_type").limit(k)


def file_type_distribution(files: DataFrame) -> DataFrame:
    return files.groupBy("file_type").agg(F.count(F.lit(1)).alias("files"))


def mode_usage(files: DataFrame) -> DataFrame:
    """Files per sanitizing mode; files without one do not count."""
    return (
        files.filter(F.col("anonymization_mode") != "")
        .groupBy("anonymization_mode")
        .agg(F.count(F.lit(1)).alias("files"))
    )


def recent_activity(
    files: DataFrame,
    audit: DataFrame,
    as_of: str | datetime | Column | None = None,
    days: int = 7,
) -> DataFrame:
    """Uploads and logins of the last days, each from one filtered scan."""
    since = _moment(as_of) - F.make_dt_interval(F.lit(days))
    uploads = files.filter(F.col("created_at") >= since).agg(
        F.count(F.lit(1)).alias("uploads"), F.lit(0).cast("long").alias("logins")
    )
    logins = audit.filter(
        (F.col("timestamp") >= since) & (F.col("event_type") == "USER_LOGIN")
    ).agg(F.lit(0).cast("long").alias("uploads"), F.count(F.lit(1)).alias("logins"))
    return uploads.unionByName(logins).agg(
        F.sum("uploads").alias("recent_uploads"), F.sum("logins").alias("recent_logins")
    )


def day_type_counts(files: DataFrame, **more: Column) -> DataFrame:
    """Files and entities per day and type; ``more`` are further aggregates over the same groups.

    A file is counted on the first of its exploded counts (``first``), so one scan and one
    aggregation serve files, entities and entities per type. Sums of such tables over
    disjoint parts of the files are the table of all.
    """
    return (
        files.select(
            "created_at",
            F.to_date("created_at").alias("date"),
            F.posexplode_outer(parsed_counts(files)).alias("pos", "entity_type", "n"),
        )
        .withColumn("first", F.coalesce(F.col("pos"), F.lit(0)) == 0)
        .groupBy("date", "entity_type")
        .agg(
            F.count_if(F.col("first")).alias("files"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
            *[column.alias(name) for name, column in more.items()],
        )
    )


def trend_of(by_type: DataFrame) -> DataFrame:
    """Counts per day and type as a row a day: at most days times types rows are grouped."""
    entry = F.when(F.col("entity_type").isNotNull(), F.struct("entity_type", "n"))
    return (
        by_type.groupBy("date")
        .agg(
            F.sum("files").alias("files_processed"),
            F.sum("n").alias("entities_detected"),
            F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("entity_breakdown"),
        )
        .orderBy("date")
    )


def daily_trend(
    files: DataFrame, as_of: str | datetime | Column | None = None, days: int = 30
) -> DataFrame:
    """Completed files per day: files, entities, entities per type."""
    since = _moment(as_of) - F.make_dt_interval(F.lit(days))
    recent = files.filter((F.col("created_at") >= since) & (F.col("status") == "completed"))
    return trend_of(day_type_counts(recent))


def user_activity(audit: DataFrame, limit: int = 20) -> DataFrame:
    """The latest events in short."""
    return (
        audit.orderBy(F.desc("timestamp"), F.desc("id"))
        .limit(limit)
        .select("timestamp", "username", "event_type", "filename", "success", "ip_address")
    )


def query_audit_log(
    audit: DataFrame,
    *,
    event_type: str | None = None,
    username: str | None = None,
    limit: int = 100,
) -> DataFrame:
    """Audit rows, newest first, optionally of one type or one user."""
    if event_type:
        audit = audit.filter(F.col("event_type") == event_type)
    if username:
        audit = audit.filter(F.col("username") == username)
    return audit.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)
