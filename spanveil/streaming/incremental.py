"""Files as they land: admit, encrypt, detect, sanitize and log each new batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanveil.functions.fixed_values import MAX_FILE_SIZE
from spanveil.functions.texts import content_hash
from spanveil.operators.audit import log_lifecycle
from spanveil.operators.catalog import admit, catalog_rows, process_files, refused_rows
from spanveil.sources.crypto import key_id
from spanveil.sources.storage import write_audit, write_sanitized, write_vault


def write_batch(
    files: DataFrame,
    users: DataFrame,
    folder: str,
    name: str,
    *,
    vault_key: bytes | None = None,
    limit: int = MAX_FILE_SIZE,
    **options,
) -> None:
    """Write one batch of files: encrypted originals, sanitized copies, catalog and audit rows.

    Files of a kind or size that is not allowed are refused, and files whose text
    could not be read fail; both have a catalog row and an audit row with the reason.  With
    ``vault_key`` the originals of admitted files are stored encrypted.

    The processed rows are written first and read back for the other outputs,
    so the texts are looked at once.  They hold detected values, so their
    folder is to be kept from readers of sanitized copies.  Every output of a
    batch has a folder of its own that is overwritten: a batch that runs again
    after a failure replaces what it left behind.  A mark of the batch is taken away first and
    written last; ``committed`` reads what has one.
    """
    spark = files.sparkSession
    _withdraw(spark, _mark(folder, name))

    def target(output: str) -> str:
        return f"{folder}/{output}/batch={name}"

    original = F.col("content" if "content" in files.columns else "text")
    admitted, refused = admit(
        files.withColumn("__size", F.octet_length(original)), size="__size", limit=limit
    )
    processed = process_files(admitted.drop("__size"), **options).drop("text")
    refused = refused_rows(refused.drop("__size")).drop("text")
    processed.unionByName(refused).write.mode("overwrite").parquet(target("processed"))
    done = spark.read.parquet(target("processed"))
    stored = {"sanitized_path": F.when(F.col("status") == "completed", target("sanitized"))}
    if vault_key is not None:
        write_vault(
            admitted.withColumn("content", original.cast("binary")),
            target("vault"),
            vault_key,
            mode="overwrite",
        )
        kept = F.col("anonymization_mode").isNotNull()
        stored["original_path"] = F.when(kept, target("vault"))
        stored["encryption_key_id"] = F.when(kept, key_id(vault_key))
    write_sanitized(done, target("sanitized"), mode="overwrite")
    catalog_rows(done.withColumns(stored)).write.mode("overwrite").parquet(target("catalog"))
    write_audit(log_lifecycle(done, users), f"{folder}/audit", name)
    spark.range(1).select(F.current_timestamp().alias("committed_at")).write.mode("overwrite").parquet(
        _mark(folder, name)
    )


def _mark(folder: str, name: str) -> str:
    return f"{folder}/commits/batch={name}"


def _withdraw(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def committed(spark: SparkSession, folder: str, output: str) -> DataFrame:
    """An output (processed, vault, sanitized, catalog, audit) of the batches that are whole.

    Outputs of a batch come into sight together: no catalog row is seen without its copy, its
    vault entry and its log.  A batch that runs again is out of sight until it is done.
    Without any batch that is whole there is no row.
    """
    rows = spark.read.parquet(f"{folder}/{output}")
    if not _exists(spark, f"{folder}/commits"):
        return rows.limit(0)
    # A row for each batch.
    whole = spark.read.schema("committed_at timestamp, batch string").parquet(f"{folder}/commits")
    named = F.col("batch").cast("string")
    return rows.withColumn("batch", named).join(whole.select("batch").distinct(), "batch", "left_semi")


def run_incremental(
    files: DataFrame, users: DataFrame, folder: str, *, repeats_within: str | None = None, **options
) -> None:
    """Work off what the stream of files has by now.

    If it has nothing, empty outputs are written, so that readers find tables in any case.
    """
    spark = files.sparkSession
    query = start_incremental(files, users, folder, once=True, repeats_within=repeats_within, **options)
    query.awaitTermination()
    if not any(p["numInputRows"] for p in query.recentProgress) and not _exists(spark, f"{folder}/catalog"):
        empty = spark.createDataFrame([], files.schema)
        write_batch(empty, users, folder, "none", **options)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def distinct_uploads(files: DataFrame, within: str) -> DataFrame:
    """The first upload of each file and content of a stream; later ones within the time are dropped.

    ``within`` bounds how long an upload is remembered, and how late one may come by its
    ``created_at``: the state holds a file's id and hash for that time and no longer.  A file that
    comes with another content is an upload of its own.
    """
    original = F.col("content" if "content" in files.columns else "text")
    return (
        files.withColumn("__hash", content_hash(F.coalesce(original.cast("binary"), F.lit(b""))))
        .withWatermark("created_at", within)
        .dropDuplicatesWithinWatermark(["file_id", "__hash"])
        .drop("__hash")
    )


def start_incremental(
    files: DataFrame,
    users: DataFrame,
    folder: str,
    *,
    once: bool = False,
    repeats_within: str | None = None,
    **options,
) -> StreamingQuery:
    """Follow a stream of files (file_id, filename, text, uploaded_by, created_at).

    ``folder`` is shared storage.  Nothing is kept between rows, so there is no state to grow,
    unless ``repeats_within`` (as "7 days") asks to drop repeated uploads.
    """
    if repeats_within is not None:
        files = distinct_uploads(files, repeats_within)

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, users, folder, str(batch_id), **options)

    writer = files.writeStream.foreachBatch(handle).option(
        "checkpointLocation", f"{folder}/progress"
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
