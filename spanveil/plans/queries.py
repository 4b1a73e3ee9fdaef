"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.functions import fixed_values as V
from spanveil.functions import texts as T
from spanveil.functions.masks import mask, redact, tokenize
from spanveil.functions.rules import ADDRESS_RANK, BASIC_RULES, STRUCTURED_RULES, Pattern, Rule
from spanveil.operators import access, analyze, audit, catalog, columns, entities, nested, search, segments, stats
from spanveil.operators import detect as D
from spanveil.operators import sanitize as S
from spanveil.plans import corpora as C
from spanveil.plans.oracles import TOKEN_KEY
from spanveil.sources import crypto
from spanveil.sources.readers import read_spread, read_table, with_text
from spanveil.sources.storage import settle, shared_folder
from spanveil.streaming.incremental import committed, run_incremental, write_batch
from spanveil.streaming.trends import start_trend, trend_so_far

Query = Callable[[SparkSession, str], DataFrame]
Reader = Callable[[SparkSession, str, str], DataFrame]


NAMED_KINDS = ["PERSON_NAME", "LOCATION", "ORGANIZATION", "SOMETHING_ELSE"]
# Texts of the log are short, so a task gets more of its rows.
LOG_ROWS_PER_TASK = 25_000
# Some of the files of ``upload_outcomes`` are a character too long.
UPLOAD_LIMIT = 26


# --- inputs -----------------------------------------------------------------
def _documents(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "documents").select("doc_id", "text")


def _files_with_text(spark: SparkSession, directory: str) -> DataFrame:
    """Documents as files that came in."""
    return _documents(spark, directory).select(
        F.col("doc_id").alias("file_id"),
        F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")).alias("filename"),
        "text",
        (F.col("doc_id") % 50).alias("uploaded_by"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"),
    )


def _processed(spark: SparkSession, directory: str) -> DataFrame:
    return catalog.process_files(_files_with_text(spark, directory), mode="redact")


def _records(spark: SparkSession, directory: str) -> DataFrame:
    return C.records(spark, directory)


def _users(spark: SparkSession, directory: str) -> DataFrame:
    return C.run(spark, directory, C.USERS, "customer")


def _files(spark: SparkSession, directory: str) -> DataFrame:
    return C.run(spark, directory, C.FILES, "orders")


def _actions(spark: SparkSession, directory: str, read: Reader = read_table) -> DataFrame:
    return C.run(spark, directory, C.ACTIONS, "events", read=read).withColumn(
        "success", F.col("success") == 1
    )


def _log(spark: SparkSession, directory: str, read: Reader = read_table) -> DataFrame:
    named = _actions(spark, directory, read).withColumn(
        "filename", F.concat(F.lit("Report_"), F.col("file_id"))
    )
    return audit.log_events(named, _users(spark, directory))


def _detected(spark: SparkSession, directory: str) -> DataFrame:
    return D.detect(C.corpus(spark, directory))


# --- scans and scalars ------------------------------------------------------
def text_extraction(spark: SparkSession, directory: str) -> DataFrame:
    broken = F.concat(F.unhex(F.lit("C328")), F.col("html").cast("binary"))
    content = F.when(F.col("page_id") % 4 < 2, F.col("html").cast("binary")).otherwise(broken)
    kind = F.when(F.col("page_id") % 2 == 0, "txt").otherwise("unknown")
    text = T.extract_text(F.col("content"), F.col("kind"))
    pages = read_table(spark, directory, "pages")
    return (
        pages.select("page_id", content.alias("content"), kind.alias("kind"))
        .withColumn("text", text)
        .select("page_id", T.content_hash(F.col("text")).alias("text_hash"), F.length("text").alias("n_chars"))
    )


def file_types(spark: SparkSession, directory: str) -> DataFrame:
    named = _files(spark, directory).select(T.file_type_of(F.col("filename")).alias("file_type"))
    return named.groupBy("file_type").agg(F.count(F.lit(1)).alias("files"))


def admission(spark: SparkSession, directory: str) -> DataFrame:
    suffix = F.element_at(
        F.array(*[F.lit(x) for x in (".txt", ".HTML", ".csv", ".exe")]),
        (F.col("page_id") % 4 + 1).cast("int"),
    )
    files = read_table(spark, directory, "pages").select(
        "page_id",
        F.concat(F.lit("page_"), F.col("page_id"), suffix).alias("filename"),
        F.octet_length("html").alias("file_size"),
    )
    admitted, refused = catalog.admit(files, limit=2000)
    return admitted.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(refused).select(
        "page_id", "reject_reason"
    )


def content_hash(spark: SparkSession, directory: str) -> DataFrame:
    return _documents(spark, directory).select("doc_id", T.content_hash(F.col("text")).alias("hash"))


def integrity_check(spark: SparkSession, directory: str) -> DataFrame:
    changed = F.concat("text", F.when(F.col("doc_id") % 10 == 3, "!").otherwise(""))
    docs = _documents(spark, directory).select(
        "doc_id", changed.alias("content"), T.content_hash(F.col("text")).alias("expected_hash")
    )
    return crypto.verify_hashes(docs, "content", "expected_hash").select("doc_id", "actual_hash")


def encrypt_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    key, other = (crypto.derive_key("registered", s) for s in ("queries", "others"))
    docs = _documents(spark, directory)
    # The initial vector is random; a hash of the cipher text would make it run twice.
    locked = docs.select("doc_id", "text", crypto.encrypt(F.col("text"), key).alias("locked"))
    return locked.select(
        "doc_id",
        T.content_hash(crypto.decrypt(F.col("locked"), key)).alias("hash"),
        (F.col("locked") != F.col("text").cast("binary")).alias("changed"),
        crypto.decrypt(F.col("locked"), other).isNull().alias("refused"),
    )


def key_rotation(spark: SparkSession, directory: str) -> DataFrame:
    """Contents under keys of their own, read after the master key was changed."""
    secret, old, new = (crypto.derive_key("registered", s) for s in ("files", "queries", "others"))
    docs = _documents(spark, directory)
    keys = crypto.wrapped_keys(docs, secret, old, "doc_id")
    locked = docs.select(
        "doc_id", crypto.encrypt_with(F.col("text"), crypto.data_key(secret, F.col("doc_id"))).alias("locked")
    )
    own = crypto.unwrap(F.col("wrapped_key"), new)
    return locked.join(crypto.rotate_keys(keys, old, new), "doc_id").select(
        "doc_id",
        T.content_hash(crypto.decrypt_with(F.col("locked"), own)).alias("hash"),
        crypto.unwrap(F.col("wrapped_key"), old).isNull().alias("refused"),
    )


def key_ids(spark: SparkSession, directory: str) -> DataFrame:
    return _documents(spark, directory).select(
        "doc_id", F.length(crypto.new_key_id()).alias("id_length")
    )


def preview(spark: SparkSession, directory: str) -> DataFrame:
    shown, more = T.preview_bytes(F.col("html").cast("binary"))
    return read_table(spark, directory, "pages").select(
        "page_id", shown.alias("content"), more.alias("truncated")
    )


# --- detectors --------------------------------------------------------------
def _long(find: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, directory: str) -> DataFrame:
        found = find(C.corpus(spark, directory))
        return D.explode_detections(found, ["key"]).select("key", "start", "end", "text")

    return query


def _detectors() -> dict[str, Query]:
    found = {
        f"detect_{r.entity_type.lower()}": _long(lambda df, r=r: D.find_rule(df, r))
        for r in STRUCTURED_RULES
    }
    found |= {
        f"basic_{r.entity_type}": _long(lambda df, r=r: D.find_rule(df, r)) for r in BASIC_RULES
    }
    kinds = {"after_prefix": "prefix", "street": "street", "unit": "unit", "city": "city"}
    found |= {
        f"address_{name}": _long(lambda df, kind=kind: D.find_address_kind(df, kind))
        for name, kind in kinds.items()
    }
    return found | {"detect_address": _long(D.find_addresses)}


# --- detection --------------------------------------------------------------
def detect_raw(spark: SparkSession, directory: str) -> DataFrame:
    return D.explode_detections(D.detect_raw(C.corpus(spark, directory)), ["key"]).drop("pos")


def detect_all(spark: SparkSession, directory: str) -> DataFrame:
    return D.explode_detections(_detected(spark, directory), ["key"])


def resolve_overlaps(spark: SparkSession, directory: str) -> DataFrame:
    docs = read_table(spark, directory, "documents").select("text", "source")
    return D.count_entities(D.detect(docs, addresses=False), ["source"])


def entity_counts(spark: SparkSession, directory: str) -> DataFrame:
    return D.detect_with_counts(C.corpus(spark, directory)).select(
        "key", F.to_json("entity_counts").alias("entity_counts"), "total_entities"
    )


def counts_by_entity_type(spark: SparkSession, directory: str) -> DataFrame:
    return D.count_entities(_detected(spark, directory))


def detections_json(spark: SparkSession, directory: str) -> DataFrame:
    return D.detections_to_json(_detected(spark, directory)).select("key", "pii_detected")


def _load_model() -> entities.Model:
    """A stand-in for a named-entity model: customer names are persons."""
    import re

    name = re.compile(r"Customer#[0-9]+")
    return lambda texts: [
        [("PERSON", m.start(), m.end()) for m in name.finditer(text)] for text in texts
    ]


def model_entities(spark: SparkSession, directory: str) -> DataFrame:
    found = entities.with_model_entities(_records(spark, directory), _load_model)
    return D.explode_detections(D.detect(found, model_spans="model_spans"), ["key"])


def listed_entities(spark: SparkSession, directory: str) -> DataFrame:
    names = read_table(spark, directory, "nation").select(
        F.col("n_name").alias("name"), F.lit("LOCATION").alias("entity_type")
    )
    found = entities.with_listed_entities(_records(spark, directory), names, "key")
    return D.explode_detections(D.detect(found, model_spans="model_spans"), ["key"])


def user_rules(spark: SparkSession, directory: str) -> DataFrame:
    own = Rule(
        "ORDER_CODE",
        50,
        0.99,
        (Pattern(r"\bCustomer#[0-9]+\b"),),
        mask=lambda value: F.regexp_replace(value, "[0-9]+", "?"),
    )
    rules = (*STRUCTURED_RULES, own)
    found = D.detect(_records(spark, directory), rules=rules)
    return S.sanitize(found, rules=rules).select("key", "sanitized_text")


def user_rules_of_equal_rank(spark: SparkSession, directory: str) -> DataFrame:
    """Two rules of one rank, also that of addresses; the test of one leaves the other alone."""
    seventh = Rule(
        "SEVENTH",
        ADDRESS_RANK,
        0.99,
        (Pattern(r"\bCustomer#[0-9]+\b"),),
        keep=lambda value: value.endswith("7"),
    )
    nation = Rule("NATION_CODE", ADDRESS_RANK, 0.99, (Pattern(r"\bNATION_[0-9]+\b"),))
    found = D.detect(_records(spark, directory), rules=(*STRUCTURED_RULES, seventh, nation))
    return D.explode_detections(found, ["key"])


def replacements_of_names(spark: SparkSession, directory: str) -> DataFrame:
    """Masks of what models find, and of types without a mask of their own."""
    kinds = F.array(*[F.lit(k) for k in NAMED_KINDS])
    return (
        read_table(spark, directory, "customer")
        .select(
            F.explode(kinds).alias("entity_type"),
            F.concat_ws(" ", F.lit("Ann O'Neil"), "c_mktsegment", F.col("c_custkey") % 100).alias("value"),
        )
        .distinct()
        .select("*", mask(F.col("value"), F.col("entity_type")).alias("masked"))
    )


def upload_outcomes(spark: SparkSession, directory: str) -> DataFrame:
    """Files of all kinds: refused, failed because they hold no plain text, or completed."""
    files = (
        _files(spark, directory)
        .select("file_id", "filename", "file_type", "uploaded_by", "created_at")
        .withColumn(
            "content",
            F.concat(F.lit("order "), "file_id", F.lit(" of c"), "uploaded_by", F.lit("@example.com"))
            .cast("binary"),
        )
        .withColumn("size", F.octet_length("content"))
    )
    admitted, refused = catalog.admit(files, size="size", limit=UPLOAD_LIMIT)
    processed = catalog.process_files(with_text(admitted), mode="redact").drop("text", "size")
    every = processed.unionByName(catalog.refused_rows(refused).drop("text", "size"))
    return every.groupBy("file_type", "status", "error_message").agg(
        F.count("*").alias("files"), F.sum("total_entities").cast("long").alias("entities")
    )


def _detected_totals(spark: SparkSession, directory: str) -> DataFrame:
    return D.detect_with_counts(C.corpus(spark, directory)).select("entity_counts")


# --- basic profile ----------------------------------------------------------
def _basic(spark: SparkSession, directory: str) -> DataFrame:
    return D.detect_basic(C.corpus(spark, directory))


def basic_detect_all(spark: SparkSession, directory: str) -> DataFrame:
    return D.explode_detections(_basic(spark, directory), ["key"]).drop("detection_method")


def basic_counts(spark: SparkSession, directory: str) -> DataFrame:
    return D.count_entities(_basic(spark, directory))


def basic_mask(spark: SparkSession, directory: str) -> DataFrame:
    return S.mask_basic(_basic(spark, directory)).select("key", "masked_text")


def basic_redact(spark: SparkSession, directory: str) -> DataFrame:
    return S.redact_basic(_basic(spark, directory)).select("key", "redacted_text")


# --- sanitizing -------------------------------------------------------------
def _sanitize(mode: str) -> Query:
    def query(spark: SparkSession, directory: str) -> DataFrame:
        key = TOKEN_KEY if mode == "tokenize" else None
        return S.sanitize(_detected(spark, directory), mode=mode, key=key).select(
            "key", "sanitized_text"
        )

    return query


def replacements(spark: SparkSession, directory: str) -> DataFrame:
    value, kind = F.col("value"), F.col("entity_type")
    return (
        D.explode_detections(_detected(spark, directory), [])
        .select("entity_type", F.col("text").alias("value"))
        .distinct()
        .select(
            "entity_type",
            "value",
            mask(value, kind).alias("masked"),
            redact(kind).alias("redacted"),
            tokenize(value, TOKEN_KEY).alias("token"),
        )
    )


def compare_modes(spark: SparkSession, directory: str) -> DataFrame:
    return S.compare_modes(_detected(spark, directory), key=TOKEN_KEY).select(
        "key", *[f"{mode}_version" for mode in V.MODES]
    )


def _dumps(spark: SparkSession, directory: str) -> DataFrame:
    return C.run(spark, directory, C.DUMPS, "customer", read=read_spread)


def sanitize_sql_dump(spark: SparkSession, directory: str) -> DataFrame:
    return S.sanitize(D.detect(_dumps(spark, directory))).select("key", "sanitized_text")


def sanitize_sql_literals(spark: SparkSession, directory: str) -> DataFrame:
    return S.sanitize_sql_literals(_dumps(spark, directory)).select("key", "sanitized_text")


# --- segments ---------------------------------------------------------------
def _segments(spark: SparkSession, directory: str) -> DataFrame:
    return C.run(spark, directory, C.SEGMENTS, "conversations")


def assemble_segments(spark: SparkSession, directory: str) -> DataFrame:
    return segments.assemble(_segments(spark, directory), "conv_id", "turn").select("conv_id", "text")


def _sanitize_segments(fallback: bool) -> Query:
    def query(spark: SparkSession, directory: str) -> DataFrame:
        return segments.sanitize_segments(
            _segments(spark, directory), "conv_id", "turn", partial_fallback=fallback
        ).drop("kind")

    return query


def sanitize_long_documents(spark: SparkSession, directory: str) -> DataFrame:
    """Three documents of all turns, each cut into runs."""
    long = C.run(spark, directory, C.LONG_SEGMENTS, "conversations")
    return segments.sanitize_segments(long, "conv_id", "turn", run=20_000, reach=2_000).drop("kind")


# --- analysis ---------------------------------------------------------------
def analyze_texts(spark: SparkSession, directory: str) -> DataFrame:
    return analyze.analyze(C.corpus(spark, directory)).select(
        "key", F.col("text").alias("original_text"), "sanitized_text", "total_entities"
    )


def highlight(spark: SparkSession, directory: str) -> DataFrame:
    return analyze.highlight(_detected(spark, directory)).select("key", "html")


def batch_lines(spark: SparkSession, directory: str) -> DataFrame:
    return analyze.split_lines(C.corpus(spark, directory), ["key"])


def batch_analyze(spark: SparkSession, directory: str) -> DataFrame:
    lines = batch_lines(spark, directory).select(
        F.concat("key", F.lit("#"), "pos").alias("key"), F.col("line").alias("text")
    )
    analyzed = analyze.analyze(lines, mode="redact")
    return analyze.for_display(analyzed, ["sanitized_text"]).select(
        "key", "sanitized_text", "total_entities"
    )


def _analyzed(spark: SparkSession, directory: str) -> DataFrame:
    return D.detect_with_counts(C.corpus(spark, directory))


def batch_summary(spark: SparkSession, directory: str) -> DataFrame:
    return analyze.summarize(_analyzed(spark, directory)).withColumn(
        "average_entities_per_text", F.round("average_entities_per_text", 6)
    )


def batch_breakdown(spark: SparkSession, directory: str) -> DataFrame:
    return analyze.breakdown(_analyzed(spark, directory))


def entity_type_info(spark: SparkSession, directory: str) -> DataFrame:
    spans = D.explode_detections(_detected(spark, directory), [])
    kind = F.when(F.col("confidence") < 0.8, "OTHER").otherwise(F.col("entity_type"))
    counts = spans.select(kind.alias("entity_type")).groupBy("entity_type").agg(
        F.count(F.lit(1)).alias("n")
    )
    return analyze.with_entity_info(counts)


# --- catalog and figures ----------------------------------------------------
def catalog_rows(spark: SparkSession, directory: str) -> DataFrame:
    return catalog.catalog_rows(_processed(spark, directory)).select(
        "file_id",
        "filename",
        "file_type",
        "file_size",
        "original_hash",
        "sanitized_hash",
        "anonymization_mode",
        "status",
        "total_entities",
    )


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    return catalog.list_files(_files(spark, directory)).select(
        "file_id",
        "filename",
        "file_type",
        "status",
        "anonymization_mode",
        "uploaded_by",
        T.display_time(F.col("created_at")).alias("created"),
        F.coalesce(F.try_element_at("entity_counts", F.lit("EMAIL")), F.lit(0)).alias("emails"),
    )


def search_files(spark: SparkSession, directory: str) -> DataFrame:
    return catalog.search_files(_files(spark, directory), "12.V2").select("file_id", "filename")


def file_stats(spark: SparkSession, directory: str) -> DataFrame:
    return stats.file_stats(_files(spark, directory)).withColumn(
        "completion_rate", F.round("completion_rate", 6)
    )


def daily_trend(spark: SparkSession, directory: str) -> DataFrame:
    return _shown_trend(stats.daily_trend(_files(spark, directory), C.AS_OF_FILES))


def _shown_trend(trend: DataFrame) -> DataFrame:
    emails = F.try_element_at("entity_breakdown", F.lit("EMAIL"))
    return trend.select(
        F.col("date").cast("string").alias("date"),
        "files_processed",
        "entities_detected",
        F.coalesce(emails, F.lit(0)).alias("emails"),
    )


def user_activity(spark: SparkSession, directory: str) -> DataFrame:
    shown = stats.user_activity(_log(spark, directory))
    return shown.withColumn("timestamp", T.display_time(F.col("timestamp"))).withColumnRenamed(
        "timestamp", "at"
    )


def _audit_query(**filters) -> Query:
    def query(spark: SparkSession, directory: str) -> DataFrame:
        return stats.query_audit_log(_log(spark, directory), **filters).select(
            "id", T.display_time(F.col("timestamp")).alias("at"), "username", "event_type"
        )

    return query


def display_time(spark: SparkSession, directory: str) -> DataFrame:
    moment = F.when(F.col("id") % 5 != 0, F.col("timestamp"))
    return _actions(spark, directory).select("id", T.display_time(moment).alias("shown"))


# --- audit log --------------------------------------------------------------
def log_events(spark: SparkSession, directory: str) -> DataFrame:
    counts = F.when(
        F.col("id") % 2 == 0, F.create_map(F.lit("EMAIL"), F.col("id") % 3 + 1)
    ).otherwise(F.create_map().cast("map<string,bigint>"))
    actions = _actions(spark, directory).withColumn("entity_counts", counts)
    return audit.log_events(actions, _users(spark, directory)).select(
        "id", "event_type", "user_id", "username", "user_role", "success", "ip_address", "entity_counts"
    )


_FILE_EVENT = [
    "id", "event_type", "user_id", "username", "user_role", "file_id", "filename", "file_hash", "ip_address",
]
_USER_EVENT = ["id", "event_type", "user_id", "username", "user_role", "success", "ip_address"]
_LIFE_EVENT = [
    "id", "event_type", "user_id", "username", "user_role", "file_id", "entity_counts", "total_entities",
    "anonymization_mode", "success", "file_hash",
]


def _of_type(spark: SparkSession, directory: str, kind: str) -> DataFrame:
    return _actions(spark, directory).filter(F.col("event_type") == kind)


def log_uploads(spark: SparkSession, directory: str) -> DataFrame:
    actions = _of_type(spark, directory, "FILE_UPLOAD")
    return audit.log_uploads(actions, _users(spark, directory), _files(spark, directory)).select(
        _FILE_EVENT
    )


def log_downloads(spark: SparkSession, directory: str) -> DataFrame:
    actions = _of_type(spark, directory, "FILE_DOWNLOAD_SANITIZED").withColumn(
        "is_sanitized", F.col("value") < 20
    )
    return audit.log_downloads(actions, _users(spark, directory), _files(spark, directory)).select(
        _FILE_EVENT
    )


def log_views_of_original(spark: SparkSession, directory: str) -> DataFrame:
    actions = _of_type(spark, directory, "FILE_VIEW_ORIGINAL")
    return audit.log_views_of_original(
        actions, _users(spark, directory), _files(spark, directory)
    ).select(_FILE_EVENT)


def log_logins(spark: SparkSession, directory: str) -> DataFrame:
    actions = _of_type(spark, directory, "USER_LOGIN")
    return audit.log_logins(actions, _users(spark, directory)).select(_USER_EVENT)


def log_user_creation(spark: SparkSession, directory: str) -> DataFrame:
    actions = _of_type(spark, directory, "USER_CREATED")
    return audit.log_user_creation(actions, _users(spark, directory)).select(_USER_EVENT)


def log_detections(spark: SparkSession, directory: str) -> DataFrame:
    return audit.log_detections(_processed(spark, directory), _users(spark, directory)).select(
        _LIFE_EVENT
    )


def log_sanitizations(spark: SparkSession, directory: str) -> DataFrame:
    return audit.log_sanitizations(_processed(spark, directory), _users(spark, directory)).select(
        _LIFE_EVENT
    )


def log_lifecycle(spark: SparkSession, directory: str) -> DataFrame:
    return audit.log_lifecycle(_processed(spark, directory), _users(spark, directory)).select(
        _LIFE_EVENT
    )


def no_values_in_log(spark: SparkSession, directory: str) -> DataFrame:
    log = audit.log_lifecycle(_processed(spark, directory), _users(spark, directory))
    return audit.find_leaks(log).agg(F.count(F.lit(1)).alias("leaks"))


def client_ip(spark: SparkSession, directory: str) -> DataFrame:
    last = (F.col("user_id") % 250).cast("string")
    forwarded = F.when(F.col("id") % 3 == 0, F.concat(F.lit(" 10.0.0."), last, F.lit(" , 10.9.9.9")))
    real = F.when(F.col("id") % 3 == 1, F.concat(F.lit("172.16.0."), last)).otherwise("")
    return _actions(spark, directory).select(
        "id", T.client_ip(forwarded, real, F.col("ip_address")).alias("client")
    )


# --- access -----------------------------------------------------------------
def _files_for(role: str) -> Query:
    return lambda spark, directory: access.files_for(_files(spark, directory), role).select(
        "file_id", "status"
    )


def content_by_role(spark: SparkSession, directory: str) -> DataFrame:
    processed = _processed(spark, directory)
    shown = {
        "admin": access.content_for(processed, "admin", original=True),
        "standard": access.content_for(processed, "standard"),
    }
    first, second = (
        content.select("file_id", F.lit(role).alias("role"), "content")
        for role, content in shown.items()
    )
    return first.unionByName(second)


def active_users_only(spark: SparkSession, directory: str) -> DataFrame:
    return access.actions_of_active_users(
        _actions(spark, directory), _users(spark, directory)
    ).select("id", "user_id", "event_type")


def role_violations(spark: SparkSession, directory: str) -> DataFrame:
    return access.role_violations(_log(spark, directory)).select(
        "id", "event_type", "user_id", "username", "user_role"
    )


# --- tables and streams -----------------------------------------------------
def _contacts(spark: SparkSession, directory: str) -> DataFrame:
    return read_spread(spark, directory, "customer").selectExpr(
        "c_custkey",
        "c_name",
        f"{C.EMAIL} || ' ' || ({C.PHONE}) AS contact",
        f"CASE WHEN c_custkey % 3 = 0 THEN ({C.ADDRESS}) END AS note",
    )


def scan_columns(spark: SparkSession, directory: str) -> DataFrame:
    return columns.scan_columns(_contacts(spark, directory)).withColumn(
        "hit_rate", F.round("hit_rate", 6)
    )


def sanitize_columns(spark: SparkSession, directory: str) -> DataFrame:
    return columns.sanitize_columns(_contacts(spark, directory), ["contact"]).select(
        "c_custkey", "contact"
    )


def _profiles(spark: SparkSession, directory: str) -> DataFrame:
    """Customers as nested rows; some have JSON text that is cut off."""
    return C.run(spark, directory, C.PROFILES, "customer", read=read_spread)


def scan_nested(spark: SparkSession, directory: str) -> DataFrame:
    found = nested.scan_nested(_profiles(spark, directory), json={"payload": C.PAYLOAD})
    return found.withColumn("hit_rate", F.round("hit_rate", 6))


def sanitize_nested(spark: SparkSession, directory: str) -> DataFrame:
    done = nested.sanitize_nested(_profiles(spark, directory), json={"payload": C.PAYLOAD})
    return done.select(
        "c_custkey",
        F.col("contact.mail").alias("mail"),
        F.col("contact.name").alias("name"),
        F.get("entries", 0)["value"].alias("first_value"),
        F.get("entries", 1)["value"].alias("second_value"),
        F.element_at("labels", "ip").alias("ip"),
        "payload",
    )


def uncovered_parts(spark: SparkSession, directory: str) -> DataFrame:
    found = D.find_uncovered(C.corpus(spark, directory))
    return found.select("key", F.inline("uncovered")).select("key", "start", "end", "text")


def search_files_by_index(spark: SparkSession, directory: str) -> DataFrame:
    files = _files(spark, directory)
    index = settle(search.name_index(files), "name-index")
    return search.search_by_index(index, files, "12.V2").select("file_id", "filename")


def detected_values_in_log(spark: SparkSession, directory: str) -> DataFrame:
    """Names of users, which no pattern finds, in file names of the log."""
    log = _log(spark, directory, partial(read_spread, rows_per_task=LOG_ROWS_PER_TASK))
    named = F.concat(F.lit("Statement of "), F.col("username"), F.lit(".txt"))
    told = log.withColumn("filename", F.when(F.col("id") % 3 == 0, named).otherwise(F.col("filename")))
    values = _users(spark, directory).select(
        F.lit("PERSON_NAME").alias("entity_type"), F.col("username").alias("text")
    )
    return audit.find_value_leaks(told, values)


def daily_trend_followed(spark: SparkSession, directory: str) -> DataFrame:
    """The trend of a stream of files, to its present end."""
    schema = read_table(spark, directory, "orders").schema
    orders = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 8)
        .parquet(f"{directory.rstrip('/')}/orders.parque[t]")
    )
    view = f"orders_{uuid.uuid4().hex}"
    orders.createOrReplaceTempView(view)
    files = spark.sql(C.FILES.replace("FROM orders", f"FROM {view}"))
    spark.catalog.dropTempView(view)
    folder = _new_folder(spark, "trend")
    start_trend(files, folder, once=True).awaitTermination()
    return _shown_trend(trend_so_far(spark, folder, C.AS_OF_FILES))


def incremental(spark: SparkSession, directory: str) -> DataFrame:
    """Follow the documents table as a stream, to its present end."""
    schema = read_table(spark, directory, "documents").schema
    # The table may be a file or a folder of files; as a pattern its path is taken for either.
    stream = spark.readStream.schema(schema).parquet(f"{directory.rstrip('/')}/documents.parque[t]")
    files = stream.select(
        F.col("doc_id").alias("file_id"),
        F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")).alias("filename"),
        "text",
        (F.col("doc_id") % 50).alias("uploaded_by"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"),
    )
    run_id = spark.range(1).select(F.uuid()).first()[0]
    folder = f"{shared_folder(spark)}/incremental-{run_id}"
    run_incremental(files, _users(spark, directory), folder, mode="redact")
    return spark.read.parquet(f"{folder}/sanitized").select("file_id", "sanitized_hash")


def _new_folder(spark: SparkSession, purpose: str) -> str:
    run_id = spark.range(1).select(F.uuid()).first()[0]
    return f"{shared_folder(spark)}/{purpose}-{run_id}"


def repeated_uploads(spark: SparkSession, directory: str) -> DataFrame:
    """All documents uploaded twice, with a restart of the stream in between: one copy each."""
    files, folder = _files_with_text(spark, directory), _new_folder(spark, "repeated")
    for _ in range(2):
        files.write.mode("append").parquet(f"{folder}/uploads")
        stream = spark.readStream.schema(files.schema).parquet(f"{folder}/uploads")
        run_incremental(
            stream, _users(spark, directory), folder, repeats_within="7 days", mode="redact"
        )
    return spark.read.parquet(f"{folder}/sanitized").select("file_id", "sanitized_hash")


def stored_outputs(spark: SparkSession, directory: str) -> DataFrame:
    """What a batch leaves in the vault, the catalog and the audit log, read back."""
    files, folder = _files_with_text(spark, directory), _new_folder(spark, "stored")
    key = crypto.derive_key("registered", "queries")
    write_batch(files, _users(spark, directory), folder, "0", vault_key=key, mode="redact")
    vault = spark.read.parquet(f"{folder}/vault").select(
        "file_id",
        T.content_hash(crypto.decrypt(F.col("encrypted"), key)).alias("restored_hash"),
        "original_hash",
    )
    events = (
        spark.read.parquet(f"{folder}/audit")
        .groupBy("file_id")
        .agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("events"))
    )
    kept = spark.read.parquet(f"{folder}/catalog").select("file_id", "status")
    return vault.join(events, "file_id").join(kept, "file_id")


def committed_outputs(spark: SparkSession, directory: str) -> DataFrame:
    """Two batches, the second run again as after a failure: what readers of whole batches see."""
    files, folder = _files_with_text(spark, directory), _new_folder(spark, "committed")
    users = _users(spark, directory)
    first = F.pmod(F.xxhash64("file_id"), F.lit(2)) == 0
    for name, part in (("0", files.filter(first)), ("1", files.filter(~first)), ("1", files.filter(~first))):
        write_batch(part, users, folder, name, mode="redact")
    events = committed(spark, folder, "audit").groupBy("file_id").agg(F.count(F.lit(1)).alias("events"))
    copies = committed(spark, folder, "sanitized").select("file_id", "sanitized_hash")
    listed = committed(spark, folder, "catalog").select("file_id", "status")
    return listed.join(copies, "file_id").join(events, "file_id")


def all_queries() -> dict[str, Query]:
    return {
        "text_extraction": text_extraction,
        "file_types": file_types,
        "admission": admission,
        "content_hash": content_hash,
        "integrity_check": integrity_check,
        "encrypt_round_trip": encrypt_round_trip,
        "key_ids": key_ids,
        "key_rotation": key_rotation,
        "stored_outputs": stored_outputs,
        "committed_outputs": committed_outputs,
        "repeated_uploads": repeated_uploads,
        "preview": preview,
        **_detectors(),
        "detect_raw": detect_raw,
        "detect_all": detect_all,
        "resolve_overlaps": resolve_overlaps,
        "uncovered_parts": uncovered_parts,
        "entity_counts": entity_counts,
        "counts_by_entity_type": counts_by_entity_type,
        "detections_json": detections_json,
        "model_entities": model_entities,
        "listed_entities": listed_entities,
        "user_rules": user_rules,
        "user_rules_of_equal_rank": user_rules_of_equal_rank,
        "replacements_of_names": replacements_of_names,
        "upload_outcomes": upload_outcomes,
        "top_detected_types": lambda s, d: stats.top_entity_types(_detected_totals(s, d), 10),
        "top_detected_types_displayed": lambda s, d: stats.top_entity_types(_detected_totals(s, d), 8),
        "recent_events": lambda s, d: stats.recent_activity(
            _files(s, d), _actions(s, d), C.AS_OF_EVENTS
        ),
        "basic_detect_all": basic_detect_all,
        "basic_counts": basic_counts,
        "basic_mask": basic_mask,
        "basic_redact": basic_redact,
        **{f"sanitize_{mode}": _sanitize(mode) for mode in V.MODES},
        "replacements": replacements,
        "compare_modes": compare_modes,
        "sanitize_sql_dump": sanitize_sql_dump,
        "sanitize_sql_literals": sanitize_sql_literals,
        "assemble_segments": assemble_segments,
        "sanitize_segments": _sanitize_segments(False),
        "sanitize_long_documents": sanitize_long_documents,
        "sanitize_segments_by_first_word": _sanitize_segments(True),
        "analyze": analyze_texts,
        "highlight": highlight,
        "batch_lines": batch_lines,
        "batch_analyze": batch_analyze,
        "batch_summary": batch_summary,
        "batch_breakdown": batch_breakdown,
        "entity_type_info": entity_type_info,
        "catalog": catalog_rows,
        "list_files": list_files,
        "search_files": search_files,
        "search_files_by_index": search_files_by_index,
        "user_stats": lambda s, d: stats.user_stats(_users(s, d)),
        "file_stats": file_stats,
        "pii_total": lambda s, d: stats.pii_total(_files(s, d)),
        "entity_totals": lambda s, d: stats.entity_totals(_files(s, d)),
        "top_entity_types": lambda s, d: stats.top_entity_types(_files(s, d)),
        "top_entity_types_displayed": lambda s, d: stats.top_entity_types(_files(s, d), 2),
        "file_type_distribution": lambda s, d: stats.file_type_distribution(_files(s, d)),
        "mode_usage": lambda s, d: stats.mode_usage(_files(s, d)),
        "recent_activity": lambda s, d: stats.recent_activity(
            _files(s, d), _actions(s, d), C.AS_OF_FILES
        ),
        "daily_trend": daily_trend,
        "daily_trend_followed": daily_trend_followed,
        "user_activity": user_activity,
        "audit_query": _audit_query(event_type="USER_LOGIN"),
        "audit_query_by_user": _audit_query(username="Customer#000000007"),
        "display_time": display_time,
        "log_events": log_events,
        "log_uploads": log_uploads,
        "log_downloads": log_downloads,
        "log_views_of_original": log_views_of_original,
        "log_logins": log_logins,
        "log_user_creation": log_user_creation,
        "log_detections": log_detections,
        "log_sanitizations": log_sanitizations,
        "log_lifecycle": log_lifecycle,
        "no_values_in_log": no_values_in_log,
        "detected_values_in_log": detected_values_in_log,
        "client_ip": client_ip,
        "files_for_standard": _files_for("standard"),
        "files_for_admin": _files_for("admin"),
        "content_by_role": content_by_role,
        "active_users_only": active_users_only,
        "role_violations": role_violations,
        "scan_columns": scan_columns,
        "sanitize_columns": sanitize_columns,
        "scan_nested": scan_nested,
        "sanitize_nested": sanitize_nested,
        "incremental": incremental,
    }
