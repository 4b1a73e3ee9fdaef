"""Inputs of the registered queries, as SQL that Spark and DuckDB both run.

The driver's tables hold few kinds of entities, so texts with all kinds are
made from the keys of the customer table, by the same expressions in both
engines.  ``chr(10)`` is a line end.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanveil.sources.readers import read_spread, read_table


def _digits(value: str, width: int, fill: str = "0") -> str:
    return f"lpad(CAST({value} AS STRING), {width}, '{fill}')"


K = "c_custkey"

EMAIL = f"'user.' || {K} || '@mail' || ({K} % 7) || '.example.com'"
PHONE = f"""CASE {K} % 4
  WHEN 0 THEN '+91-9' || {_digits(K, 9)}
  WHEN 1 THEN '09' || {_digits(K, 9)}
  WHEN 2 THEN '+91 98765 ' || {_digits(f"{K} % 100000", 5)}
  ELSE '+44 20' || {_digits(K, 8)} END"""
AADHAAR = f"""CASE {K} % 2
  WHEN 0 THEN '2034 5678 ' || {_digits(f"{K} % 10000", 4)}
  ELSE '98765432' || {_digits(f"{K} % 10000", 4)} END"""
PAN = f"'ABCDE' || {_digits(f'{K} % 10000', 4)} || 'F'"
IP = f"'10.' || ({K} % 256) || '.' || ({K} % 200) || '.' || c_nationkey"
CARD = f"""CASE {K} % 3
  WHEN 0 THEN '4532-1234-5678-' || {_digits(f"{K} % 10000", 4)}
  WHEN 1 THEN '411111111111' || {_digits(f"{K} % 10000", 4)}
  ELSE '5500 0000 0000 ' || {_digits(f"{K} % 10000", 4)} END"""
BIRTH = f"""CASE {K} % 3
  WHEN 0 THEN '14 March 19' || {_digits(f"{K} % 100", 2)}
  WHEN 1 THEN '19' || {_digits(f"{K} % 100", 2)} || '-03-14'
  ELSE '14/03/19' || {_digits(f"{K} % 100", 2)} END"""
PASSPORT = f"'J' || {_digits(K, 7)}"
ACCOUNT = _digits(K, 11, "3")
IFSC = f"'HDFC0' || {_digits(K, 6)}"
UPI = f"'u' || {K} || CASE {K} % 3 WHEN 0 THEN '@okaxis' WHEN 1 THEN '@upi' ELSE '@other' END"
DEVICE = f"CASE {K} % 2 WHEN 0 THEN 'android-' ELSE 'IOS-' END || lower(hex({K} + 4096))"
FINGERPRINT = f"'fp_hash_' || lower(hex({K} + 65536))"
FACE = f"'face_tmp_' || lower(hex({K} + 1048576))"
ADDRESS = f"""CASE {K} % 5
  WHEN 0 THEN 'lives at ' || ({K} % 90 + 1) || ' Mahatma Gandhi Road near the old mill; then moved'
  WHEN 1 THEN 'Address: Plot ' || {K} || ' Sector Nine, Block B'
  WHEN 2 THEN 'in Flat ' || {K} || '-B Green Meadows Colony, Pune 411' || {_digits(f"{K} % 1000", 3)}
  WHEN 3 THEN 'ships to Navi Mumbai, 400' || {_digits(f"{K} % 1000", 3)}
  ELSE ({K} % 90 + 1) || ' Park Street Kolkata 700' || {_digits(f"{K} % 1000", 3)} || ' phone none' END"""

RECORD = " || ".join(
    [
        f"'Name: ' || c_name || chr(10) || 'Email: ' || {EMAIL}",
        f"chr(10) || 'Phone: ' || ({PHONE})",
        f"chr(10) || 'Aadhaar: ' || ({AADHAAR}) || ', PAN: ' || {PAN}",
        f"chr(10) || 'Login from ' || {IP} || ' with card ' || ({CARD}) || '.'",
        f"chr(10) || 'Born ' || ({BIRTH}) || ' passport ' || {PASSPORT}",
        f"chr(10) || 'Account ' || {ACCOUNT} || ' at ' || {IFSC} || ' or ' || {UPI}",
        f"chr(10) || 'Device ' || {DEVICE} || ' ' || {FINGERPRINT} || ' ' || {FACE}",
        f"chr(10) || ({ADDRESS}) || '.' || chr(10) || c_mktsegment || ' in NATION_' || c_nationkey",
    ]
)

DOCUMENTS = "SELECT 'doc-' || doc_id AS key, text FROM documents"
RECORDS = f"SELECT 'rec-' || {K} AS key, {RECORD} AS text FROM customer"
CORPUS = f"{DOCUMENTS} UNION ALL {RECORDS}"

# chr(39) is a quote and chr(92) a backslash.
_QUOTE = "chr(39) || (%s) || chr(39)"
DUMPS = f"""SELECT 'dump-' || {K} AS key,
  'INSERT INTO people VALUES (' || {K} || ', ' || {_QUOTE % "c_name"} || ', ' || {_QUOTE % EMAIL}
  || ', ' || {_QUOTE % PHONE} || ', ' || chr(39) || 'it' || chr(92) || chr(39) || 's ' || ({AADHAAR})
  || chr(39) || ', ' || ({CARD}) || ', ' || {_QUOTE % ADDRESS} || ');' AS text
FROM customer"""

# Turns of a conversation as segments.  A date is cut by a turn's end, so that
# its value is in no segment and only the fallback finds its first word.
SEGMENTS = """SELECT conv_id, turn, CASE turn % 3
  WHEN 0 THEN text || ' write to c' || conv_id || '@example.com, born 14 March'
  WHEN 1 THEN '1992 and ' || text || ' see 10.1.2.' || (conv_id % 250)
  ELSE 'again c' || conv_id || '@example.com c' || conv_id || '@example.com 10.1.2.' || (conv_id % 250) END AS text
FROM conversations"""

# Few documents of very many segments.
LONG_SEGMENTS = f"""SELECT conv_id % 3 AS conv_id, conv_id * 1000 + turn AS turn, text
FROM ({SEGMENTS})"""

# Nested rows, for Spark only; the JSON text of some has no end.
JSON_TEXT = f"""'{{"mail":"' || {EMAIL} || '","n":' || {K} || CASE WHEN {K} % 5 = 0 THEN '' ELSE '}}' END"""
PAYLOAD = "mail string, n bigint"
PROFILES = f"""SELECT {K}, named_struct('mail', {EMAIL}, 'name', c_name, 'nation', c_nationkey) AS contact,
  array(named_struct('kind', 'phone', 'value', {PHONE}),
    named_struct('kind', 'note', 'value', CASE WHEN {K} % 3 = 0 THEN {ADDRESS} END)) AS entries,
  map('ip', {IP}) AS labels, {JSON_TEXT} AS payload
FROM customer"""

USERS = """SELECT c_custkey AS id, c_name AS username,
  CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'standard' END AS role,
  CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 1 END AS is_active
FROM customer"""

FILES = """SELECT o_orderkey AS file_id,
  'Report_' || o_orderkey || CASE o_orderkey % 9 WHEN 0 THEN '.sql' WHEN 1 THEN '.PDF' WHEN 2 THEN '.docx'
    WHEN 3 THEN '.csv' WHEN 4 THEN '.json' WHEN 5 THEN '.txt' WHEN 6 THEN '.v2.JPG' WHEN 7 THEN '.exe' ELSE '' END
    AS filename,
  CASE o_orderkey % 9 WHEN 0 THEN 'sql' WHEN 1 THEN 'pdf' WHEN 2 THEN 'docx' WHEN 3 THEN 'csv' WHEN 4 THEN 'json'
    WHEN 5 THEN 'txt' WHEN 6 THEN 'image' ELSE 'unknown' END AS file_type,
  CASE WHEN o_orderkey % 23 = 0 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed'
    WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'processing' END AS status,
  CASE o_orderkey % 4 WHEN 0 THEN 'mask' WHEN 1 THEN 'redact' WHEN 2 THEN 'tokenize' ELSE NULL END
    AS anonymization_mode,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN '{}'
    ELSE '{"EMAIL":' || (o_orderkey % 5 + 1) || ',"PHONE":' || (o_orderkey % 3 + 1)
      || CASE WHEN o_orderkey % 2 = 0 THEN ',"IP_ADDRESS":' || (o_orderkey % 7 + 1) ELSE '' END || '}' END
    AS entity_counts,
  'original-' || o_orderkey AS original_hash, 'sanitized-' || o_orderkey AS sanitized_hash,
  o_custkey AS uploaded_by, CAST(o_orderdate AS TIMESTAMP) AS created_at
FROM orders"""

ACTIONS = """SELECT event_id AS id, user_id, event_id AS file_id, ts AS timestamp, value,
  CASE event_type WHEN 'view' THEN 'FILE_VIEW_ORIGINAL' WHEN 'signup' THEN 'USER_CREATED'
    WHEN 'error' THEN 'FILE_UPLOAD' WHEN 'click' THEN 'USER_LOGIN' ELSE 'FILE_DOWNLOAD_SANITIZED' END AS event_type,
  CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS success,
  '192.168.0.' || (user_id % 250) AS ip_address
FROM events"""

AS_OF_FILES = "2001-08-01 00:00:00"
AS_OF_EVENTS = "2024-01-30 00:00:00"


def run(
    spark: SparkSession, directory: str, sql: str, *tables: str, read: Callable[..., DataFrame] = read_table
) -> DataFrame:
    """Run one of the statements above on the tables it names, read by ``read``.

    The tables are views of a name of their own for as long as the statement is
    analyzed, so no view of the session is touched.
    """
    suffix = uuid.uuid4().hex
    for table in tables:
        read(spark, directory, table).createOrReplaceTempView(f"{table}_{suffix}")
        sql = re.sub(rf"\bFROM {table}\b", f"FROM {table}_{suffix}", sql)
    found = spark.sql(sql)
    for table in tables:
        spark.catalog.dropTempView(f"{table}_{suffix}")
    return found


def records(spark: SparkSession, directory: str) -> DataFrame:
    """Records of the customers: (key, text)."""
    return read_spread(spark, directory, "customer").selectExpr(
        f"'rec-' || {K} AS key", f"{RECORD} AS text"
    )


def corpus(spark: SparkSession, directory: str) -> DataFrame:
    """Documents and records: (key, text)."""
    parts = [
        read_table(spark, directory, "documents").select("doc_id", "text").selectExpr(
            "'doc-' || doc_id AS key", "text"
        ),
        records(spark, directory),
    ]
    return parts[0].unionByName(parts[1])
