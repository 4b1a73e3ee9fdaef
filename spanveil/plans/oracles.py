"""What the registered queries should return, as DuckDB SQL.

Detection is stated again from the patterns as written (DuckDB runs them as
they are, except for look-aheads), with offsets from the lengths of the text
between matches, overlaps settled by a list reduction and texts rebuilt from
pieces.  ``s`` and ``e`` are start and end offsets from zero.
"""

from __future__ import annotations

import hashlib

from spanveil.functions import fixed_values as V
from spanveil.plans import corpora as C

TOKEN_KEY = "registered-queries"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _any_case(pattern: str) -> str:
    return "(?i)" + pattern


# --- matches of one pattern -------------------------------------------------
def matches(source: str, pattern: str, group: int = 0) -> str:
    """Rows (key, text, s, e, m): all matches, or one group up to an optional last character."""
    p = _text(pattern)
    lengths = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)::BIGINT"
    before = f"{lengths.format('gaps[1:i]')} + {lengths.format('hits[1:i - 1]')}"
    if group:
        delimited = "CASE WHEN ends_with(hits[i], parts[i]) THEN 0 ELSE 1 END"
        columns = (
            f"({before}) + length(hits[i]) - ({delimited}) - length(parts[i]) AS s, "
            f"({before}) + length(hits[i]) - ({delimited}) AS e, parts[i] AS m"
        )
    else:
        columns = f"({before}) AS s, ({before}) + length(hits[i]) AS e, hits[i] AS m"
    return f"""SELECT key, text, {columns} FROM (
  SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT key, text, regexp_extract_all(text, {p}) AS hits, regexp_extract_all(text, {p}, {group}) AS parts,
      string_split_regex(text, {p}) AS gaps
    FROM {source} WHERE regexp_matches(text, {p})))"""


DIGITS = "length(regexp_replace({}, '[^0-9]', '', 'g'))"
UPI_TEST = "(" + " OR ".join(f"contains(lower(m), '{h}')" for h in V.UPI_HANDLES) + ")"

# (entity, rank, confidence, patterns, test)
MAIN = [
    ("EMAIL", 1, 0.95, [V.EMAIL], None),
    ("PHONE", 2, 0.90, [V.PHONE_INDIAN_MOBILE, V.PHONE_INDIAN_SPACED, V.PHONE_INTERNATIONAL], None),
    ("AADHAAR", 3, 0.98, [V.AADHAAR], DIGITS.format("m") + " = 12"),
    ("PAN", 4, 0.98, [V.PAN], None),
    ("IP_ADDRESS", 5, 0.95, [V.IP_ADDRESS], None),
    ("CREDIT_CARD", 6, 0.85, [V.CREDIT_CARD], DIGITS.format("m") + " BETWEEN 13 AND 19"),
    ("DOB", 7, 0.80, [V.DATE_DAY_FIRST, V.DATE_YEAR_FIRST, _any_case(V.DATE_MONTH_NAME)], None),
    ("PASSPORT", 8, 0.90, [V.PASSPORT], None),
    ("BANK_ACCOUNT", 9, 0.85, [V.BANK_ACCOUNT], None),
    ("IFSC", 10, 0.95, [V.IFSC], None),
    ("UPI", 11, 0.90, [V.UPI], UPI_TEST),
    ("DEVICE_ID", 12, 0.95, [_any_case(V.DEVICE_ID)], None),
    ("FINGERPRINT", 13, 0.98, [_any_case(V.FINGERPRINT)], None),
    ("FACE_TEMPLATE", 14, 0.98, [_any_case(V.FACE_TEMPLATE)], None),
]
BASIC = [
    ("email", 1, 1.0, [_any_case(V.EMAIL)], None),
    ("phone", 2, 1.0, [V.BASIC_PHONE], None),
    ("aadhaar", 3, 1.0, [V.BASIC_AADHAAR], None),
    ("pan", 4, 1.0, [_any_case(V.PAN)], None),
    ("ip", 5, 1.0, [V.BASIC_IP], None),
    ("credit_card", 6, 1.0, [V.CREDIT_CARD], None),
]


def rule_rows(source: str, rule: tuple) -> str:
    """Rows (key, entity, rank, conf, method, s, e, m) of one rule."""
    entity, rank, confidence, patterns, test = rule
    union = " UNION ".join(f"SELECT key, s, e, m FROM ({matches(source, p)})" for p in patterns)
    return (
        f"SELECT DISTINCT key, '{entity}' AS entity, {rank} AS rank, {confidence}::DOUBLE AS conf, "
        f"'regex' AS method, s, e, m FROM ({union}) WHERE {test or 'true'}"
    )


# --- addresses --------------------------------------------------------------
_STRIP = r"regexp_replace({}, '^[\s\v]+|[\s\v]+$', '', 'g')"
_END = r"(?:[,.;\n]|$)"
_PREFIX = "(?i)(?:" + "|".join(V.ADDRESS_PREFIX_WORDS) + ")" + V.ADDRESS_PREFIX_TAIL.split("(?=")[0] + _END
_STREET = _any_case(V.STREET_HEAD + "(?:" + "|".join(V.STREET_WORDS) + ")")
_UNIT = "(?i)((?:" + "|".join(V.UNIT_WORDS) + ")" + V.UNIT_TAIL.split("(?=")[0] + ")" + _END
_CITY = "(?i)(?:" + "|".join(V.CITIES) + ")" + V.CITY_TAIL


def address_parts(source: str) -> str:
    """Common table expressions up to ``addr`` (key, entity, rank, conf, method, s, e, m)."""
    good = f"length(m) BETWEEN {V.ADDRESS_MIN_LENGTH} AND {V.ADDRESS_MAX_LENGTH}"
    cut = "instr(lower(acc), d) - 1"
    delimiters = ", ".join("chr(10)" if d == "\n" else f"'{d}'" for d in V.STREET_DELIMITERS)
    context = _STRIP.format(
        f"substr(text, greatest(0, s - {V.STREET_CONTEXT_BEFORE}) + 1, "
        f"least(length(text), e + {V.STREET_CONTEXT_AFTER}) - greatest(0, s - {V.STREET_CONTEXT_BEFORE}))"
    )
    clash = "(old.s <= x[1].s AND x[1].s < old.e) OR (old.s < x[1].e AND x[1].e <= old.e)"
    return f"""
addr_a AS (SELECT key, s, e, m FROM (
  SELECT key, s, e, {_STRIP.format('m')} AS m FROM ({matches(source, _PREFIX, 1)})) WHERE {good}),
addr_b AS (SELECT key, s, s + length(m) AS e, m, o FROM (
  SELECT key, greatest(0, s - {V.STREET_CONTEXT_BEFORE}) AS s, s AS o,
    list_reduce([{delimiters}], lambda acc, d:
      CASE WHEN {cut} > {V.STREET_CUT_AFTER} THEN {_STRIP.format(f'substr(acc, 1, {cut})')} ELSE acc END,
      {context}) AS m
  FROM ({matches(source, _STREET)})) WHERE {good}),
addr_c AS (SELECT key, s, e, m FROM (
  SELECT key, s, e, {_STRIP.format('m')} AS m FROM ({matches(source, _UNIT, 1)})) WHERE {good}),
addr_d AS (SELECT key, s, e, {_STRIP.format('m')} AS m FROM ({matches(source, _CITY)})),
addr_all AS (
  SELECT key, 1 AS p, s AS o, s, e, m FROM addr_a UNION ALL SELECT key, 2, o, s, e, m FROM addr_b
  UNION ALL SELECT key, 3, s, s, e, m FROM addr_c UNION ALL SELECT key, 4, s, s, e, m FROM addr_d),
addr_settled AS (SELECT key, list_reduce(
    coalesce(list([{{'s': s, 'e': e, 'm': m}}] ORDER BY p, o) FILTER (p > 1), []),
    lambda acc, x: CASE WHEN len(list_filter(acc, lambda old: {clash})) > 0 THEN acc ELSE list_concat(acc, x) END,
    coalesce(list({{'s': s, 'e': e, 'm': m}} ORDER BY o) FILTER (p = 1), [])) AS found
  FROM addr_all GROUP BY key),
addr AS (SELECT key, 'ADDRESS' AS entity, 15 AS rank, 0.75::DOUBLE AS conf, 'regex' AS method,
  f.s AS s, f.e AS e, f.m AS m FROM (SELECT key, unnest(found) AS f FROM addr_settled))"""


# --- the whole detection ----------------------------------------------------
def raw_parts(source_sql: str, rules=MAIN, addresses: bool = True, extra: str = "") -> str:
    """Common table expressions ``src`` and ``raw``."""
    parts = [f"src AS MATERIALIZED ({source_sql})"]
    union = [rule_rows("src", r) for r in rules]
    if addresses:
        parts.append(address_parts("src"))
        union.append("SELECT * FROM addr")
    if extra:
        union.append(extra)
    parts.append("raw AS MATERIALIZED (" + " UNION ALL ".join(union) + ")")
    return ",\n".join(parts)


_WINS = """(x[1].e - x[1].s) > (acc[-1].e - acc[-1].s) OR ((x[1].e - x[1].s) = (acc[-1].e - acc[-1].s)
  AND (x[1].conf > acc[-1].conf OR (x[1].conf = acc[-1].conf AND x[1].method = 'regex' AND acc[-1].method = 'ner')))"""
_ONE = "{'s': s, 'e': e, 'entity': entity, 'm': m, 'conf': conf, 'method': method}"


def detection_parts(source_sql: str, **options) -> str:
    """Common table expressions up to ``det`` (key, pos, entity, s, e, m, conf, method)."""
    return f"""{raw_parts(source_sql, **options)},
merged AS (SELECT key, list_reduce(lists, lambda acc, x:
    CASE WHEN x[1].s >= acc[-1].e THEN list_concat(acc, x)
         WHEN {_WINS} THEN list_concat(acc[1:-2], x) ELSE acc END) AS found
  FROM (SELECT key, list([{_ONE}] ORDER BY s, -e, rank) AS lists FROM raw GROUP BY key)),
det AS MATERIALIZED (SELECT key, i - 1 AS pos, found[i].entity AS entity, found[i].s AS s, found[i].e AS e,
    found[i].m AS m, found[i].conf AS conf, found[i].method AS method
  FROM (SELECT key, found, unnest(range(1, len(found) + 1)) AS i FROM merged))"""


DETECTION_COLUMNS = (
    'entity AS entity_type, s AS "start", e AS "end", m AS "text", conf AS confidence, '
    "method AS detection_method"
)


# --- replacements -----------------------------------------------------------
def _stars(n: str) -> str:
    return f"repeat('*', greatest({n}, 0)::INTEGER)"


def mask_sql(v: str, entity: str = "entity") -> str:
    """The masked value."""
    digits = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    n = f"length({v})"
    nd = f"length({digits})"
    at = f"instr({v}, '@')"
    domain = f"substr({v}, {at} + 1)"
    words = f"list_filter(regexp_split_to_array({v}, '[\\s\\v]+'), lambda w: w <> '')"
    word = (
        "CASE WHEN regexp_full_match(w, '[0-9]+') THEN left(w, 1) || " + _stars("length(w) - 1")
        + " WHEN length(w) > 5 THEN left(w, 2) || " + _stars("length(w) - 2")
        + " WHEN length(w) > 3 THEN left(w, 1) || " + _stars("length(w) - 1")
        + " ELSE " + _stars("length(w)") + " END"
    )
    name = "CASE WHEN length(w) > 1 THEN left(w, 1) || " + _stars("length(w) - 1") + " ELSE '*' END"
    dash = f"instr({v}, '-')"
    under = f"length(regexp_extract({v}, '^(?s:.*)_'))"
    return f"""CASE {entity}
  WHEN 'EMAIL' THEN CASE WHEN {at} = 0 THEN '***' WHEN {at} > 2 THEN left({v}, 1) || '***@' || {domain}
    ELSE '***@' || {domain} END
  WHEN 'PHONE' THEN CASE WHEN {nd} >= 4 THEN {_stars(f'{nd} - 4')} || right({digits}, 4) ELSE {_stars(nd)} END
  WHEN 'AADHAAR' THEN CASE WHEN {nd} = 12 THEN '********' || right({digits}, 4) ELSE {_stars(nd)} END
  WHEN 'PAN' THEN CASE WHEN {n} >= 3 THEN left({v}, 2) || '******' || right({v}, 1) ELSE '***' END
  WHEN 'IP_ADDRESS' THEN CASE WHEN len(string_split({v}, '.')) = 4 THEN string_split({v}, '.')[1] || '.***.***.***'
    ELSE '***.***.***.***' END
  WHEN 'CREDIT_CARD' THEN '****-****-****-' || CASE WHEN {nd} >= 4 THEN right({digits}, 4) ELSE '****' END
  WHEN 'PERSON_NAME' THEN array_to_string(list_transform({words}, lambda w: {name}), ' ')
  WHEN 'DOB' THEN CASE WHEN len({words}) >= 3 THEN '** ' || ({words})[2] || ' ****' ELSE '**/**/****' END
  WHEN 'PASSPORT' THEN CASE WHEN {n} >= 1 THEN left({v}, 1) || {_stars(f'{n} - 1')} ELSE '********' END
  WHEN 'BANK_ACCOUNT' THEN CASE WHEN {n} >= 4 THEN {_stars(f'{n} - 4')} || right({v}, 4) ELSE {_stars(n)} END
  WHEN 'IFSC' THEN CASE WHEN {n} >= 5 THEN left({v}, 5) || {_stars(f'{n} - 5')} ELSE {_stars(n)} END
  WHEN 'UPI' THEN CASE WHEN {at} = 0 THEN '****' WHEN {at} > 3 THEN left({v}, 2) || '****@' || {domain}
    ELSE '****@' || {domain} END
  WHEN 'DEVICE_ID' THEN CASE WHEN {dash} > 0 THEN left({v}, {dash}) || {_stars(f'{n} - {dash}')} ELSE '****' END
  WHEN 'FINGERPRINT' THEN CASE WHEN contains({v}, '_') THEN left({v}, {under}) || {_stars(f'{n} - {under}')}
    ELSE '****' END
  WHEN 'FACE_TEMPLATE' THEN CASE WHEN contains({v}, '_') THEN left({v}, {under}) || {_stars(f'{n} - {under}')}
    ELSE '****' END
  WHEN 'ADDRESS' THEN array_to_string(list_transform({words}, lambda w: {word}), ' ')
  ELSE CASE WHEN {n} > 4 THEN left({v}, 2) || '***' || right({v}, 2) ELSE '***' END END"""


def token_sql(v: str, key: str = TOKEN_KEY) -> str:
    """``TOK_`` and 80 bits of the keyed hash in base32."""
    secret = key.encode()
    if len(secret) > 64:
        secret = hashlib.sha256(secret).digest()
    secret = secret.ljust(64, b"\0")
    inner = f"unhex('{bytes(b ^ 0x36 for b in secret).hex()}')"
    outer = f"unhex('{bytes(b ^ 0x5C for b in secret).hex()}')"
    mac = f"sha256({outer} || unhex(sha256({inner} || encode({v}))))"
    alphabet = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"

    def half(start: int) -> str:
        number = f"('0x' || substr({mac}, {start}, 10))::BIGINT"
        return "".join(
            f" || substr({alphabet}, (({number} >> {shift}) & 31)::INTEGER + 1, 1)"
            for shift in range(35, -1, -5)
        )

    return f"('TOK_'{half(1)}{half(11)})"


def replacement_sql(mode: str, v: str, entity: str = "entity") -> str:
    if mode == "redact":
        return f"'[REDACTED_' || {entity} || ']'"
    if mode == "tokenize":
        return f"'[' || {token_sql(v)} || ']'"
    return mask_sql(v, entity)


_VALUE = "substr(text, (s + 1)::INTEGER, (e - s)::INTEGER)"


def rebuilt_parts(replacement: str, name: str = "rebuilt") -> str:
    """A table expression (key, out): texts of ``src`` with the spans of ``det`` replaced."""
    return f"""
{name} AS (SELECT src.key, coalesce(any_value(body) || substr(any_value(src.text), (max(last) + 1)::INTEGER),
    any_value(src.text)) AS out
  FROM src LEFT JOIN (
    SELECT key, string_agg(substr(text, (gap + 1)::INTEGER, (s - gap)::INTEGER) || new, '' ORDER BY s) AS body, max(e) AS last
    FROM (SELECT det.key, s, e, text, coalesce(lag(e) OVER (PARTITION BY det.key ORDER BY s), 0) AS gap,
        {replacement} AS new
      FROM (SELECT det.*, src.text AS text, {_VALUE.replace('text', 'src.text')} AS v
        FROM det JOIN src ON det.key = src.key) det) GROUP BY key) b ON src.key = b.key
  GROUP BY src.key)"""


COUNTS = "counts AS (SELECT key, count(*) AS total FROM det GROUP BY key)"


# --- the oracles ------------------------------------------------------------
def _detector(rule: tuple) -> str:
    return f"""WITH src AS ({C.CORPUS}), raw AS ({rule_rows('src', rule)})
SELECT key, s AS "start", e AS "end", m AS "text" FROM raw"""


def _address_pattern(table: str) -> str:
    return f"""WITH src AS ({C.CORPUS}), {address_parts('src')}
SELECT key, s AS "start", e AS "end", m AS "text" FROM {table}"""


def _with(parts: str, query: str) -> str:
    return f"WITH {parts}\n{query}"


def detectors() -> dict[str, str]:
    found = {f"detect_{rule[0].lower()}": _detector(rule) for rule in MAIN}
    found |= {f"basic_{rule[0]}": _detector(rule) for rule in BASIC}
    for name, table in {
        "after_prefix": "addr_a",
        "street": "addr_b",
        "unit": "addr_c",
        "city": "addr_d",
    }.items():
        found[f"address_{name}"] = _address_pattern(table)
    found["detect_address"] = _address_pattern("addr")
    return found


def detection() -> dict[str, str]:
    det = detection_parts(C.CORPUS)
    documents = "SELECT 'doc-' || doc_id AS key, text, source FROM documents"
    structured = detection_parts(documents, addresses=False)
    pairs = "string_agg('\"' || entity || '\":' || n, ',' ORDER BY first)"
    model = (
        "SELECT key, 'PERSON_NAME', 100, 0.85::DOUBLE, 'ner', s, e, m FROM ("
        + matches("src", r"Customer#[0-9]+")
        + ")"
    )
    listed = (
        "SELECT key, 'LOCATION', 100, 0.85::DOUBLE, 'ner', s, e, m FROM ("
        + matches("src", r"\bNATION_[0-9]+\b")
        + ") WHERE m IN (SELECT n_name FROM nation)"
    )
    return {
        "detect_raw": _with(
            raw_parts(C.CORPUS), f"SELECT key, {DETECTION_COLUMNS} FROM raw"
        ),
        "detect_all": _with(det, f"SELECT key, pos, {DETECTION_COLUMNS} FROM det"),
        "resolve_overlaps": _with(
            structured,
            "SELECT source, entity AS entity_type, count(*) AS n FROM det JOIN src USING (key) GROUP BY ALL",
        ),
        "uncovered_parts": _with(
            det,
            """SELECT run.key, min(p)::INTEGER AS "start", max(q)::INTEGER AS "end",
  substr(any_value(src.text), min(p) + 1, max(q) - min(p)) AS "text" FROM (
  SELECT key, p, q, sum(begins) OVER (PARTITION BY key ORDER BY p) AS part FROM (
    SELECT key, p, q, CASE WHEN lag(q) OVER (PARTITION BY key ORDER BY p) = p THEN 0 ELSE 1 END AS begins FROM (
      SELECT key, p, lead(p) OVER w AS q, sum(in_raw) OVER w AS open_raw, sum(in_det) OVER w AS open_det FROM (
        SELECT key, p, sum(r) AS in_raw, sum(d) AS in_det FROM (
          SELECT key, s AS p, 1 AS r, 0 AS d FROM raw UNION ALL SELECT key, e, -1, 0 FROM raw
          UNION ALL SELECT key, s, 0, 1 FROM det UNION ALL SELECT key, e, 0, -1 FROM det) GROUP BY key, p)
      WINDOW w AS (PARTITION BY key ORDER BY p))
    WHERE open_raw > 0 AND open_det = 0)) run JOIN src ON run.key = src.key GROUP BY run.key, part""",
        ),
        "entity_counts": _with(
            det,
            f"""SELECT src.key, '{{' || coalesce(c.counts, '') || '}}' AS entity_counts, coalesce(c.total, 0) AS total_entities
FROM src LEFT JOIN (SELECT key, {pairs} AS counts, sum(n)::BIGINT AS total
  FROM (SELECT key, entity, count(*) AS n, min(pos) AS first FROM det GROUP BY ALL) GROUP BY key) c
  ON src.key = c.key""",
        ),
        "counts_by_entity_type": _with(
            det, "SELECT entity AS entity_type, count(*) AS n FROM det GROUP BY ALL"
        ),
        "detections_json": _with(
            det,
            f"""SELECT src.key, '[' || coalesce(string_agg('{{"entity_type":"' || entity || '","start":' || s || ',"end":' || e
  || ',"text":' || to_json(m) || ',"confidence":' || conf || ',"detection_method":"' || method || '"}}', ',' ORDER BY pos), '')
  || ']' AS pii_detected FROM src LEFT JOIN det ON src.key = det.key GROUP BY src.key""",
        ),
        "model_entities": _with(
            detection_parts(C.RECORDS, extra=model),
            f"SELECT key, pos, {DETECTION_COLUMNS} FROM det",
        ),
        "listed_entities": _with(
            detection_parts(C.RECORDS, extra=listed),
            f"SELECT key, pos, {DETECTION_COLUMNS} FROM det",
        ),
        "user_rules": _with(
            detection_parts(
                C.RECORDS, rules=MAIN + [("ORDER_CODE", 50, 0.99, [r"\bCustomer#[0-9]+\b"], None)]
            )
            + ","
            + rebuilt_parts(
                "CASE WHEN entity = 'ORDER_CODE' THEN 'Customer#?' ELSE " + mask_sql("v") + " END"
            ),
            "SELECT key, out AS sanitized_text FROM rebuilt",
        ),
        "user_rules_of_equal_rank": _with(
            detection_parts(
                C.RECORDS,
                rules=MAIN
                + [
                    ("SEVENTH", 15, 0.99, [r"\bCustomer#[0-9]+\b"], "m LIKE '%7'"),
                    ("NATION_CODE", 15, 0.99, [r"\bNATION_[0-9]+\b"], None),
                ],
            ),
            f"SELECT key, pos, {DETECTION_COLUMNS} FROM det",
        ),
        "replacements_of_names": f"""SELECT entity AS entity_type, v AS value, {mask_sql('v')} AS masked
FROM (SELECT DISTINCT unnest(['PERSON_NAME', 'LOCATION', 'ORGANIZATION', 'SOMETHING_ELSE']) AS entity,
  'Ann O''Neil ' || c_mktsegment || ' ' || c_custkey % 100 AS v FROM customer)""",
        "top_detected_types": _with(det, "SELECT entity AS entity_type, count(*)::BIGINT AS total FROM det GROUP BY 1 ORDER BY total DESC, entity_type LIMIT 10"),
        "top_detected_types_displayed": _with(det, "SELECT entity AS entity_type, count(*)::BIGINT AS total FROM det GROUP BY 1 ORDER BY total DESC, entity_type LIMIT 8"),
    }


def _basic(columns: str, final: str) -> str:
    return _with(
        raw_parts(C.CORPUS, rules=BASIC, addresses=False)
        + """,
per_text AS (SELECT src.key, any_value(src.text) AS text,
  coalesce(list({'s': s, 'e': e, 'entity': entity} ORDER BY s DESC, rank DESC) FILTER (s IS NOT NULL), []) AS found
  FROM src LEFT JOIN raw ON src.key = raw.key GROUP BY src.key)""",
        final,
    )


def basic() -> dict[str, str]:
    splice = "substr(acc.t, 1, x.s::INTEGER) || {} || substr(acc.t, (x.e + 1)::INTEGER)"
    fold = """SELECT key, list_reduce(list_transform(found, lambda f: {{'s': f.s, 'e': f.e, 'entity': f.entity, 't': ''}}),
  lambda acc, x: {{'s': x.s, 'e': x.e, 'entity': '', 't': {}}}, {{'s': 0::BIGINT, 'e': 0::BIGINT, 'entity': '', 't': text}}).t
  AS {} FROM per_text"""
    return {
        "basic_detect_all": _with(
            raw_parts(C.CORPUS, rules=BASIC, addresses=False),
            """SELECT key, row_number() OVER (PARTITION BY key ORDER BY s, rank) - 1 AS pos,
  entity AS entity_type, s AS "start", e AS "end", m AS "text", conf AS confidence FROM raw""",
        ),
        "basic_counts": _with(
            raw_parts(C.CORPUS, rules=BASIC, addresses=False),
            "SELECT entity AS entity_type, count(*) AS n FROM raw GROUP BY ALL",
        ),
        "basic_mask": _basic(
            "", fold.format(splice.format("repeat('*', (x.e - x.s)::INTEGER)"), "masked_text")
        ),
        "basic_redact": _basic(
            "", fold.format(splice.format("'[REDACTED_' || upper(x.entity) || ']'"), "redacted_text")
        ),
    }


def sanitizing() -> dict[str, str]:
    det = detection_parts(C.CORPUS)
    found = {
        f"sanitize_{mode}": _with(
            det + "," + rebuilt_parts(replacement_sql(mode, "v")),
            "SELECT key, out AS sanitized_text FROM rebuilt",
        )
        for mode in V.MODES
    }
    found["replacements"] = _with(
        det,
        f"""SELECT entity AS entity_type, m AS value, {mask_sql('m')} AS masked,
  '[REDACTED_' || entity || ']' AS redacted, '[' || {token_sql('m')} || ']' AS token
FROM (SELECT DISTINCT entity, m FROM det)""",
    )
    found["compare_modes"] = _with(
        det
        + "".join(
            "," + rebuilt_parts(replacement_sql(mode, "v"), f"by_{mode}") for mode in V.MODES
        ),
        """SELECT key, m.out AS mask_version, r.out AS redact_version, t.out AS tokenize_version
FROM by_mask m JOIN by_redact r USING (key) JOIN by_tokenize t USING (key)""",
    )
    found["sanitize_sql_dump"] = _with(
        detection_parts(C.DUMPS) + "," + rebuilt_parts(mask_sql("v")),
        "SELECT key, out AS sanitized_text FROM rebuilt",
    )
    literal = _text(V.SQL_LITERAL)
    pieces = f"""dumps AS ({C.DUMPS}),
pieces AS (SELECT key AS dump, i, gaps[i] AS gap, hits[i] AS literal FROM (
  SELECT key, gaps, hits, unnest(range(1, len(gaps) + 1)) AS i FROM (
    SELECT key, regexp_extract_all(text, {literal}) AS hits, string_split_regex(text, {literal}) AS gaps FROM dumps)))"""
    source = """SELECT dump || '#' || i AS key, literal[2:-2] AS text FROM pieces WHERE literal IS NOT NULL"""
    found["sanitize_sql_literals"] = _with(
        pieces + ",\n" + detection_parts(source) + "," + rebuilt_parts(mask_sql("v")),
        """SELECT dump AS key, string_agg(gap || coalesce(chr(39) || out || chr(39), ''), '' ORDER BY i) AS sanitized_text
FROM pieces LEFT JOIN rebuilt ON rebuilt.key = dump || '#' || i GROUP BY dump""",
    )
    return found


def segments() -> dict[str, str]:
    base = f"segs AS ({C.SEGMENTS})"
    joined = "SELECT conv_id AS key, string_agg(text, chr(10) ORDER BY turn) AS text FROM segs GROUP BY conv_id"
    word = r"coalesce(regexp_extract(m, '[^\s]+'), '')"

    swaps = f"""(SELECT key, list({{'i': i, 'f': m, 'w': {word}, 'r': {mask_sql('m')}, 't': ''}} ORDER BY i) AS swaps
  FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s DESC) AS i FROM det) GROUP BY key)"""
    none = "{'i': 0::BIGINT, 'f': '', 'w': '', 'r': '', 't': %s}"

    def reduced(condition: str, what: str, by: str, start: str) -> str:
        step = none % f"CASE WHEN {condition} THEN replace(acc.t, {what}, {by}) ELSE acc.t END"
        return f"list_reduce(swaps, lambda acc, d: {step}, {none % start}).t"

    whole = f"""SELECT conv_id, turn, coalesce({reduced("contains(acc.t, d.f)", "d.f", "d.r", "text")}, text) AS sanitized_text
FROM segs LEFT JOIN {swaps} d ON conv_id = d.key"""
    # What is replaced becomes a character of the private use area first, so that no
    # later search looks into it.
    mark, mark_word = "chr((57344 + d.i)::INT)", "chr((59344 + d.i)::INT)"
    by_value = reduced("contains(text, d.f)", "d.f", mark, "text")
    by_word = reduced("NOT contains(text, d.f) AND d.w <> ''", "d.w", mark_word, "valued")
    back = reduced("contains(acc.t, " + mark + ")", mark, "d.r", "worded")
    back_word = reduced("contains(acc.t, " + mark_word + ")", mark_word, "d.r", "backed")
    first_word = f"""SELECT conv_id, turn, coalesce({back_word}, text) AS sanitized_text FROM (
  SELECT *, {back} AS backed FROM (SELECT *, {by_word} AS worded FROM (SELECT *, {by_value} AS valued
  FROM segs LEFT JOIN {swaps} d ON conv_id = d.key)))"""

    parts = base + ", " + detection_parts(joined)
    long = f"segs AS ({C.LONG_SEGMENTS}), " + detection_parts(joined)
    return {
        "assemble_segments": f"WITH {base} SELECT key AS conv_id, text FROM ({joined})",
        "sanitize_segments": _with(parts, whole),
        "sanitize_long_documents": _with(long, whole),
        "sanitize_segments_by_first_word": _with(parts, first_word),
    }


def analysis() -> dict[str, str]:
    det = detection_parts(C.CORPUS)
    colours = " ".join(f"WHEN '{n}' THEN '{c}'" for n, c, _ in V.ENTITY_TYPES)
    before, after_colour, after_kind, after_conf, end = (
        '<span style="background-color: ',
        '; padding: 2px 4px; border-radius: 3px; font-weight: 500;" title="',
        " (confidence: ",
        ')">',
        "</span>",
    )
    mark = (
        f"'{before}' || CASE entity {colours} ELSE '{V.UNKNOWN_COLOUR}' END || '{after_colour}' || entity || "
        f"'{after_kind}' || printf('%.2f', conf) || '{after_conf}' || v || '{end}'"
    )
    lines = "SELECT key, i, regexp_replace(line, '^[\\s\\v]+|[\\s\\v]+$', '', 'g') AS text FROM (SELECT key, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (SELECT key, string_split(text, chr(10)) AS l FROM (%s)))" % C.CORPUS
    values = ", ".join(f"('{n}', '{c}', '{d}')" for n, c, d in V.ENTITY_TYPES)
    return {
        "analyze": _with(
            det + "," + rebuilt_parts(mask_sql("v")) + ", " + COUNTS,
            """SELECT src.key, text AS original_text, out AS sanitized_text, coalesce(total, 0) AS total_entities
FROM src JOIN rebuilt ON src.key = rebuilt.key LEFT JOIN counts ON src.key = counts.key""",
        ),
        "highlight": _with(
            det + "," + rebuilt_parts(mark),
            f"SELECT key, {_text(V.HIGHLIGHT_BOX_OPEN)} || out || {_text(V.HIGHLIGHT_BOX_CLOSE)} AS html FROM rebuilt",
        ),
        "batch_lines": f"""SELECT key, row_number() OVER (PARTITION BY key ORDER BY i) - 1 AS pos, text AS line
FROM ({lines}) WHERE text <> ''""",
        "batch_analyze": _with(
            detection_parts(f"SELECT key || '#' || (row_number() OVER (PARTITION BY key ORDER BY i) - 1) AS key, text FROM ({lines}) WHERE text <> ''")
            + ","
            + rebuilt_parts("'[REDACTED_' || entity || ']'")
            + ", "
            + COUNTS,
            f"""SELECT src.key, CASE WHEN length(out) > {V.DISPLAY_LENGTH} THEN substr(out, 1, {V.DISPLAY_LENGTH}) || '...' ELSE out END
  AS sanitized_text, coalesce(total, 0) AS total_entities
FROM src JOIN rebuilt ON src.key = rebuilt.key LEFT JOIN counts ON src.key = counts.key""",
        ),
        "batch_summary": _with(
            det,
            """SELECT (SELECT count(*) FROM src) AS total_texts, (SELECT count(*) FROM det) AS total_entities_detected,
  round((SELECT count(*) FROM det) / (SELECT count(*) FROM src), 6) AS average_entities_per_text""",
        ),
        "batch_breakdown": _with(
            det, "SELECT entity AS entity_type, count(*) AS n FROM det GROUP BY ALL"
        ),
        "entity_type_info": _with(
            det,
            f"""SELECT entity_type, count(*) AS n, coalesce(any_value(colour), '{V.UNKNOWN_COLOUR}') AS colour,
  coalesce(any_value(description), '{V.UNKNOWN_DESCRIPTION}') AS description
FROM (SELECT CASE WHEN conf < 0.8 THEN 'OTHER' ELSE entity END AS entity_type FROM det) d
LEFT JOIN (VALUES {values}) t(name, colour, description) ON d.entity_type = t.name GROUP BY entity_type""",
        ),
    }


def scans() -> dict[str, str]:
    name = "'page_' || page_id || CASE page_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.HTML' WHEN 2 THEN '.csv' ELSE '.exe' END"
    return {
        "text_extraction": f"""SELECT page_id, sha256(t) AS text_hash, length(t) AS n_chars FROM (SELECT page_id, CASE page_id % 4
  WHEN 0 THEN html WHEN 1 THEN html WHEN 2 THEN '(' || html ELSE '' END AS t FROM pages)""",
        "file_types": f"SELECT file_type, count(*) AS files FROM ({C.FILES}) GROUP BY ALL",
        "admission": f"""SELECT page_id, CASE WHEN page_id % 2 = 1 THEN 'File type not allowed'
  WHEN octet_length(encode(html)) > 2000 THEN 'File too large' END AS reject_reason FROM pages""",
        "content_hash": "SELECT doc_id, sha256(text) AS hash FROM documents",
        "integrity_check": """SELECT doc_id, sha256(text || CASE WHEN doc_id % 10 = 3 THEN '!' ELSE '' END) AS actual_hash
FROM documents WHERE doc_id % 10 = 3""",
        "encrypt_round_trip": "SELECT doc_id, sha256(text) AS hash, true AS changed, true AS refused FROM documents",
        "key_rotation": "SELECT doc_id, sha256(text) AS hash, true AS refused FROM documents",
        "key_ids": "SELECT doc_id, 36::INTEGER AS id_length FROM documents",
        "preview": f"""SELECT page_id, substr(html, 1, {V.PREVIEW_LENGTH}) AS content, length(html) > {V.PREVIEW_LENGTH} AS truncated
FROM pages""",
    }


def catalog() -> dict[str, str]:
    files = f"files AS ({C.FILES})"
    users = f"users AS ({C.USERS})"
    actions = f"actions AS ({C.ACTIONS})"
    entries = """entries AS (SELECT file_id, created_at, status, unnest(json_keys(entity_counts)) AS entity_type, entity_counts
  FROM files WHERE entity_counts IS NOT NULL),
pairs AS (SELECT file_id, created_at, status, entity_type, (entity_counts ->> entity_type)::BIGINT AS n FROM entries)"""
    totals = "SELECT entity_type, sum(n)::BIGINT AS total FROM pairs GROUP BY entity_type"
    log = f"""{users}, {actions}, log AS (SELECT a.id, a.event_type, a.user_id, u.username, u.role AS user_role,
  'Report_' || a.file_id AS filename, a.success, a.ip_address, a.timestamp FROM actions a LEFT JOIN users u ON a.user_id = u.id)"""
    stamp = "strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS at"
    recent = f"created_at >= TIMESTAMP '{C.AS_OF_FILES}' - INTERVAL {{}} DAY"
    trend = f"""WITH {files}, {entries}
SELECT strftime(f.created_at, '%Y-%m-%d') AS date, count(DISTINCT f.file_id) AS files_processed,
  coalesce(sum(n), 0)::BIGINT AS entities_detected, coalesce(sum(n) FILTER (entity_type = 'EMAIL'), 0)::BIGINT AS emails
FROM files f LEFT JOIN pairs p ON f.file_id = p.file_id
WHERE f.status = 'completed' AND f.{recent.format(30)} GROUP BY 1"""
    return {
        "catalog": _with(
            detection_parts("SELECT 'doc-' || doc_id AS key, doc_id, text FROM documents")
            + ","
            + rebuilt_parts("'[REDACTED_' || entity || ']'")
            + ", "
            + COUNTS,
            """SELECT doc_id AS file_id, 'doc_' || doc_id || '.txt' AS filename, 'txt' AS file_type, octet_length(encode(text)) AS file_size,
  sha256(text) AS original_hash, sha256(out) AS sanitized_hash, 'redact' AS anonymization_mode, 'completed' AS status,
  coalesce(total, 0) AS total_entities FROM src JOIN rebuilt ON src.key = rebuilt.key LEFT JOIN counts ON src.key = counts.key""",
        ),
        "list_files": f"""WITH {files} SELECT file_id, filename, file_type, status, anonymization_mode, uploaded_by,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created, coalesce((entity_counts ->> 'EMAIL')::BIGINT, 0) AS emails FROM files""",
        "search_files": f"WITH {files} SELECT file_id, filename FROM files WHERE contains(lower(filename), '12.v2')",
        "search_files_by_index": f"WITH {files} SELECT file_id, filename FROM files WHERE contains(lower(filename), '12.v2')",
        "user_stats": f"""WITH {users} SELECT count(*) AS total, count(*) FILTER (role = 'admin') AS admins,
  count(*) FILTER (role = 'standard') AS standard, count(*) FILTER (is_active = 1) AS active,
  count(*) FILTER (is_active = 0) AS inactive FROM users""",
        "file_stats": f"""WITH {files} SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed,
  count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing,
  count(*) FILTER (status = 'failed') AS failed,
  round(count(*) FILTER (status = 'completed') * 100.0 / count(*), 6)::DOUBLE AS completion_rate FROM files""",
        "pii_total": f"WITH {files}, {entries} SELECT sum(n)::BIGINT AS total_entities_detected FROM pairs",
        "entity_totals": f"WITH {files}, {entries} {totals}",
        "top_entity_types": f"WITH {files}, {entries} {totals} ORDER BY total DESC, entity_type LIMIT 10",
        "top_entity_types_displayed": f"WITH {files}, {entries} {totals} ORDER BY total DESC, entity_type LIMIT 2",
        "file_type_distribution": f"WITH {files} SELECT file_type, count(*) AS files FROM files GROUP BY ALL",
        "mode_usage": f"""WITH {files} SELECT anonymization_mode, count(*) AS files FROM files
WHERE anonymization_mode IS NOT NULL GROUP BY ALL""",
        "recent_activity": f"""WITH {files}, {actions} SELECT (SELECT count(*) FROM files WHERE {recent.format(7)}) AS recent_uploads,
  (SELECT count(*) FROM actions WHERE event_type = 'USER_LOGIN' AND timestamp >= TIMESTAMP '{C.AS_OF_FILES}' - INTERVAL 7 DAY) AS recent_logins""",
        "recent_events": f"""WITH {files}, {actions} SELECT
  (SELECT count(*) FROM files WHERE created_at >= TIMESTAMP '{C.AS_OF_EVENTS}' - INTERVAL 7 DAY) AS recent_uploads,
  (SELECT count(*) FROM actions WHERE event_type = 'USER_LOGIN' AND timestamp >= TIMESTAMP '{C.AS_OF_EVENTS}' - INTERVAL 7 DAY) AS recent_logins""",
        "upload_outcomes": f"""WITH {files}, judged AS (
  SELECT file_type, file_type IN ('pdf', 'docx', 'image') AS no_text,
    CASE WHEN file_type = 'unknown' THEN 'File type not allowed'
      WHEN strlen('order ' || file_id || ' of c' || uploaded_by || '@example.com') > 26 THEN 'File too large' END AS reason
  FROM files)
SELECT file_type, CASE WHEN reason IS NOT NULL OR no_text THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN reason IS NOT NULL THEN reason WHEN no_text THEN 'no text could be read' END AS error_message,
  count(*) AS files, sum(CASE WHEN reason IS NOT NULL OR no_text THEN 0 ELSE 1 END)::BIGINT AS entities
FROM judged GROUP BY ALL""",
        "daily_trend": trend,
        "daily_trend_followed": trend,
        "user_activity": f"""WITH {log} SELECT {stamp}, username, event_type, filename, success, ip_address FROM log
ORDER BY timestamp DESC, id DESC LIMIT 20""",
        "audit_query": f"""WITH {log} SELECT id, {stamp}, username, event_type FROM log WHERE event_type = 'USER_LOGIN'
ORDER BY timestamp DESC, id DESC LIMIT 100""",
        "audit_query_by_user": f"""WITH {log} SELECT id, {stamp}, username, event_type FROM log
WHERE username = 'Customer#000000007' ORDER BY timestamp DESC, id DESC LIMIT 100""",
        "display_time": f"""WITH {actions} SELECT id, CASE WHEN id % 5 = 0 THEN 'N/A' ELSE strftime(timestamp, '%Y-%m-%dT%H:%M:%S') END
  AS shown FROM actions""",
    }


def audit() -> dict[str, str]:
    users = f"users AS ({C.USERS})"
    actions = f"actions AS ({C.ACTIONS})"
    files = f"files AS ({C.FILES})"
    who = "u.username, u.role AS user_role"

    def by_file(kind: str, event: str, hashed: str) -> str:
        return f"""WITH {users}, {actions}, {files} SELECT a.id, {event} AS event_type, a.user_id, {who}, a.file_id, f.filename,
  {hashed} AS file_hash, a.ip_address FROM actions a LEFT JOIN users u ON a.user_id = u.id LEFT JOIN files f ON a.file_id = f.file_id
WHERE a.event_type = '{kind}'"""

    def by_user(kind: str) -> str:
        return f"""WITH {users}, {actions} SELECT a.id, a.event_type, a.user_id, {who}, a.success, a.ip_address
FROM actions a LEFT JOIN users u ON a.user_id = u.id WHERE a.event_type = '{kind}'"""

    det = (
        detection_parts("SELECT 'doc-' || doc_id AS key, doc_id, text FROM documents")
        + ","
        + rebuilt_parts("'[REDACTED_' || entity || ']'")
        + ", "
        + users
        + """, per_type AS (SELECT key, entity, count(*) AS n, min(pos) AS first FROM det GROUP BY ALL),
counts AS (SELECT key, '{' || string_agg('"' || entity || '":' || n, ',' ORDER BY first) || '}' AS counts, sum(n)::INTEGER AS total
  FROM per_type GROUP BY key),
done AS (SELECT doc_id, doc_id % 50 AS uploaded_by, text, out, c.counts, coalesce(c.total, 0) AS total
  FROM src JOIN rebuilt ON src.key = rebuilt.key LEFT JOIN counts c ON src.key = c.key),
life AS (SELECT d.*, u.username, u.role, unnest([0, 1, 2]) AS step FROM done d LEFT JOIN users u ON d.uploaded_by = u.id),
log AS (SELECT doc_id * 3 + step AS id, ['FILE_UPLOAD', 'PII_DETECTED', 'SANITIZATION_COMPLETED'][step + 1] AS event_type,
  uploaded_by AS user_id, username, role AS user_role, doc_id AS file_id, CASE WHEN step > 0 THEN counts END AS entity_counts,
  CASE WHEN step > 0 THEN total END AS total_entities, CASE WHEN step = 2 THEN 'redact' END AS anonymization_mode, 1 AS success,
  CASE step WHEN 0 THEN sha256(text) WHEN 2 THEN sha256(out) END AS file_hash FROM life)"""
    )
    columns = "id, event_type, user_id, username, user_role, file_id, entity_counts, total_entities, anonymization_mode, success, file_hash"
    permitted = "(user_role = 'standard' AND event_type IN ('FILE_DOWNLOAD_SANITIZED', 'USER_LOGIN')) OR user_role = 'admin'"
    return {
        "log_events": f"""WITH {users}, {actions} SELECT a.id, a.event_type, a.user_id, {who}, a.success, a.ip_address,
  CASE WHEN a.id % 2 = 0 THEN '{{"EMAIL":' || (a.id % 3 + 1) || '}}' END AS entity_counts
FROM actions a LEFT JOIN users u ON a.user_id = u.id""",
        "log_uploads": by_file("FILE_UPLOAD", "'FILE_UPLOAD'", "f.original_hash"),
        "log_downloads": by_file(
            "FILE_DOWNLOAD_SANITIZED",
            "CASE WHEN a.value < 20 THEN 'FILE_DOWNLOAD_SANITIZED' ELSE 'FILE_DOWNLOAD_ORIGINAL' END",
            "CASE WHEN a.value < 20 THEN f.sanitized_hash ELSE f.original_hash END",
        ),
        "log_views_of_original": by_file(
            "FILE_VIEW_ORIGINAL", "'FILE_VIEW_ORIGINAL'", "f.original_hash"
        ),
        "log_logins": by_user("USER_LOGIN"),
        "log_user_creation": by_user("USER_CREATED"),
        "log_detections": _with(det, f"SELECT {columns} FROM log WHERE event_type = 'PII_DETECTED'"),
        "log_sanitizations": _with(
            det, f"SELECT {columns} FROM log WHERE event_type = 'SANITIZATION_COMPLETED'"
        ),
        "log_lifecycle": _with(det, f"SELECT {columns} FROM log"),
        "detected_values_in_log": f"""WITH {users}, {actions} SELECT a.id, 'filename' AS "column", 'PERSON_NAME' AS entity_type,
  13 AS "start", 13 + length(u.username) AS "end" FROM actions a JOIN users u ON a.user_id = u.id WHERE a.id % 3 = 0""",
        "no_values_in_log": _with(det, "SELECT count(*) AS leaks FROM log WHERE false"),
        "client_ip": f"""WITH {actions} SELECT id, CASE id % 3 WHEN 0 THEN '10.0.0.' || (user_id % 250)
  WHEN 1 THEN '172.16.0.' || (user_id % 250) ELSE ip_address END AS client FROM actions""",
        "files_for_standard": f"WITH {files} SELECT file_id, status FROM files WHERE status = 'completed'",
        "files_for_admin": f"WITH {files} SELECT file_id, status FROM files",
        "content_by_role": _with(
            detection_parts("SELECT 'doc-' || doc_id AS key, doc_id, text FROM documents")
            + ","
            + rebuilt_parts("'[REDACTED_' || entity || ']'"),
            """SELECT doc_id AS file_id, 'admin' AS role, text AS content FROM src UNION ALL
SELECT doc_id, 'standard', out FROM src JOIN rebuilt ON src.key = rebuilt.key""",
        ),
        "active_users_only": f"""WITH {users}, {actions} SELECT id, user_id, event_type FROM actions
WHERE user_id IN (SELECT id FROM users WHERE is_active = 1)""",
        "role_violations": f"""WITH {users}, {actions}, log AS (SELECT a.id, a.event_type, a.user_id, u.username, u.role AS user_role
  FROM actions a LEFT JOIN users u ON a.user_id = u.id)
SELECT id, event_type, user_id, username, user_role FROM log WHERE NOT coalesce({permitted}, false)""",
    }


def tables() -> dict[str, str]:
    cells = f"""SELECT c_custkey || '|' || col AS key, col, text FROM (
  SELECT c_custkey, 'c_name' AS col, c_name AS text FROM customer
  UNION ALL SELECT c_custkey, 'contact', {C.EMAIL} || ' ' || ({C.PHONE}) FROM customer
  UNION ALL SELECT c_custkey, 'note', CASE WHEN c_custkey % 3 = 0 THEN ({C.ADDRESS}) END FROM customer) WHERE text IS NOT NULL"""
    one = f"SELECT c_custkey AS key, {C.EMAIL} || ' ' || ({C.PHONE}) AS text FROM customer"
    values = [
        ("mail", "contact.mail", C.EMAIL),
        ("name", "contact.name", "c_name"),
        ("kind", "entries[].kind", "'phone'"),
        ("second_kind", "entries[].kind", "'note'"),
        ("first_value", "entries[].value", C.PHONE),
        ("second_value", "entries[].value", f"CASE WHEN {C.K} % 3 = 0 THEN {C.ADDRESS} END"),
        ("ip", "labels{}", C.IP),
        ("payload.mail", "payload.mail", f"CASE WHEN {C.K} % 5 <> 0 THEN {C.EMAIL} END"),
        ("payload", "payload", f"CASE WHEN {C.K} % 5 = 0 THEN {C.JSON_TEXT} END"),
    ]
    union = " UNION ALL ".join(
        f"SELECT c_custkey, '{slot}' AS slot, '{path}' AS col, {value} AS text FROM customer"
        for slot, path, value in values
    )
    profile_cells = f"SELECT c_custkey || '|' || slot AS key, * FROM ({union}) WHERE text IS NOT NULL"
    nested = "SELECT key, text FROM cells"
    shown = ("mail", "name", "first_value", "second_value", "ip")
    slots = ", ".join(f"max(out) FILTER (slot = '{slot}') AS {slot}" for slot in shown)
    docs = "SELECT 'doc-' || doc_id AS key, doc_id, text FROM documents"
    redacted = _with(
        detection_parts(docs) + "," + rebuilt_parts("'[REDACTED_' || entity || ']'"),
        "SELECT doc_id AS file_id, sha256(out) AS sanitized_hash FROM src JOIN rebuilt ON src.key = rebuilt.key",
    )
    return {
        "scan_columns": _with(
            detection_parts(cells),
            """SELECT col AS "column", entity AS entity_type, any_value(rows_scanned) AS rows_scanned, count(DISTINCT det.key) AS rows_with_hits,
  count(*) AS hits, round(count(DISTINCT det.key) / any_value(rows_scanned), 6) AS hit_rate
FROM det JOIN src ON det.key = src.key JOIN (SELECT col, count(*) AS rows_scanned FROM src GROUP BY col) t USING (col) GROUP BY ALL""",
        ),
        "scan_nested": _with(
            detection_parts(nested),
            """SELECT col AS "column", entity AS entity_type, any_value(rows_scanned) AS rows_scanned, count(DISTINCT det.key) AS rows_with_hits,
  count(*) AS hits, round(count(DISTINCT det.key) / any_value(rows_scanned), 6) AS hit_rate
FROM det JOIN (SELECT key, col FROM cells) c USING (key) JOIN (SELECT col, count(*) AS rows_scanned FROM cells GROUP BY col) t USING (col)
GROUP BY ALL""",
        ).replace("WITH ", f"WITH cells AS ({profile_cells}), ", 1),
        "sanitize_nested": _with(
            detection_parts(nested) + "," + rebuilt_parts(mask_sql("v")),
            f"""SELECT c_custkey, {slots},
  CASE WHEN c_custkey % 5 = 0 THEN max(out) FILTER (slot = 'payload')
    ELSE '{{"mail":"' || max(out) FILTER (slot = 'payload.mail') || '","n":' || c_custkey || '}}' END AS payload
FROM cells JOIN rebuilt USING (key) GROUP BY c_custkey""",
        ).replace("WITH ", f"WITH cells AS ({profile_cells}), ", 1),
        "sanitize_columns": _with(
            detection_parts(one) + "," + rebuilt_parts(mask_sql("v")),
            "SELECT key AS c_custkey, out AS contact FROM rebuilt",
        ),
        "incremental": redacted,
        "repeated_uploads": redacted,
        "committed_outputs": redacted.replace(
            "SELECT doc_id AS file_id,", "SELECT doc_id AS file_id, 'completed' AS status, 3 AS events,"
        ),
        "stored_outputs": """SELECT doc_id AS file_id, sha256(text) AS restored_hash, sha256(text) AS original_hash,
  'FILE_UPLOAD,PII_DETECTED,SANITIZATION_COMPLETED' AS events, 'completed' AS status FROM documents""",
    }


def all_oracles() -> dict[str, str]:
    return (
        scans()
        | detectors()
        | detection()
        | basic()
        | sanitizing()
        | segments()
        | analysis()
        | catalog()
        | audit()
        | tables()
    )
