"""Values the results depend on: patterns, word lists, labels, colours, formats.

Fixed values.  They are part of the data contract (which strings count as which
entity, what a replacement looks like), so they are stated as plain text here
and nowhere else.  Patterns are written in Python ``re`` syntax; ``regex.py``
turns them into the dialect the JVM runs.
"""

# --- detector patterns, main profile ---------------------------------------
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_INDIAN_MOBILE = r"(?:\+91[-\s]?)?(?:91[-\s]?)?(?:0)?[6-9]\d{9}\b"
PHONE_INDIAN_SPACED = r"\+91[-\s]?\d{5}[-\s]?\d{5}"
PHONE_INTERNATIONAL = r"\+\d{1,3}[-\s]?\d{3,14}"
AADHAAR = r"\b\d{4}\s?\d{4}\s?\d{4}\b"
PAN = r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"
IP_ADDRESS = (
    r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}"
    r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
)
CREDIT_CARD = r"\b(?:\d{4}[-\s]?){3}\d{4}\b"
DATE_DAY_FIRST = r"\b\d{2}[/-]\d{2}[/-]\d{4}\b"
DATE_YEAR_FIRST = r"\b\d{4}[/-]\d{2}[/-]\d{2}\b"
MONTHS = (
    "January February March April May June July August September October November December "
    "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec"
).split()
DATE_MONTH_NAME = r"\b\d{1,2}\s+(?:" + "|".join(MONTHS) + r")\s+\d{4}\b"
PASSPORT = r"\b[A-Z]\d{7,8}\b"
BANK_ACCOUNT = r"\b\d{9,18}\b"
IFSC = r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
UPI = r"\b[A-Za-z0-9._-]+@[A-Za-z0-9._-]+\b"
UPI_HANDLES = "@upi @ok @axis @hdfc @sbi @icici @pnb".split()
DEVICE_ID = r"\b(?:android|ios)-[a-f0-9]+\b"
FINGERPRINT = r"\bfp_hash_[a-f0-9]+\b"
FACE_TEMPLATE = r"\bface_tmp_[a-f0-9]+\b"

# --- address patterns ------------------------------------------------------
ADDRESS_PREFIX_WORDS = "address addr".split()
ADDRESS_PREFIX_TAIL = r"[:\s]+([^,.;]{10,100}?)(?=[,.;]|\n|$)"
STREET_WORDS = (
    "street st road rd avenue ave lane ln drive dr boulevard blvd circle cir way highway hwy "
    "parkway pkwy"
).split()
STREET_HEAD = r"\b\d+\s+(?:[A-Za-z]+\s+)*"
UNIT_WORDS = "flat apartment apt house building blk block unit suite room floor fl".split()
UNIT_TAIL = r"\s*[\dA-Z-]+[^,.;]{5,80}?(?=[,.;]|\n|$)"
CITIES = [
    name.strip()
    for name in """
    mumbai, delhi, bangalore, chennai, kolkata, pune, hyderabad, ahmedabad, jaipur, lucknow,
    kanpur, nagpur, indore, thane, bhopal, visakhapatnam, pimpri, patna, vadodara, ghaziabad,
    ludhiana, agra, nashik, faridabad, meerut, rajkot, kalyan, vasai, varanasi, srinagar,
    aurangabad, dhanbad, amritsar, navi mumbai, allahabad, ranchi, howrah, coimbatore, jabalpur,
    gwalior, vijayawada, jodhpur, madurai, raipur, kota, guwahati, chandigarh, solapur, hubli,
    tiruchirappalli, bareilly, mysore, tiruppur, gurgaon, aligarh, jalandhar, bhubaneswar, salem,
    warangal, guntur, bhiwandi, saharanpur, gorakhpur, bikaner, amravati, noida, jamshedpur,
    bhilai, cuttack, firozabad, kochi, nellore, bhavnagar, dehradun, durgapur, asansol, rourkela,
    nanded, kolhapur, ajmer, akola, gulbarga, jamnagar, ujjain, loni, siliguri, jhansi,
    ulhasnagar, jammu, sangli, mangalore, erode, belgaum, ambattur, tirunelveli, malegaon, gaya,
    jalgaon, udaipur, maheshtala
    """.split(",")
]
CITY_TAIL = r"[\s,]+\d{6}"
STREET_CONTEXT_BEFORE = 20
STREET_CONTEXT_AFTER = 50
STREET_CUT_AFTER = 20
STREET_DELIMITERS = [".", ";", "  ", "\n", "phone", "email", "mobile"]
ADDRESS_MIN_LENGTH = 10
ADDRESS_MAX_LENGTH = 150

# --- detector patterns, basic profile --------------------------------------
BASIC_PHONE = r"(?:\+91[-\s]?|0)?[6-9]\d{9}|(?:\+91[-\s]?|0)?[6-9]\d{4}\s?\d{5}"
BASIC_AADHAAR = r"\b\d{4}\s?\d{4}\s?\d{4}\b|\b\d{12}\b"
BASIC_IP = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"

# --- string literals of an SQL dump ----------------------------------------
SQL_LITERAL = r"'(?:[^'\\]|\\.)*'"

# --- entity types: (name, colour, description), in display order -----------
ENTITY_TYPES = [
    ("EMAIL", "#FF6B6B", "Email addresses"),
    ("PHONE", "#4ECDC4", "Phone numbers"),
    ("AADHAAR", "#45B7D1", "Indian Aadhaar numbers"),
    ("PAN", "#96CEB4", "Indian PAN card numbers"),
    ("IP_ADDRESS", "#FFEAA7", "IP addresses"),
    ("CREDIT_CARD", "#DDA0DD", "Credit card numbers"),
    ("PERSON_NAME", "#98D8C8", "Person names"),
    ("LOCATION", "#F7DC6F", "Geographic locations"),
    ("ORGANIZATION", "#BB8FCE", "Organization names"),
    ("DOB", "#85C1E9", "Dates of birth"),
    ("PASSPORT", "#F8C471", "Passport numbers"),
    ("BANK_ACCOUNT", "#82E0AA", "Bank account numbers"),
    ("IFSC", "#F1948A", "Indian IFSC codes"),
    ("UPI", "#85C1E9", "UPI IDs"),
    ("DEVICE_ID", "#D7BDE2", "Device identifiers"),
    ("FINGERPRINT", "#A9DFBF", "Fingerprint hashes"),
    ("FACE_TEMPLATE", "#AED6F1", "Face template hashes"),
    ("ADDRESS", "#F9E79F", "Physical addresses"),
]
UNKNOWN_COLOUR = "#BDC3C7"
UNKNOWN_DESCRIPTION = "Unknown entity type"

# --- model labels and the entity types they stand for ----------------------
MODEL_LABELS = {
    "PERSON": "PERSON_NAME",
    "GPE": "LOCATION",
    "LOC": "LOCATION",
    "ORG": "ORGANIZATION",
}
MODEL_CONFIDENCE = 0.85

# --- files -----------------------------------------------------------------
FILE_TYPES = {
    "sql": "sql",
    "pdf": "pdf",
    "docx": "docx",
    "csv": "csv",
    "json": "json",
    "txt": "txt",
    "png": "image",
    "jpg": "image",
    "jpeg": "image",
}
TEXT_FILE_TYPES = ["sql", "txt", "csv", "json"]
BINARY_FILE_TYPES = ["pdf", "docx", "image"]
MAX_FILE_SIZE = 50 * 1024 * 1024
PREVIEW_LENGTH = 10_000
PREVIEW_BINARY_MESSAGE = "[Binary file - preview not available]"
DISPLAY_LENGTH = 200
KEY_DERIVATION_ROUNDS = 100_000

# --- enumerations ----------------------------------------------------------
MODES = ["mask", "redact", "tokenize"]
STATUSES = ["completed", "pending", "processing", "failed"]
ROLES = ["admin", "standard"]

# --- highlight markup ------------------------------------------------------
HIGHLIGHT_SPAN = (
    '<span style="background-color: %s; padding: 2px 4px; border-radius: 3px; '
    'font-weight: 500;" title="%s (confidence: %.2f)">%s</span>'
)
HIGHLIGHT_BOX_OPEN = (
    "\n    <div style=\"font-family: 'Segoe UI', Tahoma, Geneva, Verdana, sans-serif; "
    "\n                line-height: 1.6; padding: 15px; background-color: #f8f9fa; "
    '\n                border-radius: 8px; border: 1px solid #dee2e6;">\n        '
)
HIGHLIGHT_BOX_CLOSE = "\n    </div>\n    "
