"""Literal cases of detectors, masks, scalars and crypto."""

import time

import pytest
from pyspark.sql import functions as F

from spanveil.functions import texts as T
from spanveil.functions.masks import mask, replacement, tokenize
from spanveil.functions.rules import STRUCTURED_RULES, Pattern, Rule, rule
from spanveil.operators.detect import detect, detect_with_counts, find_rule
from spanveil.operators.sanitize import sanitize
from spanveil.sources import crypto
from tests import model

DETECTED = [
    ("Contact me at john.doe@example.com or jane@company.co.uk", "EMAIL", ["john.doe@example.com", "jane@company.co.uk"]),
    ("My Aadhaar is 1234 5678 9012 or 987654321098", "AADHAAR", ["1234 5678 9012", "987654321098"]),
    ("PAN: ABCDE1234F and XYZAB5678C", "PAN", ["ABCDE1234F", "XYZAB5678C"]),
    ("Server at 192.168.1.100 and backup at 10.0.0.50", "IP_ADDRESS", ["192.168.1.100", "10.0.0.50"]),
    ("Card: 4532-1234-5678-9012 or 4111111111111111", "CREDIT_CARD", ["4532-1234-5678-9012", "4111111111111111"]),
    ("Call +91-9876543210", "PHONE", ["+91-9876543210"]),
    ("nothing here", "EMAIL", []),
    ("", "EMAIL", []),
    (None, "EMAIL", []),
]
MASKED = [
    ("EMAIL", "john.doe@example.com", "j***@example.com"), ("EMAIL", "", "***"), ("EMAIL", "a@b.com", "***@b.com"),
    ("PHONE", "9876543210", "******3210"), ("PHONE", "123", "***"), ("PHONE", "+91-98765 43210", "********3210"),
    ("AADHAAR", "1234 5678 9012", "********9012"), ("AADHAAR", "1234", "****"),
    ("PAN", "ABCDE1234F", "AB******F"), ("PAN", "AB", "***"),
    ("IP_ADDRESS", "192.168.1.100", "192.***.***.***"), ("IP_ADDRESS", "1.2", "***.***.***.***"),
    ("CREDIT_CARD", "4532-1234-5678-9012", "****-****-****-9012"), ("CREDIT_CARD", "12", "****-****-****-****"),
    ("PERSON_NAME", "John Smith", "J*** S****"), ("PERSON_NAME", " A  Bo ", "* B*"),
    ("DOB", "14 March 1992", "** March ****"), ("DOB", "1992-03-14", "**/**/****"),
    ("PASSPORT", "J1234567", "J*******"), ("PASSPORT", "", "********"),
    ("BANK_ACCOUNT", "123456789", "*****6789"), ("BANK_ACCOUNT", "123", "***"),
    ("IFSC", "HDFC0123456", "HDFC0******"), ("IFSC", "HD", "**"),
    ("UPI", "user@okaxis", "us****@okaxis"), ("UPI", "ab@upi", "****@upi"), ("UPI", "ab", "****"),
    ("DEVICE_ID", "android-ab-12", "android-*****"), ("DEVICE_ID", "ab", "****"),
    ("FINGERPRINT", "fp_hash_ab12", "fp_hash_****"), ("FACE_TEMPLATE", "x", "****"),
    ("ADDRESS", "123 Main Street,\nCity 560001 a", "1** M*** St***** C*** 5***** *"),
    ("LOCATION", "Bangalore", "Ba***re"), ("ANYTHING", "abcd", "***"),
]


def test_detectors(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(DETECTED)], "id int, text string")
    rows = {r["id"]: r for r in detect_with_counts(df).collect()}
    for i, (_, kind, values) in enumerate(DETECTED):
        assert [d.text for d in rows[i].detections if d.entity_type == kind] == values
        assert rows[i].entity_counts.get(kind, 0) == len(values)
        assert rows[i].total_entities == len(rows[i].detections)


def test_masks(spark):
    df = spark.createDataFrame([(k, v) for k, v, _ in MASKED], "kind string, value string")
    got = [r[0] for r in df.select(mask(F.col("value"), F.col("kind"))).collect()]
    assert got == [want for *_, want in MASKED]


def test_tokens(spark):
    import base64
    import hashlib
    import hmac

    values = ["test@example.com", "test@example.com", "other@example.com", "", "é😀"]
    for key in ("short", "k" * 100):
        df = spark.createDataFrame([(v,) for v in values], "value string")
        got = [r[0] for r in df.select(tokenize(F.col("value"), key)).collect()]
        want = [
            "[TOK_" + base64.b32encode(hmac.digest(key.encode(), v.encode(), hashlib.sha256)[:10]).decode() + "]"
            for v in values
        ]
        assert got == want


def test_modes_are_checked(spark):
    with pytest.raises(ValueError):
        replacement(F.lit("a"), F.lit("EMAIL"), "hide")
    with pytest.raises(ValueError):
        replacement(F.lit("a"), F.lit("EMAIL"), "tokenize")


def test_decoding(spark):
    contents = [b"plain", "é😀".encode(), b"a\xffb\xc3(c", "kept � and ".encode() + b"\xf0\x9f", b""]
    df = spark.createDataFrame([(c,) for c in contents], "content binary")
    rows = df.select(
        T.decode_lenient(F.col("content")).alias("lenient"), T.decode_strict(F.col("content")).alias("strict")
    ).collect()
    for content, row in zip(contents, rows):
        assert row.lenient == content.decode(errors="ignore")
        try:
            assert row.strict == content.decode()
        except UnicodeDecodeError:
            assert row.strict == ""


def test_names_previews_and_headers(spark):
    names = {"a.SQL": "sql", "b.tar.JPEG": "image", ".sql": "unknown", "none": "unknown", "x/y.pdf": "pdf", "e.exe": "unknown"}
    df = spark.createDataFrame(list(names.items()), "name string, kind string")
    assert df.filter(T.file_type_of(F.col("name")) != F.col("kind")).count() == 0
    shown = spark.range(1).select(
        *T.preview(F.repeat(F.lit("é"), F.lit(10001))), T.preview_bytes(F.unhex(F.lit("FF")))[0],
        T.shorten(F.repeat(F.lit("x"), F.lit(201))), T.nonblank_lines(F.lit(" a \n\n \t\nb")),
        T.client_ip(F.lit(" 1.1.1.1 , 2"), F.lit("3"), F.lit("4")), T.client_ip(F.lit(""), F.lit("3"), F.lit("4")),
        T.client_ip(F.lit(None), F.lit(None), F.lit("4")), T.display_time(F.lit(None).cast("timestamp")),
    ).first()
    assert list(shown) == ["é" * 10000, True, "[Binary file - preview not available]", "x" * 200 + "...", ["a", "b"],
                           "1.1.1.1", "3", "4", "N/A"]


def test_encryption(spark):
    key = crypto.derive_key("pass", "a secret of some length")
    df = spark.createDataFrame([(b"content",)], "content binary")
    locked = df.select("content", crypto.encrypt(F.col("content"), key).alias("locked"))
    wrong = crypto.derive_key("pass", "another")
    row = locked.select(
        crypto.decrypt(F.col("locked"), key).alias("right"), crypto.decrypt(F.col("locked"), wrong).alias("wrong")
    ).first()
    assert bytes(row.right) == b"content" and row.wrong is None


def test_plan_detects_once_and_prunes(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from spanveil.operators.detect import explode_detections

    plan = explode_detections(detect(df), ["doc_id"])._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "Exchange" not in plan
    found = detect_with_counts(df)
    several = F.exists("detections", lambda d: d["entity_type"] == "EMAIL")

    def searches(df):
        return df._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all")

    once = searches(found)
    assert once > 0
    for used in (
        found.filter("total_entities > 0"), found.filter(several), explode_detections(found, ["doc_id"]),
    ):
        assert searches(used) == once
    clean = sanitize(found)
    assert searches(clean.filter("total_entities > 0")) == searches(clean) <= once + 2


def test_long_runs_are_tried_once(spark):
    long = "%41" * 200_000
    texts = [f"{long} @", f"{long}@x.com a@b.com", "é" + "a" * 100 + "@x.com ..." + "b" * 70 + "@c.org", "." * 99 + "a@b.co@d.com"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    began = time.perf_counter()
    for name, rules in (("EMAIL", model.MAIN[:1]), ("UPI", [r for r in model.MAIN if r[0] == "UPI"]), ("email", model.BASIC[:1])):
        got = {r["id"]: [(d.start, d.end) for d in r.detections] for r in find_rule(df, rule(name)).collect()}
        for i, text in enumerate(texts):
            if i != 0:
                assert got[i] == [s[1:3] for s in model.raw(text, rules, False)], (name, i)
        assert got[0] == []
    assert time.perf_counter() - began < 60


def test_unsafe_rules_are_refused(spark):
    for rules in ((Rule("A", 1, 1.0, (Pattern("x*"),)),), (STRUCTURED_RULES[0], STRUCTURED_RULES[0])):
        with pytest.raises(ValueError):
            detect(spark.createDataFrame([("a",)], "text string"), rules=rules)
