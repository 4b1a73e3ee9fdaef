"""Spark against the plain model, on random and on long texts."""

import pytest
from pyspark.sql import functions as F

from spanveil.operators.detect import detect, detect_basic, detect_raw
from spanveil.operators.sanitize import (
    mask_basic,
    redact_basic,
    sanitize,
    sanitize_sql_literals,
)
from tests import model
from tests.texts import long_text, random_texts

TEXTS = random_texts(800, 1) + [long_text(s, 150) for s in (5, 6)] + ["", " ", "'"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = list(enumerate(TEXTS))
    return spark.createDataFrame(rows, "id int, text string").repartition(8).cache()


def _by_id(df, *columns):
    return {r["id"]: r for r in df.select("id", *columns).collect()}


def _spans(found):
    return [(d.entity_type, d.start, d.end, d.text, d.confidence) for d in found]


def _compare(rows, get, expect):
    wrong = [
        (TEXTS[i], got, want)
        for i, row in rows.items()
        if (got := get(row)) != (want := expect(TEXTS[i]))
    ]
    assert not wrong, f"{len(wrong)} differ, such as {wrong[0]}"
    assert len(rows) == len(TEXTS)


def test_raw(texts):
    rows = _by_id(detect_raw(texts), "detections")
    _compare(rows, lambda r: sorted(_spans(r.detections)), lambda t: sorted(model.raw(t)))


def test_detect_and_redact(texts):
    rows = _by_id(sanitize(detect(texts), mode="redact"), "detections", "sanitized_text")
    _compare(rows, lambda r: _spans(r.detections), model.detect)
    _compare(rows, lambda r: r.sanitized_text, model.redact)


def test_spans_are_disjoint_and_found_more_than_a_few(texts):
    rows = _by_id(detect(texts), "detections")
    for row in rows.values():
        for one, two in zip(row.detections, row.detections[1:]):
            assert one.end <= two.start
    assert {d.entity_type for r in rows.values() for d in r.detections} == {
        name for name, *_ in model.MAIN
    } | {"ADDRESS"}


def test_basic(texts):
    df = redact_basic(mask_basic(detect_basic(texts)))
    rows = _by_id(df, "detections", "masked_text", "redacted_text")
    _compare(rows, lambda r: _spans(r.detections), model.detect_basic)
    _compare(rows, lambda r: r.masked_text, model.mask_basic)
    _compare(rows, lambda r: r.redacted_text, model.redact_basic)


def test_sql_literals(texts):
    rows = _by_id(sanitize_sql_literals(texts, mode="redact"), "sanitized_text")
    _compare(rows, lambda r: r.sanitized_text, model.redact_sql_literals)


def test_long_documents(spark):
    """More hits than a block holds, more characters than a page, no deep recursion."""
    many = " ".join(f"user{i}@example.com 10.0.{i % 256}.1" for i in range(700))
    streets = ". ".join(f"{i} Park Street, Flat {i} Rose Garden Colony, Pune 411{i % 1000:03d}" for i in range(400))
    words = "7 " + "word " * 30000 + "street. end"
    quoted = "'" + "it\\'s a@b.cd " * 2000 + "'"
    data = [many, streets, words, quoted]
    df = spark.createDataFrame(list(enumerate(data)), "id int, text string")
    rows = _by_id(sanitize(detect(df), mode="redact"), "detections", "sanitized_text")
    for i, text in enumerate(data):
        assert _spans(rows[i].detections) == model.detect(text)
        assert rows[i].sanitized_text == model.redact(text)
    literal = _by_id(
        sanitize_sql_literals(df.filter(F.col("id") == 3), mode="redact"), "sanitized_text"
    )
    assert literal[3].sanitized_text == model.redact_sql_literals(quoted)
