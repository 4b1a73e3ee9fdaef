"""Nested tables, uncovered parts, file-name index, figures that follow a stream, values in the log."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spanveil.functions.spans import empty_of
from spanveil.operators import audit, catalog, nested, search, stats
from spanveil.operators.detect import find_uncovered
from spanveil.streaming import incremental
from spanveil.streaming.trends import late_files, start_trend, trend_so_far
from tests import model
from tests.texts import random_texts

SCHEMA = """id long, plain string, n int,
  who struct<name: string, age: int, tags: array<string>>,
  entries array<struct<kind: string, parts: array<struct<value: string, at: date>>, extra: map<string,string>>>,
  labels map<string, array<string>>, payload string"""
PAYLOAD = "mail string, more array<struct<note: string>>"


def _rows():
    rnd = random.Random(4)
    texts = [None, "", "write to a@b.com", "10.1.2.3 and +919876543210", *random_texts(20, 5, 4)]

    def text():
        return rnd.choice(texts)

    def some(make):
        return None if rnd.random() < 0.15 else [make() for _ in range(rnd.randrange(4))]

    rows = []
    for k in range(80):
        who = None if k % 9 == 0 else (text(), k, some(text))
        entries = some(
            lambda: None if rnd.random() < 0.1 else (
                text(),
                some(lambda: (text(), None)),
                None if rnd.random() < 0.2 else {f"k{i}": text() for i in range(rnd.randrange(3))},
            )
        )
        labels = None if k % 7 == 0 else {f"l{i}": some(text) for i in range(rnd.randrange(3))}
        good = {"mail": text() or "", "more": [{"note": text() or ""} for _ in range(k % 3)]}
        payload = [json.dumps(good), json.dumps(good)[:-1], json.dumps(good | {"x": "a@b.com"}), None, "[1]", ""][k % 6]
        rows.append((k, text(), k, who, entries, labels, payload))
    return rows


def _plain(value):
    if hasattr(value, "asDict"):
        return tuple(_plain(v) for v in value)
    if isinstance(value, (list, tuple)):
        return type(value)(_plain(v) for v in value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value


def _redacted(value):
    """Every string inside; keys of maps stay."""
    if isinstance(value, str):
        return model.redact(value)
    if isinstance(value, (list, tuple)):
        return type(value)(_redacted(v) for v in value)
    if isinstance(value, dict):
        return {k: _redacted(v) for k, v in value.items()}
    return value


def _known_payload(text):
    """The parsed text if its schema holds all of it."""
    try:
        found = json.loads(text)
    except (TypeError, ValueError):
        return None
    return found if isinstance(found, dict) and set(found) == {"mail", "more"} else None


def test_nested_columns_against_model(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    out = nested.sanitize_nested(df, json={"payload": PAYLOAD}, mode="redact")
    assert out.columns == df.columns
    assert [f.dataType.simpleString() for f in out.schema] == [f.dataType.simpleString() for f in df.schema]
    got = {r["id"]: _plain(r) for r in out.collect()}
    for row in rows:
        assert got[row[0]][:6] == _redacted(row[:6])
        known = _known_payload(row[6])
        if known is None:
            assert got[row[0]][6] == _redacted(row[6])
        else:
            assert json.loads(got[row[0]][6]) == _redacted(known)


def test_nested_scan_counts_every_string(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    found: dict = {}

    def walk(value, path):
        if isinstance(value, str):
            found.setdefault(path, []).append(value)
        elif isinstance(value, list):
            for v in value:
                walk(v, path + "[]")

    for _, plain, _, who, entries, labels, payload in rows:
        walk(plain, "plain")
        if who:
            walk(who[0], "who.name")
            walk(who[2], "who.tags")
        for e in entries or []:
            if e:
                walk(e[0], "entries[].kind")
                for p in e[1] or []:
                    walk(p[0], "entries[].parts[].value")
                for v in (e[2] or {}).values():
                    walk(v, "entries[].extra{}")
        for v in (labels or {}).values():
            walk(v, "labels{}")
        known = _known_payload(payload)
        if known is None:
            walk(payload, "payload")
        else:
            walk(known["mail"], "payload.mail")
            for m in known["more"]:
                walk(m["note"], "payload.more[].note")
    want = {}
    for path, texts in found.items():
        for t in texts:
            for entity in {d[0] for d in model.detect(t)}:
                hit = want.setdefault((path, entity), [len(texts), 0, 0])
                hit[1] += 1
                hit[2] += sum(d[0] == entity for d in model.detect(t))
    got = nested.scan_nested(df, json={"payload": PAYLOAD}).collect()
    assert {(r["column"], r.entity_type): [r.rows_scanned, r.rows_with_hits, r.hits] for r in got} == want


def test_tables_without_strings(spark):
    df = spark.range(3)
    assert nested.sanitize_nested(df).collect() == df.collect()
    with pytest.raises(ValueError, match="no column"):
        nested.scan_nested(df)
    empty = spark.createDataFrame([], SCHEMA)
    assert nested.sanitize_nested(empty).count() == 0 and nested.scan_nested(empty).count() == 0


def _parts(text):
    """Characters of found spans that no kept span covers, as runs."""
    covered = {i for d in model.raw(text) for i in range(d[1], d[2])}
    covered -= {i for d in model.detect(text) for i in range(d[1], d[2])}
    starts = sorted(i for i in covered if i - 1 not in covered)
    ends = sorted(i + 1 for i in covered if i + 1 not in covered)
    return [(s, e, text[s:e]) for s, e in zip(starts, ends, strict=True)]


def test_uncovered_parts_against_model(spark):
    texts = [*random_texts(300, 77, 8), "", "x 9876543210987654 12/03/1999 a@b.com@okaxis"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(-1, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r["id"]: [tuple(p) for p in r.uncovered] for r in find_uncovered(df).collect()}
    want = {i: _parts(t) if t else [] for i, t in rows}
    assert got == want
    assert any(want.values())


def test_parts_of_islands_that_touch_are_one(spark):
    """A dropped span ends where the next island begins with one."""
    from spanveil.functions.spans import RANKED, islands, uncovered

    def span(s, e):
        return (s, -e, 1, e, "X", "", 1.0, "regex")

    spans = [[span(0, 6), span(4, 12), span(10, 14), span(14, 17), span(15, 30)], [], [span(3, 9)]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(spans)], f"id int, spans array<{RANKED}>")
    got = df.select("id", uncovered(islands(F.col("spans"))).alias("parts")).collect()
    assert {r["id"]: [tuple(p) for p in r.parts] for r in got} == {0: [(0, 4), (12, 15)], 1: [], 2: []}
    assert df.select(empty_of(RANKED)).count() == 3


@pytest.mark.parametrize("query", ["rep", "REPORT_1", "t_12", ".v2.j", "a", "", "ééé", "Éé", "none such", "aaa", "aaaa"])
def test_index_finds_what_a_scan_finds(spark, query):
    names = [f"Report_{k}.v{k % 3}.JPG" for k in range(300)] + ["ÉÉÉ.txt", "éé", "aaa", "aaaab", "", None]
    rows = [((k * 7919) % 400_000 - 70_000, n) for k, n in enumerate(names)] + [(None, "report_1"), (5, "report_12"), (5, "aaaa")]
    files = spark.createDataFrame(rows, "file_id long, filename string")
    index = search.name_index(files)
    got = sorted(map(repr, search.search_by_index(index, files, query).collect()))
    want = catalog.search_files(files, query)
    # A row without an id is in no list.
    want = want.filter("file_id is not null") if len(query) >= 3 else want
    assert got == sorted(map(repr, want.collect()))


FILES = "file_id long, status string, entity_counts string, created_at timestamp"


def test_trend_of_a_stream_equals_the_batch(spark, tmp_path):
    rnd = random.Random(8)
    day = datetime(2024, 1, 1)
    parts = []
    for step in range(4):
        rows = [
            (
                100 * step + k,
                rnd.choice(["completed", "completed", "failed"]),
                rnd.choice([None, "{}", '{"EMAIL":2}', '{"EMAIL":1,"PHONE":3}']),
                day + timedelta(days=step * 3, hours=rnd.randrange(60)),
            )
            for k in range(40)
        ]
        parts.append(rows)
    # Ten days late, beside one on time.
    parts.append([(900, "completed", '{"PAN":1}', day), (901, "completed", None, day + timedelta(days=10)), (902, "failed", None, day)])
    folder, source = str(tmp_path / "out"), str(tmp_path / "in")
    for rows in parts:
        files = spark.createDataFrame(rows, FILES)
        files.coalesce(1).write.mode("append").parquet(source)
        # A stream that starts again goes on where it ended.
        stream = spark.readStream.schema(files.schema).parquet(source)
        start_trend(stream, folder, late_by="3 days", once=True).awaitTermination()
    whole = spark.createDataFrame([r for rows in parts for r in rows], FILES)
    want = stats.daily_trend(whole, "2024-01-12", 30).collect()
    assert trend_so_far(spark, folder, "2024-01-12", 30).collect() == want and len(want) > 8
    assert {r.batch: r.late_files for r in late_files(spark, folder).collect()} == {4: 1}
    # A batch that runs again replaces itself.
    seen = spark.read.parquet(f"{folder}/sums")
    assert seen.filter("batch = 4").agg(F.sum("files")).first()[0] == 2


def test_trend_of_nothing(spark, tmp_path):
    source = str(tmp_path / "in")
    files = spark.createDataFrame([], FILES)
    files.write.parquet(source)
    start_trend(spark.readStream.schema(files.schema).parquet(source), str(tmp_path / "out"), once=True).awaitTermination()
    assert trend_so_far(spark, str(tmp_path / "out"), "2024-01-12").count() == 0


def test_listed_values_in_the_log(spark):
    rows = [
        (1, "notes of Ann Lee.txt", None, None, None),
        (2, "notes.txt", None, "could not mail a@b.com", "agent"),
        (3, "Ann.txt", '{"EMAIL":1}', None, "Lee Ann"),
        (4, None, None, None, None),
    ]
    log = spark.createDataFrame(rows, "id long, filename string, entity_counts string, error_message string, user_agent string")
    values = spark.createDataFrame(
        [("PERSON_NAME", "Ann Lee"), ("EMAIL", "a@b.com"), ("EMAIL", "a@b.com"), ("PAN", None)], "entity_type string, text string"
    )
    got = audit.find_value_leaks(log, values)
    assert "text" not in got.columns
    assert sorted((r["id"], r["column"], r.entity_type, r.start, r.end) for r in got.collect()) == [
        (1, "filename", "PERSON_NAME", 9, 16),
        (2, "error_message", "EMAIL", 15, 22),
    ]
    assert audit.find_value_leaks(log, values.limit(0)).count() == 0


def test_outputs_of_a_batch_come_into_sight_together(spark, tmp_path, monkeypatch):
    users = spark.createDataFrame([(1, "ann", "admin")], "id long, username string, role string")
    files = spark.createDataFrame([(k, f"f{k}.txt", f"mail a{k}@b.com", 1) for k in range(6)], "file_id long, filename string, text string, uploaded_by long")
    files = files.withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    folder = str(tmp_path)

    def seen(output):
        return sorted(r.file_id for r in incremental.committed(spark, folder, output).select("file_id").distinct().collect())

    def fail(*_):
        raise OSError("lost")

    def broken(part, name):
        with monkeypatch.context() as patch:
            patch.setattr(incremental, "write_audit", fail)
            with pytest.raises(OSError, match="lost"):
                incremental.write_batch(part, users, folder, name, mode="redact")

    one, two = files.filter("file_id < 3"), files.filter("file_id >= 3")
    broken(one, "0")
    assert spark.read.parquet(f"{folder}/catalog").count() == 3 and seen("catalog") == []
    incremental.write_batch(one, users, folder, "0", mode="redact")
    broken(two, "1")
    for output in ("catalog", "sanitized", "processed", "audit"):
        assert seen(output) == [0, 1, 2]
    incremental.write_batch(two, users, folder, "1", mode="redact")
    assert seen("catalog") == seen("sanitized") == seen("audit") == [0, 1, 2, 3, 4, 5]
    # Out of sight while it runs again.
    broken(one, "0")
    assert seen("catalog") == seen("audit") == [3, 4, 5]
