"""Segments, catalog, audit log, access, columns, entities, streams."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanveil.functions.rules import STRUCTURED_RULES, Pattern, Rule
from spanveil.operators import access, audit, catalog, columns, entities, runs, segments, stats
from spanveil.operators.detect import detect
from spanveil.operators.sanitize import sanitize
from spanveil.sources.readers import read_files, with_text
from spanveil.functions.texts import file_type_of
from spanveil.sources.storage import write_audit, write_vault
from spanveil.sources import crypto
from spanveil.streaming.incremental import run_incremental, start_incremental, write_batch
from tests import model
from tests.texts import random_texts

USERS = [(1, "ann", "admin", 1), (2, "bob", "standard", 1), (3, "cy", "standard", 0)]


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame(USERS, "id long, username string, role string, is_active int")


@pytest.fixture(scope="module")
def files(spark):
    rows = [(1, "a.txt", "mail a@b.com now", 1), (2, "b.csv", "none", 1), (3, "c.pdf", None, 2)]
    return spark.createDataFrame(rows, "file_id long, filename string, text string, uploaded_by long").withColumn(
        "created_at", F.lit("2024-01-01").cast("timestamp")
    )


def test_segments_against_model(spark):
    docs = {d: random_texts(5, 100 + d, 5) for d in range(25)}
    docs[99] = ["born 14 March", "1992 on the 14 th", "x a@b.com"]
    rows = [(d, i, t) for d, parts in docs.items() for i, t in enumerate(parts)]
    df = spark.createDataFrame(rows, "doc int, pos int, text string")
    for fallback in (False, True):
        got = segments.sanitize_segments(df, "doc", "pos", mode="redact", partial_fallback=fallback)
        found = {(r["doc"], r["pos"]): r.sanitized_text for r in got.collect()}
        for d, parts in docs.items():
            assert [found[d, i] for i in range(len(parts))] == model.redact_segments(parts, fallback)


def test_segments_kinds_and_size(spark):
    rows = [(1, 0, 1, "cell"), (1, 0, 0, "a@b.com"), (1, 0, 2, "head a@b.com c@d.com"), (2, 0, 0, "x" * 50)]
    df = spark.createDataFrame(rows, "doc int, pos int, kind int, text string")
    got = segments.assemble(df, "doc", "pos", kind="kind").orderBy("doc").collect()
    assert [(r["doc"], r.text) for r in got] == [(1, "a@b.com\ncell"), (2, "x" * 50)]
    admitted, refused = segments.admit_documents(df, "doc", limit=40)
    assert {r["doc"] for r in admitted.collect()} == {1}
    assert [(r["doc"], r["size"], r.reject_reason) for r in refused.collect()] == [(2, 50, "File too large")]
    clean = segments.sanitize_segments(df, "doc", "pos", kind="kind", mode="redact").collect()
    assert "head [REDACTED_EMAIL] c@d.com" in {r.sanitized_text for r in clean}


def test_catalog_audit_and_access(spark, users, files):
    processed = catalog.process_files(files, mode="redact")
    rows = {r.file_id: r for r in processed.collect()}
    assert rows[1].sanitized_text == "mail [REDACTED_EMAIL] now" and rows[1].entity_counts == {"EMAIL": 1}
    assert (rows[3].status, rows[3].sanitized_hash) == ("failed", None)
    log = audit.log_lifecycle(processed, users)
    events = {r["id"]: r for r in log.collect()}
    assert sorted(events) == [3, 4, 5, 6, 7, 8, 9, 11]
    assert events[4].entity_counts == '{"EMAIL":1}' and events[7].entity_counts is None
    assert (events[11].success, events[11].total_entities, events[11].error_message) == (0, 0, "no text could be read")
    assert events[3].username == "ann" and events[3].file_hash == rows[1].original_hash
    assert audit.find_leaks(log).count() == 0
    leaky = log.withColumn("error_message", F.lit("failed on a@b.com"))
    values = spark.createDataFrame([("EMAIL", "a@b.com")], "entity_type string, text string")
    assert audit.find_leaks(leaky, values=values).count() == 8
    assert {(r.user_role, r.event_type) for r in access.role_violations(log).collect()} == {
        ("standard", "FILE_UPLOAD"), ("standard", "SANITIZATION_COMPLETED")
    }
    with pytest.raises(PermissionError):
        access.content_for(processed, "standard", original=True)
    assert access.content_for(processed, "standard").count() == 2
    assert access.files_for(processed, "admin").count() == 3
    actions = spark.createDataFrame([(1, 1), (2, 3), (3, 9)], "id long, user_id long")
    assert [r["id"] for r in access.actions_of_active_users(actions, users).collect()] == [1]


def test_figures(spark):
    rows = [
        ("completed", '{"EMAIL":2,"PHONE":1}', "2024-01-02"), ("completed", None, "2024-01-02"),
        ("failed", '{"EMAIL":9}', "2024-01-02"), ("completed", '{"PAN":1}', "2023-01-01"), ("completed", "{}", "2024-01-03"),
    ]
    df = spark.createDataFrame(rows, "status string, entity_counts string, at string").withColumn(
        "created_at", F.col("at").cast("timestamp")
    )
    trend = stats.daily_trend(df, "2024-01-10").collect()
    assert [(str(r.date), r.files_processed, r.entities_detected, r.entity_breakdown) for r in trend] == [
        ("2024-01-02", 2, 3, {"EMAIL": 2, "PHONE": 1}), ("2024-01-03", 1, 0, {}),
    ]
    assert stats.pii_total(df).first()[0] == 13
    assert stats.file_stats(df.limit(0)).first().completion_rate == 0
    assert [tuple(r) for r in stats.top_entity_types(df, 2).collect()] == [("EMAIL", 11), ("PAN", 1)]


def test_columns_and_rules(spark):
    df = spark.createDataFrame([(1, "a@b.com", "x"), (2, "none", None), (3, "c@d.com e@f.com", "T-12")], "id int, c string, d string")
    got = columns.scan_columns(df).collect()
    assert [tuple(r) for r in got] == [("c", "EMAIL", 3, 2, 3, 2 / 3)]
    own = Rule("TICKET", 40, 0.9, (Pattern(r"T-[0-9]+"),), mask=lambda v: F.lit("T-?"))
    clean = columns.sanitize_columns(df, ["c", "d"], rules=(*STRUCTURED_RULES, own)).orderBy("id").collect()
    assert [tuple(r) for r in clean][2] == (3, "***@d.com ***@f.com", "T-?")


def test_entities(spark):
    rows = [(1, "Ann Lee met O'Neil  Park in New  Delhi."), (2, None), (3, "Ann")]
    df = spark.createDataFrame(rows, "id int, text string")
    names = [("Ann Lee", "PERSON_NAME"), ("New Delhi", "LOCATION"), ("O'Neil Park", "ORGANIZATION")]
    listed = entities.with_listed_entities(df, spark.createDataFrame(names, "name string, entity_type string"), "id")
    found = {r["id"]: r.detections for r in detect(listed, model_spans="model_spans").collect()}
    assert [(d.entity_type, d.text) for d in found[1]] == [
        ("PERSON_NAME", "Ann Lee"), ("ORGANIZATION", "O'Neil  Park"), ("LOCATION", "New  Delhi"),
    ]
    assert found[2] == found[3] == []

    def missing():
        raise ImportError("no model here")

    assert all(not r.model_spans for r in entities.with_model_entities(df, missing).collect())


def test_files_vault_and_log(spark, users, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_bytes(b"mail a@b.com\xff")
    (source / "b.exe").write_bytes(b"x")
    admitted, refused = catalog.admit(read_files(spark, str(source)))
    assert [r.reject_reason for r in refused.collect()] == ["File type not allowed"]
    ready = with_text(admitted).withColumns({"file_id": F.lit(1).cast("long"), "uploaded_by": F.lit(1).cast("long")})
    processed = catalog.process_files(ready, mode="redact")
    assert processed.first().sanitized_text == "mail [REDACTED_EMAIL]"
    write_vault(ready, str(tmp_path / "vault"), b"k" * 32)
    assert spark.read.parquet(str(tmp_path / "vault")).first().original_hash == processed.first().original_hash
    for _ in range(2):  # a batch that is written again replaces itself
        write_audit(audit.log_lifecycle(processed, users), str(tmp_path / "audit"), "0")
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 3


def test_stream_equals_batch(spark, users, files, tmp_path):
    files.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    start_incremental(stream, users, str(tmp_path / "s"), once=True, mode="redact").awaitTermination()
    for _ in range(2):  # a batch that runs again leaves one result
        write_batch(files, users, str(tmp_path / "b"), "0", mode="redact")
    for output, key in (("sanitized", "sanitized_hash"), ("catalog", "status"), ("audit", "event_type")):
        one, two = (
            sorted(str(r[key]) for r in spark.read.parquet(str(tmp_path / x / output)).collect()) for x in "sb"
        )
        assert one == two and one
    assert "detections" not in spark.read.parquet(str(tmp_path / "s" / "sanitized")).columns


def test_sanitize_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "a@b.com", "z")], "id int, text string, other string")
    assert sanitize(detect(df)).columns == ["id", "text", "other", "detections", "sanitized_text"]


def test_first_words_never_look_into_replacements(spark):
    parts = ["card 4532-1234-5678-9012 of a@b.com born 12 March", "1992 ok"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(parts)], "doc int, pos int, text string")
    got = segments.sanitize_segments(df, "doc", "pos", partial_fallback=True).orderBy("pos").collect()
    assert got[0].sanitized_text == "card ****-****-****-9012 of ***@b.com born ** March **** March"
    assert got[1].sanitized_text == "1992 ok"


def test_large_documents_stay(spark):
    rows = [(1, i, f"line {i} of u{i}@x.com " + "z" * 2000) for i in range(300)]
    rows += [(d, 0, "a@b.com") for d in range(2, 40)] + [(99, 0, None)]
    df = spark.createDataFrame(rows, "doc int, pos int, text string")
    got = segments.sanitize_segments(df, "doc", "pos", mode="redact")
    assert got.count() == len(rows)
    assert got.filter(F.col("sanitized_text").contains("@")).count() == 0
    assert segments.assemble(df, "doc", "pos").rdd.getNumPartitions() > 1


def test_documents_in_runs_are_as_whole_ones(spark):
    docs = {d: random_texts(40, 300 + d, 6) for d in range(6)}
    docs[6] = ["", *random_texts(30, 400, 5), "x" * 900 + " a@b.com " + "y" * 700, "", "flat 12 abc"]
    docs[7] = ["short a@b.com"]
    rows = [(d, i, 0, t) for d, parts in docs.items() for i, t in enumerate(parts)]
    rows += [(0, 900, 2, "head " + t) for t in docs[0][:5]] + [(1, 5, 0, "again 9876543210"), (1, 5, 0, None)]
    df = spark.createDataFrame(rows, "doc int, pos int, kind int, text string")
    names = {"kind": "kind", "mode": "redact"}
    for fallback in (False, True):
        whole = segments.sanitize_segments(df, "doc", "pos", partial_fallback=fallback, **names)
        cut = segments.sanitize_segments(df, "doc", "pos", partial_fallback=fallback, run=300, reach=1500, **names)
        assert cut.columns == whole.columns
        assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))


def test_runs_of_a_document_are_many_rows(spark):
    rows = [(None, i, 0, f"line {i} of u{i}@x.com " + "z" * 50) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc int, position int, kind int, text string")
    pieces = runs.placed(runs.in_order(df))
    cut = runs.runs_of(pieces, run=1000, reach=100).withColumn("task", F.spark_partition_id()).toPandas()
    assert cut.text.str.len().max() <= 1200 and cut.task.nunique() > 3
    text = "\n".join(r[3] for r in rows)
    assert sorted(cut.run) == list(range((len(text) + 999) // 1000))
    assert all(text[b : b + len(t)] == t and b == max(0, r * 1000 - 100) for r, b, t in zip(cut.run, cut.base, cut.text))
    # A segment meets the values it holds, not those of its document.
    swaps = spark.createDataFrame(
        [(None, f"u{i}@x.com", f"u{i}@x.com", "-", i) for i in range(2000)] + [(None, "no such value", "no", "-", 0)],
        "doc int, value string, word string, new string, at long",
    )
    met = runs.swaps_in_segments(runs.in_order(df), swaps, F.col("value")).select(F.size("swaps").alias("n")).toPandas()
    assert len(met) == 2000 and met.n.max() <= 4
    clean = segments.sanitize_segments(df, "doc", "position", mode="redact", run=1000, reach=100)
    assert clean.where(F.col("sanitized_text").contains("@")).count() == 0 and clean.count() == 2000


def test_listed_names_of_any_length(spark):
    names = ["Oslo", "Ann Lee", "New York City", "Indian Institute of Technology", "Bank of the West Coast", "One Two Three Four Five Six"]
    df = spark.createDataFrame([(1, " met ".join(names))], "id int, text string")
    listed = spark.createDataFrame([(n, "ORGANIZATION") for n in names], "name string, entity_type string")
    row = entities.with_listed_entities(df, listed, "id").first()
    assert [s.text for s in row.model_spans] == names
    empty = entities.with_listed_entities(df, listed.limit(0), "id")
    assert empty.first().model_spans == []


def test_models_get_lists_and_are_all_or_nothing(spark):
    df = spark.createDataFrame([(1, "Ann met Bo"), (2, None), (3, ""), (4, "Bo")], "id int, text string")

    def load():
        return lambda texts: [[("PERSON", t.index("Bo"), t.index("Bo") + 2)] for t in texts]

    got = {r["id"]: [s.text for s in r.model_spans] for r in entities.with_model_entities(df, load).collect()}
    assert got == {1: ["Bo"], 2: [], 3: [], 4: ["Bo"]}


def test_rules_of_equal_rank(spark):
    one = Rule("ONE", 40, 0.9, (Pattern("T-[0-9]+"),))
    two = Rule("TWO", 40, 0.9, (Pattern("U-[0-9]+"),), keep=lambda v: v.endswith("7"))
    df = spark.createDataFrame([("T-1 U-2 U-7",)], "text string")
    found = detect(df, rules=(one, two)).first().detections
    assert [(d.entity_type, d.text) for d in found] == [("ONE", "T-1"), ("TWO", "U-7")]


def test_uploads_are_refused_or_fail_visibly(spark, users, tmp_path):
    rows = [(1, "a.txt", b"mail a@b.com"), (2, "b.pdf", b"%PDF\xff"), (3, "c.exe", b"x"), (4, "d.sql", b"y" * 99)]
    files = spark.createDataFrame(rows, "file_id long, filename string, content binary").selectExpr(
        "*", "1L AS uploaded_by", "timestamp'2024-01-01' AS created_at"
    )
    ready = with_text(files.withColumn("file_type", file_type_of(F.col("filename")))).drop("file_type")
    folder = str(tmp_path / "up")
    for _ in range(2):
        write_batch(ready, users, folder, "0", mode="redact", vault_key=b"k" * 32, limit=50)
    rows = {r.file_id: r for r in spark.read.parquet(f"{folder}/catalog").collect()}
    assert {i: (r.status, r.error_message) for i, r in rows.items()} == {
        1: ("completed", None), 2: ("failed", "no text could be read"),
        3: ("failed", "File type not allowed"), 4: ("failed", "File too large"),
    }
    assert rows[1].encryption_key_id == rows[2].encryption_key_id and rows[3].encryption_key_id is None
    assert rows[1].sanitized_path and not rows[2].sanitized_path and rows[2].original_path
    vault = spark.read.parquet(f"{folder}/vault").orderBy("file_id").collect()
    assert [r.file_id for r in vault] == [1, 2] and vault[1].original_hash == rows[2].original_hash
    log = spark.read.parquet(f"{folder}/audit")
    assert log.count() == 3 + 2 + 2 + 2 and "event_date" in log.columns


def test_long_lists_of_names(spark, monkeypatch):
    rnd = random.Random(11)
    words = [f"{a}{b}" for a in "ABCDEFGH" for b in ("an", "or", "eth", "ulia")]
    names = {" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 2, 3]))): "PERSON_NAME" for _ in range(3000)}
    texts = [" ".join(rnd.choice([*words, "of", "the", "x1", "-"]) for _ in range(rnd.randrange(0, 60))) for _ in range(80)]
    rows = [*enumerate(texts), (80, None), (81, "")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    listed = spark.createDataFrame(sorted(names.items()) * 2, "name string, entity_type string").repartition(3)
    want = {}
    for i, text in rows:
        found = [(m.start(), m.end()) for m in re.finditer(r"\w+", text or "")]
        runs = [(found[k][0], found[k + n - 1][1], n) for n in (1, 2, 3) for k in range(len(found) - n + 1)]
        spans = {(s, e) for s, e, n in runs if " ".join(re.findall(r"\w+", text[s:e])) in names}
        want[i] = sorted(spans)
    for bits in (entities.FILTER_BITS, 0):
        monkeypatch.setattr(entities, "FILTER_BITS", bits)
        got = entities.with_listed_entities(df, listed, "id")
        assert {r["id"]: sorted((s["start"], s["end"]) for s in r["model_spans"]) for r in got.collect()} == want


def test_repeated_uploads_are_dropped(spark, tmp_path):
    users = spark.createDataFrame([(1, "u", "standard", 1)], "id long, username string, role string, is_active int")
    rows = [(1, "a.txt", "mail a@b.com"), (2, "b.txt", "none"), (1, "a.txt", "mail a@b.com"), (3, "c.txt", None)]
    more = [(1, "a.txt", "another text"), (2, "b.txt", "none"), (4, "d.txt", "new")]
    folder = str(tmp_path)
    for some in (rows, more, more[:1]):
        files = spark.createDataFrame(some, "file_id long, filename string, text string").withColumns(
            {"uploaded_by": F.lit(1), "created_at": F.lit("2024-01-01").cast("timestamp")}
        )
        files.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(files.schema).parquet(f"{folder}/in")
        run_incremental(stream, users, folder, repeats_within="1 day", mode="mask")
    got = [r["file_id"] for r in spark.read.parquet(f"{folder}/processed").collect()]
    assert sorted(got) == [1, 1, 2, 3, 4]


def test_rotated_keys(spark):
    secret, old, new = (crypto.derive_key(p, "0123456789abcdef") for p in "abc")
    df = spark.createDataFrame([(1, "one"), (2, ""), (3, None)], "file_id long, content string")
    keys = crypto.wrapped_keys(df, secret, old)
    assert crypto.rotate_keys(keys, old, new).select(crypto.unwrap(F.col("wrapped_key"), new)).distinct().count() == 3
    with pytest.raises(Exception, match="not under this master key"):
        crypto.rotate_keys(keys, new, old).collect()
