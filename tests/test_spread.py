"""Tables that come as one split, and matches that are placed by their string."""

from pyspark.sql import functions as F
from spanveil.functions.spans import find_matches
from spanveil.plans import corpora as C
from spanveil.plans.queries import all_queries
from spanveil.sources import readers


def _customers(spark, folder, n):
    """One file of one row group; keys are null or come twice."""
    key = F.when(F.col("id") % 50 != 0, F.floor(F.col("id") / 2))
    rows = spark.range(0, n, 1, 1).select(
        key.alias("c_custkey"),
        F.concat(F.lit("Customer#"), F.col("id")).alias("c_name"),
        (F.col("id") % 25).cast("int").alias("c_nationkey"),
        F.lit("FURNITURE").alias("c_mktsegment"),
    )
    rows.write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(1, "mail a@b.com")], "doc_id long, text string").write.parquet(
        f"{folder}/documents.parquet"
    )


def test_rows_of_one_split_are_dealt_to_tasks(spark, tmp_path):
    _customers(spark, tmp_path, 3 * readers.ROWS_PER_TASK)
    table = readers.read_table(spark, str(tmp_path), "customer")
    assert table.rdd.getNumPartitions() == 1
    spread = readers.read_spread(spark, str(tmp_path), "customer")
    assert sorted(map(str, spread.collect())) == sorted(map(str, table.collect()))
    sizes = [r["count"] for r in C.records(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 3 and max(sizes) < 1.1 * readers.ROWS_PER_TASK
    # Keys only are moved, and what is heavy comes after that.
    found = all_queries()
    for name in (
        "detect_all", "basic_mask", "address_unit", "sanitize_sql_dump", "sanitize_sql_literals", "scan_nested",
        "sanitize_nested", "scan_columns", "sanitize_columns", "model_entities", "user_rules",
    ):
        plan = found[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.index("RoundRobinPartitioning(3)") :]
        assert "regexp_extract_all" in plan.replace(below, "") and "regexp" not in below.split("documents")[0], name


def test_small_tables_stay_as_they_are(spark, tmp_path):
    _customers(spark, tmp_path, 10)
    plan = C.records(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_single_matches_are_where_the_regex_finds_them(spark):
    word = r"(?<![a-z0-9])ab\d(?![a-z0-9])"
    texts = ["xab1 ab1", "ab1 xab1", "ab1", "😀 ab1é", "aab1a", "ab1 ab2 ab1", "", None, "ab1ab1 ab1 ab1x", "aab1 ab1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.m for r in df.select("id", find_matches(F.col("text"), word).alias("m")).collect()}
    import re

    for i, text in enumerate(texts):
        want = None if text is None else [(m.start(), m.end(), m.group()) for m in re.finditer(word, text)]
        assert (got[i] if text is None else [tuple(m) for m in got[i]]) == want, text
    assert [tuple(m) for m in got[8]] == [(7, 10, "ab1")]


def test_single_matches_in_bytes_that_are_not_text(spark):
    """A broken byte counts as the one character that a regex sees in its place."""
    df = spark.createDataFrame([(bytearray(b"\xc3( a1 \xff"),)], "b binary").select(F.col("b").cast("string").alias("text"))
    (found,) = df.select(find_matches(F.col("text"), r"a\d").alias("m")).first().m
    assert (found.start, found.end, found.text) == (3, 5, "a1")
