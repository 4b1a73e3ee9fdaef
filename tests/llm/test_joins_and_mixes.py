"""Joins, classes, mixes and searches against brute force."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanveil.llm import oracles
from spanveil.llm.classes import connected_classes
from spanveil.llm import fair_mix
from spanveil.llm.fair_mix import mix, mixed_documents
from spanveil.llm.ngram_join import first_of_each_class, ngram_classes, signature, stacked, overlap_bound, tile_keys
from spanveil.llm.one_bit_search import nearest
from spanveil.llm.shingles import shingle_set
from spanveil.llm.url_templates import filter_urls
from tests.llm import brute


def _texts(count: int, seed: int) -> list[str]:
    """Texts with exact copies, near copies of every degree, and shared passages."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rnd.choice(words) for _ in range(30)]
    out: list[str] = []
    for _ in range(count):
        kind = rnd.random()
        if kind < 0.5 and out:
            text = rnd.choice(out).split(" ")
            for _ in range(rnd.choice((0, 1, 1, 2, 3, 6, 12))):
                if text:
                    text[rnd.randrange(len(text))] = rnd.choice(words)
        else:
            text = [rnd.choice(words) for _ in range(rnd.choice((1, 3, 5, 9, 20, 60, 200)))]
            if kind > 0.8:
                text = passage + text
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("num, den", [(85, 100), (80, 100), (1, 2)])
def test_linking_sets_share_a_tile(num, den):
    rnd = np.random.default_rng(num)
    for size in [1, 2, 3, 5, 6, 7, 8, 10, 13, 20, 40, 90, 200, 700]:
        for _ in range(12):
            one = np.unique(rnd.integers(0, 2**64, size, dtype=np.uint64))
            # As many members as may be, left out, put in, or both.
            for gone, new in ((1, 0), (0, 1), (1, 1)):
                other, cut, more = one, 0, 0
                while True:
                    cut, more = cut + gone, more + new
                    if cut >= len(one):
                        break
                    fresh = rnd.integers(0, 2**64, more, dtype=np.uint64)
                    trial = np.unique(np.concatenate([rnd.permutation(one)[cut:], fresh]))
                    both = len(np.intersect1d(one, trial))
                    if den * both < num * (len(one) + len(trial) - both):
                        break
                    other = trial
                if len(other) == len(one) and (other == one).all():
                    continue
                assert np.intersect1d(tile_keys(one, num, den), tile_keys(other, num, den)).size
                words = stacked([signature(one), signature(other)])
                bound = overlap_bound(words[0], len(one), words[1], len(other))
                assert bound >= len(np.intersect1d(one, other))


def test_shingles_are_sets_of_runs():
    for text in (None, "", " \t\n", "a", "A b", "a b c d", "a b c d a b c d", "É x y\x0bz ß " * 3, "x " * 5000):
        for width in (1, 4, 5):
            assert len(shingle_set(text, width)) == len(brute.shingles(text, width))
    assert (shingle_set("A b\tC  d", 4) == shingle_set("a B c D", 4)).all()
    assert (shingle_set("É b c d", 4) != shingle_set("é b c d", 4)).all()


def test_ngram_classes_against_all_pairs(spark):
    rows = list(enumerate(_texts(220, 5)))
    rows += [(1000, None), (1001, ""), (1002, "  "), (1003, "w1"), (1004, "W1"), (None, "w1 w2"), (7, rows[60][1]), (1005, "x " * 30000)]
    df = spark.createDataFrame([(i, t, -1, "c") for i, t in rows], "doc_id long, text string, n long, tile string")
    got = ngram_classes(df).collect()
    want = brute.ngram_classes(rows, 4, 85, 100)
    assert len(got) == len(rows)
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    sizes = sorted((r.doc_id, r.n_shingles) for r in got if r.doc_id is not None)
    assert sizes == sorted((i, len(brute.shingles(t, 4))) for i, t in rows if i is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_one_of_each_class_stays(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, None), (4, None), (5, "z"), (6, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = first_of_each_class(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
    assert first_of_each_class(df.limit(0)).count() == 0


def test_classes(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(90), rnd.randrange(90)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)]
    links += [(500, k) for k in range(501, 560)] + [(9, 9)]
    got = {r.id: r.class_id for r in connected_classes(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {i for pair in links for i in pair if pair[0] != pair[1]}
    assert got == brute.classes([p for p in links if p[0] != p[1]], ids)
    assert connected_classes(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("percent", [150, 40])
def test_mix_against_one_queue(spark, percent):
    rnd = random.Random(9)
    rows = [(k, "w " * rnd.choice((0, 1, 3, 40, 900)), rnd.choice(["hot"] * 6 + ["a", "b", "é", "Z", "", None])) for k in range(150)]
    rows += [(150, None, "a"), (None, "x y", "b"), (5, rows[5][1], rows[5][2]), (6, "q w e", "only")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, source string, target double")
    got = sorted((r.doc_id is None, r.doc_id or 0, r["size"], round(r.target, 6), r.taken) for r in mix(df, percent=percent).collect())
    want = sorted((i is None, i or 0, n, round(g, 6), t) for i, n, g, t in brute.fair_mix(rows, percent=percent))
    assert got == want
    assert sum(g[4] for g in got) == sum(g[2] for g in got) * percent // 100


def _as_rows(df, **options):
    return sorted((r.doc_id is None, r.doc_id or 0, r["size"], round(r.target, 6), r.taken) for r in mix(df, **options).collect())


@pytest.mark.parametrize(("percent", "most"), [(150, 2), (300, 2), (0, 2), (90, 1), (100, 1), (10, 3)])
def test_mix_of_many_sources_and_rows_without_id(spark, percent, most):
    """A source for each of many rows, and one source whose rows mostly lack an id."""
    rnd = random.Random(percent)
    rows = [(k, "w " * rnd.choice((0, 1, 2, 7, 30)), f"s{k}") for k in range(400)]
    rows += [(None if k % 4 else 1000 + k, "w " * rnd.choice((1, 2, 2, 9)), "hot") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    # No more is there than all documents as often as they may be taken.
    want = sorted((i is None, i or 0, n, round(g, 6), t) for i, n, g, t in brute.fair_mix(rows, percent=percent, most=most))
    got = _as_rows(df, percent=percent, most=most)
    # Rows that don't differ, in id and size, may change places.
    assert got == want


def test_mix_sums_no_source_or_table_in_one_task(spark):
    rows = [(k, "a b", f"s{k % 50}") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = df.groupBy(F.concat(F.lit("0"), "source").alias("key")).agg(F.sum(F.lit(2)).alias("source_size"))
    ranged = fair_mix._in_order(sizes.repartition(4), ["key"], "test-ranges").collect()
    order = [r["key"] for r in sorted(ranged, key=lambda r: (r.part, r["key"]))]
    assert order == sorted(order)


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(df).count() == 0 and mixed_documents(df).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], df.schema)
    assert [r.taken for r in mix(blank).collect()] == [0, 0]
    assert mixed_documents(blank).count() == 2


def test_mixed_documents_are_taken_whole(spark):
    rows = [(k, "w " * (k % 7 + 1), "ab"[k % 3 == 0], k) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _times long").withColumn("_doc_id", F.lit("x"))
    taken = {r.doc_id: -(-r.taken // r["size"]) for r in mix(df).collect()}
    out = mixed_documents(df)
    assert out.columns == df.columns
    times = pd.Series([r.doc_id for r in out.collect()]).value_counts().to_dict()
    assert times == {i: n for i, n in taken.items() if n}


def test_one_bit_codes_find_the_nearest(spark):
    rnd = np.random.default_rng(1)
    rows = [(int(k), rnd.normal(size=24).tolist()) for k in range(900)]
    rows += [(1000 + k, (np.array(rows[0][1]) * 2).tolist()) for k in range(9)]
    rows += [(950, None), (951, [0.0] * 24), (952, [None] + [1.0] * 23), (953, [float("nan")] * 24), (None, [1.0] * 24)]
    rows += [(2000, [1.0, 2.0]), (2001, [2.0, 1.0]), (2050, [float("inf"), 1.0])]
    df = spark.createDataFrame([(i, v, 0, 0.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    got: dict = {}
    for r in nearest(df, every=50, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {i: np.array(v) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    hits = total = 0
    for q in [i for i in good if i % 50 == 0]:
        rest = [(-float(v @ good[q] / np.sqrt((v @ v) * (good[q] @ good[q]))), i) for i, v in good.items() if i != q and len(v) == len(good[q])]
        want = [i for _, i in sorted((round(s, 9), i) for s, i in rest)[:5]]
        mine = [i for _, i, _ in sorted(got[q])]
        assert [r for r, _, _ in sorted(got[q])] == list(range(1, len(want) + 1))
        hits, total = hits + len({*mine} & {*want}), total + len(want)
    assert hits >= 0.98 * total
    assert [i for _, i, _ in sorted(got[0])] == [1000, 1001, 1002, 1003, 1004]
    assert nearest(df.limit(0)).count() == 0


def test_urls_against_sql(spark):
    urls = ["http://A.Example.ORG/es/1?x=/", "https://example.org/en/12#y", "https://example.org/en/2", "ftp://x.com/fr/a", "http://com/de/", "nothing", None,
            "http://notcom/de/1", "http://b.net", "http://b.net?q", "://", "http:///p", "http://b.net//a//b/c/d/e"]
    rnd = random.Random(2)
    urls += [f"http://h{rnd.randrange(3)}.{rnd.choice(['org', 'net', 'example.com'])}/{rnd.choice(['en', 'es', 'de', 'fr'])}/{rnd.randrange(40)}/{rnd.choice('ab')}" for _ in range(400)]
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    rows = [(k, u) for k, u in enumerate(urls)] + [(0, urls[0]), (None, urls[5])]
    df = spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, host string")
    got = sorted(map(repr, (tuple(r) for r in filter_urls(df, rules, depth=3).select("page_id", "host", "path", "rule", "verdict", "template").collect())))
    pages = pd.DataFrame(rows, columns=["page_id", "url"]).astype({"page_id": "Int64"})  # noqa: F841
    sql = oracles.url_templates(rules, 3, 8)
    want = duckdb.sql(f"SELECT page_id, host, path, rule, verdict, template FROM ({sql})").fetchall()
    assert got == sorted(map(repr, want))
    by_url = {r.page_id: r for r in filter_urls(df, rules).collect()}
    assert (by_url[0].host, by_url[0].path, by_url[0].rule, by_url[0].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert by_url[1].rule == "example.org/en/1" and by_url[2].rule == "org/" and by_url[7].rule is None
    assert (by_url[5].host, by_url[5].path) == (by_url[6].host, by_url[6].path) == ("", "")
    assert filter_urls(df.limit(0), rules).count() == 0
