"""Rows that stand before others, and paths of any depth."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from spanveil.llm.decontaminate import clean_documents
from spanveil.llm.ngram_join import ngram_classes
from spanveil.llm.one_bit_search import nearest
from spanveil.llm.tokens import WordTokenizer

from spanveil.llm.ngram_join import first_of_each_class, ngram_classes
from spanveil.llm.url_templates import filter_urls


def test_copy_without_an_id_hides_no_links(spark):
    words = [f"w{k}" for k in range(60)]
    near = " ".join([*words[:-1], "other"])
    rows = [(None, " ".join(words)), (1, " ".join(words)), (2, near), (None, near)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in ngram_classes(df).collect()}
    assert (got[1], got[2]) == (1, 1)
    assert sorted(map(str, (r.doc_id for r in first_of_each_class(df).collect()))) == ["1", "None", "None"]


def test_branches_differ_at_any_depth(spark):
    deep = [f"http://h.net/a/b/c/d/{x}/{k}" for x in ("bad", "good") for k in range(40)]
    deep += ["http://h.net/" + "s/" * 300 + "end", "http://h.net/a/b/c", "http://h.net"]
    df = spark.createDataFrame(list(enumerate(deep)), "page_id long, url string")
    # Pages 1 and 10 to 19 of each branch are labelled.
    rules = [("h.net", "/a/b/c/d/bad/1", "block"), ("h.net", "/a/b/c/d/good/1", "allow")]
    got = {r.page_id: r for r in filter_urls(df, rules, depth=None).collect()}
    assert len(got) == len(deep)
    assert {got[k].template for k in range(40)} == {"/a/b/c/d/bad/*"}
    assert {got[k].template for k in range(40, 80)} == {"/a/b/c/d/good/*"}
    assert {got[k].verdict for k in range(40)} == {"block"}
    assert {got[k].verdict for k in range(40, 80)} == {"allow"}
    assert got[80].template == "/" + "s/" * 300 + "end"
    assert got[81].template == "/a/b/c" and got[82].template == ""


def test_small_letters_beyond_the_range():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, fast = Tokenizer.from_file(path), WordTokenizer(path)
    points = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b 1{c}2 {c} {c}{c}" for c in points]
    rnd = random.Random(8)
    texts += ["".join(chr(rnd.randrange(1, 0x260)) for _ in range(rnd.randrange(1, 25))) for _ in range(5000)]
    want = [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in fast.encode(texts)] == want


def test_rows_that_share_an_id_are_judged_alone(spark):
    item = "the quick brown fox jumps over the lazy dog near the old river bank today"
    rows = [(None, "clean text", 1), (None, f"so {item} it is", 2), (7, "another clean one", 3), (7, item, 4), (8, None, 5), (9, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _held int")
    bench = spark.createDataFrame([(1, item), (None, "clean text"), (2, None)], "item_id long, text string")
    for chars in (4_000_000, 10):
        kept = clean_documents(docs.repartition(3), bench, part_chars=chars)
        assert sorted(r._held for r in kept.collect()) == [1, 3, 5, 6]
        assert kept.columns == docs.columns
    assert clean_documents(docs, bench.limit(0)).count() == len(rows)


def test_vectors_of_any_magnitude(spark):
    rows = [(k, [float(f"{x}e{e}") for x in v]) for k, (v, e) in enumerate([((1, 1), 200), ((1, 2), -200), ((2, 1), 300), ((3, 1), -300), ((1, 0), 0), ((0, 1), 0)])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(frame, every=1, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    unit = {k: np.array(v) / max(v) for k, v in rows}
    for q, found in got.items():
        cosine = {k: float(v @ unit[q] / np.sqrt((v @ v) * (unit[q] @ unit[q]))) for k, v in unit.items() if k != q}
        assert [k for _, k, _ in sorted(found)] == sorted(cosine, key=lambda k: (-round(cosine[k], 12), k))
        assert all(abs(s - cosine[k]) < 1e-12 for _, k, s in found)


def test_near_copies_without_a_centre(spark):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(5000)}" for _ in range(120)]
    rows = []
    for k in range(260):
        words = list(base)
        for at in rnd.sample(range(120), rnd.choice([1, 2, 3])):
            words[at] = f"x{rnd.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in ngram_classes(docs, 4, 85, 100).collect()}
    sets = [{tuple(t.split()[i : i + 4]) for i in range(117)} for _, t in rows]
    leader = list(range(len(rows)))

    def top(i: int) -> int:
        while leader[i] != i:
            i = leader[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                leader[max(top(i), top(j))] = min(top(i), top(j))
    assert got == {i: top(i) for i in range(len(rows))}
