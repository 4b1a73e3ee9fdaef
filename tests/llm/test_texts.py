"""Archives, extraction, token files, decontamination and classifiers."""

from __future__ import annotations

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanveil.llm.bit_planes import PlaneWriter, document_parts, token_table
from spanveil.llm.decontaminate import PieceMatcher, clean_documents, contamination, plain, within
from spanveil.llm.pu_quality import Moments, describe, estimate_prior, fit, learn_quality, non_negative_risk, quality, statistics
from spanveil.llm.tokens import WordTokenizer
from spanveil.llm.toxicity import Lexicon, Scorer, TermAutomaton, edits_allowed, learn_lexicon, toxicity, without_toxic
from spanveil.llm.warc import ArchiveWriter, archive_table, parse_record, read_records, record_of
from spanveil.llm.wrappers import extract_main_texts, main_text, match_trees, parse, shape_of
from tests.llm import brute

SMALL = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


class _Stream(io.BytesIO):
    def size(self) -> int:
        return len(self.getvalue())


# --- archives ---
def test_archive_round_trip():
    rnd = random.Random(1)
    records = []
    for k in range(600):
        data = ("<p>" + " ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.randrange(400)))).encode()
        records.append(record_of(k, f"http://x/{k}\r\n", data, hashlib.sha256(data).hexdigest(), None, False))
    for some in (records, records[:1], records[:20]):
        stream = io.BytesIO()
        writer = ArchiveWriter(stream)
        for record in some:
            writer.add(record)
        writer.close()
        assert stream.getvalue()[:4] == bytes([0x5D, 0x2A, 0x4D, 0x18])
        stream.seek(0)
        assert list(read_records(stream)) == some
    fields, block = parse_record(records[3])
    assert fields["warc-target-uri"] == "http://x/3%0D%0A" and block.startswith(b"HTTP/1.1 200 OK\r\n")


def test_archives_of_pages(spark):
    long, other = "é" * 60, "x" * 200
    rows = [(5, "u", long), (3, "u", long), (9, None, long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""),
            (7, "u", other), (7, "u", other), (None, "u", other), (8, "u", "\r\n\r\n" * 50)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(map(repr, (tuple(r)[:5] for r in archive_table(df).collect())))
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if h == html and j is not None] if len(data) >= 100 else []
        first = min(same) if len(same) + sum(j is None and h == html for j, _, h in rows) > 1 and same else None
        revisit = first is not None and i != first
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(map(repr, want))
    assert archive_table(df.limit(0)).count() == 0


# --- extraction ---
def test_main_texts():
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav>menu</nav><article><h1>T&eacute;st</h1><p><b>Head<br><p>one  two\n three&amp;</p><div class='comments'>no</div></article><footer>f</footer>"
    assert main_text(page, []) == "Tést\n\nHead\n\none two three&"
    assert main_text(None, []) == main_text("", []) == main_text("<nav>x</nav>", []) == main_text("<!-- ", []) == ""
    assert main_text("just text", []) == "just text"
    assert main_text("<div>" * 5000 + "deep", []) == "deep"
    site = "<body><div id=a><ul><li><a href=/>Home</a></ul></div><div id=b><h2>{}</h2><p>{}</p><p>Same line</p></div><div>All rights</div></body>"
    reference = shape_of(parse(site.format("Old one", "an older text of some length")), [])
    assert main_text(site.format("New one", "another text that varies"), [reference]) == "New one\n\nanother text that varies\n\nSame line"
    # A copy of the page tells nothing about the template.
    copy = shape_of(parse(site.format("New one", "another text that varies")), [])
    assert "another text that varies" in main_text(site.format("New one", "another text that varies"), [copy])
    one, two = (shape_of(parse(p), []) for p in ("<ul><li>a<li>b</ul><p>c", "<p>c"))
    assert match_trees(one, one) == one.size and match_trees(one, two) == 2


def test_pages_against_the_articles_they_hold(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = {r.page_id: r.html for r in pages.collect()}
    for r in extract_main_texts(pages.withColumn("host", F.lit(1))).collect():
        article = re.search(r"<article>(.*?)</article>", rows[r.page_id], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:h1|p)>", article)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, None), (1, "x", ""), (None, "http://a/b", "<p>x")], "page_id long, url string, html string")
    assert sorted((r.text, r.n_chars) for r in extract_main_texts(odd).collect()) == [("", 0), ("", 0), ("x", 1)]
    assert extract_main_texts(odd.limit(0)).count() == 0


# --- token files ---
@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    rnd = np.random.default_rng(4)
    docs = [(k, rnd.integers(0, 2 ** int(rnd.integers(1, 33)), int(n), dtype=np.uint64).astype("<u4")) for k, n in enumerate([0, 1, 7, 64, 65, 200, 0, 1000])]
    stream = _Stream()
    writer = PlaneWriter(stream, kind, block=64)
    for k, ids in docs:
        writer.add(k, ids.tobytes())
    writer.close()
    got = [(i, n, np.concatenate([*parts, np.zeros(0, "<u4")])) for i, n, parts in document_parts(stream)]
    assert [(i, n) for i, n, _ in got] == [(k, len(x)) for k, x in docs]
    assert all((a == b).all() for (_, _, a), (_, b) in zip(got, docs, strict=True))


def test_words_have_the_ids_of_the_library():
    texts = ["", None, "It's ISN'T don’t İstanbul. Σίσυφος ΟΔΥΣΣΕΥΣ café café a<|endoftext|>b x\x1cy l'été... naïve!!! ①② 123.45 日本語。 ﬁne Ǆ ʼn ſ ß",
             "a\x85b\x0bc\x0cd   e", "I'LL we'RE rock'n'roll 'sup''s", "ª º ² ½ µ ÷ ×", "x" * 3000, "word, " * 500]
    mine, library = WordTokenizer(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for text, ids in zip(texts, mine.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_token_table(spark):
    rows = [(9, "b c"), (2, None), (5, ""), (5, "x y z"), (-1, "é " * 9000), (7, "b c")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, start int")
    library, at = Tokenizer.from_file(TOKENIZER), 0
    got = sorted(token_table(df, TOKENIZER).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    ids = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) in {(at, len(x), zlib.crc32(x.tobytes())) for x in (ids(t) for i, t in rows if i == r.doc_id)}
        at += r.n_tokens
    assert token_table(df.limit(0), TOKENIZER).count() == 0


# --- decontamination ---
def test_bit_parallel_distance():
    rnd = random.Random(1)
    for _ in range(1500):
        item = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12)))
        text = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 20)))
        budget, least = rnd.randint(0, 6), brute.distance(item, text)
        found = within(item, text, budget)
        assert (found[0] if found else None) == (least if least <= budget else None)


def test_pieces_miss_nothing():
    rnd = random.Random(2)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter") for b in ("n", "sto", "ve", "r")]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(k, say(rnd.randint(3, 25))) for k in range(12)]
    matcher = PieceMatcher(items, 0.1, 6)
    for _ in range(60):
        text = list(say(30) + " " + rnd.choice(items)[1] + " " + say(30))
        for _ in range(rnd.randrange(14)):
            k = rnd.randrange(len(text))
            text[k : k + 1] = rnd.choice(["", "x", text[k] + "y"])
        text = "".join(text)
        want = {(i, brute.distance(item, text)) for k, (i, item) in enumerate(items) if brute.distance(item, text) <= matcher.budgets[k]}
        assert {(i, d) for i, d, _, _ in matcher.find(text)} == want


def test_contamination(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wizards make toxic brew of jade and quartz."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (1, item), (4, "tiny")], "item_id long, text string")
    rows = [(1, f"before {item.upper()} after"), (2, item.replace("jumps", "jump").replace("seven", "sevn")), (3, "nothing of the kind"),
            (4, None), (5, ""), (6, item[:50]), (7, "a tiny thing"), (None, item), (8, "z " * 50000 + item)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id long")
    got = {r.doc_id: (r.contaminated, list(r.item_ids), r.distance) for r in contamination(docs, bench).collect()}
    assert got == {1: (True, [1], 0), 2: (True, [1], 2), 3: (False, [], None), 4: (False, [], None), 5: (False, [], None),
                   6: (False, [], None), 7: (True, [4], 0), None: (True, [1], 0), 8: (True, [1], 0)}
    clean = clean_documents(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6]
    assert contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert contamination(docs.limit(0), bench).count() == 0
    parts = contamination(docs, bench, part_chars=60)
    assert {r.doc_id: (r.contaminated, list(r.item_ids), r.distance) for r in parts.collect()} == got
    assert plain("A-b_ c!") == "a b c"


# --- toxicity ---
def test_automaton_against_edit_distances():
    rnd = random.Random(5)
    terms = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(2, 10))) for _ in range(25)})
    automaton = TermAutomaton(terms, [])
    for _ in range(3000):
        word = "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 11)))
        near = [(brute.edit_distance(t, word), t) for t in terms]
        near = [(d, t) for d, t in near if d <= edits_allowed(t)]
        assert automaton.match(word) == (min(near)[::-1] if near else None)
    assert TermAutomaton([], ["loth"]).match("lothar") == ("loth", 0) and TermAutomaton([], []).match("x") is None


def test_context_tells_quotation_from_abuse():
    scorer = Scorer(Lexicon({"stupid": 0.99, "worthless": 0.99}, {}, {"stupid": 0.8}, frozenset({"stupor"})))
    meant, quoted, reported, spelled, clean, innocent = scorer.score(
        ["you are a stupid thing", 'the word "stupid" is rude', "as she wrote stupid there", "how stup1d this is", "a kind word", "in a stupor"]
    )
    assert meant > 0.9 and quoted < 0.5 and quoted < reported < 0.7 and spelled >= 0.7
    assert clean == innocent == scorer.score([None])[0] == scorer.score([""])[0] < 0.1
    assert scorer.score(['"stupid" and worthless, all of you'])[0] > 0.9


def test_toxicity_is_learned(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = learn_lexicon(docs, labels)
    got = toxicity(docs, lexicon).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert ((held.predicted == 1) == (held.toxic == 1)).mean() > 0.93
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]
    rows = [(1, None), (2, ""), (None, "x"), (2, "such a moron and idiot"), (3, "e " * 99999)]
    odd = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    scores = [(r.doc_id, r.predicted) for r in toxicity(odd, Lexicon({"idiot": 0.99}, {})).collect()]
    assert sorted(scores, key=repr) == sorted([(1, 0), (2, 0), (None, 0), (2, 1), (3, 0)], key=repr)
    kept = without_toxic(odd, Lexicon({"idiot": 0.99}, {}))
    assert kept.columns == odd.columns and kept.where("text like '%idiot%'").count() == 0
    assert toxicity(odd.limit(0), lexicon).count() == 0
    assert learn_lexicon(docs, labels.limit(0)) == Lexicon()


# --- quality ---
def test_quality_is_learned_from_positives(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = learn_quality(docs, labels)
    got = quality(docs, model).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert ((held.predicted == 1) == (held.quality == 1)).mean() > 0.9
    assert abs(model.prior - got.quality.mean()) < 0.15
    # No label of a bad text is looked at.
    blind = learn_quality(docs, labels.where("quality = 1"))
    assert np.allclose(blind.weights, model.weights) and blind.prior == model.prior
    odd = spark.createDataFrame([(1, None), (2, ""), (2, " "), (None, "x")], "doc_id long, text string")
    scores = [r.score for r in quality(odd, model).collect()]
    assert len(scores) == 4 and all(0 <= s <= 1 for s in scores)
    assert quality(odd.limit(0), model).count() == 0
    empty = learn_quality(docs.limit(0), labels)
    assert {r.score for r in quality(odd, empty).collect()} == {0.5}


def test_quality_reads_all_documents(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "text").toPandas()
    values = np.array([statistics(text) for text in rows.text])
    marked = labels.toPandas().set_index("doc_id").quality
    good = [zlib.crc32(str(i).encode()) % 3 != 1 and marked.get(i) == 1 for i in rows.doc_id]
    plain = fit(values[np.array(good)], values)
    # However the rows are dealt out, sums are exact, so two runs are one model.
    one, two = (learn_quality(docs.repartition(n), labels) for n in (3, 7))
    for name in ("mean", "spread", "weights", "prior"):
        assert np.array_equal(getattr(one, name), getattr(two, name))
        assert np.allclose(getattr(one, name), getattr(plain, name))
    known = describe(docs)
    assert known.count() == docs.count()
    assert quality(docs, one, known).exceptAll(quality(docs, two)).count() == 0


def test_risk_and_prior():
    rnd = np.random.default_rng(0)
    good, bad = rnd.normal(1.5, 1, (3000, 3)), rnd.normal(-1.5, 1, (3000, 3))
    mixed = np.vstack([rnd.normal(1.5, 1, (700, 3)), bad[:300]])
    model = fit(good, mixed)
    assert abs(model.prior - 0.7) < 0.1
    assert (model.score(good) > 0.5).mean() > 0.93 and (model.score(bad) < 0.5).mean() > 0.93
    assert estimate_prior(model.score(good), model.score(bad)) < 0.2
    # Where the corrected risk is negative, the step is the way back up.
    x = np.ones((4, 1))
    assert non_negative_risk(np.zeros(1), x, x, 1.5)[1] < 0
    # Moments give the mean of the losses, and the step is the slope of the risk.
    p, u, w = rnd.normal(0.5, 1, (50, 3)), rnd.normal(0, 1, (80, 3)), rnd.normal(0, 0.3, 3)
    miss, false, slope = non_negative_risk(w, p, Moments.of(u), 0.4)
    assert np.isclose(miss, 0.4 * np.mean((1 - p @ w) ** 2) / 4)
    assert np.isclose(false, np.mean((1 + u @ w) ** 2) / 4 - 0.4 * np.mean((1 + p @ w) ** 2) / 4)
    for k in range(3):
        ahead, behind = (sum(non_negative_risk(w + h * np.eye(3)[k], p, u, 0.4)[:2]) for h in (1e-5, -1e-5))
        assert np.isclose((ahead - behind) / 2e-5, slope[k], atol=1e-6)
    assert statistics(None) == statistics("  ") == [0.0] * len(statistics("a b"))
