"""Suffix arrays, repeated strings and periodic runs against plain searches."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np

from spanveil.llm import suffix_dedup
from spanveil.llm.common import table
from spanveil.llm.periodic_runs import WaveletTree, _search, periodic_runs
from spanveil.llm.suffix_dedup import anchors, gram_of, remove_repeats, segments
from spanveil.llm.suffix_groups import lyndon_groups, suffix_array


# --- suffix arrays ---
def _some_pieces(rnd: random.Random) -> list[int]:
    text = []
    for _ in range(rnd.randrange(1, 6)):
        letters, size = rnd.choice([1, 2, 3, 10]), rnd.randrange(0, 40)
        root = [rnd.randrange(1, letters + 1) for _ in range(rnd.choice([size, rnd.randrange(1, 8)]))]
        piece = (root * 40)[:size] if root else []
        text += (piece + [0]) * rnd.choice([1, 1, 2])
    return text


def test_suffix_array_against_sorting():
    rnd = random.Random(1)
    for _ in range(800):
        text = _some_pieces(rnd)
        ends = [i for i, c in enumerate(text) if c == 0]
        want = sorted(range(len(text)), key=lambda i: next((text[i : e + 1], e) for e in ends if e >= i))
        assert suffix_array(np.array(text, dtype=np.int64)).tolist() == want
    assert suffix_array(np.zeros(0, dtype=np.int64)).tolist() == []


def test_groups_are_lyndon_words():
    rnd = random.Random(2)
    for _ in range(200):
        text = _some_pieces(rnd)
        array, group, _, smaller = lyndon_groups(np.array(text, dtype=np.int64))
        words = {}
        for i in array.tolist():
            if text[i]:
                word = tuple(text[i : smaller[i]])
                assert all(word < word[k:] for k in range(1, len(word)))
                words.setdefault(int(group[i]), set()).add(word)
        assert all(len(w) == 1 for w in words.values())
        assert [w for g in sorted(words) for w in words[g]] == sorted(w for s in words.values() for w in s)


# --- repeated strings ---
def plain_repeats(rows: list[tuple], length: int) -> list[tuple]:
    seen, found = set(), []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone, own = bytearray(len(data)), set()
        for p in range(len(data) - length + 1):
            string = data[p : p + length]
            if string in seen or string in own:
                gone[p : p + length] = b"\1" * length
            own.add(string)
        seen |= own
        kept = bytes(x for x, y in zip(data, gone, strict=True) if not y)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        found.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=repr)


def _documents(rnd: random.Random, count: int) -> list[tuple]:
    def some(n: int) -> str:
        return "".join(rnd.choice("abcdefghij klmno") for _ in range(n))

    passages = [some(rnd.randrange(60, 400)) for _ in range(8)] + ["a" * 300, "ab" * 130, "é" * 120]
    rows: list[tuple] = []
    for i in range(count):
        text = ""
        for _ in range(rnd.randrange(0, 6)):
            p = rnd.choice(passages)
            text += rnd.choice([some(rnd.randrange(200)), p, p[rnd.randrange(len(p)) :]])
        if rows and rnd.random() < 0.3:
            text = rnd.choice(rows)[1] or ""
            k = rnd.randrange(len(text) + 1)
            text = text[:k] + rnd.choice(["", "Z"]) + text[k + rnd.choice([0, 1]) :]
        rows.append((3 * i, text, "k", 1, 2))
    return rows + [(5000, None, "k", 1, 2), (5001, "", "k", 1, 2), (7, some(100), "k", 1, 2), (None, passages[0] * 2, "k", 1, 2)]


def test_repeats_against_all_strings(spark):
    rnd = random.Random(4)
    for hot in (suffix_dedup.HOT, 0, 4):
        rows = _documents(rnd, 200)
        df = spark.createDataFrame(rows, "doc_id long, text string, k string, sub int, place int").repartition(6)
        got = remove_repeats(df, 100, hot)
        assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == plain_repeats(rows, 100)
    got = {r.doc_id: r for r in remove_repeats(df, 30).collect()}
    assert {i: tuple(r)[1:5] for i, r in got.items()} == {r[0]: r[1:] for r in plain_repeats(rows, 30)}
    assert all(r.n_removed == sum(s.end - s.start for s in r.spans) and r.n_spans == len(r.spans) for r in got.values())
    assert remove_repeats(df.limit(0)).collect() == []


def test_repeated_rows_are_one_document(spark):
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdefg") for _ in range(150))
    rows = [(1, text)] * 3 + [(2, text), (None, text), (None, text), (3, text + "x"), (3, text + "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in remove_repeats(df.repartition(3)).collect())
    assert got == [(0, 150), (0, 150), (1, 0), (1, 0), (1, 0), (2, 150), (3, 150), (3, 150)]


def test_long_documents_in_blocks(monkeypatch):
    rnd = random.Random(5)
    data = bytes(rnd.randrange(97, 110) for _ in range(3000))
    texts = [data, b"x" * 99, b"", data[:100], data[500:1200]]

    def strings() -> dict[tuple[int, int], int]:
        anchor, _, document, place, count, _ = segments(texts, 100)
        return {(d, p + k): a for a, d, p, n in zip(*(x.tolist() for x in (anchor, document, place, count)), strict=True) for k in range(n)}

    whole = strings()
    assert sorted(whole) == [(d, p) for d, t in enumerate(texts) for p in range(len(t) - 99)]
    monkeypatch.setattr(suffix_dedup, "BYTES_AT_ONCE", 700)
    assert strings() == whole
    grams, place = anchors(np.frombuffer(data, dtype=np.uint8), 100)
    assert all(p <= q <= p + 100 - gram_of(100) for p, q in enumerate(place.tolist()))


# --- runs ---
def plain_runs(words: list) -> list[tuple[int, int, int]]:
    found = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            size = i + q - s
            if i > s and size >= max(24, 3 * q):
                part = words[s : s + size]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    found.append((s, size, q))
            i += i == s
    return sorted(found, key=lambda r: (r[0], r[2]))


def _words(rnd: random.Random) -> list[bytes]:
    words: list[bytes] = []
    for _ in range(rnd.randrange(0, 6)):
        letters = rnd.choice([1, 2, 2, 3, 5, 50])
        root = [b"%d" % rnd.randrange(letters) for _ in range(rnd.randrange(1, 30))]
        if rnd.random() < 0.5:
            root = root * rnd.randrange(1, 8) + [b"%d" % rnd.randrange(letters)]
        part = root * rnd.randrange(1, 9)
        words += part[: len(part) - rnd.randrange(len(root))]
        if words and rnd.random() < 0.3:
            words[rnd.randrange(len(words))] = b"z"
    return words[:700]


def test_runs_against_all_periods():
    rnd = random.Random(6)
    for _ in range(250):
        docs = [_words(rnd) for _ in range(rnd.randrange(1, 6))]
        assert _search(docs) == [plain_runs(words) for words in docs]
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 700:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    words = [c.encode() for c in fibonacci[-1]]
    assert _search([words, words[:100] * 5]) == [plain_runs(words), plain_runs(words[:100] * 5)]


def test_wavelet_tree():
    rnd = np.random.default_rng(3)
    for n in (1, 5, 300):
        values = rnd.integers(0, 1000, n)
        tree = WaveletTree(values)
        for _ in range(50):
            low, high = sorted(rnd.integers(0, n + 1, 2).tolist())
            bound = int(rnd.integers(0, 1100))
            part = sorted(values[low:high].tolist())
            at = [np.array([x]) for x in (low, high)]
            assert tree.below(*at, np.array([bound]))[0] == sum(v < bound for v in part)
            assert tree.successor(*at, np.array([bound]))[0] == next((v for v in part if v >= bound), -1)
            if part:
                assert [tree.kth(*at, np.array([k]))[0] for k in range(len(part))] == part


def plain_document(doc_id: int | None, text: str | None) -> tuple:
    words = (text or "").encode().split()
    n, hashed = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and hashed % 10 == 0 and n:
        g = hashed // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    digests = "".join(f"{s},{size},{q}\n" for s, size, q in runs).encode(), b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2], *(hashlib.sha256(x).hexdigest() for x in digests))


def test_runs_of_documents(spark):
    rnd = random.Random(7)
    rows = [(i, b" ".join(_words(rnd)).decode()) for i in range(150)]
    rows += [(10, None), (10, ""), (None, "a " * 40), (11, " \n\t "), (12, "a b " * 30), (13, "x\x85y \x1f" * 30), (14, "A a " * 30)]
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, start int, period string").repartition(4)
    got = sorted((tuple(r) for r in periodic_runs(df, planted=True).collect()), key=repr)
    assert got == sorted((plain_document(*r) for r in rows), key=repr)
    assert periodic_runs(df.limit(0)).collect() == []
    df = table(spark, "/root/testdata/sf0.001", "documents")
    got = sorted(tuple(r) for r in periodic_runs(df, planted=True).collect())
    assert got == sorted(plain_document(r.doc_id, r.text) for r in df.collect())
