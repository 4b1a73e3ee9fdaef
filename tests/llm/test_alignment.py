"""Tokens of two tokenizers against a count of all links in plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from spanveil.llm.common import table
from spanveil.llm.token_alignment import align_tokens, byte_side, merged, pack, unpack

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["é", "ß", " ", "  ", "\n", "\t", "▁", "😀", "漢字", "ά", " ", "​", "<s>", "</s>", "<|endoftext|>", "<0x41>", "'s",
       "123", "1234567", "\x00", "﻿", "ﬁ", "Ⅷ", "é", "　", "\x85", "'LL", "\r\n", "a" * 50, "word", "the ", "ing", "x"]


def _pieces() -> tuple[Tokenizer, dict[int, bytes], sentencepiece.SentencePieceProcessor, list[bytes]]:
    own = Tokenizer.from_file(BYTES)
    own.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    a = {i: bytes(byte_of.get(c, 0) for c in t) for t, i in own.get_vocab().items()}
    b = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(b)]
    return own, a, model, b


def plain_alignment(texts: list[str | None]) -> list[tuple]:
    own, a, model, b = _pieces()
    rows, documents = [], Counter()
    for text in texts:
        ids_a = own.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = model.encode(text) if text else []
        whole = [(" " + text).encode()] * 2 if text else None
        if not text or [b"".join(a[i] for i in ids_a), b"".join(b[i] for i in ids_b)] != whole:
            rows.append(None)
            continue
        groups, x, y, left, right = [], [], [], 0, 0
        rest = list(ids_b)
        for i in ids_a:
            x.append(i)
            left += len(a[i])
            while right < left:
                y.append(rest.pop(0))
                right += len(b[y[-1]])
            if left == right:
                groups.append((x, y))
                x, y = [], []
        links = [(i, j) for x, y in groups for i in x for j in y]
        documents.update(set(links))
        rows.append((len(ids_a), len(ids_b), groups, links))
    best = defaultdict(int)
    for (i, _), n in documents.items():
        best[i] = max(best[i], n)
    found = []
    for row in rows:
        if row is None:
            found.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = row
        written = ";".join("|".join(",".join(map(str, ids)) for ids in group) for group in groups)
        found.append((n_a, n_b, len(groups), len(links), sum(documents[k] == best[k[0]] for k in links),
                      sum(documents[k] for k in links), hashlib.sha256(written.encode()).hexdigest()))
    return found


def test_alignment_of_odd_texts(spark):
    rnd = random.Random(3)
    texts = [None, "", "a", " ", "  ", "<unk>", "漢" * 300, "x" * 5000, " " * 3000, "same text", "same text"]
    texts += ["".join(rnd.choice(ODD) for _ in range(rnd.randrange(1, 30))) for _ in range(300)]
    rows = [(i, t, "x", 7, 1) for i, t in enumerate(texts)] + [(0, "same text", "y", 7, 2), (None, "same text", "y", 7, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, batch string, class int, n_a long")
    got = sorted(map(repr, (tuple(r) for r in align_tokens(df.repartition(5), BYTES, PIECES).collect())))
    want = plain_alignment([r[1] for r in rows])
    assert got == sorted(repr((r[0], *w)) for r, w in zip(rows, want, strict=True))
    assert align_tokens(df.limit(0), BYTES, PIECES).collect() == []


def test_alignment_of_documents(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id")
    rows = df.select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in align_tokens(df.repartition(7), BYTES, PIECES).collect())
    assert got == sorted((r[0], *w) for r, w in zip(rows, plain_alignment([r[1] for r in rows]), strict=True))


def test_fast_ids_are_those_of_the_tokenizer():
    own = Tokenizer.from_file(BYTES)
    own.encode_special_tokens = True
    points = [chr(c) for c in range(1, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b 1{c}2 {c}{c} '{c}s\n{c}" for c in points] + [" " * n + "x" for n in (1, 7, 1999, 2000, 50_000)]
    assert byte_side(BYTES).encode(texts) == [own.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_runs_are_merged():
    rnd = np.random.default_rng(2)
    for _ in range(50):
        runs = [np.unique(rnd.integers(0, 5000, rnd.integers(0, 3000)), return_counts=True) for _ in range(rnd.integers(0, 6))]
        every = Counter()
        for keys, counts in runs:
            every.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        got = [pair for keys, counts in merged(runs) for pair in zip(keys.tolist(), counts.tolist(), strict=True)]
        assert got == sorted(every.items())
    values = np.array([0, 1, 255, 256, 2**40], dtype=np.int64)
    assert unpack(pack(values)).tolist() == values.tolist() and len(unpack(pack(values[:0]))) == 0
